"""What a query's checkpoint and a file sink's log say. Both are small text files: a ``v1`` line, then JSON lines."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import SparkSession

from tributary import fs


def _numbered(spark: SparkSession, folder: str) -> dict[int, str]:
    return {int(n): f for f in fs.files(spark, folder, False) if (n := f.rsplit("/", 1)[-1]).isdigit()}


def _offsets(text: str) -> dict:
    lines = text.strip().split("\n")[2:]  # version, metadata, then one line a source
    if len(lines) != 1:
        raise ValueError(f"the checkpoint must have one source, not {len(lines)}")
    return json.loads(lines[0])


def latest_offsets(spark: SparkSession, checkpoint: str) -> tuple[int, dict] | None:
    """Batch and offsets of the last planned batch."""
    log = _numbered(spark, f"{checkpoint}/offsets")
    return (max(log), _offsets(fs.read_text(spark, log[max(log)]))) if log else None


def latest_committed_offsets(spark: SparkSession, checkpoint: str) -> tuple[int, dict] | None:
    """Batch and offsets of the last committed batch; a commit without offsets is an error."""
    commits = _numbered(spark, f"{checkpoint}/commits")
    if not commits:
        return None
    log = _numbered(spark, f"{checkpoint}/offsets")
    if max(commits) not in log:
        raise ValueError(f"batch {max(commits)} is committed but has no offsets")
    return max(commits), _offsets(fs.read_text(spark, log[max(commits)]))


def has_sink_log(spark: SparkSession, root: str) -> bool:
    return not fs.is_empty(spark, f"{root}/_spark_metadata")


def plain(path: str) -> str:
    """A path without its scheme, decoded, so that listings and logs compare."""
    return unquote(re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?", "", path))


def committed_files(spark: SparkSession, root: str) -> set[str]:
    """Files that a file sink has committed: the last compaction and what followed it."""
    logs = {}
    for f in fs.files(spark, f"{root}/_spark_metadata", False):
        if m := re.fullmatch(r"(\d+)(\.compact)?", f.rsplit("/", 1)[-1]):
            logs[int(m[1])] = (f, bool(m[2]))
    compact = max((b for b, (_, c) in logs.items() if c), default=-1)
    out: set[str] = set()
    for b in sorted(b for b in logs if b >= compact):
        for line in fs.read_text(spark, logs[b][0]).strip().split("\n")[1:]:
            entry = json.loads(line)
            path = plain(entry["path"])
            out.discard(path) if entry.get("action") == "delete" else out.add(path)
    return out


def uncommitted_files(spark: SparkSession, root: str) -> set[str]:
    """Parquet files on disk that the sink's log doesn't list: traces of a partial write."""
    on_disk = {p for p in map(plain, fs.files(spark, root)) if p.endswith(".parquet") and "/_spark_metadata/" not in p}
    return on_disk - committed_files(spark, root)
