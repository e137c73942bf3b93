"""Schema registry clients and subjects."""

from __future__ import annotations

import base64
import json
import urllib.request
from pathlib import Path

from tributary.config import Config


def subject(strategy: str, topic: str | None, name: str | None, namespace: str | None, is_key: bool) -> str:
    """The subject under ``topic.name``, ``record.name`` or ``topic.record.name``."""
    record = f"{namespace}.{name}" if namespace else name
    if strategy == "topic.name":
        return f"{topic}-{'key' if is_key else 'value'}"
    if strategy in ("record.name", "topic.record.name"):
        if not name:
            raise ValueError(f"strategy '{strategy}' needs a record name")
        return record if strategy == "record.name" else f"{topic}-{record}"
    raise ValueError(f"unknown naming strategy '{strategy}'")


class FileRegistry:
    """Schemas in a folder: ``ids/<id>.json`` and ``subjects/<subject>.json``, which lists ids."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def register(self, subject_: str, schema) -> int:
        text = json.dumps(schema, sort_keys=True)
        (self.folder / "ids").mkdir(parents=True, exist_ok=True)
        (self.folder / "subjects").mkdir(exist_ok=True)
        ids = {f.read_text(): int(f.stem) for f in (self.folder / "ids").glob("*.json")}
        n = ids.get(text) or max(ids.values(), default=0) + 1
        (self.folder / "ids" / f"{n}.json").write_text(text)
        at = self.folder / "subjects" / f"{subject_}.json"
        known = json.loads(at.read_text()) if at.exists() else []
        if n not in known:
            at.write_text(json.dumps([*known, n]))
        return n

    def by_id(self, n: int):
        return json.loads((self.folder / "ids" / f"{n}.json").read_text())

    def latest(self, subject_: str) -> tuple[int, object]:
        at = self.folder / "subjects" / f"{subject_}.json"
        if not at.exists():
            raise KeyError(f"no schema under subject '{subject_}'")
        n = json.loads(at.read_text())[-1]
        return n, self.by_id(n)


class HttpRegistry:
    """A client of the registry's public REST interface.

    Options: ``basic.auth.user.info`` (where none is given), ``bearer.auth.token``, ``request.header.<name>`` and
    ``http.read.timeout.ms``; others are kept and have no meaning here.
    """

    def __init__(self, url: str, user_info: str | None = None, options: dict[str, str] | None = None):
        self.url, self.options = url.rstrip("/"), dict(options or {})
        self.user_info = user_info or self.options.get("basic.auth.user.info")

    def _call(self, path: str, body: dict | None = None) -> dict:
        head = {"Content-Type": "application/vnd.schemaregistry.v1+json"}
        head |= {k.removeprefix("request.header."): v for k, v in self.options.items() if k.startswith("request.header.")}
        if self.user_info:
            head["Authorization"] = "Basic " + base64.b64encode(self.user_info.encode()).decode()
        elif token := self.options.get("bearer.auth.token"):
            head["Authorization"] = f"Bearer {token}"
        wait = int(self.options.get("http.read.timeout.ms", 30_000)) / 1000
        with urllib.request.urlopen(urllib.request.Request(self.url + path, json.dumps(body).encode() if body else None, head), timeout=wait) as r:
            return json.load(r)

    def register(self, subject_: str, schema) -> int:
        return self._call(f"/subjects/{subject_}/versions", {"schema": json.dumps(schema)})["id"]

    def by_id(self, n: int):
        return json.loads(self._call(f"/schemas/ids/{n}")["schema"])

    def latest(self, subject_: str) -> tuple[int, object]:
        got = self._call(f"/subjects/{subject_}/versions/latest")
        return got["id"], json.loads(got["schema"])


def client(conf: Config):
    """From ``schema.registry.url`` (``file:<folder>`` or http), ``schema.registry.basic.auth.user.info.file`` and
    ``schema.registry.options.*``, which are passed on."""
    url = conf.require("schema.registry.url")
    if url.startswith("file:"):
        return FileRegistry("/" + url.removeprefix("file:").lstrip("/"))
    info = None
    if path := conf.get("schema.registry.basic.auth.user.info.file"):
        lines = Path(path).read_text().splitlines()
        if not lines or not lines[0].strip():
            raise ValueError(f"{path} is empty")
        info = lines[0].strip()
    return HttpRegistry(url, info, dict(conf.subset("schema.registry.options")))
