"""Configuration to running ingestion: one reader, ordered transformers, one writer."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

import tributary
from tributary.config import Config, EnvSecrets, resolve_secrets
from tributary.errors import IngestionError, IngestionStartError
from tributary.registry import Context, Reader, Transformer, Writer, load

log = logging.getLogger(__name__)


def banner() -> str:
    return f"tributary {getattr(tributary, '__version__', '<unknown>')}"


def transformers(conf: Config, context: Context) -> list[Transformer]:
    """``component.transformer.id.<order>=<id>``, ``component.transformer.class.<id>``, ``transformer.<id>.*``; orders may be negative."""
    ids = {}
    for order, name in conf.subset("component.transformer.id").items():
        try:
            ids[int(order)] = name
        except ValueError:
            raise ValueError(f"transformer order '{order}' is not a whole number") from None
    if len(set(ids.values())) < len(ids):
        raise ValueError("transformer ids must be unique")
    out = []
    for _, name in sorted(ids.items()):
        cls = load(conf.require(f"component.transformer.class.{name}"), Transformer)
        own = conf.subset(f"transformer.{name}").with_retained(conf, cls.retained)
        cls.check(own)
        out.append(cls.from_config(own, context))
    return out


def build(conf: Config) -> tuple[Reader, list[Transformer], Writer]:
    context = Context()
    r, w = load(conf.require("component.reader"), Reader), load(conf.require("component.writer"), Writer)
    r.check(conf)
    w.check(conf)
    return r.from_config(conf, context), transformers(conf, context), w.from_config(conf, context)


def start(spark: SparkSession, reader: Reader, steps: list[Transformer], writer: Writer) -> StreamingQuery:
    try:
        df = reader.read(spark)
        for s in steps:
            df = s.transform(df)
        return writer.write(df)
    except Exception as e:
        raise IngestionStartError(f"the ingestion could not start: {e}") from e


def finish(query: StreamingQuery, method: str = "AwaitTermination", timeout_ms: int | None = None) -> None:
    """Wait as configured: until the query ends (or the timeout, which stops it), or until all input is processed."""
    try:
        if method.lower() == "processallavailable":
            query.processAllAvailable()
            query.stop()
        elif method.lower() == "awaittermination":
            if timeout_ms is None:
                query.awaitTermination()
            elif not query.awaitTermination(timeout_ms / 1000):
                query.stop()
        else:
            raise ValueError(f"'ingestor.spark.termination.method' can't be {method!r}")
    except ValueError:
        raise
    except Exception as e:
        raise IngestionError(f"the ingestion failed and a retry may write records twice: {e}") from e


def run(spark: SparkSession, conf: Config, secrets: dict | None = None) -> StreamingQuery:
    conf = resolve_secrets(conf, secrets if secrets is not None else {"env": EnvSecrets()})
    log.info("%s with %s", banner(), conf.redacted())
    try:
        parts = build(conf)
    except Exception as e:
        raise IngestionStartError(f"the ingestion could not be composed: {e}") from e
    query = start(spark, *parts)
    finish(query, conf.get("ingestor.spark.termination.method", "AwaitTermination"), conf.number("ingestor.spark.await.termination.timeout"))
    return query


def main(args: list[str]) -> None:
    """``main(["key=value", ...])`` or ``main(["path/to/file.properties"])``."""
    conf = Config.from_lines(args) if args and all("=" in a for a in args) else Config.from_file(*args)
    run(SparkSession.builder.appName(conf.get("ingestor.spark.app.name", "ingestion")).getOrCreate(), conf)


if __name__ == "__main__":
    main(sys.argv[1:])
