"""Exceptions of the engine."""


class IngestionError(Exception):
    """A started ingestion failed; a retry may write records twice unless the sink is idempotent."""


class IngestionStartError(IngestionError):
    """An ingestion could not be composed or started; nothing was written."""


class IncompatibleSchemaError(Exception):
    """A schema has no counterpart in the other type system."""
