"""Errors by cause."""


class EngineError(Exception):
    """Any error of the engine."""


class InvalidConfigError(EngineError):
    """A setting or a catalog entry is not valid."""


class PlanningError(EngineError):
    """A query can't be planned: unknown names, wrong types, missing parameters."""


class ExecutionError(EngineError):
    """A query failed while it ran."""


class StorageError(EngineError):
    """Reading or writing failed."""


class UnsupportedError(EngineError):
    """What is asked for does not exist."""
