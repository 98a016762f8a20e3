"""Errors that name what was wrong."""


class EngineError(Exception):
    """Base of this engine's errors."""


class UnsupportedQueryError(EngineError):
    """The SQL is malformed, or asks for something the engine does not answer."""


class ColumnNotFoundError(EngineError):
    """A name that the input does not have."""

    def __init__(self, name: str, have: tuple[str, ...]):
        super().__init__(f"column {name!r} not found; there are {list(have)}")


class SourceError(EngineError):
    """An input that cannot be read as a table."""
