"""Errors of the engine."""


class ArgumentError(ValueError):
    """A value that the data model does not allow."""


class DimensionMismatch(ArgumentError):
    """Ranks or lengths that do not fit each other."""


class NotWriteable(PermissionError):
    """A write to something that was opened for reading."""
