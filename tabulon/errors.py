"""Errors that callers can rely on."""


class EngineError(ValueError):
    """Base of all: invalid SQL, types that do not fit, ambiguous names."""


class UnsupportedOperationError(EngineError):
    """A statement other than SELECT, or an operation that the engine does not offer."""


class UnsupportedOperatorError(EngineError):
    """An operator that the engine does not offer, or not for these types."""


class UnsupportedLiteralError(EngineError):
    """Something that cannot stand as a constant or condition where it does."""


class NoSuchTableError(EngineError):
    """A table name that is not registered."""


class NoSuchColumnError(EngineError):
    """A column name that no table in scope has."""


class DuplicateTableError(EngineError):
    """A table of that name is registered already."""


class TableSizeMismatch(EngineError):
    """Aggregates beside plain columns without GROUP BY."""


def translated(error: Exception) -> Exception:
    """The engine's error for one of Spark's, or the same error."""
    kind = getattr(error, "getCondition", lambda: None)() or ""
    for start, cls in (("TABLE_OR_VIEW_NOT_FOUND", NoSuchTableError), ("UNRESOLVED_COLUMN", NoSuchColumnError), ("MISSING_GROUP_BY", TableSizeMismatch), ("MISSING_AGGREGATION", TableSizeMismatch), ("PARSE_", EngineError), ("AMBIGUOUS_", EngineError), ("DATATYPE_MISMATCH", EngineError), ("CAST_INVALID_INPUT", EngineError), ("CAST_OVERFLOW", EngineError), ("INCOMPATIBLE_", EngineError), ("NUM_COLUMNS_MISMATCH", EngineError), ("SCALAR_SUBQUERY_TOO_MANY_ROWS", EngineError), ("DIVIDE_BY_ZERO", EngineError), ("UNSUPPORTED_", UnsupportedOperationError)):
        if kind.startswith(start):
            return cls(str(error).split("\n")[0])
    return error
