"""Categories of errors that callers can tell apart."""


class EngineError(Exception):
    """Any error of this library that isn't a bug."""


class InvalidArgument(EngineError, ValueError):
    """An argument can't mean anything: reversed bounds, a negative timestamp, a blank name."""


class NotFound(EngineError, LookupError):
    """A record, table, partition or node isn't there."""


class NotReady(EngineError):
    """The table isn't ready."""


class Conflict(EngineError):
    """Something else holds a lease, or the ring has changed."""


class ResourceExhausted(EngineError):
    """Too much is waiting to be written."""
