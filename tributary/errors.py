"""What the engine raises on its own account."""


class TributaryError(Exception):
    """The base of them all."""


class LimitExceeded(TributaryError, ValueError):
    """An interactive call or a folder beyond its configured bounds."""


class InvalidScripts(TributaryError):
    """Statements that break a rule, where a caller asked for none."""


class GenerationFailed(TributaryError):
    """The hook that makes further statements gave up."""
