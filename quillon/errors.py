"""The one exception of the dialect."""


class DialectError(ValueError):
    """A statement that can't be parsed, bound or run; its text is the message to show."""
