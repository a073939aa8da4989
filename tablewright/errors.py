"""Errors raised while a plan is being built, before any job starts."""


class ToolError(ValueError):
    """A request names something that does not exist or is not allowed."""
