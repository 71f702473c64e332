"""Errors of the library."""


class TerraceError(Exception):
    """Base of all."""


class ConfigError(TerraceError, ValueError):
    """A configuration that cannot be right."""


class PlanStale(TerraceError):
    """The catalogue is no longer the one that the plan was made from."""


class LockHeld(TerraceError):
    """Another writer holds the table."""


class HookFailed(TerraceError):
    """A hook before an operation refused it, or did not run."""
