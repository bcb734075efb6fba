"""Errors; all are ValueErrors, so callers may catch them together."""


class DemeanError(ValueError):
    """Base of all errors of this library."""


class EmptyObservations(DemeanError):
    """There are no observations."""


class InvalidInput(DemeanError):
    """A column, weight or null that can't be used."""


class SingularDiagonal(DemeanError):
    """A level to eliminate has no weight."""

    def __init__(self, block: str, index: int):
        super().__init__(f"level {index} of block {block} has zero weight")
        self.block, self.index = block, index


class ConfigError(DemeanError):
    """Settings that don't go together."""


class BuildError(DemeanError):
    """A preconditioner that can't be built or doesn't fit the design."""


class ApplyError(DemeanError):
    """A local solve or preconditioner application failed."""


class TooLarge(DemeanError):
    """An aggregate exceeds the bound for the driver; use the Implicit operator, without a preconditioner built from pairs."""
