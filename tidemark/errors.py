"""Errors raised while a job is being put together."""


class SchemaError(ValueError):
    """The input does not carry what the operator needs."""


class IdentificationError(ValueError):
    """The data cannot support the requested estimate."""


class ExtrapolationError(ValueError):
    """A candidate lies outside what the fit has seen."""
