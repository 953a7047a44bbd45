"""Exceptions of the coverage engine."""


class CoverageError(Exception):
    """Base class."""


class InvalidRequestError(CoverageError, ValueError):
    """A request that cannot be planned: a bad box, grid, chunk, resolution, CRS or format."""


class UnknownServiceError(CoverageError, ValueError):
    """No service is registered for the type that was asked for or detected."""


class DecodeError(CoverageError, ValueError):
    """Bytes that are no image of the expected format."""


class MetadataError(CoverageError, ValueError):
    """Service metadata that is malformed or lacks what is required."""
