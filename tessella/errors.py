"""Errors of the library."""


class TessellaError(Exception):
    """Base of all of them."""


class MissingExtraError(TessellaError, ImportError):
    """An optional package is not installed."""


class FormatError(TessellaError, ValueError):
    """A table, manifest or blob breaks the format."""


class PartitioningError(FormatError):
    """A vertex lies outside the cell that is to hold it."""


class UnfinishedCollectionError(TessellaError, FileNotFoundError):
    """No manifest: the collection was not finished or is not there."""
