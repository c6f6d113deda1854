"""All registered queries; importing the package fills the registry."""

from loadcurve.catalog import ingest, modelling, relational, scalars  # noqa: F401
from loadcurve.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
