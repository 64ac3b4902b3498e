"""One registered query per operator, over the driver's tables."""

from zonespark.catalog import detection, exchange, export, files, layouts, library, reuse, zones  # noqa: F401
from zonespark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
