"""All named queries; importing the modules fills the registry."""

from lapspark.plans import race, telemetry, quality, classifier  # noqa: F401
from lapspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
