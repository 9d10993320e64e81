"""Named queries. Importing this package registers all of them."""

from chunkloom.plans import codecs, dedup, maintenance, physical, streams  # noqa: F401
from chunkloom.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
