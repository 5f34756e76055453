"""The rules by id. Each builds a DataFrame of what it finds in a recording."""

from . import manifest, messages, numeric, population, temporal, video  # noqa: F401 - they register their rules
from .base import REGISTRY, Found, Rule, rules_for

__all__ = ["REGISTRY", "Found", "Rule", "rules_for"]
