"""Defects put into recordings on purpose, and how well rules find them."""

from .recipes import RECIPES, Recipe, apply_recipe
from .scoring import outcomes, rates, wilson

__all__ = ["RECIPES", "Recipe", "apply_recipe", "outcomes", "rates", "wilson"]
