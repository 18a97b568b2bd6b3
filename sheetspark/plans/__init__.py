"""Recipes: operators in a fixed order."""
