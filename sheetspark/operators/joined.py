"""Joins of tables that both grow with the pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def merged(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join that sorts and merges both sides, and never sends one whole to the driver and to all tasks.

    Spark's estimate of a table knows nothing of the pixels that an id is exploded into, nor how far a file of runs or pixels was
    packed; it takes such tables for small and would broadcast millions of rows.
    """
    return left.join(right.hint("merge"), on, how)


def beside(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of many rows a picture (pixels, lines) with a small row a picture.

    A task hashes the rows of its own share of the pictures; the many are neither sorted nor, where they are dealt by picture already,
    moved, and nothing goes whole to the driver.
    """
    return left.join(right.hint("shuffle_hash"), on, how)
