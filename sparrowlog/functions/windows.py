"""Ranks and scalings inside a list (an impression's candidates)."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def average_rank(score: Column, *part: str) -> Column:
    """Ascending rank from 1; ties share the mean of their places."""
    ties = F.count("*").over(Window.partitionBy(*part, score))
    return F.rank().over(Window.partitionBy(*part).orderBy(score)) + (ties - 1) / F.lit(2.0)


def ordinal_rank(score: Column, pos: Column, *part: str) -> Column:
    """Descending place from 1; ties keep the order of the list."""
    return F.row_number().over(Window.partitionBy(*part).orderBy(score.desc(), pos))


def scaled_rank(score: Column, *part: str) -> Column:
    """Average rank scaled to 0..1; a list of one gets 0.5."""
    n = F.count("*").over(Window.partitionBy(*part))
    return F.when(n == 1, F.lit(0.5)).otherwise((average_rank(score, *part) - 1) / (n - 1))


def zscore(score: Column, *part: str) -> Column:
    """By the list's mean and population deviation; 0 where the list is flat."""
    w = Window.partitionBy(*part)
    spread = F.stddev_pop(score).over(w)
    return F.when(spread < 1e-12, F.lit(0.0)).otherwise((score - F.avg(score).over(w)) / spread)


def over_max(score: Column, *part: str) -> Column:
    return score / (F.max(score).over(Window.partitionBy(*part)) + 1)
