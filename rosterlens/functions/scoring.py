"""Scoring rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The proficiency titles and what they are worth.
TITLE_SCORES = {"Strong": 4, "Competent": 3, "Emerging": 2, "Novice": 1}
FREE_TITLE_SCORES = {"Positive": 3, "Derailing": 1}
PASS_MARK = 3


def passed(score: Column) -> Column:
    """1 from the pass mark up, 0 below it, NULL without a score."""
    return F.when(score.isNotNull(), (score >= PASS_MARK).cast("int"))


def proficiency(title: Column, kind: Column) -> Column:
    """Points of a title. No title counts as the lowest level, an unknown one by its kind."""
    points = F.when(title.isNull(), 1)
    for name, value in TITLE_SCORES.items():
        points = points.when(title == name, value)
    for name, value in FREE_TITLE_SCORES.items():
        points = points.when(kind == name, value)
    return points.otherwise(0)


def session_status(completed: Column, started_at: Column) -> Column:
    return (
        F.when(completed == 1, "COMPLETED")
        .when(started_at.isNotNull(), "IN_PROGRESS")
        .otherwise("PENDING")
    )


def is_positive(kind: Column) -> Column:
    """1 for Positive, else 0; an unknown kind counts as 0."""
    return F.coalesce((kind == "Positive").cast("int"), F.lit(0))
