"""Text cleaning, all built from Spark's own string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and the entities the cleaner deletes.
WHITE_SPACE = " \t\n\r\f\x0b"
DELETED_ENTITIES = ["nbsp", "rsquo", "rdquo", "ldquo", "lsquo", "ndash", "hellip"]

_MARKUP = "<[^>]*>|&(?:" + "|".join(DELETED_ENTITIES) + ");"
_PARAGRAPH = "</?p[^>]*>"


def trim_ws(text: Column) -> Column:
    """Strip white space of every kind; Spark's own trim strips blanks only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def not_blank(text: Column) -> Column:
    return F.length(trim_ws(text)) > 0


def html_clean(text: Column) -> Column:
    """Trim, then delete tags and the listed entities. Blanks inside tags survive."""
    return F.regexp_replace(trim_ws(text), _MARKUP, "")


def strip_p(text: Column) -> Column:
    """Delete tags that begin with p, then trim."""
    return trim_ws(F.regexp_replace(text, _PARAGRAPH, ""))


def parse_day(text: Column) -> Column:
    """Year-month-day text to a timestamp without zone; bad text fails under ANSI mode."""
    return F.to_timestamp_ntz(trim_ws(text), F.lit("y-M-d"))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores. Short ones are still in."""
    return F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_\\s]", " "), "\\s+")


def tokens(text: Column) -> Column:
    """The words longer than two characters, in order, repeats kept."""
    return F.filter(words(text), lambda w: F.length(w) > 2)
