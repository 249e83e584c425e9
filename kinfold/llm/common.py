"""Shared parts of the corpus operators: words, written intermediates and joins on hot keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.operators.components import components
from kinfold.operators.joins import HOT_SHARE, hot_keys, hot_left_join, unused
from kinfold.session import clear_scratch, scratch, shared_dir, written

__all__ = ["HOT_SHARE", "clear_scratch", "components", "hot_keys", "hot_left_join", "scratch", "shared_dir", "unused", "words", "written"]

#: A word is a run of characters other than space and the five ASCII controls tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
