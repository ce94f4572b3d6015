"""Word splitting shared by the text operators: a word is a run without ASCII white space."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: For Python tasks.
WORD_RE = re.compile(WORD)
LOWER_ASCII = str.maketrans(UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(text, UPPER, LOWER)


def is_fold(doc_id: Column, of: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == fold, F.lit(False))
