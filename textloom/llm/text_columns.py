"""Column expressions shared by the text operators. White space is ASCII 0x20 and 0x09-0x0D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Maximal runs of anything but white space; null and empty give no word."""
    return F.filter(F.split(text_or_empty(c), BLANK_RUN), lambda w: w != "")


def n_words(c: Column) -> Column:
    """Their number, without making the words: white-space runs between two of them, and one."""
    t = F.btrim(text_or_empty(c), F.lit(BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, BLANK_RUN))).cast("long")


def lower_az(c: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())
