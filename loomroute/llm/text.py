"""Column expressions on text shared by the operators of this folder."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of ASCII characters that are neither letters nor digits (upper case is lowered before).
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, every other character kept. Pure ASCII takes the byte-wise path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def padded_words(c: Column) -> Column:
    """Lower-cased words between an empty first and an empty last element; null counts as empty text.

    The word at index i >= 1 is the i-th word, and the last index is the number of words plus one.
    """
    return F.split(F.concat(F.lit(" "), ascii_lower(F.coalesce(c, F.lit(""))), F.lit(" ")), WORD_BREAK, -1)
