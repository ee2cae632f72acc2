"""Character classes that Java's patterns and Spark's ``trim`` don't know: blanks beyond ASCII, and pictographs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.config import BLANKS, PICTOGRAPHS

#: The inside of a character class of all blanks, and of one of all pictographs.
BLANK = "".join(rf"\x{{{ord(c):X}}}" for c in BLANKS)
PICTOGRAPH = re.sub(r"([0-9A-F]+)\s*", r"\\x{\1}", PICTOGRAPHS.strip())


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{BLANK}]+", "")


def blanks_as_one(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return trim(F.regexp_replace(text, f"[{BLANK}]+", " "))
