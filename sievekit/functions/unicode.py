"""Text hidden in characters that nobody sees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width and bidirectional controls, soft hyphen, byte order mark.
INVISIBLE = "[\\x{00AD}\\x{061C}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}]"
TAGS = "[\\x{E0020}-\\x{E007E}]"


def visible(text: Column) -> Column:
    """Without invisible characters and tag characters."""
    return F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), "[\\x{E0000}-\\x{E007F}]", "")


def decoded(text: Column) -> Column:
    """Invisible characters gone, tag characters as the letters that they stand for."""
    plain = F.regexp_replace(text, INVISIBLE, "")
    tags = F.regexp_extract_all(plain, F.lit(TAGS), F.lit(0))
    # A tag is F3 A0 80 80 + k in UTF-8, two bytes of which change.
    return F.aggregate(
        F.array_distinct(tags),
        plain,
        lambda out, t: F.replace(out, t, F.chr((F.conv(F.substring(F.hex(F.encode(t, "UTF-8")), 5, 2), 16, 10).cast("int") % 64) * 64 + F.conv(F.substring(F.hex(F.encode(t, "UTF-8")), 7, 2), 16, 10).cast("int") % 64)),
    )


def smuggled(text: Column, phrases: str) -> Column:
    """Does a phrase show only after decoding?"""
    return decoded(text).rlike(phrases) & ~text.rlike(phrases)
