"""Text functions built from the engine's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest part of a line that patterns see.
LINE_CHARS = 2000
#: What ends a line: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def identifiers(line: Column, stop: list[str]) -> Column:
    """Distinct identifiers on a line, without ``stop`` words, in order of appearance."""
    words = F.regexp_extract_all(line, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"))


def occurrences(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def net_depth(line: Column) -> Column:
    """Opening less closing brackets."""
    return occurrences(line, "([{") - occurrences(line, ")]}")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; empty text: 0."""
    letters = F.split(text, "")
    n = F.size(letters)

    def share(letter: Column) -> Column:
        p = F.size(F.filter(letters, lambda x: x == letter)) / n
        return p * F.log2(p)

    bits = F.aggregate(F.transform(F.array_distinct(letters), share), F.lit(0.0), lambda a, x: a - x)
    return F.when(F.char_length(text) == 0, F.lit(0.0)).otherwise(bits)


def is_placeholder(text: Column) -> Column:
    """Stand-in values: named as such, or one character over and over."""
    named = F.lower(text).rlike("example|changeme|placeholder|dummy|your[_-]?(key|token|secret)|xxxx")
    return named | text.rlike(r"^(.)\1*$")


def sole_call(line: Column, keywords: list[str]) -> Column:
    """The one function name called on a line, else ''."""
    names = F.array_distinct(F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\s*\("), F.lit(1)))
    names = F.array_except(names, F.array(*map(F.lit, keywords)))
    return F.when(F.size(names) == 1, F.element_at(names, 1)).otherwise(F.lit(""))


def package_name(name: Column) -> Column:
    """Runs of '-', '_' and '.' are one '-', letters are lower case."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def fingerprint(rule: Column, path: Column, code: Column) -> Column:
    """SHA-256 of rule, path and code joined by '|'."""
    return F.sha2(F.concat_ws("|", rule, path, code), 256)


def one_edit_apart(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance of exactly 1: one insertion, deletion, substitution or swap of neighbours."""
    place = F.sequence(F.lit(1), F.greatest(F.char_length(a) - 1, F.lit(1)))
    swapped = F.exists(
        place,
        lambda k: F.concat(a.substr(F.lit(1), k - 1), a.substr(k + 1, F.lit(1)), a.substr(k, F.lit(1)), a.substr(k + 2, F.char_length(a))) == b,
    )
    same_length = F.char_length(a) == F.char_length(b)
    return (a != b) & ((F.levenshtein(a, b) == 1) | (same_length & swapped))
