"""Secret scan: keywords by Aho-Corasick, patterns anchored at the hits, then checksums inside the values.

The keyword automaton reads each text once. A pattern is only tried where its keyword stands, so texts
without keywords cost one pass. Runs of hexadecimal digits have no keyword and are looked for directly.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from sievekit.llm.common import map_texts

BASE = ("assign", "access", "hex")
#: Kinds whose values carry a checksum or structure of their own.
ADDED = ("github", "npm", "jwt", "pem")
KINDS = BASE + ADDED

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ANCHORED = {
    "assign": (_ASSIGN, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    "access": (_ACCESS, ("akia",)),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    "npm": (re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), ("npm_",)),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"), ("eyj",)),
    "pem": (re.compile(r"-----BEGIN ([A-Z ]{0,32}PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----"), ("-----begin",)),
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_UPPER = {k: k + 32 for k in range(65, 91)}


def crc_suffix(value: str) -> bool:
    """Is the last part of six characters the CRC-32 of the thirty before it, in base 62?"""
    body, check = value[4:34], value[34:]
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = _DIGITS[k] + out
    return out.rjust(6, "0") == check


def _json(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # nested too deep: no token has that
        return None


def _der(body: str) -> bool:
    """Does the block decode to one ASN.1 sequence whose length field fits?"""
    try:
        data = base64.b64decode("".join(body.split()), validate=True)
    except ValueError:
        return False
    if len(data) < 4 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return data[1] + 2 == len(data)
    size = data[1] & 0x7F
    return 0 < size <= 4 and int.from_bytes(data[2 : 2 + size], "big") + 2 + size == len(data)


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 12
    if kind == "access":
        return len(match[0]) >= 18
    if kind == "jwt":
        head = _json(match[1])
        return isinstance(head, dict) and "alg" in head and isinstance(_json(match[2]), dict)
    return _der(match[2]) if kind == "pem" else crc_suffix(match[0])


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (_, words) in _ANCHORED.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _lowered(text: str) -> str:
    """Lower case with every place kept."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_UPPER)


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping within a kind; a match that fails its test is used up."""
    found, reached = [], dict.fromkeys(_ANCHORED, 0)
    for last, (kind, size) in words.iter(_lowered(text)):
        start = last + 1 - size
        if start >= reached[kind] and (match := _ANCHORED[kind][0].match(text, start)):
            reached[kind] = match.end()
            if _valid(kind, match):
                found.append((start, match.end(), kind))
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and ``found``, an array of (start, end, kind) in code points, end exclusive.

    A null or empty text has no findings. Whole texts are scanned, in time linear in their length. Matches of one kind
    don't overlap; those that begin at one place come in the order of KINDS. A key block without an end, and a token
    whose parts aren't JSON or are nested beyond the parser's depth, is no finding. Repeated rows give repeated rows;
    other columns aren't read, whatever their names; an empty table gives an empty result.
    """

    def make():
        words = automaton()

        def apply(ids: list, texts: list[str]) -> dict[str, list]:
            return {"found": [[{"start": a, "end": b, "kind": k} for a, b, k in scan(text, words)] for text in texts]}

        return apply

    return map_texts(docs, make, "found array<struct<start: int, end: int, kind: string>>", id_col, text_col)
