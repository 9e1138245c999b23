"""Benchmark passages in documents, also with other numbers, names or units put in.

Texts become templates: numbers and units turn into typed placeholders, other words lose case and edge punctuation.
Capitalised words may be names or not, wherever they stand, so each window of words is hashed under two readings, with
names as placeholders and with names as plain words, and joined with the benchmark's windows of the same reading.
What stood in the placeholders decides in the end: along one alignment, equal values of the item have to be equal in
the document; windows that disagree with what most windows say don't count. A document holds an item when the other
windows cover at least half of the item's.

What templates can't tell is compared word by word: windows that are mostly placeholders under both readings, and
items of very few words, which have to stand alone on a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import cut, worker_table

WINDOW = 8
#: Items of fewer words stand in ordinary text by chance; they are looked for as whole lines.
LEAST_WORDS = 5
#: A window needs so many words outside placeholders, in eighths of its words.
LEAST_PLAIN = 4
SHARE = 0.5
#: Bits of the filter of window hashes that every task holds: 2 MB.
BITS = 1 << 24
CACHE_WORDS = 300_000
#: Characters of the words that are remembered from one text to the next.
CACHE_CHARS = 8_000_000

_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?")
_NAME = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:'s)?")
#: Written units.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters litre litres"
    " second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros"
    " percent degree degrees meter meters metre metres gram grams kilometer kilometers kilogram kilograms".split()
)
_EDGE = ".,;:!?\"'()[]{}<>|%&*#$"
_MARKS = {"number": 1, "name": 2, "unit": 3}


#: Readings of a window: names as placeholders, names as plain words, everything literally, a whole line literally.
NAMED, PLAIN, LITERAL, LINE = range(4)


class Vocabulary:
    """Words met by a task, each with its literal hash, kind of placeholder (0: none) and whether it looks like a name."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.chars = 0
        self.rows = np.zeros((1024, 3), dtype=np.uint64)

    def _row(self, token: str) -> tuple[int, int, int]:
        core = token.strip(_EDGE)
        kind = _MARKS["number"] if _NUMBER.fullmatch(core) else _MARKS["unit"] if core.lower() in UNITS else 0
        return xxhash.xxh3_64_intdigest(core.lower().encode()), kind, not kind and bool(_NAME.fullmatch(core))

    def numbers(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            known.clear()
            self.chars = 0
        out = [known.get(t, -1) for t in tokens]
        for k, n in enumerate(out):
            if n < 0:
                if (n := known.get(tokens[k], -1)) < 0:
                    n = known[tokens[k]] = len(known)
                    self.chars += len(tokens[k])
                    if n >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[n] = self._row(tokens[k])
                out[k] = n
        return np.array(out, dtype=np.int64)

    def of(self, tokens: list[str]) -> np.ndarray:
        numbers = self.numbers(tokens)  # may replace the rows
        return self.rows[numbers]


_BASE = 0x9FB21C651E98DF25
_powers = np.zeros((2, 0), dtype=np.uint64)


def _hashed(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` words: differences of one running sum, whatever the size."""
    global _powers
    if _powers.shape[1] < len(words):
        n = max(1 << 14, 2 * len(words))
        both = np.full((2, n), 1, dtype=np.uint64)
        both[0, 1:], both[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        _powers = np.cumprod(both, axis=1, dtype=np.uint64)
    n = len(words) - size + 1
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _powers[1, : len(words)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _powers[0, :n] + np.uint64(size)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Template:
    """A text's words as literal hashes, placeholder kinds and looks of names."""

    def __init__(self, text: str, vocabulary: Vocabulary):
        self.text, self.tokens = text, text.split()
        rows = vocabulary.of(self.tokens)
        self.literal, self.kind, self.name = rows[:, 0], rows[:, 1], rows[:, 2] == 1

    def windows(self, size: int, reading: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``size`` words that a reading tells apart: those with enough plain words, or any."""
        if len(self.tokens) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        if reading == LITERAL:
            h = _hashed(self.literal, size)
            return np.arange(len(h)), h
        slot = self._slot(reading)
        word = np.where(self.kind > 0, self.kind, self.literal)
        if reading == NAMED:
            word = np.where(self.name, np.uint64(_MARKS["name"]), word)
        sums = np.concatenate([[0], np.cumsum(slot)])
        at = np.flatnonzero((size - (sums[size:] - sums[:-size])) * 8 >= LEAST_PLAIN * size)
        if not len(at):
            return at, np.zeros(0, dtype=np.uint64)
        return at, _hashed(word, size)[at] + np.uint64(reading)

    def _slot(self, reading: int) -> np.ndarray:
        return (self.kind > 0) | self.name if reading == NAMED else self.kind > 0

    def slots(self, at: int, size: int, reading: int) -> list[str]:
        """What stands in the placeholders of a window, lower case."""
        if reading >= LITERAL:
            return []
        slot = self._slot(reading)
        return [self.tokens[k].strip(_EDGE).lower() for k in range(at, at + size) if slot[k]]

    def lines(self, sizes: set[int], vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.uint64]]:
        """Number, number of words and hash of the lines that have one of these numbers of words."""
        for number, line in enumerate(self.text.splitlines()):
            words = line.split(None, max(sizes))
            if len(words) in sizes:
                yield number, len(words), _hashed(vocabulary.of(words)[:, 0], len(words))[0]


_WINDOWS = "id long, place int, size int, reading int, hash long, slots array<string>"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=["id", "place", "size", "reading", "hash", "slots"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary()
    for batch in batches:
        found = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            template = Template(text or "", vocabulary)
            size = min(WINDOW, len(template.tokens))
            if 0 < size < LEAST_WORDS:
                found.append((key, 0, size, LINE, int(_hashed(template.literal, size)[0].view(np.int64)), []))
            elif size:
                told = np.zeros(len(template.tokens) - size + 1, dtype=bool)
                for reading in (NAMED, PLAIN, LITERAL):
                    at, h = template.windows(size, reading)
                    for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        # Literally only where no template can tell.
                        if reading != LITERAL or not told[p]:
                            found.append((key, p, size, reading, x, template.slots(p, size, reading)))
                    told[at] = True
        yield _rows(found)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE
) -> DataFrame:
    """One row for each document and benchmark item that it holds: id, item, ``n_windows`` of the item, ``covered``, ``share``, ``literal``.

    ``literal``: every placeholder of the windows that count holds what it holds in the item. Whole texts are searched,
    however long; a task only sends on the windows whose hash may be one of the benchmark's. Null and empty texts hold
    nothing and are held by nothing; rows without an id take no part; repeated rows count once. If two values are equally
    frequent for one placeholder, the greater one in the order of strings counts. Other columns aren't read, whatever
    their names. If either table is empty, so is the result.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).filter("id is not null and text is not null")
    items = cut(items.mapInArrow(_item_windows, _WINDOWS).distinct())
    wanted = sorted((r.size_, r.reading) for r in items.select(F.col("size").alias("size_"), "reading").distinct().collect())  # 4 x WINDOW of them at most
    held = np.zeros(BITS // 8, dtype=np.uint8)
    own_bit = items.select((F.col("hash").bitwiseAND(F.lit(BITS - 1))).alias("bit"))
    own_bit = own_bit.select(F.bitmap_bucket_number(F.col("bit") + 1).alias("k"), F.bitmap_bit_position(F.col("bit") + 1).alias("p"))
    for r in own_bit.groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).collect():  # BITS / 8 bytes at most
        held[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.b), dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast((wanted, held))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (wanted, bits) = worker_table("vocabulary", Vocabulary), sent.value
        short = {size for size, reading in wanted if reading == LINE}

        def hit(h: np.ndarray) -> np.ndarray:
            at = (h & np.uint64(BITS - 1)).astype(np.int64)
            return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, found = batch.slice(start, 256), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    template = Template(text or "", vocabulary)
                    for size, reading in wanted:
                        if reading != LINE:
                            at, h = template.windows(size, reading)
                            for k in np.flatnonzero(hit(h)).tolist():
                                found.append((key, int(at[k]), size, reading, int(h[k].view(np.int64)), template.slots(int(at[k]), size, reading)))
                    if short:
                        for number, size, h in template.lines(short, vocabulary):
                            if hit(np.array([h]))[0]:
                                found.append((key, number, size, LINE, int(h.view(np.int64)), []))
                if found:
                    yield _rows(found)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    hits = own.mapInArrow(search, _WINDOWS)
    right = items.select(F.col("id").alias("item"), F.col("place").alias("item_place"), "size", "reading", "hash", F.col("slots").alias("item_slots"))
    met = hits.join(right, ["hash", "size", "reading"])
    # One alignment: the item's words at one distance in the document. It has each place of the item once.
    aligned = ["id", "item", "reading", "shift"]
    met = met.select("id", "item", "reading", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", F.arrays_zip("item_slots", "slots").alias("pairs"))
    met = cut(met.distinct())
    values = met.select(*aligned, "item_place", F.explode("pairs").alias("pair")).select(*aligned, "item_place", "pair.*")
    votes = values.groupBy(*aligned, "item_slots", "slots").agg(F.count("*").alias("n"))
    votes = votes.groupBy(*aligned, "item_slots").agg(F.max_by("slots", F.struct("n", "slots")).alias("most"))
    odd = values.join(votes, [*aligned, "item_slots"]).filter("slots != most").select(*aligned, "item_place").distinct()
    agreed = met.join(odd, [*aligned, "item_place"], "left_anti")
    agreed = agreed.select("id", "item", "item_place", F.forall("pairs", lambda x: x["item_slots"] == x["slots"]).alias("literal"))
    by_item = agreed.groupBy("id", "item", "item_place").agg(F.max("literal").alias("literal")).groupBy("id", "item")
    by_item = by_item.agg(F.count("*").alias("covered"), F.min("literal").alias("literal"))
    number = items.groupBy(F.col("id").alias("item")).agg(F.count_distinct("place").alias("n_windows"))
    out = by_item.join(number, "item").withColumn("share", F.col("covered") / F.col("n_windows")).filter(F.col("share") >= share)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "covered", "share", "literal")
