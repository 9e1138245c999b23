"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary text.

A word is a sequence of letters between a start and an end mark; each symbol is predicted from the five before it.
Each class has its own discounted counts and hands the rest to a model that both share: the counts of both
classes together, which in turn backs off to continuation counts (before how many different symbols does a shorter
context with this symbol stand?). A word that is rare in both classes so gets much the same probability from either
model, also if only its beginning has been met. Texts are compared by the difference of the two log-likelihoods for
each word: over the whole text, and over its most telling windows, for a long text may be toxic in one place.

All counts are tables of the engine, without a bound. Texts are not shuffled when they are scored: every task
holds the differences in a table of a fixed number of hashed places.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.bitmap import bitmap, marked
from sievekit.llm.common import cut, map_texts, share_of, worker_table, written
from sievekit.llm.logistic import Logistic

#: Symbols before the one that is predicted.
CONTEXT = 5
DISCOUNT = 0.75
#: Observations that the shared model weighs against a class's own counts.
PRIOR = 30.0
WINDOWS = (1, 4, 16)
#: Every labelled row is counted; those of one fold in five are left out of the counts and serve the calibration,
#: at most so many of them.
CALIBRATION_ROWS = 8000
#: Places of the table that tasks hold, 2 bytes each. Sequences that share a place share the mean of their differences,
#: weighted by their counts; none is left out.
PLACES = 1 << 24
BLOCK = 1 << 16
#: Words and sequences that a task counts before it hands on; words whose difference it remembers.
COUNTED = 200_000
CACHE_WORDS = 200_000
#: Characters of the words that are remembered from one slice of texts to the next.
CACHE_CHARS = 8_000_000
START, END = "\x02", "\x03"
_EDGE = ".,;:!?\"'()[]{}<>|%&*#$-" + START + END


def words_of(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(_EDGE))]


def sequences(word: str) -> list[str]:
    """Each symbol of a word after the first mark, behind its context."""
    marked_ = START + word + END
    return [marked_[max(0, k - CONTEXT) : k + 1] for k in range(1, len(marked_))]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and the number of texts of either class that hold them, added up over many texts."""
    found: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        every = list(found[0].keys() | found[1].keys())
        for at in range(0, len(every), 100_000):
            part = every[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), **{f"c{k}": pa.array([found[k][w] for w in part], pa.int64()) for k in (0, 1)}})
        for counts in found:
            counts.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found[label].update(set(words_of(text or "")))
            if len(found[0]) + len(found[1]) > COUNTED:
                yield from out()
    yield from out()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of the words and their counts."""
    found: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = [pa.array(x, pa.int64()) for x in zip(*found.values(), strict=True)] or [pa.array([], pa.int64())] * 2
        made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *columns], names=["s", "c0", "c1"])
        found.clear()
        return made

    for batch in batches:
        for word, c0, c1 in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for s in sequences(word):
                counts = found.setdefault(s, [0, 0])
                counts[0] += c0
                counts[1] += c1
        if len(found) > COUNTED:
            yield out()
    yield out()


def differences(words: DataFrame) -> DataFrame:
    """``s`` and ``value``, the log of the toxic probability of its last symbol less that of the ordinary one, and ``weight``.

    ``words``: word, c0, c1. A sequence of ``s`` without its last symbol, ``context`` true, has the value of any
    symbol that was never met behind it.
    """
    seen = cut(words.mapInArrow(_sequences, "s string, c0 long, c1 long").groupBy("s").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    parts = [F.expr("substring(s, 1, char_length(s) - 1)").alias("h"), F.expr("right(s, 1)").alias("c")]
    # Shared backoff: continuation counts of ever longer contexts. ``t`` is a context with its symbol.
    ends = seen.select(F.explode(F.expr("transform(sequence(2, char_length(s)), k -> right(s, k))")).alias("t")).distinct()
    after = ends.groupBy(F.expr("substring(t, 2)").alias("t")).agg(F.count("*").alias("n"))
    after = cut(after.withColumn("h", F.expr("substring(t, 1, char_length(t) - 1)")))
    sums = after.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    after = cut(after.join(sums, "h").select("t", F.char_length("t").alias("size"), (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("all")).alias("own"), (DISCOUNT * F.col("kinds") / F.col("all")).alias("left")))
    kinds = after.filter("size = 1").count()
    shared = after.filter("size = 1").select("t", (F.col("own") + F.col("left") / (kinds + 1.0)).alias("p"))
    levels = [shared]
    for size in range(2, CONTEXT + 1):
        shorter = levels[-1].withColumnRenamed("t", "u")
        longer = after.filter(F.col("size") == size).withColumn("u", F.expr("substring(t, 2)")).join(shorter, "u")
        levels.append(cut(longer.select("t", (F.col("own") + F.col("left") * F.col("p")).alias("p"))))
    backoff = levels[0]
    for level in levels[1:]:
        backoff = backoff.unionByName(level)
    sums = [F.sum(f"c{k}").alias(f"n{k}") for k in (0, 1)] + [F.count_if(F.col(f"c{k}") > 0).alias(f"k{k}") for k in (0, 1)]
    contexts = cut(seen.select(*parts, "c0", "c1").groupBy("h").agg(*sums, F.count("*").alias("kinds")))
    rows = seen.select("s", *parts, "c0", "c1", F.expr("substring(s, 2)").alias("t")).join(contexts, "h").join(backoff, "t")
    both, total = F.col("c0") + F.col("c1"), F.col("n0") + F.col("n1")
    pooled = (F.greatest(both - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("p")) / total
    spread = [(DISCOUNT * F.col(f"k{k}") + PRIOR) / (F.col(f"n{k}") + PRIOR) for k in (0, 1)]
    p = [F.greatest(F.col(f"c{k}") - DISCOUNT, F.lit(0.0)) / (F.col(f"n{k}") + PRIOR) + spread[k] * pooled for k in (0, 1)]
    met = rows.select("s", F.lit(False).alias("context"), (F.ln(p[1]) - F.ln(p[0])).alias("value"), both.alias("weight"))
    never = contexts.select(F.col("h").alias("s"), F.lit(True).alias("context"), (F.ln(spread[1]) - F.ln(spread[0])).alias("value"), total.alias("weight"))
    return met.unionByName(never)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _keys(symbols: np.ndarray, place: np.ndarray, context: bool) -> np.ndarray:
    """Places in the table of the sequences that end at each symbol, or of their contexts. ``place``: of the symbol in its word."""
    h = np.full(len(symbols), 3 if context else 1, dtype=np.uint64)
    for k in range(int(context), CONTEXT + 1):
        inside = place >= k
        h[inside] = h[inside] * _BASE + symbols[np.flatnonzero(inside) - k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(PLACES - 1)).astype(np.int64)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each sequence, as sums to add up."""
    for batch in batches:
        s, context = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=bool)
        at = np.zeros(len(s), dtype=np.int64)
        # A context is what stands before a symbol that doesn't matter.
        symbols = np.array([ord(x) for t, c in zip(s, context, strict=True) for x in (t + END if c else t)], dtype=np.uint64)
        sizes = np.array([len(t) + c for t, c in zip(s, context, strict=True)], dtype=np.int64)
        if len(s):
            last = np.cumsum(sizes) - 1
            place = np.arange(len(symbols)) - np.repeat(last - sizes + 1, sizes)
            for kind in (False, True):
                at[context == kind] = _keys(symbols, place, kind)[last[context == kind]]
        weight = batch.column(3).to_numpy().astype(float)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "sum": pa.array(batch.column(2).to_numpy() * weight), "weight": pa.array(weight)})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        at, value = (batch.column(k).to_numpy() for k in (1, 2))
        for block in np.unique(at // BLOCK).tolist():
            own = at // BLOCK == block
            found.setdefault(block, np.full(BLOCK, np.nan, dtype=np.float16))[at[own] % BLOCK] = value[own]
    packed = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in found.values()]
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.int64()), "packed": pa.array(packed, pa.binary())})


class KneserNey:
    """The differences of all sequences in PLACES places, and those of words."""

    def __init__(self, blocks: dict[int, bytes]):
        self.blocks = blocks
        self.key = xxhash.xxh3_64_hexdigest(b"".join(k.to_bytes(8) + blocks[k] for k in sorted(blocks)))
        self.values: np.ndarray | None = None
        self.known: dict[str, float] = {}
        self.chars = 0

    @classmethod
    def of(cls, words: DataFrame) -> KneserNey:
        """``words``: word, c0, c1, the number of ordinary and of toxic texts that hold it."""
        found = differences(words).mapInArrow(_folded, "at long, sum double, weight double")
        found = found.groupBy("at").agg((F.sum("sum") / F.sum("weight")).alias("value")).select(F.floor(F.col("at") / BLOCK).alias("block"), "at", "value")
        made = found.repartition("block").mapInArrow(_blocks, "block long, packed binary").collect()  # 2 x PLACES bytes at most
        return cls({r.block: bytes(r.packed) for r in made})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"values": None, "known": {}}

    def learn(self, words: list[str]) -> None:
        """Differences of words that aren't known yet."""
        if self.values is None:
            self.values = np.full(PLACES, np.nan, dtype=np.float16)
            for block, packed in self.blocks.items():
                self.values[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.float16)
        for at in range(0, len(words), 4096):
            part = [START + w + END for w in words[at : at + 4096]]
            symbols = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            sizes = np.array([len(w) for w in part], dtype=np.int64)
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(symbols)) - np.repeat(begin, sizes)
            value = self.values[_keys(symbols, place, False)].astype(float)
            never = np.flatnonzero(np.isnan(value))
            if len(never):
                value[never] = np.nan_to_num(self.values[_keys(symbols, place, True)[never]].astype(float))
            value[begin] = 0  # the start mark isn't predicted
            self.known.update(zip(words[at : at + 4096], np.add.reduceat(value, begin).tolist(), strict=True))

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: mean difference of its words, and the greatest mean over windows of some lengths. A text without words has 0."""
        out = np.zeros((len(texts), 1 + len(WINDOWS)))
        own = [words_of(t) for t in texts]
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0
        new = list({w for x in own for w in x if w not in self.known})
        self.chars += sum(map(len, new))
        self.learn(new)
        for k, words in enumerate(own):
            if n := len(words):
                sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.known.__getitem__, words), dtype=float, count=n))])
                out[k, 0] = sums[-1] / n
                for j, w in enumerate(WINDOWS, 1):
                    w = min(w, n)
                    out[k, j] = (sums[w:] - sums[:-w]).max() / w
        return out


def _loaded(language: KneserNey) -> KneserNey:
    return worker_table(language.key, lambda: language)


class ToxicityModel:
    def __init__(self, language: KneserNey, calibration: Logistic):
        self.language, self.calibration = language, calibration


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Both language models and the calibration from all labelled rows for which ``usable`` holds.

    ``labels`` has the id and ``label_col`` (1 toxic, 0 ordinary; null: unlabelled). A bitmap of labelled ids keeps
    other texts out of the join. Counts cover every word of every labelled row outside the calibration's fold; a text
    counts a word once. Of rows with one label's id each is counted.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"), usable.alias("_usable"))
    own = own.filter(F.col("_usable") & F.col("_label").isin(0, 1) & F.col("_id").isNotNull()).dropDuplicates(["_id"])
    own = cut(own.select("_id", "_label", F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(5)).alias("_fold")))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counted = own.filter("_fold != 0").select("_id", "_label")
    rows = marked(texts, bitmap(counted, "_id"), "_id").filter("_in").drop("_in").join(counted.hint("merge"), "_id")
    words = rows.select("_text", "_label").mapInArrow(_words, "word string, c0 long, c1 long")
    language = KneserNey.of(written(words.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))))

    sent = docs.sparkSession.sparkContext.broadcast(language)

    def make():
        language = _loaded(sent.value)

        def apply(ids: list, texts: list[str], labels: list[int]) -> dict[str, list]:
            return {"label": labels, "features": language.features(texts).tolist()}

        return apply

    held = share_of(own.filter("_fold = 0"), CALIBRATION_ROWS, "_id", 4)
    rows = texts.join(F.broadcast(held), "_id").dropDuplicates(["_id"])  # bounded by CALIBRATION_ROWS
    found = map_texts(rows, make, "label int, features array<double>", "_id", "_text", keep=("_label",)).collect()
    sent.destroy()
    data = np.array(sorted((r.label, *r.features) for r in found), dtype=float).reshape(len(found), 2 + len(WINDOWS))
    return ToxicityModel(language, Logistic(data[:, 1:], data[:, 0]))


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and ``score`` from 0 to 1, higher for text that is more likely toxic.

    The score depends on the whole text alone, however long; a null or empty text has no words and gets the score of
    nothing. Equal texts, and so repeated rows, get equal scores. If the labels hold one class only, every score is
    that class's share. Other columns aren't read, whatever their names; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by PLACES

    def make():
        model = sent.value
        language = _loaded(model.language)

        def apply(ids: list, texts: list[str]) -> dict[str, list]:
            return {"score": model.calibration.score(language.features(texts))}

        return apply

    return map_texts(docs, make, "score double", id_col, text_col)
