"""Token counts of a sentencepiece model from the lengths of pre-tokens, in one map.

In a model whose pieces hold the word mark (U+2581) only at their start and never a line feed, no merge
crosses the place before a run of marks or around a line feed. So the number of tokens of a text is the sum
over its pre-tokens, and the length of a pre-token is looked up: first in a broadcast table of frequent
ones, then in the worker's cache, else by encoding it. No pre-token is ever shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from sievekit.llm.common import map_texts, worker_table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bounds of the broadcast table: words, characters of each (so 8,192 x 64 characters), and what it is fitted on:
#: a share of the rows, and at most so many counted words. It only saves work; counts don't depend on it.
TABLE_WORDS = 8192
WORD_CHARS = 64
SAMPLE_SHARE = 0.01
SAMPLE_COUNTS = 65_536
#: Words that a worker remembers in each of two generations.
CACHE_WORDS = 300_000

_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def separable(model: bytes) -> None:
    """Raises ValueError unless pre-tokens are independent in the model."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    spec, plain = proto.normalizer_spec, {1, 2, 3, 6}
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("the model rewrites texts")
    if bad := [p.piece for p in proto.pieces if p.type not in plain or MARK in p.piece.lstrip(MARK) or "\n" in p.piece]:
        raise ValueError(f"pieces cross pre-tokens: {bad[:3]}")


class Lengths(dict):
    """Tokens of each word, counted when missing. The frequent ones stay; of the rest, two generations."""

    def __init__(self, count, frequent: dict[str, int], most: int = CACHE_WORDS):
        super().__init__(frequent)
        self.count, self.frequent, self.most, self.old = count, frequent, most + len(frequent), {}

    def __missing__(self, word: str) -> int:
        if (n := self.old.get(word)) is None:
            n = self.count(word)
            if len(word) > WORD_CHARS:
                return n
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.frequent)
        self[word] = n
        return n


class Tokens:
    """Counts a text's tokens. ``inner``: words after a mark; ``first``: words that begin a later line."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lead = len(self.model.encode("\n"))  # the mark before every text, and the line feed
        self.feed = len(self.model.encode("\n\n")) - self.lead
        self.inner = Lengths(lambda word: self.symbols(" " + word), frequent)
        self.first = Lengths(self.symbols, {}, CACHE_WORDS // 4)

    def symbols(self, text: str) -> int:
        """Tokens of ``text`` with no mark put before it."""
        return len(self.model.encode("\n" + text)) - self.lead

    def spaced(self, line: str, begins: bool) -> int:
        """A line with runs of marks."""
        marked = MARK * begins + line.replace(" ", MARK)
        return sum(self.inner[run[1:]] if run[0] == MARK else self.first[run] for run in _RUNS.findall(marked))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        lines = text.split("\n")
        n = self.feed * (len(lines) - 1)
        inner, begins = self.inner.__getitem__, True
        for line in lines:
            if "  " in line or MARK in line or begins and line[:1] == " ":
                n += self.spaced(line, begins)
            else:
                words = line.split(" ")
                if not begins:
                    n += self.first[words[0]]
                    del words[0]
                n += sum(map(inner, words))
            begins = False
        return n


def frequent_words(docs: DataFrame, text_col: str, share: float = SAMPLE_SHARE, counts: int = SAMPLE_COUNTS, words: int = TABLE_WORDS) -> list[str]:
    """Frequent words of a sample. Each task sends its own most frequent ones; the driver stops asking tasks after ``counts`` rows."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(w for line in (text or "").split("\n") for w in line.split(" ") if len(w) <= WORD_CHARS)
                if len(found) > 32 * words:
                    found = Counter(dict(found.most_common(4 * words)))
        best = found.most_common(words)
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    total: Counter = Counter()
    for row in docs.select(text_col).sample(fraction=share, seed=7).mapInArrow(top, "word string, n long").limit(counts).collect():
        total[row.word] += row.n
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:words]]




def token_counts(docs: DataFrame, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    A null or empty text has 0 bytes and 0 tokens. Whole texts are counted; a word longer than 64 characters is
    encoded each time and not remembered. Repeated rows give repeated rows; other columns aren't read; an empty
    table gives an empty result.
    """
    with open(path or public_tokenizers.path(MODEL), "rb") as file:
        model = file.read()
    separable(model)
    count = Tokens(model, {})
    frequent = {w: count.inner.count(w) for w in frequent_words(docs, text_col)}
    sent = docs.sparkSession.sparkContext.broadcast((model, frequent))  # a model file and TABLE_WORDS short words at most
    key = hashlib.sha256(repr(sorted(frequent.items())).encode() + model).hexdigest()

    def make():
        count = worker_table(key, lambda: Tokens(*sent.value))

        def apply(ids: list, texts: list[str]) -> dict[str, list]:
            numbers = [count(text) for text in texts]
            return {"n_bytes": [len(text.encode()) for text in texts], "n_tokens": numbers, "over_limit": [n > limit for n in numbers]}

        return apply

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
