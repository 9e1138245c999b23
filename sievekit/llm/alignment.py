"""Alignment of two tokenizers' tokens by bytes, with counts of linked ids over the whole corpus.

Counting is external. Tasks hold links until a run is full, then sort its pair-document records by A id's radix cell, A id, B id
and document, and pack them as a zstd run: a row with the run's records, and for each cell a row with its pairs and their
numbers of documents. Each cell merges the rows of all runs with a heap, pair by pair in side-major order (A id, then B
id). When an A id ends, the counts of its pairs and their maximum are known and stream back, in the order of each run's
own pairs, so a run is answered without its records having moved to a cell: an id that is everywhere costs a cell one entry
for each run and pair. A last step reads each run's records beside its answers and adds them up by document.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string
from tokenizers import Tokenizer

from sievekit.llm.common import SLICE_ROWS, worker_table, written
from sievekit.llm.ragged import Ragged, WordStore, parts_of
from sievekit.llm.token_counts import separable

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links of a run; radix cells at least and at most (powers of two).
RUN_LINKS, LEAST_CELLS, MOST_CELLS = 2_000_000, 64, 4096
#: Words that a worker remembers and their characters, about 150 MB; characters of texts looked up at once, and of a text read whole.
WORDS, WORD_CHARS, CHARS_AT_ONCE = 400_000, 8_000_000, 2_000_000

_UNEVEN = re.compile(r"[ \n](?:[ \n]|$)|^[ \n]|[^\S \n]")
_BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)")


def words_of(text: str) -> list[str]:
    """A text cut where both tokenizers end a token: before a single space or line feed between other characters.

    A word begins with its line feed; the space that begins it is left out (also before the whole text), unless white space follows.
    """
    return _cut(" " + text) if _UNEVEN.search(text) else text.replace("\n", " \n").split(" ")


def _cut(text: str) -> list[str]:
    return [w[1:] if w[0] == " " and len(w) > 1 and not w[1].isspace() else w for w in _BORDER.split(text)]


def chunks_of(text: str, size: int) -> Iterator[list[str]]:
    """The words of a long text, about ``size`` characters at a time; each chunk ends where a word does."""
    at = 0
    while at < len(text):
        border = _BORDER.search(text, at + size)
        end = border.start() if border else len(text)
        yield _cut(text[at:end]) if at else words_of(text[:end])
        at = end


class Aligner:
    """Both sides' ids, groups and links of words. Words are looked up; new ones are encoded by the libraries, many at once."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.lead = self.b.encode("\n")[:1]
        self.a_bytes = byte_level(self.a.get_vocab())
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.store = WordStore(self._add, self._clear, WORDS, WORD_CHARS)
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.links, self.groups = Ragged(np.int32), Ragged(np.uint64), []

    def _add(self, words: list[str], rows: np.ndarray) -> None:
        units = [w if w[:1].isspace() else " " + w for w in words]
        a_ids = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b_ids = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        numbers, links, sizes = [], [], []
        for unit, a, b in zip(units, a_ids, b_ids, strict=True):
            if unit[0] == "\n":
                b = b[1:] if b[:1] == self.lead else []
            found = self._aligned(unit.encode(), a, b)
            numbers += (len(a), len(b), found[1], 1) if found else (0, 0, 0, 0)
            groups, _, own = found or ("", 0, [])
            self.groups.append(groups)
            links += own
            sizes.append(len(own))
        self.numbers.put(rows, np.array(numbers, np.int32), np.full(len(words), 4, np.int64))
        self.links.put(rows, np.array(links, np.uint64), np.array(sizes, np.int64))

    def _aligned(self, data: bytes, a: list[int], b: list[int]) -> tuple[str, int, list[int]] | None:
        """Groups as text, their number, and links as A id << 32 | B id; None where a side's bytes are others."""
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != data or b"".join(b_parts) != data:
            return None
        groups, links = [], []
        i = j = i0 = j0 = 0
        a_end, b_end = len(a_parts[0]), len(b_parts[0])
        while True:
            links.append(a[i] << 32 | b[j])
            if a_end == b_end:
                i, j = i + 1, j + 1
                groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
                if i == len(a):
                    return ";".join(groups), len(groups), links
                i0, j0 = i, j
                a_end += len(a_parts[i])
                b_end += len(b_parts[j])
            elif a_end < b_end:
                i += 1
                a_end += len(a_parts[i])
            else:
                j += 1
                b_end += len(b_parts[j])


def byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of each token: printable characters of Latin-1 stand for themselves, the other bytes for 256 and on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [n for n in range(256) if n not in set(plain)]
    byte = {chr(n): n for n in plain} | {chr(256 + k): n for k, n in enumerate(rest)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


_PACK = {np.dtype(t): k for k, t in enumerate(("<u1", "<u2", "<u4", "<u8"))}


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each as narrow as its greatest allows, as one zstd frame."""
    out = []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        kind = next(t for t in _PACK if most < 1 << 8 * t.itemsize)
        out += [bytes([_PACK[kind]]), len(x).to_bytes(8, "little"), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    kinds = list(_PACK)
    while at < len(data):
        kind, n = kinds[data[at]], int.from_bytes(data[at + 1 : at + 9], "little")
        out.append(np.frombuffer(data, kind, n, at + 9))
        at += 9 + n * kind.itemsize
    return out


_DOC = "n_a long, n_b long, n_groups long, groups_sha256 string"


class Runs:
    """Turns documents into rows of runs: (run, cell, head, body, documents); cell and head, or body and documents, are set."""

    def __init__(self, aligner: Aligner, cells: int, run_links: int = RUN_LINKS):
        self.aligner, self.cells, self.run_links = aligner, cells, run_links
        self.number = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
        self._begin()

    def _begin(self) -> None:
        self.docs: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, texts: list[str]) -> Iterator[dict]:
        for begin, end in parts_of(texts, list(map(len, texts)), CHARS_AT_ONCE):
            if len(texts[begin]) > CHARS_AT_ONCE:
                yield from self.flush()
                yield from self._long(ids[begin], texts[begin])
            else:
                self._some(ids[begin:end], texts[begin:end])
                if self.size >= self.run_links:
                    yield from self.flush()

    def _some(self, ids: list, texts: list[str]) -> None:
        words, ends = [], [0]
        for text in texts:
            if text:
                words += words_of(text)
            ends.append(len(words))
        x = self.aligner
        rows = x.store.rows(words)
        numbers = np.zeros((len(rows) + 1, 4), np.int64)
        np.cumsum(x.numbers.take(rows)[0].reshape(-1, 4), axis=0, out=numbers[1:]) if len(rows) else None
        sums = np.diff(numbers[ends], axis=0).tolist()
        first = len(self.docs)
        good = np.zeros(len(ids), bool)
        for k, (n_a, n_b, n_groups, ok) in enumerate(sums):
            a, b = ends[k], ends[k + 1]
            if a < b and ok == b - a:
                good[k] = True
                text = ";".join(map(x.groups.__getitem__, rows[a:b].tolist()))
                self.docs.append((ids[k], n_a, n_b, n_groups, hashlib.sha256(text.encode()).hexdigest()))
            else:
                self.docs.append((ids[k], 0, 0, 0, ""))
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        chosen = good[owner]
        codes, lengths = x.links.take(rows[chosen])
        self.codes.append(codes)
        self.owners.append(np.repeat((owner[chosen] + first).astype(np.uint32), lengths))
        self.size += len(codes)

    def _long(self, id_, text: str) -> Iterator[dict]:
        """A very long text is a run of its own, its links counted chunk by chunk."""
        x, sums, digest = self.aligner, np.zeros(4, np.int64), hashlib.sha256()
        codes, counts, units = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for words in chunks_of(text, CHARS_AT_ONCE):
            rows = x.store.rows(words)
            sums += x.numbers.take(rows)[0].reshape(-1, 4).sum(axis=0)
            digest.update((";" * (units > 0) + ";".join(map(x.groups.__getitem__, rows.tolist()))).encode())
            units += len(rows)
            some, n = np.unique(x.links.take(rows)[0], return_counts=True)
            codes, place = np.unique(np.concatenate([codes, some]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        if sums[3] == units:
            self.docs.append((id_, *sums[:3].tolist(), digest.hexdigest()))
        else:
            self.docs.append((id_, 0, 0, 0, ""))
            codes, counts = codes[:0], counts[:0]
        order, _ = self._order(codes)
        yield from self._run(codes[order], np.arange(len(codes)), np.zeros(len(codes), np.uint32), counts[order])
        self._begin()

    def flush(self) -> Iterator[dict]:
        if not self.docs:
            return
        codes, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.codes]), return_inverse=True)
        order, rank = self._order(codes)
        key = rank[place].astype(np.uint64) << np.uint64(32) | np.concatenate([np.zeros(0, np.uint32), *self.owners])
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(key)))
        key = key[first]
        yield from self._run(codes[order], (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts)
        self._begin()

    def _order(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted pairs by cell, and the places that they have then."""
        order = np.argsort(self._cells(codes), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return order, rank

    def _cells(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(32)).astype(np.int64) & (self.cells - 1)

    def _run(self, codes: np.ndarray, pair: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        """Rows of a run from its pairs by cell and its records (place of the pair, document, occurrences) in order."""
        number, self.number = self.number, self.number + 1
        n_docs = np.bincount(pair, minlength=len(codes))
        cell = self._cells(codes)
        bounds = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)] if len(cell) else [0]
        for a, b in pairwise(bounds):
            yield {"run": number, "cell": int(cell[a]), "head": packed(np.diff(codes[a:b], prepend=np.uint64(0)), n_docs[a:b]), "body": None, "docs": None}
        yield {"run": number, "cell": None, "head": None, "body": packed(n_docs, owner, counts), "docs": self.docs}


def merged(heads: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(run, answers) of a cell from (run, head): for each of a run's pairs, its count over all runs times two, plus one where it is its A id's highest.

    What is held is the heads, packed, the unpacked ones' numbers and the answers.
    """

    def stream(k: int, head: bytes) -> Iterator[tuple[int, int, int]]:
        steps, n_docs = unpacked(head)
        codes = np.cumsum(steps.astype(np.uint64))
        for at in range(0, len(codes), 4096):
            for code, n in zip(codes[at : at + 4096].tolist(), n_docs[at : at + 4096].tolist(), strict=True):
                yield code, k, n

    answers: list[list[int]] = [[] for _ in heads]
    side, code, count, holders, held, best = None, None, 0, [], [], 0

    def close_side() -> None:
        for n, runs in held:
            value = 2 * n + (n == best)
            for k in runs:
                answers[k].append(value)

    for this, k, n in heapq.merge(*(stream(k, head) for k, (_, head) in enumerate(heads))):
        if this != code:
            if code is not None:
                held.append((count, holders))
                best = max(best, count)
            if this >> 32 != side:
                close_side()
                side, held, best = this >> 32, [], 0
            code, count, holders = this, 0, []
        count += n
        holders.append(k)
    if code is not None:
        held.append((count, holders))
        best = max(best, count)
        close_side()
    for (run, _), values in zip(heads, answers, strict=True):
        yield run, packed(np.array(values, np.uint64))


def aligned(docs: DataFrame, cells: int | None = None, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, run_links: int = RUN_LINKS) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A null or empty text, or one that a side's tokens don't spell, has no tokens: zeros and ''. Every row counts as a document of its
    own, so repeated rows count each time; other columns aren't read; an empty table gives an empty result. Whole texts are
    aligned, very long ones chunk by chunk. Each A id's links are bounded for a task by (runs x its B ids), whatever the number of
    documents that hold it.
    """
    with open(path_a or public_tokenizers.path(SIDE_A), encoding="utf-8") as file:
        a_json = file.read()
    with open(path_b or public_tokenizers.path(SIDE_B), "rb") as file:
        b_model = file.read()
    separable(b_model)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((a_json, b_model))  # two tokenizer files
    key = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, 1 << (2 * partitions - 1).bit_length()))
    kind = docs.schema[id_col].dataType
    doc = StructType([StructField("id", kind), *_parse_datatype_string(_DOC).fields])
    run = StructType([*_parse_datatype_string("run long, cell int, head binary, body binary").fields, StructField("docs", ArrayType(doc))])
    out = StructType([StructField(id_col, kind), *_parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(run)
        runs = Runs(worker_table("alignment " + key, lambda: Aligner(*sent.value)), cells, run_links)

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            names = doc.names
            for r in rows:
                r["docs"] = r["docs"] and [dict(zip(names, d, strict=True)) for d in r["docs"]]
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                if rows := list(runs.add(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])):
                    yield batch_of(rows)
        if rows := list(runs.flush()):
            yield batch_of(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, heads = None, []

        def answer() -> pa.RecordBatch:
            found = list(merged(heads))
            return pa.RecordBatch.from_pydict({"run": pa.array([r for r, _ in found], pa.int64()), "cell": pa.array([cell] * len(found), pa.int32()), "head": pa.array([x for _, x in found], pa.binary())})

        for batch in batches:
            for number, this, head in zip(*(batch.column(c).to_pylist() for c in ("run", "cell", "head")), strict=True):
                if this != cell and heads:
                    yield answer()
                    heads = []
                cell = this
                heads.append((number, head))
        if heads:
            yield answer()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        answers: list[np.ndarray] = []
        for batch in batches:
            for head, body, rows in zip(*(batch.column(c).to_pylist() for c in ("head", "body", "docs")), strict=True):
                if body is None:
                    answers += unpacked(head)
                    continue
                n_docs, owner, counts = (x.astype(np.int64) for x in unpacked(body))
                value = np.repeat(np.concatenate([np.zeros(0, np.int64), *answers]).astype(np.int64), n_docs)
                answers = []
                sums = np.zeros((3, len(rows)), np.int64)
                for at, x in enumerate((counts, counts * (value & 1), counts * (value >> 1))):
                    np.add.at(sums[at], owner, x)
                columns = [[r["id"] for r in rows], *([r[c] for r in rows] for c in ("n_a", "n_b", "n_groups")), *sums.tolist(), [r["groups_sha256"] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    table = written(docs.select(id_col, text_col).mapInArrow(make_runs, run))
    heads = table.filter("cell is not null").select("run", "cell", "head").repartition(partitions, "cell").sortWithinPartitions("cell", "run")
    answers = heads.mapInArrow(count, "run long, cell int, head binary")
    bodies = table.filter("cell is null").select("run", F.lit(cells).alias("cell"), F.lit(None).cast("binary").alias("head"), "body", "docs")
    both = answers.select("run", "cell", "head", F.lit(None).cast("binary").alias("body"), F.lit(None).cast(bodies.schema["docs"].dataType).alias("docs")).unionByName(bodies)
    return both.repartition(partitions, "run").sortWithinPartitions("run", "cell").mapInArrow(add_up, out)
