"""Packing of documents into training sequences at a target mixture of sources.

All pieces lie on one line of tokens, cut every ``window`` tokens; what is left at its end is cut at powers of two, so
nothing is padded. Documents are tokenised once and dealt to blocks of about a million tokens. What each block needs of the
blocks before it are sums: the tokens of each source so far. They give its place on the line and each source's deficit,
target share times tokens so far less tokens served, which so is carried across blocks as across windows. Within a block a
deficit round-robin over the sources' queues fills window after window: each source gains its share of the window, and those
with a deficit are served, largest first, until it is gone.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string
from tokenizers import Tokenizer

from sievekit.llm.common import map_texts, worker_table, written
from sievekit.llm.ragged import Ragged, WordStore, parts_of

TOKENIZER = "word_bpe_49k.json"
#: The id after each document, tokens of a sequence, tokens of a block, and the least that a source is served at once
#: (a document's or window's rest may be less): rare sources come in pieces of this size every few windows.
END_ID, WINDOW, BLOCK_TOKENS, LEAST_PIECE = 2, 4096, 1 << 20, 256
#: Shares of blocks (block and source) up to which they are broadcast, about 20 MB; beyond, Spark joins them.
BROADCAST_SHARES = 400_000
#: Words that a worker remembers and their characters, about 250 MB; characters of texts looked up at once.
WORDS, WORD_CHARS = 1_600_000, 24_000_000
CHARS_AT_ONCE = 4_000_000


class WordTokens:
    """Ids of whole texts of a tokenizer that drops white space: no token crosses a space or line feed, so words are encoded one by one.

    Letters and the marks that follow them are never in one token either. So a word of letters that ends in points or commas
    is put together from its two parts; and words of letters alone are encoded many at once, as each has one token that ends it.
    """

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(data)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.store = WordStore(self._add, self._clear, WORDS, WORD_CHARS)
        self._clear()

    def _clear(self) -> None:
        self.ids = Ragged(np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)

    def _add(self, words: list[str], rows: np.ndarray) -> None:
        letters, joined, others = [], [], []  # of the last: number, letters in lower case, marks
        for word, row in zip(words, rows.tolist(), strict=True):
            core = word.rstrip(".,")
            low = core.lower() if core.isascii() or core.isalpha() and max(core) <= "\xff" else core  # as the tokenizer would
            if not low.isalpha():
                others.append((word, row))
            elif low == word:
                letters.append((word, row))
            else:
                joined.append((row, low, word[len(core) :]))
        known = len(self.store.index)
        parts = self.store.numbers([part for _, *both in joined for part in both])
        for word, row in zip(self.store.index.new, range(known, len(self.store.index)), strict=True):
            (letters if word.isalpha() else others).append((word, row))
        for begin in range(0, len(letters), 2048):
            self._letters(letters[begin : begin + 2048])
        self._each(others)
        values, lengths = self.ids.take(parts)
        self.ids.put(np.array([row for row, *_ in joined], np.int64), values, lengths[::2] + lengths[1::2])

    def _letters(self, words: list[tuple[str, int]]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(w for w, _ in words)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(words) and last[-1] == len(ids) - 1:
            self.ids.put(np.array([row for _, row in words]), ids, np.diff(last, prepend=-1))
        else:
            self._each(words)

    def _each(self, words: list[tuple[str, int]]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, _ in words], add_special_tokens=False)]
        self.ids.put(np.array([row for _, row in words], np.int64), np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for begin, end in parts_of(texts, list(map(len, texts)), CHARS_AT_ONCE):
            words, sizes = [], []
            for text in texts[begin:end]:
                own = text.replace("\n", " ").split(" ")
                words += own
                sizes.append(len(own))
            ids, lengths = self.ids.take(rows) if len(rows := self.store.rows(words)) else (self.ids.flat[:0], np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *sizes])]
            out += [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out


def blocks(docs: DataFrame, data: str, id_col: str, text_col: str, source_col: str, block_tokens: int) -> DataFrame:
    """A written table of blocks: ``part``, ``seq``, and arrays ``ids``, ``sources``, ``lengths`` of their documents with ``tokens`` as bytes.

    Tokenised documents are dealt out evenly and come in the order of a hash, so that each block holds its part of every source
    however the input is stored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(data)  # one tokenizer file
    key = hashlib.sha256(data.encode()).hexdigest()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    kind = docs.schema["id"].dataType

    def make():
        tokens = worker_table("packing " + key, lambda: WordTokens(sent.value))

        def apply(ids: list, texts: list[str], sources: list) -> dict[str, list]:
            found = [np.append(x, x.dtype.type(END_ID)) for x in tokens(texts)]
            return {"source": sources, "n": [len(x) for x in found], "tokens": [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in found]}

        return apply

    dealt = map_texts(docs, make, "source string, n long, tokens binary", "id", "text", ("source",))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).sortWithinPartitions(F.xxhash64("id", "n", "source"))
    dealt = dealt.withColumn("part", F.spark_partition_id())
    plain = "part int, seq int, sources array<string>, lengths array<long>, tokens binary"
    out = StructType([*_parse_datatype_string(plain).fields, StructField("ids", ArrayType(kind))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        held: list[tuple] = []
        size, seq = 0, 0

        def block() -> pa.RecordBatch:
            part, ids, sources, lengths, tokens = zip(*held, strict=True)
            wide = b"".join(_wide(t, n).astype("<u4").tobytes() for t, n in zip(tokens, lengths, strict=True))
            row = {"part": part[0], "seq": seq, "sources": list(sources), "lengths": list(lengths), "tokens": _narrow(wide), "ids": list(ids)}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "source", "n", "tokens")), strict=True):
                held.append(row)
                size += row[3]
                if size >= block_tokens:
                    yield block()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    return written(dealt.mapInArrow(gather, out))


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _narrow(data: bytes) -> bytes:
    ids = np.frombuffer(data, "<u4")
    return ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else data


def shares(table: DataFrame, weights: dict[str | None, float] | None) -> tuple[DataFrame, int]:
    """For each block: its place ``offset`` on the line and ``share``, an array of its (source, target, before); and the tokens of all.

    ``target``: the source's weight in millionths of the sum, by default its own tokens; ``before``: its tokens in earlier
    blocks. Sums run over parts first and then within a part, so no window holds more than one source's parts or one part's blocks.
    """
    rows = table.select("part", "seq", F.explode(F.arrays_zip("sources", "lengths")).alias("x")).groupBy("part", "seq", F.col("x.sources").alias("source"))
    rows = written(rows.agg(F.sum("x.lengths").alias("n")))
    spark = table.sparkSession
    by_part = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("part", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("parts_before"))
    within = Window.partitionBy("part", "source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    rows = rows.join(parts, (rows["part"] == parts["part"]) & rows["source"].eqNullSafe(parts["source"])).drop(parts["part"]).drop(parts["source"])
    if weights is None:
        target = rows.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("target"))
    else:
        target = spark.createDataFrame([(s, round(w * 1_000_000)) for s, w in weights.items()], "of string, target long")
    rows = rows.join(target, rows["source"].eqNullSafe(target["of"]), "left")
    rows = rows.groupBy("part", "seq").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("source", F.coalesce("target", F.lit(0)).alias("target"), (F.col("own_before") + F.col("parts_before")).alias("before"))).alias("share")
    )
    rows = written(rows)
    total, places = 0, []
    for r in rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toLocalIterator():  # one row for each part
        places.append((r.part, total))
        total += r.n
    place = spark.createDataFrame(places, "part int, first long")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(place), "part")  # as many rows as parts
    return rows.select("part", "seq", (F.col("own") + F.col("first")).alias("offset"), "share"), total


def sequence(place: int, total: int, window: int) -> tuple[int, int, int]:
    """(number, begin, end) of the sequence at a place of the line. The rest at its end falls into powers of two, the largest first."""
    number, begin, rest = place // window, place - place % window, total % window
    if begin + window <= total:
        return number, begin, begin + window
    while place >= begin + (size := 1 << (rest.bit_length() - 1)):
        number, begin, rest = number + 1, begin + size, rest - size
    return number, begin, begin + size


def round_robin(
    sources: list, lengths: list[int], share: dict, whole: int, offset: int, total: int, window: int = WINDOW, least: int = LEAST_PIECE
) -> list[tuple[int, int, int, int]]:
    """(document, start, length, place) of a block's pieces in the order of the line. ``share``: of each source its target and tokens before; ``whole``: the sum of all targets.

    A deficit is target x tokens of the line - whole x tokens served, in whole numbers.
    """
    queues: dict = {}
    for k, source in enumerate(sources):
        queues.setdefault(source, deque()).append(k)
    deficit = {s: share[s][0] * offset - whole * share[s][1] for s in queues}
    start = [0] * len(lengths)
    out: list[tuple[int, int, int, int]] = []
    place = offset

    def serve(source, most: int) -> int:
        nonlocal place
        doc = queues[source][0]
        taken = min(most, lengths[doc] - start[doc])
        if out and out[-1][0] == doc and out[-1][3] + out[-1][2] == place and out[-1][3] >= begin:
            out[-1] = (doc, out[-1][1], out[-1][2] + taken, out[-1][3])
        else:
            out.append((doc, start[doc], taken, place))
        start[doc] += taken
        place += taken
        deficit[source] -= whole * taken
        if start[doc] == lengths[doc]:
            queues[source].popleft()
            if not queues[source]:
                del queues[source]
        return taken

    while queues:
        _, begin, end = sequence(place, total, window)
        for source in deficit:
            deficit[source] += share[source][0] * (end - place)
        for source in sorted(queues, key=lambda s: (-deficit[s], s is not None, s or "")):
            while place < end and source in queues and deficit[source] > 0:
                serve(source, min(end - place, max(least, -(-deficit[source] // whole))))
        while place < end and queues:  # the rest goes to those that are the least ahead
            source = max(queues, key=lambda s: (deficit[s], s is not None, s or ""))
            serve(source, min(end - place, least))
    return out


def pack(
    docs: DataFrame, window: int = WINDOW, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", path: str | None = None, block_tokens: int = BLOCK_TOKENS, least_piece: int = LEAST_PIECE,
) -> DataFrame:
    """One row for each piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Every id of every document, the end id included, lies in exactly one piece; no sequence but the last few is shorter than
    ``window``, and these are powers of two: nothing is padded. Windows hold the sources in the proportions of ``weights`` (by
    default those of the whole table, so that all queues end together) to within ``least_piece`` tokens and what a block lacks;
    a source without a weight fills what is left. A null or empty text is the end id alone; a null source is a source of its own;
    repeated rows and null ids are packed each for itself; other columns aren't read; an empty table gives an empty result.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("the window has to be a power of two")
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        data = file.read()
    table = blocks(docs, data, id_col, text_col, source_col, block_tokens)
    placed, total = shares(table, weights)
    n_shares = placed.agg(F.sum(F.size("share"))).first()[0] or 0
    whole = total if weights is None else max(1, sum(round(w * 1_000_000) for w in weights.values()))
    rows = table.join(F.broadcast(placed) if n_shares <= BROADCAST_SHARES else placed, ["part", "seq"])
    plain = _parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    out = StructType([StructField(id_col, docs.schema[id_col].dataType), *plain.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                ids = _wide(row["tokens"], sum(lengths)).astype("<u4")
                first = np.concatenate([[0], np.cumsum(lengths)])
                share = {x["source"]: (x["target"], x["before"]) for x in row["share"]}
                made: dict[str, list] = {name: [] for name in arrow.names}
                for doc, start, length, place in round_robin(row["sources"], lengths, share, whole, row["offset"], total, window, least_piece):
                    number, begin, _ = sequence(place, total, window)
                    at = int(first[doc]) + start
                    values = (row["ids"][doc], start, length, zlib.crc32(ids[at : at + length].tobytes()), lengths[doc], number, place - begin)
                    for name, value in zip(arrow.names, values, strict=True):
                        made[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return rows.select("ids", "sources", "lengths", "tokens", "offset", "share").mapInArrow(run, out)
