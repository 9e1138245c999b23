"""Jaccard self-join of documents on sets of word n-grams, exact, without a comparison of all pairs.

1. Sets. Every text becomes a set of hashed shingles. Half of all hashes are counted over the corpus: a set with
   more shingles of its own than a link allows has no partner and leaves. Equal sets are one class, named by its
   smallest id.
2. Stars, a shortcut: a class is compared with the most central class among those that share a min-hash with it.
   This links a large group of near copies at once, in as many comparisons as it has members. A class then leaves
   if more of its shingles than a link allows are in no other component.
3. Tiles. For similarity t two sets must share one of the first n - ceil(t n) + 1 shingles in any fixed order.
   Shingles that many documents share come last in it. A shingle that stands in the beginnings of several of
   the components so far opens a tile, split by bands of set sizes: linked sets differ by one band at most.
4. Bitmaps. In a tile, pairs of different components are bounded from above by bit counts of hashed
   signatures: each bit that one set has and the other lacks is a shingle less in the intersection.
5. Pairs that pass are compared as sorted arrays, and links join the components. Where a set has many partners left, it
   first meets only the likeliest of each other component; what that leaves apart is compared in a second round.

Pairs within a component are never compared again, so copies are not expanded into pairs. Tiles with the same
members, told by their number and two 64-bit sums of hashed ids, are one tile. Texts are shuffled at no step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.bitmap import bitmap
from sievekit.llm.common import at_least, cut, worker_table
from sievekit.llm.components import components

WORDS = 5
#: Similarity of at least NEAR / 100.
NEAR = 75
#: Bits of a signature at least, and sets up to which it grows (larger ones have a looser bound).
SIGNATURE, SIGNATURE_MOST = 256, 1 << 14
#: Odd factors: each gives one order of all hashes, and so one min-hash.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 9)], dtype=np.uint64)
#: Shingles in so many texts of a task's chunk are counted, and so many of the most frequent come last. This
#: changes the order of the shingles, hence the work, never the result. The table sent to tasks is 1 MB.
LOCAL_HOT = 6
HOT = 1 << 17
CHUNK_SHINGLES = 1_000_000
#: Pairs that a task remembers to have told; forgetting them only tells some twice.
MOST_TOLD = 1 << 20
#: Sets in one side of a tile.
CELL = 4096
#: With more partners left than this a set meets only the likeliest in the first round, one of a component and so many in all: a
#: group of near copies then makes pairs with its members, not with their square. The second round makes what is still apart.
LIKELIEST = 16
#: Tiles of a set, the first by shingle, that its rows carry. A pair that two sets could make in later tiles too is made in the
#: first one of both alone; beyond these tiles it may be made again, and none is lost.
TILES_KEPT = 32
#: Bits of the filter that keeps texts without a partner from being read again: 8 MB.
BITS = 1 << 26
CACHE_WORDS = 200_000
#: Longer words aren't remembered.
WORD_BYTES = 64
#: Bits of a hash that are left out where hashes only look for candidates. More candidates are harmless.
DROPPED = 20
#: Ids in one row of a tile's members.
MEMBERS = 1 << 16


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: dict[bytes, int], n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes. Words are runs of anything but ASCII white space, A-Z lower-cased."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(n, len(own))
    h = np.full(len(own) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9FB21C651E98DF25) + own[k : len(own) - size + 1 + k]
    h = np.sort(_mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def signature(s: np.ndarray, bits_each: int = 4) -> np.ndarray:
    """``bits_each`` bits or more for each shingle, a power of two of them; sets of like size have like signatures or one of half the size."""
    width = min(max(SIGNATURE, 1 << (bits_each * len(s) - 1).bit_length()), bits_each * SIGNATURE_MOST)
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def folded(bits: list[list[int]]) -> np.ndarray:
    """Signatures as rows of the same width: a longer one is the union of its halves."""
    out = [np.array(b, dtype=np.int64).view(np.uint64) for b in bits]
    width = min(map(len, out))
    return np.array([np.bitwise_or.reduce(b.reshape(-1, width)) for b in out])


def beginning(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles of a set, those in ``hot`` (sorted) last: one of them is in every set that is near."""
    size = len(s) - -(-NEAR * len(s) // 100) + 1
    if len(hot):
        common = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
        s = np.concatenate([s[~common], s[common]])
    return s[:size]


def _long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64) if a.dtype == np.uint64 else a


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*map(_long, arrays)]) if arrays else [], pa.int64()))


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted hashes as differences, and further columns of longs; compressed."""
    # Bytes of one weight stand together, so the high ones, mostly 0, cost nothing.
    planes = [np.uint64(len(keys)).tobytes()]
    planes += [c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (np.diff(keys, prepend=np.uint64(0)), *columns)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    n = int(raw[:8].view(np.uint64)[0])
    if not n:
        return [np.zeros(0, dtype=np.uint64)] * 3
    columns = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw[8:].reshape(-1, 8, n)]
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _need(n: np.ndarray) -> np.ndarray:
    """The least intersection with any partner."""
    return -(-NEAR * n // 100)


def _filter(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of BITS bits of a column of longs, as bytes."""
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in bitmap(keys, key, bits=BITS).collect():  # BITS / 8 bytes at most
        out[(row._bucket - 1) * 4096 : row._bucket * 4096] = np.frombuffer(bytes(row._bitmap), dtype=np.uint8)
    return out


def _spark_hash(values: np.ndarray) -> np.ndarray:
    """xxhash64 of longs with seed 42, as the engine's SQL function."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    roll = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.uint64(42) + p5 + np.uint64(8)
    h = h ^ (roll(values.view(np.uint64) * p2, 31) * p1)
    h = roll(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (_spark_hash(values).view(np.int64) % BITS).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: Rows of documents; of chunks (ids and set sizes); of shingles with the texts of a chunk that hold them; packed
#: shingles of a chunk in a range of hashes; for each document of a chunk, the shingles in a range that only it has.
DOCUMENT, CHUNK, FREQUENT, PACKED, OWN = range(5)
_MADE = "kind int, bucket int, chunk long, id long, n int, d1 long, d2 long, data binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("data", pa.binary())])


def _made(kind: int, rows: int, **columns: list | np.ndarray) -> pa.RecordBatch:
    columns |= {"kind": np.full(rows, kind)}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _ordered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes, sorted, and the number of the set that each is from."""
    every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    order = np.argsort(every)
    return every[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]


def _keys_of_partitions(spark: SparkSession) -> list[int]:
    """For each shuffle partition a number that the engine's hash sends there, so that ranges of hashes are dealt out evenly."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(40 * n + 1000).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    keys = {r.p: r.k for r in found.collect()}  # one for each partition
    return [keys.get(p, p) for p in range(n)]


def _split(columns: tuple[np.ndarray, ...], bits: int, buckets: list[int]) -> list[tuple[int, bytes]]:
    """Sorted hashes of ``bits`` bits and further columns, packed by range of hashes."""
    cuts = np.searchsorted(columns[0], np.array([(k << bits) // len(buckets) for k in range(1, len(buckets))], dtype=np.uint64))
    return [(k, pack(*x)) for k, x in zip(buckets, zip(*(np.split(c, cuts) for c in columns), strict=True), strict=True) if len(x[0])]


def _chunk(number: int, ids: list[int], sizes: list[int], packed: list[tuple[int, bytes]], buckets: list[int]) -> Iterator[pa.RecordBatch]:
    yield _made(CHUNK, 1, bucket=[buckets[number % len(buckets)]], chunk=[number], data=[np.array([ids, sizes], dtype=np.int64).tobytes()])
    yield _made(PACKED, len(packed), bucket=[k for k, _ in packed], chunk=[number] * len(packed), data=[x for _, x in packed])


def _sets(buckets: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each text, and what is counted of each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number, size, dealt = worker_table("words", Words), TaskContext.get().partitionId() << 32, 0, np.array(buckets)
        ids, sets = [], []

        def out() -> Iterator[pa.RecordBatch]:
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64) for s in sets]).reshape(-1, 2)
            yield _made(DOCUMENT, len(ids), bucket=dealt[digests[:, 0] % len(dealt)], id=ids, n=[len(x) for x in sets], d1=digests[:, 0], d2=digests[:, 1])
            real = [k for k, x in enumerate(ids) if x is not None and len(sets[k])]
            every, holder = _ordered([sets[k] for k in real])
            start = _runs(every)
            many = np.diff(np.append(start, len(every)))
            often = many >= LOCAL_HOT
            keys = _long(every[start[often]])
            yield _made(FREQUENT, len(keys), bucket=dealt[keys % len(dealt)], id=keys, n=many[often])
            lower = np.searchsorted(every, np.uint64(1 << 63))
            packed = _split((every[:lower] >> np.uint64(DROPPED), holder[:lower]), 63 - DROPPED, buckets)
            yield from _chunk(number, [ids[k] for k in real], [len(sets[k]) for k in real], packed, buckets)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(key)
                    sets.append(shingles(text or "", words))
                    size += len(sets[-1])
                if size >= CHUNK_SHINGLES:
                    yield from out()
                    number, size, ids, sets = number + 1, 0, [], []
        if ids:
            yield from out()

    return run


def _sets_of_components(buckets: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is counted of each chunk of classes (id, component, s): all hashes, with the component of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, components_, sets = [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            every, holder = _ordered(sets)
            columns = every >> np.uint64(DROPPED), holder, np.array(components_, dtype=np.int64)[holder]
            yield from _chunk(number, ids, [len(x) for x in sets], _split(columns, 64 - DROPPED, buckets), buckets)

        for batch in batches:
            for own, component, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids.append(own)
                components_.append(component)
                sets.append(unpack(s)[0])
                size += len(sets[-1])
            if size >= CHUNK_SHINGLES:
                yield from out()
                number, size, ids, components_, sets = number + 1, 0, [], [], []
        if ids:
            yield from out()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, but for packed ones: of those, how many hashes only it (or only its component) holds, for each document."""
    chunks: list[int] = []
    found: list[list[np.ndarray]] = []
    for batch in batches:
        packed = batch.column(0).to_numpy() == PACKED
        yield batch.filter(pa.array(~packed))
        mine = batch.filter(pa.array(packed))
        chunks += mine.column(2).to_pylist()
        found += map(unpack, mine.column(7).to_pylist())
    if not found:
        return
    key, holder, *component = (np.concatenate(x) for x in zip(*found, strict=True))
    source = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found])
    del found
    order = np.argsort(key)
    key = key[order]
    start = _runs(key)
    many = np.diff(np.append(start, len(key)))
    if component:
        of = component[0][order]
        alone = np.minimum.reduceat(of, start) == np.maximum.reduceat(of, start)
    else:
        alone = many == 1
    once = np.sort(order[np.repeat(alone, many)])
    source, holder = source[once], holder[once].astype(np.int64)
    each = np.searchsorted(source, np.arange(len(chunks) + 1))
    counts = [np.bincount(holder[each[k] : each[k + 1]]).astype(np.uint64) for k in range(len(chunks))]
    yield _made(OWN, len(chunks), chunk=chunks, data=[pack(np.zeros(len(c), dtype=np.uint64), c) for c in counts])


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the documents of each chunk that may have a partner."""
    ids: dict[int, np.ndarray] = {}
    sums: dict[int, np.ndarray] = {}
    sizes: dict[int, np.ndarray] = {}
    for batch in batches:
        for kind, chunk, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if kind == CHUNK:
                ids[chunk], sizes[chunk] = np.frombuffer(data, dtype=np.int64).reshape(2, -1)
            else:
                new = unpack(data)[1].astype(np.int64)
                old = sums.get(chunk, np.zeros(0, dtype=np.int64))
                new, old = (new, old) if len(new) >= len(old) else (old, new)
                new[: len(old)] += old
                sums[chunk] = new
    for chunk, n in sizes.items():
        own = np.zeros(len(n), dtype=np.int64)
        own[: len(sums.get(chunk, ()))] = sums.get(chunk, 0)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids[chunk][n - own >= _need(n)], pa.int64())})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are near, on sorted arrays."""
    for batch in batches:
        ok = np.zeros(batch.num_rows, dtype=bool)
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            x, y = unpack(x)[0], unpack(y)[0]
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            ok[k] = both and both * 100 >= NEAR * (len(x) + len(y) - both)
        yield batch.filter(pa.array(ok)).select([0, 1])


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose sets are near."""
    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return cut(joined.select("a", "b", "x", "y").mapInArrow(_near, "a long, b long").distinct())


def _stars(sets: DataFrame) -> DataFrame:
    """For each class the class to compare it with: of those most central for one of its min-hashes, the one that it shares most with.

    Central is whose min-hashes are the most common: an original has those of most of its copies, and is nearer
    to each of them than they are to each other.
    """
    members = sets.select(F.col("id").alias("class"), F.posexplode("least").alias("order", "hash"))
    groups = members.groupBy("order", "hash").agg(F.count("*").alias("many")).filter("many > 1")
    members = cut(members.join(groups, ["order", "hash"]))
    central = members.groupBy("class").agg(F.sum("many").alias("central"))
    members = cut(members.select("class", "order", "hash").join(central, "class"))
    centres = members.groupBy("order", "hash").agg(F.min_by("class", F.struct(-F.col("central"), "class")).alias("centre"))
    pairs = members.join(centres, ["order", "hash"]).filter("class != centre").groupBy("class", "centre").agg(F.count("*").alias("same"))
    pairs = pairs.groupBy("class").agg(F.max_by("centre", F.struct("same", -F.col("centre"))).alias("centre"))
    return pairs.select(F.col("class").alias("a"), F.col("centre").alias("b"))


def _beginnings(buckets: list[int], hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The shingles at the beginning of each set: packed by range of hashes; those in ``hot`` as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            key, own, comp = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            common = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), dtype=bool)
            order = np.flatnonzero(~common)[np.argsort(key[~common])]
            parts = _split((key[order] >> np.uint64(DROPPED), own[order].view(np.uint64), comp[order].view(np.uint64)), 64 - DROPPED, buckets)
            n, m = int(common.sum()), len(parts)
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([*(k for k, _ in parts), *[None] * n], pa.int32()), "packed": pa.array([*(x for _, x in parts), *[None] * n], pa.binary()),
                    "shingle": pa.array([*[None] * m, *_long(key[common]).tolist()], pa.int64()), "id": pa.array([*[None] * m, *own[common].tolist()], pa.int64()),
                    "component": pa.array([*[None] * m, *comp[common].tolist()], pa.int64()),
                }
            )

        for batch in batches:
            for own, comp, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                first = beginning(unpack(s)[0], hot)
                held.append((first, np.full(len(first), own), np.full(len(first), comp)))
                size += len(first)
            if size >= CHUNK_SHINGLES:
                yield out()
                size = 0
        if held:
            yield out()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of every shingle that several components have, one shingle only for the same ids.

    A partition holds whole ranges of hashes. Shingles that very many texts have aren't here: they are in ``hot``.
    """
    found = [unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
    if not found:
        return
    key, own, comp = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = np.lexsort((own, key))
    key, own, comp = key[order], own[order], comp[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    key, own, comp = key[new], own[new], comp[new]
    start = _runs(key)
    size = np.diff(np.append(start, len(key)))
    several = np.flatnonzero(np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start))
    if not len(several):
        return
    marks = [size[several].astype(np.uint64), *(np.add.reduceat(_mix(own ^ np.uint64(x)), start)[several] for x in (0, 0x5DEECE66D))]
    _, once = np.unique(np.array(marks), axis=1, return_index=True)
    for j in once.tolist():
        k = several[j]
        ids = own[start[k] : start[k] + size[k]]
        parts = [ids[at : at + MEMBERS].tobytes() for at in range(0, len(ids), MEMBERS)]
        values = [key[start[k]], *(m[j] for m in marks)]
        yield pa.RecordBatch.from_arrays([*(pa.array([int(v.view(np.int64))] * len(parts), pa.int64()) for v in values), pa.array(parts, pa.binary())], names=["shingle", "many", "m0", "m1", "ids"])


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shingle, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(ids, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.full(len(own), shingle)), "id": pa.array(own)})


def _tiles(best: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a partition's cells that the bit counts leave; with ``best`` only the likeliest of a set with each other component, if there are many.

    Rows come sorted by cell. In a cell of kind 0 sets of the tile's largest component meet the others; in one of
    kind 1 these others meet each other, and if i != j only the sides i and j do. ``rest``: pairs were left for later.
    """
    columns = ("shingle", "band", "kind", "i", "j", "side", "guest", "id", "component", "n", "bits", "tiles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in columns}
        told: set[tuple[int, int]] = set()

        def pairs() -> Iterator[pa.RecordBatch]:
            guest = np.array(held["guest"], dtype=bool)
            ids, comp, n, side = (np.array(held[k], dtype=np.int64) for k in ("id", "component", "n", "side"))
            apart = bool(held["i"]) and (held["kind"][0] == 0 or held["i"][0] != held["j"][0])
            bits = folded(held["bits"]) if len(ids) else None
            tiles = np.full((len(ids), TILES_KEPT), np.iinfo(np.int64).max)
            for at, own in enumerate(held["tiles"]):
                tiles[at, : len(own)] = own
            for k in np.flatnonzero(~guest):
                # Each pair once: a guest is always from the band below; hosts are compared with later hosts.
                other = np.flatnonzero((comp != comp[k]) & (guest | (np.arange(len(ids)) > k)) & (side != side[k] if apart else True))
                other = other[np.minimum(n[other], n[k]) * 100 >= np.maximum(n[other], n[k]) * NEAR]
                if not len(other):
                    continue
                lacks = np.bitwise_count(bits[k] & ~bits[other]).sum(axis=1, dtype=np.int64)
                more = np.bitwise_count(bits[other] & ~bits[k]).sum(axis=1, dtype=np.int64)
                most = np.minimum(n[k] - lacks, n[other] - more)
                left = most * (100 + NEAR) >= (n[k] + n[other]) * NEAR
                other, most = other[left], most[left]
                before = tiles[k][tiles[k] < held["shingle"][0]]
                if len(before):  # a pair that meets in an earlier tile is that one's
                    own = ~np.isin(tiles[other], before).any(axis=1)
                    other, most = other[own], most[own]
                rest = False
                if best and len(other) > LIKELIEST:
                    other = other[np.argsort((n[k] + n[other]) / (most + 1), kind="stable")]
                    _, first = np.unique(comp[other], return_index=True)
                    first = np.sort(first)[:LIKELIEST]
                    rest, other = len(first) < len(other), other[first]
                new = [p for p in zip(np.minimum(ids[other], ids[k]).tolist(), np.maximum(ids[other], ids[k]).tolist(), strict=True) if rest or p not in told]
                if new:
                    if len(told) > MOST_TOLD:
                        told.clear()
                    told.update(new)
                    yield pa.RecordBatch.from_pydict(
                        {"a": pa.array([a for a, _ in new], pa.int64()), "b": pa.array([b for _, b in new], pa.int64()), "rest": pa.array([rest] * len(new))}
                    )

        last = None
        for batch in batches:
            values = [batch.column(k).to_pylist() for k in range(len(columns))]
            for row in zip(*values, strict=True):
                if row[:5] != last:
                    yield from pairs()
                    last = row[:5]
                    for v in held.values():
                        v.clear()
                for k, v in zip(columns, row, strict=True):
                    held[k].append(v)
        yield from pairs()

    return run


def _compared(members: DataFrame, component: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """a, b, rest of the pairs of different components that meet in a tile and that the bit counts leave.

    ``members``: shingle, id. ``component``: id, n, component.
    """
    # Bands grow by the least ratio of linked sizes; a set is host in its own band and guest in the next one.
    band = F.floor(F.log(100 / NEAR, F.col("n"))).cast("int")
    places = [F.struct((band + k).alias("band"), F.lit(bool(k)).alias("guest")) for k in (0, 1)]
    tiles = members.join(component, "id").withColumn("place", F.explode(F.array(*places)))
    tiles = cut(tiles.select("shingle", "place.*", "id", "component", "n"))
    # Two texts that share a passage share many shingles: of tiles with the same members one is enough.
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "id", "guest")).alias(f"x{k}") for k in (1, 2)]
    open_ = tiles.groupBy("shingle", "band", "component").agg(F.count("*").alias("many"), F.min("guest").alias("none"), *sums)
    open_ = open_.groupBy("shingle", "band").agg(
        F.sum("many").alias("many"), F.max("many").alias("most"), F.max_by("component", F.struct("many", "component")).alias("major"),
        F.count("*").alias("components"), F.min("none").alias("none"), *(F.bit_xor(f"x{k}").alias(f"x{k}") for k in (1, 2)),
    )
    chosen = open_.filter("components > 1 and not none").groupBy("band", "many", "x1", "x2").agg(F.min_by(F.struct("shingle", "most", "major", "components"), "shingle").alias("s"))
    sides = [F.ceil(F.expr(c) / CELL).cast("int") for c in ("s.most", "many - s.most")]
    chosen = chosen.select("band", "s.shingle", "s.major", F.col("s.components").alias("components"), sides[0].alias("sides"), sides[1].alias("others"))
    # A tile of many sets is cut into cells, so no task holds more than two sides. The largest component's sets are in
    # one cell each; the others are in all of those, and in one cell for each two of their own sides.
    rows = cut(tiles.join(chosen, ["shingle", "band"]).withColumn("at", F.xxhash64(F.lit(3), "id")))
    # Sets that share many shingles meet in many tiles; each knows its first ones, so that most pairs are made in one alone.
    first = rows.groupBy("id", "band").agg(F.slice(F.array_sort(F.collect_set("shingle")), 1, TILES_KEPT).alias("tiles"))
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    major = F.array(cell(0, F.pmod("at", F.col("sides")), F.lit(0), F.lit(0)))
    across = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda k: cell(0, k, F.lit(0), F.lit(1)))
    side = F.pmod("at", F.col("others"))
    among = F.when(F.col("components") > 2, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: cell(1, F.least(side, k), F.greatest(side, k), side))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int,side:int>>"))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("component") == F.col("major"), major).otherwise(F.concat(across, among))))
    keys = ["shingle", "band", "kind", "i", "j"]
    rows = rows.select("shingle", "band", "cell.*", "guest", "id", "component", "n").join(sets.select("id", "bits"), "id").join(first, ["id", "band"])
    rows = rows.select(*keys, "side", "guest", "id", "component", "n", "bits", "tiles").repartition(*keys).sortWithinPartitions(*keys, "id")
    return cut(rows.mapInArrow(_tiles(best), "a long, b long, rest boolean").groupBy("a", "b").agg(F.max("rest").alias("rest")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id`` (the smallest id reachable by links, itself included).

    Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of 0.75 or more.
    A text of fewer words has one shingle, the whole of it; a null text or one without words has none and is
    linked with nothing. Whole texts are read, however long. Repeated rows of an id are one document; ties don't
    arise, as every link counts. A row without an id has no component. Other columns aren't read, whatever their
    names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = _keys_of_partitions(spark)
    partitions = len(buckets)
    made = cut(texts.mapInArrow(_sets(buckets), _MADE).repartition(partitions, "bucket").mapInArrow(_counted, _MADE))
    rows = made.filter(F.col("kind") == DOCUMENT).select("id", "n", "d1", "d2")

    def partnered(made: DataFrame) -> DataFrame:
        chunks = made.filter(F.col("kind").isin(CHUNK, OWN)).select("kind", "chunk", "data")
        return chunks.repartition("chunk").mapInArrow(_partnered, "id long").distinct()

    classes = cut(rows.filter("n > 0 and id is not null").join(partnered(made), "id").groupBy("d1", "d2").agg(F.min("id").alias("class"), F.min("n").alias("n")))
    hot = made.filter(F.col("kind") == FREQUENT).groupBy(F.col("id").alias("shingle")).agg(F.sum("n").alias("texts"))
    hot = np.sort(at_least(hot, "texts", HOT).select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))  # HOT rows at most
    wanted = spark.sparkContext.broadcast(_filter(classes.select("class"), "class"))

    def classes_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = worker_table("words", Words), wanted.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                keep = np.flatnonzero(_held(bits, own))
                sets = [shingles(t or "", words) for t in part.column(1).take(pa.array(keep)).to_pylist()]
                least = [(s[None, :] * FACTORS[:, None]).min(axis=1) if len(s) else s for s in sets]
                yield pa.RecordBatch.from_pydict({"id": pa.array(own[keep]), "least": _lists(least), "bits": _lists([signature(s) for s in sets]), "s": pa.array([pack(s) for s in sets], pa.binary())})

    sets = cut(texts.filter("id is not null").mapInArrow(classes_sets, "id long, least array<long>, bits array<long>, s binary"))
    wanted.destroy()
    links = _verified(sets, _stars(sets))

    def named(found: DataFrame) -> DataFrame:
        """id, n and component of each class. ``found``: id, component of those in a link."""
        rows = classes.select(F.col("class").alias("id"), "n").join(found, "id", "left")
        return cut(rows.select("id", "n", F.coalesce("component", "id").alias("component")))

    # Here a set goes by its centre's centre: sets of one name are linked, which is all that is asked of a component.
    centre = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    above = links.select(F.col("a").alias("component"), F.col("b").alias("above"))
    component = named(centre.join(above, "component", "left").select("id", F.coalesce("above", "component").alias("component")))
    # What may have a partner outside its component, by all hashes this time.
    joined = cut(sets.select("id", "s").join(component, "id").select("id", "component", "s"))
    counted = joined.mapInArrow(_sets_of_components(buckets), _MADE).repartition(partitions, "bucket").mapInArrow(_counted, _MADE)
    sent = joined.join(cut(partnered(counted)), "id").select("id", "component", "s")
    begun = cut(sent.mapInArrow(_beginnings(buckets, hot), "bucket int, packed binary, shingle long, id long, component long"))
    rare = begun.filter("bucket is not null").select("bucket", "packed").repartition(partitions, "bucket")
    rare = cut(rare.mapInArrow(_shared, "shingle long, many long, m0 long, m1 long, ids binary"))
    same = ["many", "m0", "m1"]
    rare = rare.join(rare.groupBy(*same).agg(F.min("shingle").alias("shingle")), [*same, "shingle"]).select("shingle", "ids").mapInArrow(_unfolded, "shingle long, id long")
    common = begun.filter("bucket is null").select("shingle", "id", "component").distinct()
    several = common.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("shingle")
    members = cut(rare.unionByName(common.select("shingle", "id").join(several, "shingle")))
    for best in (True, False):
        pairs = _compared(members, component, sets, best)
        links = links.unionByName(_verified(sets, pairs))
        component = named(components(links).withColumnRenamed("node", "id"))
        if not best or pairs.filter("rest").isEmpty():
            break

    named_ = cut(classes.select("d1", "d2", F.col("class").alias("id")).join(component.select("id", "component"), "id").select("d1", "d2", "component"))
    out = rows.join(named_, ["d1", "d2"], "left")
    component_id = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component_id.alias("component_id"))
