"""The trie of conversation prefixes, built from sorted shards and a skeleton of the paths that part them.

A turn becomes an element of fixed size, the digest of its role and text and the text's bytes; a conversation becomes its path,
the elements in order. Paths are dealt to shards by ranges. A node whose members lie in more than one shard is a prefix of
one of the splitters' paths; these nodes, the skeleton, are known before anything is counted, and their trie is broadcast.
Each shard reads its paths in order with a stack of the nodes that are open: it finishes every node off the skeleton, and of
skeleton nodes it makes partial sums, which a reduction combines.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sievekit.llm.common import written

#: Bytes of an element: 16 of a digest, 4 of the length in bytes of the turn's text.
DIGEST, ELEMENT = 16, 20
#: Turns that a conversation takes over from the first of its block of five are below this.
HEAD = 9
BLOCK = 5
#: Sampled paths for each shard, bytes of all that are collected, and nodes of the skeleton at most. Of sampled paths only
#: as many leading elements come to the driver as fit; a group that is equal for longer than that stays in one shard.
SAMPLED, SAMPLE_BYTES, SKELETON_NODES = 16, 32_000_000, 100_000
#: Shards are as many as shuffle partitions, and never more than this.
MOST_SHARDS = 4096
#: Bytes of joined ids in one row on the way to a digest.
CHUNK = 1 << 15


def paths(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id`` and ``path`` of each rebuilt conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    size = F.octet_length(text)
    element = F.concat(F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))), F.unhex(F.lpad(F.hex(size), 8, "0")))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), element.alias("element"))
    # An array of structs is sorted by its fields, nulls first: by turn, and equal turns by role and element.
    own = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "element"))).alias("turns"))
    own = written(own.select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t["element"])), "").alias("hex")).select("conv_id", F.unhex("hex").alias("path")))
    heads = own.select(F.col("conv_id").alias("first"), F.substring("path", 1, (HEAD - 1) * ELEMENT).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD)) * ELEMENT
    joined = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "first", "left").withColumn("h", h.cast("int"))
    rest = F.expr("if(h < length(path), substring(path, h + 1, length(path)), cast('' as binary))")
    return joined.select("conv_id", F.concat(F.coalesce(F.expr("substring(head, 1, h)"), F.lit(b"")), rest).alias("path"))


def splitters(rows: DataFrame, shards: int, sampled: int = SAMPLED, most_bytes: int = SAMPLE_BYTES, most_nodes: int = SKELETON_NODES) -> list[tuple[bytes, int]]:
    """Bounds between shards as (path, conv_id), sorted: a shard begins with the first row at or after its bound.

    Where neighbours in the sample have different paths the bound is the shorter path that parts them, so only bounds within a
    group of equal paths are whole ones. The sample is bounded by rows and bytes; it decides only how evenly shards are filled.
    """
    total = rows.count()
    want = min(shards * sampled, total)
    if shards < 2 or not want:
        return []
    length = max(1, most_bytes // (2 * want * ELEMENT)) * ELEMENT
    part = rows.filter(F.pmod(F.xxhash64(F.lit(5), "conv_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / total)) + 1)
    found = part.select("conv_id", F.substring("path", 1, length).alias("path"), (F.length("path") > length).alias("cut")).limit(2 * want).collect()
    found = sorted((bytes(r.path), r.conv_id, r.cut) for r in found)
    bounds: list[tuple[bytes, int]] = []
    nodes = 0
    for k in range(1, shards):
        at = k * len(found) // shards
        if at == 0:
            continue
        (before, _, _), (path, conv_id, cut) = found[at - 1], found[at]
        same = common(before, path)
        if before != path:
            bound = (path[: same + ELEMENT], -(1 << 63))
        elif not cut:
            bound = (path, conv_id)
        else:
            continue  # equal for longer than what was sampled of them
        if bounds and bounds[-1] >= bound:
            continue
        new = (len(bound[0]) - (common(bounds[-1][0], bound[0]) if bounds else 0)) // ELEMENT
        if nodes + new <= most_nodes:
            nodes += new
            bounds.append(bound)
    return bounds


def common(a: bytes, b: bytes) -> int:
    """Bytes of the elements that two paths share at their beginning."""
    low, high = 0, min(len(a), len(b)) // ELEMENT
    if a[: high * ELEMENT] == b[: high * ELEMENT]:
        return high * ELEMENT
    while low < high:  # the shared elements are low at least and below high
        mid = (low + high + 1) // 2
        if a[: mid * ELEMENT] == b[: mid * ELEMENT]:
            low = mid
        else:
            high = mid - 1
    return low * ELEMENT


def size_of(element: bytes) -> int:
    return struct.unpack(">I", element[DIGEST:])[0]


class Skeleton:
    """The trie of the splitters' paths: the root is 0; of each node its parent, depth and text bytes."""

    def __init__(self, bounds: list[tuple[bytes, int]]):
        self.bounds = bounds
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.size = [-1], [0], [0]
        for path, _ in bounds:
            at = 0
            for k in range(0, len(path), ELEMENT):
                key = (at, path[k : k + ELEMENT])
                if (node := self.child.get(key)) is None:
                    node = self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.size.append(size_of(key[1]))
                at = node


class _Node:
    __slots__ = ("children", "digest", "first", "leaves", "members", "piece", "saved", "size", "skeleton")

    def __init__(self, size: int, skeleton: int):
        self.size, self.skeleton = size, skeleton
        self.members = self.children = self.leaves = self.saved = 0
        self.first, self.digest, self.piece = None, None, None


#: A row of a shard: a finished node (skeleton -1; parent_skeleton 0 or more where the parent is one of the skeleton, and
#: parent_conv_id where not), a skeleton node's partial sums, or a piece of its ends (then ``piece`` is set).
_ROW = (
    "skeleton int, parent_skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece string"
)
_EMPTY = hashlib.sha256(b"").hexdigest()


class Shard:
    """Nodes of one shard from its paths in order. ``rows`` holds those that are done, as tuples in the order of _ROW.

    A finished node waits for its parent's smallest member, as one number; so what is held is the stack, and of the children
    of open nodes the finished rows, which go once their parent is closed (a skeleton parent's at once).
    """

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.rows = skeleton, []
        self.path = b""
        self.stack = [_Node(0, 0)]
        self.waiting: list[list[tuple]] = [[]]

    def add(self, path: bytes, conv_id: int) -> None:
        keep = common(self.path, path) // ELEMENT
        while len(self.stack) - 1 > keep:
            self._close()
        for k in range(keep * ELEMENT, len(path), ELEMENT):
            element, above = path[k : k + ELEMENT], self.stack[-1].skeleton
            self.stack.append(_Node(size_of(element), self.skeleton.child.get((above, element), -1) if above >= 0 else -1))
            self.waiting.append([])
        self.path = path
        node = self.stack[-1]
        node.members += 1
        node.first = conv_id if node.first is None else min(node.first, conv_id)
        self._end(node, conv_id)

    def _end(self, node: _Node, conv_id: int) -> None:
        if node.skeleton < 0:
            if node.digest is None:
                node.digest = hashlib.sha256(str(conv_id).encode())
            else:
                node.digest.update(f",{conv_id}".encode())
        else:
            node.piece = node.piece or (conv_id, [], 0)
            first, ids, size = node.piece
            ids.append(str(conv_id))
            node.piece = first, ids, size + len(ids[-1]) + 1
            if node.piece[2] >= CHUNK:
                self._piece(node)

    def _piece(self, node: _Node) -> None:
        if node.piece:
            self.rows.append((node.skeleton, None, node.piece[0], None, None, None, None, None, None, None, ",".join(node.piece[1])))
            node.piece = None

    def _close(self) -> None:
        depth = len(self.stack) - 1
        node, above, waiting = self.stack.pop(), self.stack[-1] if depth else None, self.waiting.pop()
        self.rows += [(*r[:4], node.first, *r[5:]) for r in waiting]
        if node.skeleton >= 0:
            # members x size now; the skeleton's one times size and its leaves follow when all shards are known
            node.saved += node.members * node.size
            self._piece(node)
            self.rows.append((node.skeleton, None, node.first, depth, None, node.members, node.children, node.leaves, node.saved, None, None))
        else:
            node.leaves += node.children == 0
            node.saved += (node.members - 1) * node.size
            ends = node.digest.hexdigest() if node.digest else _EMPTY
            row = (-1, above.skeleton, node.first, depth, None, node.members, node.children, node.leaves, node.saved, ends, None)
            if above.skeleton >= 0:
                self.rows.append(row)
            else:
                self.waiting[-1].append(row)
            above.children += 1
        if above:
            above.members += node.members
            above.leaves += node.leaves
            above.saved += node.saved
            if above.first is None or node.first is not None and node.first < above.first:
                above.first = node.first

    def finish(self) -> None:
        while self.stack:
            self._close()


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of skeleton nodes' ends from their pieces in order."""
    node, digest = None, None
    for batch in batches:
        for skeleton, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if skeleton != node:
                if digest:
                    yield pa.RecordBatch.from_pydict({"skeleton": pa.array([node], pa.int32()), "ends_sha256": [digest.hexdigest()]})
                node, digest = skeleton, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if digest:
        yield pa.RecordBatch.from_pydict({"skeleton": pa.array([node], pa.int32()), "ends_sha256": [digest.hexdigest()]})


def _skeleton_rows(spark: SparkSession, partial: DataFrame, pieces: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Whole skeleton nodes from the reduced partial sums: at most SKELETON_NODES rows come to the driver.

    Their own leaves, children and the one copy of each text that isn't saved are added up along the skeleton.
    """
    sums = partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    ends = pieces.repartition("skeleton").sortWithinPartitions("skeleton", "conv_id").mapInArrow(_digest_pieces, "skeleton int, ends_sha256 string")
    found = {r.skeleton: r for r in sums.join(ends, "skeleton", "left").collect()}
    children, leaves, once = ({n: 0 for n in found} for _ in range(3))
    for node in sorted(found, reverse=True):  # a child's number is greater than its parent's
        above = skeleton.parent[node]
        leaves[node] += children[node] + found[node].n_children == 0
        once[node] += skeleton.size[node]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[node]
            once[above] += once[node]
    rows = [
        (
            n, r.conv_id, skeleton.depth[n], found[skeleton.parent[n]].conv_id if n else None, r.n_convs, children[n] + r.n_children,
            leaves[n] + r.n_leaves, r.saved_tokens - once[n], r.ends_sha256 or _EMPTY,
        )
        for n, r in found.items()
    ]
    return spark.createDataFrame(rows, "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(
    turns: DataFrame, shards: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", sampled: int = SAMPLED
) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, with the columns of COLUMNS.

    Turns are ordered by ``turn``, null first; equal ones by role, then by the digest of role and text; rows repeated whole are
    turns of their own. Null roles and texts are empty. Rows without a conversation's id belong to none and are left out; other
    columns aren't read. An empty table has no conversations and so no node, not even a root. Texts stay where they are: what
    is shuffled of a turn is an element of 20 bytes. Two turns are the same if the MD5 of role and text is.
    """
    spark = turns.sparkSession
    rows = written(paths(turns, conv_col, turn_col, role_col, text_col))
    shards = min(MOST_SHARDS, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = _parse_datatype_string(_ROW)
    sent = spark.sparkContext.broadcast(Skeleton(splitters(rows, shards, sampled)))  # SKELETON_NODES nodes and MOST_SHARDS bounds at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value.bounds
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(bounds, (p, c)) for c, p in zip(ids, found, strict=True)], pa.int32())], names=["conv_id", "path", "shard"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(row)
        shard = None

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*shard.rows, strict=True), arrow, strict=True)], schema=arrow)
            shard.rows = []
            return out

        for batch in batches:
            for conv_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = shard or Shard(sent.value)
                shard.add(path, conv_id)
                if len(shard.rows) >= 10_000:
                    yield done()
        if shard:
            shard.finish()
            yield done()

    dealt = rows.mapInArrow(place, "conv_id long, path binary, shard int").repartitionById(max(1, len(sent.value.bounds) + 1), "shard")
    made = written(dealt.sortWithinPartitions("path", "conv_id").select("conv_id", "path").mapInArrow(build, row))
    partial = made.filter("skeleton >= 0 and piece is null")
    whole = _skeleton_rows(spark, partial, made.filter("piece is not null").select("skeleton", "conv_id", "piece"), sent.value)
    parents = F.broadcast(whole.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above")))  # SKELETON_NODES rows at most
    rest = made.filter("skeleton < 0").join(parents, "parent_skeleton", "left")
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return whole.select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def oracle() -> str:
    """SQL for DuckDB over ``conversations``; CRC-32 bit by bit, and the sums of subtrees by all pairs of a node and one above it."""
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, element, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, element) AS k
  FROM (SELECT conv_id, turn, role, strlen(text) AS size, md5(strlen(role)::VARCHAR || ':' || role || text) AS element FROM turns)),
convs AS (SELECT conv_id, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM turns)),
rebuilt AS (
  SELECT conv_id, element, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM (
    SELECT c.conv_id, element, size, 0 AS part, k FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND k <= h
    UNION ALL SELECT c.conv_id, element, size, 1, k FROM convs c JOIN own o ON o.conv_id = c.conv_id AND k > h)),
members AS (
  SELECT conv_id, depth, size, md5(string_agg(element, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
steps AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM members),
nodes AS (
  SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(size) AS size,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY node),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM nodes n
  LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN (SELECT parent, count(*) AS n FROM nodes GROUP BY parent) c ON c.parent = n.node),
sums AS (
  SELECT m.node, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM counted n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (node)
"""
