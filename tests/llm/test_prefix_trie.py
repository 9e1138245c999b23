"""The trie against a brute force over all prefixes, and its SQL."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sievekit.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(role, text) for _, role, _, text in sorted(x)] for c, x in own.items()}
    built = {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + x[h:] for c, x in own.items()}
    members = collections.defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(node[:-1] for node in members if node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    ends = {n: ",".join(str(c) for c in m if len(built[c]) == len(n)) for n, m in members.items()}
    return collections.Counter(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()
    )


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("path", "element", "shard", "first", "h", "depth", "skeleton")})
    return collections.Counter(tuple(r[c] for c in prefix_trie.COLUMNS) for r in prefix_trie.prefix_trie(df, **options).collect())


def random_rows(seed, convs=120, copies=30):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), convs):
        for turn in range(rng.choice([1, 2, 3, 12, 30])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "a", "é", "ab", "b"])))
    rows += [(c, t, "user", "same") for c in range(2000, 2000 + copies) for t in range(12)]  # a group of copies, with one first turn
    rows += [(3000 + c, t, "user", "same" if t < 11 else str(c)) for c in range(copies) for t in range(13)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_trie(spark, shards):
    rows = random_rows(shards)
    rows += rows[:5]
    assert made(spark, rows, shards=shards) == brute(rows)


def test_hard_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 0, None, "a"), (7, 0, "", "a"), (7, 0, "a", ""), (9, 1, "user", "x" * 300_000), (9, 1, "user", "x" * 300_000), (-3, 0, "user", "x"), (5, 0, "r", "y\x00z")]
    rows += [(11, t, "user", "deep") for t in range(300)] + [(12, t, "user", "deep") for t in range(280)]
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == collections.Counter()
    assert made(spark, [(None, 1, "user", "a")]) == collections.Counter()
    assert made(spark, [(3, 1, "user", "a")]) == brute([(3, 1, "user", "a")])


def test_long_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    rows = [(c, 0, "user", "one") for c in range(500)]
    assert made(spark, rows, shards=9) == brute(rows)


def test_bounds_are_few_and_short(spark):
    rows = spark.createDataFrame([(c, bytes([c % 3]) * 20 * 50 + bytes([c % 2]) * 20) for c in range(600)], "conv_id long, path binary")
    assert len(prefix_trie.splitters(rows, 6)) == 5
    assert all(len(path) == 20 for path, _ in prefix_trie.splitters(rows, 3, most_bytes=1)[:2])  # only one element of each comes to the driver
    assert len(prefix_trie.splitters(rows, 6, most_nodes=60)) < 5
    assert prefix_trie.splitters(rows.filter("false"), 6) == []


def test_common():
    a = bytes(range(200)) * 2
    for k in range(0, 401, 7):
        b = a[:k] + b"\xff" * (400 - k)
        assert prefix_trie.common(a, b) == k // 20 * 20
    assert prefix_trie.common(a, a[:60]) == 60 and prefix_trie.common(b"", a) == 0


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet')")
        wanted = collections.Counter(db.sql(queries.ORACLES["op11_prefix_trie"]).fetchall())
    out = queries.QUERIES["op11_prefix_trie"](spark, path)
    assert out.columns == list(prefix_trie.COLUMNS) and collections.Counter(map(tuple, out.collect())) == wanted
