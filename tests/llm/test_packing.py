"""Packing against the tokenizer's library and the sums that sequences must have."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievekit.llm import packing, queries

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
AWKWARD = [
    None, "", " ", "\n\n\t", "word " * 9_000, "x" * 30_000, "É é ́a", "a\x00b\x1cc\x85d　e", "日本語 🎉 text", "<|endoftext|> a<|startoftext|>b",
    "İSTANBUL ΣΑΣ ﬁn", "it's we'll ' s", "a  b c",
]


def rows_of(spark, texts, source=lambda k: "s", first=0):
    df = spark.createDataFrame([(first + k, t, source(k)) for k, t in enumerate(texts)], "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in ("part", "seq", "id", "n", "tokens", "ids", "start", "offset", "share", "lengths")})


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(df, out, window=4096):
    """Each id in one piece, sequences without gaps, padding of nothing."""
    texts = collections.defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r.doc_id].append(ids_of(r.text))
    cover, lengths, total = collections.Counter(), collections.defaultdict(list), 0
    for r in out:
        ids = texts[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        cover.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        lengths[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert cover == collections.Counter((d, k) for d, copies in texts.items() for ids in copies for k in range(len(ids)))
    sizes = []
    for number in sorted(lengths):
        end = 0
        for offset, length in sorted(lengths[number]):
            assert offset == end
            end += length
        sizes.append(end)
    assert sorted(lengths) == list(range(len(sizes)))
    rest = [1 << k for k in range(window.bit_length() - 2, -1, -1) if total % window >> k & 1]
    assert sizes == [window] * (total // window) + rest


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "Word", "naïve", "42", "end.", "x-y", "\n", "", "don't", "größe"]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 50, 400]))) for _ in range(n)]


def test_pieces_hold_each_id_once(spark):
    df = rows_of(spark, AWKWARD + random_texts(120), lambda k: [None, "a", "b", "whole"][k % 4])
    df = df.unionByName(df.filter("doc_id in (4, 20)"))
    out = packing.pack(df, block_tokens=5_000).collect()
    check(df, out)
    check(df, packing.pack(df, window=64, block_tokens=700, least_piece=8).collect(), 64)


def test_every_window_has_the_mixture(spark):
    """A hot source, stored apart from the others: every prefix of windows holds each source's share to within a piece and what blocks lack."""
    n = 900
    source = lambda k: "hot" if k < 600 else "b" if k < 850 else "rare"
    df = rows_of(spark, random_texts(n, 5), source).repartitionByRange(4, "doc_id")
    out = packing.pack(df, window=256, least_piece=32, block_tokens=20_000).collect()
    check(df, out, 256)
    of = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    served = collections.defaultdict(collections.Counter)
    for r in out:
        served[r.sequence_id][of[r.doc_id]] += r.length
    total = sum((c for c in served.values()), collections.Counter())
    share = {s: v / total.total() for s, v in total.items()}
    sums, most = collections.Counter(), 0
    for number in sorted(served):
        sums += served[number]
        most = max(most, *(abs(sums[s] - share[s] * sums.total()) for s in share))
    assert most < 0.04 * sums.total()  # a block of 20,000 tokens may lack some of a source's share; stored order would give 0.3
    single = packing.round_robin(["a"] * 40 + ["b"] * 20 + ["c"], [100] * 60 + [50], {"a": (4000, 0), "b": (2000, 0), "c": (50, 0)}, 6050, 0, 6050, 64, 8)
    sums = collections.Counter()
    for doc, _, length, place in single:
        sums["a" if doc < 40 else "b" if doc < 60 else "c"] += length
        if (place + length) % 64 == 0 and place + length < 5500:
            assert all(abs(sums[s] - w / 6050 * (place + length)) <= 8 + 1 for s, w in (("a", 4000), ("b", 2000), ("c", 50)))


def test_weights_of_ones_own(spark):
    """Asked for even parts, windows are even until the smaller source ends."""
    pieces = packing.round_robin(["a"] * 30 + ["b"] * 10, [301] * 40, {"a": (1, 0), "b": (1, 0)}, 2, 0, 40 * 301, 256, 16)
    assert abs(sum(length for doc, _, length, place in pieces if doc < 30 and place < 20 * 256) - 20 * 128) <= 16
    df = rows_of(spark, ["word " * 300] * 40, lambda k: "ab"[k > 30] if k else "no weight")
    check(df, packing.pack(df, window=256, least_piece=16, weights={"a": 1, "b": 1}, block_tokens=2000).collect(), 256)


def test_nothing_one_and_powers_of_two(spark):
    df = rows_of(spark, ["a"])
    assert packing.pack(df.filter("false")).collect() == []
    check(df, packing.pack(df).collect())
    check(df.filter("false").unionByName(rows_of(spark, ["a"] * 4)), packing.pack(rows_of(spark, ["a"] * 4)).collect())
    assert packing.pack(spark.createDataFrame([(None, "a", None)], "doc_id long, text string, source string")).count() == 1
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(df, window=100)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{path}/documents.parquet"), queries.QUERIES["op13_packing"](spark, path).collect())
