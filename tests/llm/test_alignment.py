"""The alignment against the libraries on whole texts and all pairs of tokens."""

import collections
import hashlib
import random
from itertools import accumulate

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from sievekit.llm import alignment, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ALIGNER = alignment.Aligner(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())

AWKWARD = [
    None, "", " ", "\n", "\n\n\t", " a", "a ", "a\n", "\na", "a  b \n c\n\nd", "word " * 2000, "x" * 3000, "é" * 500, "a\x00b\x1cc\x85d　e f", "日本語 🎉 text\nnext 👍🏽",
    "<|endoftext|> a </s><s> <unk> <0x41>", "a ▁ b", "▁a", "it's we'll\n's 's", "tab\tand\r\nmore", "The end.", "The end.", "ﬁ ́a é",
]


def tokens(text):
    """Ids and bytes of both sides, from the libraries and whole texts."""
    enc = A.encode(" " + text, add_special_tokens=False)
    plain = ByteLevel()
    a_bytes = []
    for k in range(len(enc.ids)):  # a token's bytes by the characters that the byte-level alphabet gives it
        a_bytes.append(alignment.byte_level({enc.tokens[k]: 0})[0])
    assert plain.decode(enc.tokens).lstrip(" ") == (" " + text).lstrip(" ") or "\x00" in text or "�" in plain.decode(enc.tokens)
    b_ids = B.encode(text)
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    return enc.ids, a_bytes, b_ids, b_bytes


def brute(texts):
    rows, holders = [], collections.defaultdict(set)
    for n, text in enumerate(texts):
        links, groups, a, b = [], "", [], []
        if text:
            a, a_bytes, b, b_bytes = tokens(text)
            if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
                a, b = [], []
            a_ends, b_ends = list(accumulate(map(len, a_bytes[: len(a)]))), list(accumulate(map(len, b_bytes[: len(b)])))
            cuts = sorted(set(a_ends) & set(b_ends))
            links = [(i, j) for i, e, x in zip(a, a_ends, a_bytes, strict=False) for j, f, y in zip(b, b_ends, b_bytes, strict=False) if e - len(x) < f and f - len(y) < e]
            parts, at = [], 0
            for cut in cuts:
                parts.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if at < e <= cut) for ids, ends in ((a, a_ends), (b, b_ends))))
                at = cut
            groups = ";".join(parts)
            for x in links:
                holders[x].add(n)
        rows.append((len(a), len(b), groups.count("|"), links, groups))
    count = {x: len(h) for x, h in holders.items()}
    best = collections.defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [
        (n, a, b, g, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for n, (a, b, g, links, groups) in enumerate(rows)
    ]


def frame(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("run", "cell", "head", "body", "docs", "id", "n_a")})


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_texts(n=60, seed=4):
    rng = random.Random(seed)
    words = ["the", "Alignment", "naïve", "42", "end.", "x-y", "don't", "größe", "Öl,", "ü", "tokenizers", "日本"]
    return [rng.choice([" ", " ", "\n", "  "]).join(rng.choices(words, k=rng.choice([1, 4, 30]))) for _ in range(n)]


def test_aligned(spark):
    texts = AWKWARD + random_texts()
    out = alignment.aligned(frame(spark, texts)).select(COLUMNS)
    assert sorted(map(tuple, out.collect())) == brute(texts)
    many = alignment.aligned(frame(spark, texts).repartition(7), cells=64, run_links=50).select(COLUMNS)
    assert sorted(map(tuple, many.collect())) == brute(texts)


def test_long_texts_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHARS_AT_ONCE", 40)
    runs = alignment.Runs(ALIGNER, 64)
    texts = [t for t in AWKWARD if t and len(t) < 1500] + random_texts(30)
    rows = [r for k, t in enumerate(texts) for r in runs.add([k], [t])] + list(runs.flush())
    docs = {d[0]: d[1:] for r in rows for d in r["docs"] or []}
    assert [(k, *docs[k]) for k in range(len(texts))] == [(r[0], *r[1:4], r[7]) for r in brute(texts)]
    links = {}
    for r in rows:
        if r["docs"]:
            _, owner, counts = alignment.unpacked(r["body"])
            links |= {d[0]: int(counts[owner == k].sum()) for k, d in enumerate(r["docs"])}
    assert [links[k] for k in range(len(texts))] == [r[4] for r in brute(texts)]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="ab.é \n\t'"), st.text(alphabet="a \n▁")))
def test_words_hold_the_libraries_tokens(text):
    """Cut into words, both sides have the tokens of the whole text, and chunks have the same words."""
    if not text or "▁" in text:
        return
    words = alignment.words_of(text)
    assert "".join(w if w[0].isspace() else " " + w for w in words) == " " + text
    a, _, b, _ = tokens(text)
    rows = ALIGNER.store.rows(words)
    sums = ALIGNER.numbers.take(rows)[0].reshape(-1, 4).sum(axis=0)
    assert (*sums[:2], sums[3]) == (len(a), len(b), len(words))
    assert [w for part in alignment.chunks_of(text, 3) for w in part] == words


def test_heap_merge_of_runs():
    rng = random.Random(9)
    runs = {k: {(rng.randrange(5), rng.randrange(6)): rng.randrange(1, 400) for _ in range(rng.randrange(12))} for k in range(20)}
    heads = []
    for k, pairs in runs.items():
        codes = np.array(sorted(a << 32 | b for a, b in pairs), np.uint64)
        heads.append((k, alignment.packed(np.diff(codes, prepend=np.uint64(0)), np.array([pairs[int(c) >> 32, int(c) & 0xFFFFFFFF] for c in codes], np.int64))))
    total = sum(map(collections.Counter, runs.values()), collections.Counter())
    best = {a: max(n for (x, _), n in total.items() if x == a) for a, _ in total}
    for k, answer in alignment.merged(heads):
        assert alignment.unpacked(answer)[0].tolist() == [2 * total[p] + (total[p] == best[p[0]]) for p in sorted(runs[k])]


def test_nothing_and_repeated_rows(spark):
    assert alignment.aligned(frame(spark, ["a"]).filter("false")).collect() == []
    df = frame(spark, ["The end.", None])
    out = sorted(map(tuple, alignment.aligned(df.unionByName(df)).select(COLUMNS).collect()))
    alone = brute(["The end.", "The end.", None, None])
    assert out == [(0, *alone[0][1:])] * 2 + [(1, *alone[2][1:])] * 2
    assert alignment.aligned(spark.createDataFrame([(None, "a")], "doc_id long, text string")).count() == 1


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").filter("n_chars < 1500").orderBy("doc_id").collect()
    wanted = {r.doc_id: x[1:4] + (x[4], x[7]) for r, x in zip(rows, brute([r.text for r in rows]), strict=True)}
    out = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in queries.QUERIES["op12_alignment"](spark, path).collect()}
    assert len(out) == 200 and {k: out[k] for k in wanted} == wanted
