"""Sentence pieces, periodic runs and ranked search, held against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadtrace.llm import lexical_search, periodic_runs, queries, sentence_pieces
from roadtrace.llm.textblocks import blocks

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SAMPLES = [None, "", " ", "▁", "  a", "a</s>b", " " * 300, "a" * 3000, "\x00😀ſ벨", "ab" * 900 + " " + "he" * 700, "x▁ y" * 50]


def made(seed, parts, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(most))) for _ in range(n)]


# -- sentence pieces -----------------------------------------------------------------------------

PARTS = ["a", "b", " ", "  ", "    ", "▁", "e", "t", "he", "in", "\n", "\t", "é", "日", "本", "\x00", "😀", "ion", "ſ", "한", "aaaa", "membres"]


def encoded(m, texts, size=1 << 14):
    out = []
    for b in blocks(pa.array(texts, pa.string()), size):
        ids, at = m.encode(b)
        out += [(ids[i:j].tolist(), t) for i, j, t in zip(at[:-1], at[1:], m.decode(ids, at))]
    return out


def test_ids_and_texts_equal_the_library():
    texts = SAMPLES + made(1, PARTS, 3000, 40)
    want = [LIBRARY.encode(t or "", add_eos=True) for t in texts]
    assert encoded(sentence_pieces.Model(PATH), texts) == [(w, LIBRARY.decode(w)) for w in want]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    want = LIBRARY.encode(text, add_eos=True)
    assert encoded(sentence_pieces.model(PATH), [text]) == [(want, LIBRARY.decode(want))]


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "PART", 1000)
    texts = [" ".join(made(2, PARTS, 4000, 6)), "▁ " * 3000, "▁".join(made(3, ["a", " b"], 4000, 4))]
    assert [x[0] for x in encoded(sentence_pieces.Model(PATH), texts)] == [LIBRARY.encode(t, add_eos=True) for t in texts]


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "mix", lambda x: x * np.uint64(0))
    assert [x[0] for x in encoded(sentence_pieces.Model(PATH), SAMPLES)] == [LIBRARY.encode(t or "", add_eos=True) for t in SAMPLES]


def test_decode_takes_any_ids():
    rng = random.Random(4)
    rows = [[rng.choice([1, 2, 28705, 259, 264, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))] for _ in range(2000)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = list(sentence_pieces.Model(PATH).decode(np.array([i for r in rows for i in r], np.int64), at))
    assert got == [LIBRARY.decode(r) for r in rows]


def test_pieces_over_spark(spark):
    rows = [(k if k % 7 else None, t, "x") for k, t in enumerate(SAMPLES + SAMPLES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sentence_pieces.encode(df, PATH, back=True)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == Counter((d, tuple(w := LIBRARY.encode(t or "", add_eos=True)), LIBRARY.decode(w)) for d, t, _ in rows)
    back = sentence_pieces.decode(got.drop("text", "decoded"), PATH)
    assert Counter(r.text for r in back.collect()) == Counter(LIBRARY.decode(LIBRARY.encode(t or "")) for _, t, _ in rows)
    assert sentence_pieces.encode(df.limit(0), PATH).count() == 0


# -- periodic runs -------------------------------------------------------------------------------


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def found_runs(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, length, period = periodic_runs.find_runs_of(np.array([ord(c) for t in texts for c in t], np.int64), first)
    at = np.searchsorted(start, first)
    return [list(zip((start[i:j] - f).tolist(), length[i:j].tolist(), period[i:j].tolist())) for i, j, f in zip(at[:-1], at[1:], first[:-1])]


def repetitive(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = ""
        for _ in range(rng.randrange(1, 6)):
            w += "".join(rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(1, 9))) * rng.randrange(1, 8)
            w *= rng.randrange(1, 4) if rng.random() < 0.4 else 1
        out.append(w[:400])
    return out


def test_runs_against_brute_force():
    texts = repetitive(5, 1500) + ["a" * n for n in range(70)] + [""]
    assert found_runs(texts) == [plain_runs(t) for t in texts]


@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=7), st.integers(1, 9)), max_size=7), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_any_repetition(parts, times):
    text = "".join(p * k for p, k in parts) * times
    assert found_runs([text]) == [plain_runs(text)]


def test_every_distance_has_one_scale():
    spans = [periodic_runs.distances(2**k) for k in range(1, 20)]
    assert spans[0][0] == 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_transform_is_exact(monkeypatch):
    rng = np.random.default_rng(6)
    block, window = rng.integers(1, 4, (40, 8)), rng.integers(1, 4, (40, 20))
    window[::3, 5:13] = block[::3]
    for primes in (periodic_runs.PRIMES, [(97, 5), (193, 5), (257, 3)]):  # small ones: the sums need two of them or three
        monkeypatch.setattr(periodic_runs, "PRIMES", primes)
        got = periodic_runs.zero_mismatch(block, window, 13)
        assert (got == [[(b == w[d : d + 8]).all() for d in range(13)] for b, w in zip(block, window)]).all()


@pytest.mark.parametrize("text", ["a" * 300_000, "abcdefg" * 43 * 900, "".join(random.Random(7).choice("ab") for _ in range(100_000))], ids=["one", "nested", "two"])
def test_long_repetitive_texts_take_seconds(text):
    import time

    began = time.time()
    assert found_runs([text])[0]
    assert time.time() - began < 20


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    import zlib

    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_run_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(t) for t in repetitive(9, 150)] + [None, "", " \x0b\n", "é\x85x y\tz"] + [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)] + [(7, texts[7])] * 2
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        w = planted(d, t)
        runs = plain_runs(w)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for i, x in enumerate(w) if i not in drop))]
        want.append((d, len(runs), *best, math.floor(Fraction(1000 * best[1], best[2])) if runs else None, *digest))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_runs_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", 5, "x")], "n_words int, text string, other int, runs string")
    r = periodic_runs.find_runs(df).first()
    assert (r.other, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (5, 7, [(0, 6, 1)], "a b")
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


# -- ranked search -------------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    terms = lambda t: re.findall(lexical_search.TERM, (t or "").translate(str.maketrans(lexical_search.UPPER, lexical_search.LOWER)))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(s for _, _, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, bag, size in bags:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in wanted if t in bag)
            scored += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    docs = [(rng.choice([k, k // 2]), " ".join(word() for _ in range(rng.choice([1, 3, 30, 300])))) for k in range(n)]
    docs += [(None, "w1 w2"), (None, "w1 w2"), (5, None), (6, ""), (7, "-- !"), (8, "É é W1-w1_W3 日本 3"), (9, "w1 " * 70_000)]
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 8, 40])))) for k in range(40)] + [(100, None), (101, "?"), (None, "W1 é"), (102, "nowhere"), (1, "w9 w10"), (103, "é 3 日本")]
    return docs, items


@pytest.mark.parametrize("shard_bytes,group_terms,few", [(1 << 24, 4_000_000, 200_000), (3000, 9000, 0)])
def test_search_against_brute_force(spark, monkeypatch, shard_bytes, group_terms, few):
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", group_terms)
    monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", few)
    monkeypatch.setattr(lexical_search, "QUERIES", 1000 if few else 7)
    docs, items = corpus(10, 600)
    df = spark.createDataFrame([(d, t, 0, "") for d, t in docs], "doc_id long, text string, term int, shard string").repartition(3)
    index = lexical_search.build_index(df, shard_bytes)
    got = lexical_search.search(index, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"))
    assert Counter(map(tuple, got.collect())) == Counter(plain_search(docs, items))


def test_rejected_blocks_stay_packed():
    """A common term's blocks are unpacked only where a document of the rare term stands."""
    rng = random.Random(11)
    shard = lexical_search.Shard()
    texts = [f"common{' rare' * (k % 997 == 5)} {' '.join(f'w{rng.randrange(50)}' for _ in range(20))}" for k in range(20_000)]
    for b in blocks(pa.array(texts)):
        shard.add(b, pa.array(range(b.first, b.first + b.n)))
    rows = pa.Table.from_batches(shard.rows(0)).filter(pa.compute.field("term").isin(["", "common", "rare", "w7"]))
    weight = {"": 0, "common": 200, "rare": 9000, "w7": 900}
    rows = rows.append_column("weight", pa.array([weight[t] for t in rows["term"].to_pylist()])).append_column("items", pa.array([[] if not t else [{"item_id": 1}] for t in rows["term"].to_pylist()]))
    g = lexical_search.Group(rows, 20_000, sum(map(len, map(str.split, texts))))
    docs, score = g.best(["common", "rare", "w7"], 10)
    every = {t: dict(zip(*(x.tolist() for x in lexical_search.Group(rows, 20_000, g.n * 21).all_of(t)))) for t in ("common",)}
    assert len(docs) == 10 and all("rare" in texts[d] for d in docs.tolist()) and len(every["common"]) == 20_000
    assert g.unpacked < 100 < len(g.length)
    assert score.tolist() == sorted(score.tolist(), reverse=True)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(docs), items).count() == 0
    some = lexical_search.build_index(docs.union(spark.createDataFrame([(1, "a b")], docs.schema)))
    assert lexical_search.search(some, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.search(some, items).collect()] == ([(1, 1, 1)] if math.floor(1000 * math.log(4 / 3)) else [])
    assert some.filter(F.col("term") == "a").count() == 1
