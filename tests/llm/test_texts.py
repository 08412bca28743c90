import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from roadtrace.llm import personal_data, secret_scan
from roadtrace.llm.chat import format_chats, parse, read_back
from roadtrace.llm import chat, packing
from roadtrace.llm import quality as quality_module
from roadtrace.llm.packing import pack
from roadtrace.llm.quality import judge_quality, keep_quality
from roadtrace.llm.spans import digests
from roadtrace.llm.textblocks import blocks, words
from roadtrace.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def strings(seed, alphabet, n, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_words_of_blocks():
    texts = [None, "", " ", "a", " a\tb\x0bc\n", "é\x85x \x1c", "x" * 5000 + " y"] + strings(1, ["a", " ", "\n", "é", "\x85"], 300)
    got = [[] for _ in texts]
    for b in blocks(pa.array(texts), 64):
        w = words(b)
        raw = b.data.tobytes()
        for s, e, d in zip(w.start, w.end, w.doc):
            got[b.first + d].append(raw[s:e].decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_encoder_equals_the_tokenizer():
    texts = ["", " ", "x <|endoftext|> y", "\n\n\nOf"] + strings(2, ["a", " ", "\n", "\t", "\x1c", "'s", "1", "é", ".", "\x85", "\r", "中", "\xa0", "　", "word"], 4000)
    encoder = Encoder(PATH)
    got = []
    for b in blocks(pa.array(texts)):
        ids, at = encoder.ids(b)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(b.n)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_covers_every_id_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"word{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 5, 40, 900])))) for i in range(120)] + [(120, None), (121, ""), (121, ""), (None, "null id")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    got = pack(df, PATH, 256).collect()
    encoder = Encoder(PATH)
    want = Counter((d, tuple(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in rows)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for d in {d for d, _ in rows} - {121}:
        mine = sorted(pieces[d], key=lambda r: r.start)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))]
        assert want[(d, tuple(np.frombuffer(b"".join(bytes(r.ids) for r in mine), "<u4").tolist()))] == 1
        assert {r.doc_tokens for r in mine} == {sum(r.length for r in mine)}
    assert len(pieces[121]) == 2
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(x for _, x in s[:i]) for i in range(len(s))] and sum(x for _, x in s) <= 256
    assert sum(sum(x for _, x in s) < 256 for s in sequences.values()) <= 3  # one short window a task
    assert pack(df.limit(0), PATH).collect() == []


def bm25(docs, seed, k1=1.2, b=0.75):
    """Plain scores of all documents for the terms of a seed that others hold."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    counts = [Counter(d) for d in docs]
    idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in df}
    return [sum(idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(d) / mean)) for t in set(docs[seed]) if df[t] > 1 and c[t]) for d, c in zip(docs, counts)]


def test_neighbours_are_those_of_plain_bm25():
    rng = random.Random(13)
    docs = [[rng.randrange(400) for _ in range(rng.randrange(2, 20))] for _ in range(80)]
    index = packing.Bm25(np.concatenate([np.array(d, np.uint32) for d in docs]), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    unused = np.ones(len(docs), bool)
    unused[::7] = False
    for seed in range(len(docs)):
        score = bm25(docs, seed)
        want = sorted((i for i in range(len(docs)) if unused[i] and score[i] > 1e-9), key=lambda i: -score[i])[: packing.NEIGHBOURS]
        got = index.near(seed, unused).tolist()
        assert [round(score[i], 3) for i in got] == [round(score[i], 3) for i in want]


def test_a_query_asks_all_terms(monkeypatch):
    rng = random.Random(21)
    docs = [[int(300 * rng.random() ** 2) for _ in range(rng.randrange(20, 200))] for _ in range(160)]
    docs += docs[:40] + [[7, 7, 9]] * 15  # equal ones: the earlier first
    index = packing.Bm25(np.concatenate([np.array(d, np.uint32) for d in docs]), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    unused = np.ones(len(docs), bool)
    unused[::7] = False
    for seed in range(len(docs)):
        got = index.near(seed, unused).tolist()
        with monkeypatch.context() as walked:
            walked.setattr(packing, "QUERY_POSTINGS", 1 << 40)
            assert got == index.near(seed, unused).tolist()
        score = [round(x, 4) for x in bm25(docs, seed)]
        want = sorted((i for i in range(len(docs)) if unused[i] and score[i] > 0), key=lambda i: -score[i])[: packing.NEIGHBOURS]
        assert [score[i] for i in got] == pytest.approx([score[i] for i in want], abs=2e-3)
        assert all(a < b for a, b in zip(got, got[1:]) if docs[a] == docs[b])


def test_a_lexical_key_gathers_near_documents(spark, monkeypatch):
    """Documents of one topic, spread over the input, share a shard."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 6000)
    monkeypatch.setattr(packing, "TASK_SHARDS", 1)
    rng = random.Random(14)
    rows = [(i, " ".join(f"{'topic' if rng.random() < 0.5 else 'word'}{i % 8 if rng.random() < 0.7 else rng.randrange(8)}x{rng.randrange(60)}" for _ in range(60))) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(150)]  # a hot key
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = pack(df, PATH, 512).collect()
    encoder = Encoder(PATH)
    docs = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [0] for _, t in rows]
    shard = {r.doc_id: r.sequence_id >> 40 for r in got}
    names = [d for d, _ in rows]
    reached = total = 0
    for seed in range(0, len(rows), 20):
        score = bm25(docs, seed)
        best = sorted((i for i in range(len(rows)) if i != seed), key=lambda i: -score[i])[:10]
        reached += sum(shard[names[i]] == shard[names[seed]] for i in best)
        total += len(best)
    sizes = Counter()
    for r in got:
        sizes[r.sequence_id >> 40] += r.length
    assert len(sizes) > 5 and max(sizes.values()) < 6 * 6000
    assert reached / total > 3 * sum((s / sum(sizes.values())) ** 2 for s in sizes.values())


def structured(n, topics, rng):
    """Documents of two of many topics each, four fifths of their topic words of the first, among words of a Zipf law."""
    common = np.cumsum(1 / np.arange(1, 20_001))
    rank = np.cumsum(1 / np.arange(1, 151) ** 0.7)
    words = np.stack([rng.choice(np.arange(200, 20_000), 150, replace=False) for _ in range(topics)])
    docs = []
    for _ in range(n):
        m = int(np.clip(rng.lognormal(5.2, 0.6), 40, 1500))
        topic = np.where(rng.random(m) < 0.8, *rng.integers(0, topics, 2))
        own = words[topic, np.searchsorted(rank, rng.random(m) * rank[-1])]
        docs.append(np.append(np.where(rng.random(m) < 0.4, own, np.searchsorted(common, rng.random(m) * common[-1])) + 1, packing.END).astype(np.uint32))
    return docs


def test_neighbours_by_brute_force_stand_in_the_shard(monkeypatch):
    """Of the twelve nearest of a seed by BM25 over all documents, 0.9 stand in its shard, one of 35."""
    rng = np.random.default_rng(7)
    docs = structured(20_000, 400, rng)
    size = np.array([len(d) for d in docs])
    index = packing.Bm25(np.concatenate(docs), np.concatenate([[0], np.cumsum(size)]))
    sets = [np.unique(d) for d in docs]
    at = lambda part: np.concatenate([[0], np.cumsum([len(t) for t in part])])
    terms = np.concatenate(sets).astype(np.int64)
    keys = packing.LexicalKeys(np.bincount(terms), len(docs))
    sample = [sets[i] for i in rng.permutation(len(docs))[: packing.FIT]]
    keys.fit(np.concatenate(sample).astype(np.int64), at(sample))
    centroid, second, term = keys.keys(terms, at(sets))
    order = np.lexsort((rng.random(len(docs)), term, second, centroid))
    shard = np.empty(len(docs), int)
    shard[order] = np.minimum(np.cumsum(size[order]) * 35 // size.sum(), 34)
    monkeypatch.setattr(packing, "QUERY_POSTINGS", 1 << 40)  # every term: the exact order
    unused, reached = np.ones(len(docs), bool), []
    for seed in rng.choice(len(docs), 200, replace=False).tolist():
        unused[seed] = False
        reached.append(np.mean(shard[index.near(seed, unused)] == shard[seed]))
        unused[seed] = True
    assert np.mean(reached) >= 0.9

    monkeypatch.undo()
    kept = []
    for g in range(0, 35, 7):
        mine = [docs[i] for i in np.flatnonzero(shard == g)]
        local = packing.Bm25(np.concatenate(mine), at(mine))
        unused = np.ones(len(mine), bool)
        for seed in range(0, len(mine), 25):
            unused[seed] = False
            with monkeypatch.context() as every:
                every.setattr(packing, "QUERY_POSTINGS", 1 << 40)
                want = local.near(seed, unused)
            kept.append(len(np.intersect1d(local.near(seed, unused), want)) / len(want))
            unused[seed] = True
    assert np.mean(kept) >= 0.95  # what a query loses whose lightest terms are left out


@pytest.mark.parametrize("size", [32, 64])
def test_windows_are_those_of_a_plain_greedy_filling(size, monkeypatch):
    monkeypatch.setattr(packing, "QUERY_POSTINGS", 1 << 40)
    rng = random.Random(size)
    docs = [[rng.randrange(300) for _ in range(rng.choice([1, 3, 9, 20, 45, 150]))] for _ in range(90)]
    window = packing._Window(size, 0)
    packing._fill(window, np.concatenate([np.array(d, np.uint32) for d in docs]), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))

    used, laid, filled = set(), [], 0

    def nearest(seed):
        score = [round(x, 4) for x in bm25(docs, seed)]
        return sorted((i for i in range(len(docs)) if i not in used and score[i] > 0), key=lambda i: (-score[i], i))[: packing.NEIGHBOURS]

    def lay(doc):
        nonlocal filled
        used.add(doc)
        laid.append(doc)
        filled = (filled + len(docs[doc])) % size

    while len(used) < len(docs):
        seed = min(set(range(len(docs))) - used)
        lay(seed)
        while filled and (found := nearest(seed)):
            for doc in found:
                if filled and len(docs[doc]) <= size - filled:
                    lay(doc)
            rest = [doc for doc in found if doc not in used]
            if filled and rest:
                seed = rest[0]
                lay(seed)
    want, at = [], 0
    for doc in laid:
        start = 0
        while start < len(docs[doc]):
            take = min(size - at % size, len(docs[doc]) - start)
            want.append((doc, start, take, at // size, at % size))
            start, at = start + take, at + take
    assert window.pieces == want


def test_copies_without_doc_id_are_cut_into_shards_and_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 2000)
    rows = [(None, "one text that stands here often " * 5)] * 600 + [(None, None)] * 3 + [(i, f"other text {i} " * 9) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pack(df, PATH, 256).collect()
    assert sum(r.start == 0 for r in got) == len(rows)
    tokens = Counter()
    for r in got:
        tokens[r.sequence_id >> 40] += r.length
    assert len(tokens) > 5 and max(tokens.values()) < 5 * 2000
    monkeypatch.setattr(packing, "TASKS", 3)
    again = pack(df, PATH, 256).collect()
    assert len({r.sequence_id >> 40 for r in again}) <= 3 and sum(r.length for r in again) == sum(r.length for r in got)


def test_order_is_kept_by_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 4000)
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(5, 90))), 1000 - i) for i in range(500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, place long").repartition(4), PATH, 256, order=["place"]).collect()
    first = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        first.setdefault(r.doc_id, len(first))
    # a document moves within its shard only, here about 40 documents long
    assert max(abs(k - (499 - d)) for d, k in first.items()) < 80


def test_equal_hashes_are_told_apart(monkeypatch):
    from roadtrace.llm import tokens

    monkeypatch.setattr(tokens, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64) * np.uint64(1 << 20))
    encoder = Encoder(PATH)
    texts = ["abc abd", "abe xyz", "one two ten"]
    got = []
    for b in blocks(pa.array(texts), 8):
        ids, at = encoder.ids(b)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(b.n)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts_and_verdict(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a\na\n\na", "x " * 50, "#$ é" * 9] + strings(5, ["a ", "b ", "\n", "é", "|", "abc ", " "], 200, 60)
    good = [" ".join(f"good{rng.randrange(50)}" for _ in range(40)) for _ in range(60)]
    junk = [" ".join(f"junk{rng.randrange(50)}" for _ in range(40)) for _ in range(60)]
    rows = list(enumerate(texts + good + junk))
    df = spark.createDataFrame([(d, t, True) for d, t in rows] + [(None, "x", True)], "doc_id long, text string, kept boolean")
    first = len(texts)
    labels = spark.createDataFrame([(first + i, 1, 0) for i in range(30)] + [(first + 60 + i, 0, 0) for i in range(30)] + [(None, 1, 0), (first, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in judge_quality(df, labels, prior=0.001).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(t), t
        assert not (r.base_failed and r.kept)
    assert all(got[first + i].kept for i in range(60)) and not any(got[first + 60 + i].kept for i in range(60))
    kept = {r.doc_id for r in keep_quality(df, labels, prior=0.001).collect()}
    assert kept == {d for d, r in got.items() if r.kept}
    assert {r.score for r in judge_quality(df, labels.limit(0)).collect()} == {0.0}
    assert judge_quality(df.limit(0), labels).collect() == []


def test_ratio_against_plain_counts(spark):
    """Scores and verdicts at the production prior and threshold, by counters over single documents."""
    rng = random.Random(31)
    texts = [" ".join(f"{'good' if i % 3 else 'junk'}{rng.randrange(30)}" for _ in range(rng.randrange(20, 90))) for i in range(300)] + ["word " * 30_000]
    grams = []
    for t in texts:
        (b,) = blocks(pa.array([t]), 1 << 30)
        w = words(b)
        grams.append(quality_module.ngram_buckets(w, quality_module.span_hashes(b.data, w.start, w.end))[0].tolist())
    trusted = {i for i in range(300) if i % 3 and i % 2}
    raw, target = Counter(g for d in grams for g in d), Counter(g for i in trusted for g in grams[i])
    size, prior = quality_module.BUCKETS, quality_module.PRIOR
    all_raw, all_target = sum(raw.values()) + size, sum(target.values())

    def ratio(g):
        p_raw = (raw[g] + 1) / all_raw
        return math.log((target[g] + prior * size * p_raw) / (all_target + prior * size)) - math.log(p_raw)

    want = [sum(map(ratio, d)) / len(d) for d in grams]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    for r in judge_quality(df, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9
        assert r.kept == (not r.base_failed and want[r.doc_id] >= quality_module.THRESHOLD)


CHAT = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "INST]", "a", "\n", "é", "</s>\n", "<\\s>", "[\\\\INST]"]


def test_chat_round_trip(spark, monkeypatch):
    rng = random.Random(6)
    texts = strings(7, CHAT, 600)
    rows = [(None if i % 50 == 7 else i // 4, rng.randrange(3), rng.choice(["user", "assistant", "system", None, "od\nd<s>[\\"]), rng.choice([texts[i], None])) for i in range(600)] + [(1, 0, "user", "x" * 2_000_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    table = pa.table({"conv_id": [1, 1, 2, 3, None, None], "role": ["user"] * 6, "text": ["aaaa", None, "b" * 9, "", "c", "d"]})
    monkeypatch.setattr(chat, "BLOCK_BYTES", 5)
    assert [(b.num_rows, b.column("conv_id").to_pylist()) for b in chat._bounded(table)] == [(2, [1, 2]), (2, [3, None])]
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert got.keys() == groups.keys()
    for c, v in groups.items():
        v.sort(key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        learned = "".join(x[3] or "" for x in v if x[2] == "assistant")
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in v)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(v), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    raw = bytes(format_chats(spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")).first().formatted)
    assert raw.count(b"</s>") == 1 and b"[INST]" not in raw and parse(raw) == [(b"user", b"</s>[INST] ok [/INST]")]
    assert format_chats(df.limit(0)).collect() == []


def personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


@pytest.mark.parametrize(
    "module, plain, alphabet",
    [
        (personal_data, personal, ["@", "a", ".", "1", "0", "4", "25", "-", " ", "+", "(", "é", "4111 1111", "1111-1111", " at ", "[dot]", "one ", "five "]),
        (secret_scan, secrets, ["password", "TOKEN", "api_key", "=", ":", '"', "'", " ", "abcd", "12345678", "AKIA", "ABCDEF", "f" * 16, "é", "apikey", "ſecret"]),
    ],
)
def test_base_spans_stay(module, plain, alphabet):
    for t in strings(8, alphabet, 4000, 26) + ["1" * 40_000, "a" * 40_000 + "@", "f" * 40_000]:
        assert module.base_spans(t) == plain(t), t
        assert set(plain(t)) <= set(module.find(t))


def test_deobfuscation_maps_back():
    text = "mail john dot doe at example dot com or jane[at]ex.org, ｊoe@ехample.com; plus one two three four five six seven eight nine zero"
    assert [text[s:e] for _, s, e in personal_data.find(text)] == ["john dot doe at example dot com", "jane[at]ex.org", "ｊoe@ехample.com", "plus one two three four five six seven eight nine zero"][0:3] + ["plus one two three four five six seven eight nine zero"]
    assert personal_data.find("He was at home. One or two of the five were at the dot.") == []


PLAIN = re.compile(
    rf"""(?P<at>\s{{0,3}}[\[({{<]\s{{0,3}}(?:{personal_data.AT_WORDS}|@)\s{{0,3}}[\])}}>]\s{{0,3}})
    |(?P<dot>\s{{0,3}}[\[({{<]\s{{0,3}}(?:{personal_data.DOT_WORDS}|\.)\s{{0,3}}[\])}}>]\s{{0,3}})
    |(?P<wordat>\s{{1,3}}(?:{personal_data.AT_WORDS}|@)\s{{1,3}}(?=[\w-]{{1,63}}(?:\s{{1,3}}(?:{personal_data.DOT_WORDS}|\.)\s{{1,3}}|\.)\w))
    |(?P<worddot>\s{{1,3}}(?:{personal_data.DOT_WORDS}|\.)\s{{1,3}}(?=[\w-]))
    |(?P<plus>(?<![^\W\d_])plus[ ]{{1,2}}(?=(?:{personal_data._WORDS}|[0-9])))
    |(?P<digit>(?<![^\W\d_])(?:{personal_data._WORDS})(?![^\W\d_]))
    |(?P<reference>&\#(?:x[0-9a-f]{{1,6}}|[0-9]{{1,7}});|&(?:commat|period);|%(?:40|2e))
    |(?P<foreign>(?-i:[^\x00-\x7f]))""",
    re.I | re.X,
)


def plainly_rewritten(text):
    """One pattern that stops at every character, instead of looking words up."""

    def new(m):
        if m.lastgroup == "foreign":
            return personal_data._ascii(m[0])
        if m.lastgroup == "reference":
            return personal_data._referred(m[0])
        return {"at": "@", "wordat": "@", "dot": ".", "worddot": ".", "plus": "+"}.get(m.lastgroup) or personal_data.DIGIT_WORDS[m[0].translate(personal_data._FOLD).lower()]

    return PLAIN.sub(new, text)


def test_transducers_against_one_plain_pattern():
    alphabet = ["at", "dot", " ", " ", "\n", "[", "]", "(", ")", "@", ".", "a", "Punkt", "arroba", "one", "fünf", "Sept", "plus", "7", "é", "е", "４", "٣", "​", "&#64;", "&period;", "%40", "x", "-", "K", "K", "ſ", "İ", "point"]
    for t in strings(21, alphabet, 20_000, 14):
        plain, edits = personal_data.rewritten(t)
        assert plain == plainly_rewritten(t), t
        for (_, b, _, end), (a2, _, start2, _) in zip(edits, edits[1:]):
            assert plain[b:a2] == t[end:start2]


def test_disguises_of_other_scripts_and_languages():
    hidden = {
        "joh​n@exam​ple.com": "hidden_email", "john&#64;example&period;com": "hidden_email", "juan arroba example punto es": "hidden_email", "jean arobase exemple point fr": "hidden_email",
        "hans ät beispiel punkt de": "hidden_email", "jоhn@ехamplе.com": "hidden_email", "+49 ١٧٠ ١٢٣٤٥٦٧": "hidden_phone", "null eins sieben null eins zwei drei vier fünf": "hidden_phone",
        "zéro six un deux trois quatre cinq sept huit": "hidden_phone", "seis uno dos tres cuatro cinco seis siete ocho": "hidden_phone", "192 dot 168 dot one dot 1": "hidden_ip", "４１１１ 1111 1111 1111": "hidden_card",
    }
    for t, kind in hidden.items():
        for before in ("", "Text; "):
            got = [(k, s - len(before), e - len(before)) for k, s, e in personal_data.find(before + t) if k == kind]
            assert got == [(kind, 0, len(t))], (t, personal_data.find(before + t))
    for t in ("Il y a un chat et deux chiens, point.", "Um neun war er an Punkt drei.", "Look at this. At one o'clock, two or three came.", "à la café, naïve — ‘quoted’ … 50 %"):
        assert personal_data.find(t) == [], t


def test_a_disguise_needs_no_other():
    digits = "four\tnine one\nseven\tzero one\ttwo three\tfour five\nsix"
    alone = ["john@example dot com", "john at mail.example dot com", "jane at example.com", "jane @ example.com", "john[@]example[.]com", "juan [arroba] x [punto] es", digits, "plus 49 170 1234567", "ſeven\tone two\tthree four\tfive six\tseven eight\tnine"]
    for t in alone:
        assert any(k.startswith("hidden") for k, _, _ in personal_data.find(t)), t
    other = "jane[at]ex.org and more; "
    for t in alone:
        for before, after in (("", ""), (other, ""), ("No at nor dot here; ", "")):
            shift = len(before)
            got = [(k, s - shift, e - shift) for k, s, e in personal_data.find(before + t + after) if s >= shift]
            assert got == personal_data.find(t), (before, t)


def test_constants_reach_sensitive_names():
    text = 'K = "a8Kd93kLqz"\ndb_pwd: K\nclient_secret = "x9fj" + "dk20dkPq"\nname = "hello world"\npwd = "changeme-please"'
    assert [text[s:e] for k, s, e in secret_scan.find(text) if k == "literal"] == ["a8Kd93kLqz", "x9fj", "dk20dkPq"]


def test_literals_of_any_length_and_over_lines():
    rng = random.Random(12)
    key = lambda n: "".join(rng.choice("abcdefghkmpqHIJKLMNPRSTV0123456789") for _ in range(n))
    found = lambda t: [t[s:e] for k, s, e in secret_scan.find(t) if k == "literal"]
    bits = [key(24) for _ in range(200)]
    assert found('k = ""\n' + "".join(f'k = k + "{b}"\n' for b in bits) + "client_secret = k") == bits
    assert found('pwd = ""\n' + "".join(f'pwd += "{b}"\n' for b in bits)) == bits
    assert found(f"<privateKey>{(long := key(1600))}</privateKey>") == [long]
    assert found(f'client_key{" " * 30}={" " * 30}"{bits[0]}"') == [bits[0]]
    assert found(f'db_pwd = "{bits[0]}" +\n    "{bits[1]}"\n  + "{bits[2]}"') == bits[:3]
    assert found(f'private_key = """{bits[0]}\n{bits[1]}"""') == [f"{bits[0]}\n{bits[1]}"]
    assert found(f"a:\n  private_key: |\n    {bits[0]}\n    {bits[1]}\n  b: c\n") == [f"{bits[0]}\n    {bits[1]}"]
    assert found(f'+db_pwd = "{bits[0]}"\n+client_key = "{bits[1]}"\n+"signing_key": "{bits[2]}"') == bits[:3]
    for t in ("a" * 40_000 + " " * 40_000, "a1" * 40_000, "k = k + k\n" * 3000, "<a>" + "b" * 80_000, "a" + " " * 80_000 + '"""' * 999):
        assert not secret_scan.literal_spans(t)


def test_lists_scopes_and_blocks():
    rng = random.Random(22)
    key = lambda: "".join(rng.choice("abcdefghkmpqHIJKLMNPRSTV0123456789") for _ in range(24))
    found = lambda t: [t[s:e] for k, s, e in secret_scan.find(t) if k == "literal"]
    a, b, c = key(), key(), key()
    assert found(f"passphrase:\n  - {a}\n  - '{b}'  # old\n  - name: {c}\nother: x\n") == [a, b]
    assert found(f'{{"signing_keys": ["{a}", "{b}"], "n": ["{c}"]}}') == [a, b]
    assert found(f"[client]\nclient_key = {a}\n; client_key = {b}\n# db_pwd: {c}\n") == [a, b, c]
    assert found(f"// auth_key := `{a}`\n/* db_pwd='{b}' */") == [a, b]
    assert found(f'def f():\n    k = "{a}"\n\ndef g():\n    db_pwd = k\n') == []
    assert found(f'k = "{a}"\ndef g():\n    k = "{b}"\n    db_pwd = k\nclient_key = k\n') == [a, b]
    assert found(f'function f() {{ var k = "{a}"; }}\nvar k = "{b}"; {{ db_pwd = k; }}') == [b]
    assert found(f'cfg["db_pwd"] = "{a}"\n--client-key {b} <{"x" * 200}_key>{c}</{"x" * 200}_key>') == [a, b, c]
    assert found(f'k = "{a[:12]}"\n{{ k += "{a[12:]}"\n }}\nauth_key = k') == [a[:12], a[12:]]


def test_literals_against_generated_programs():
    """Random assignments whose secrets are known from how they were written."""
    rng = random.Random(23)
    key = lambda: "".join(rng.choice("abcdefghkmpqHIJKLMNPRSTV0123456789") for _ in range(20))
    for _ in range(300):
        text, held, want = "", {}, set()
        for _ in range(rng.randrange(1, 12)):
            name = rng.choice(["k", "x1", "db_pwd", "client_key", "authToken", "label"])
            start, parts = f"{name}{rng.choice([' = ', ': ', '=', ' := '])}", []
            text += rng.choice(["", "# ", "export ", "- "]) + start
            for i in range(rng.randrange(1, 4)):
                text += " + " if i else ""
                if held and rng.random() < 0.4:
                    other = rng.choice(sorted(held))
                    parts += held[other]
                    text += other
                else:
                    quote = rng.choice(["'", '"', "`"])
                    parts.append((len(text) + 1, len(text) + 21))
                    text += quote + key() + quote
            held[name] = parts
            text += "\n"
            if secret_scan.name_score(name) > 1:
                want |= set(parts)
        assert {(s, e) for k, s, e in secret_scan.find(text) if k == "literal"} == want, text


def test_span_queries(spark):
    df = spark.createDataFrame([(1, "token = abcdefgh1 " + "0" * 32, "x"), (2, None, "x"), (3, "", "x"), (None, "AKIAAAAABBBBCCCC", "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in digests(secret_scan.find_secrets(df), secret_scan.BASE_KINDS).collect()}
    assert got[1].n_assign == 1 and got[1].n_hex == 1 and got[1].base_sha256 == hashlib.sha256(b"assign:0:17,hex:18:50").hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_access == 1
    texts = {r.doc_id: r.text for r in secret_scan.redact_secrets(df).collect()}
    assert texts == {1: "[SECRET] [SECRET]", 2: None, 3: "", None: "[SECRET]"}
    assert secret_scan.redact_secrets(df).columns == df.columns and secret_scan.find_secrets(df.limit(0)).collect() == [] == secret_scan.redact_secrets(df.limit(0)).collect()


def test_personal_data_on_tables(spark):
    long = "word " * 200_000 + "jane[at]ex.org"
    df = spark.createDataFrame([(1, "to a@b.co or +49 170 1234567", "x"), (1, "to a@b.co or +49 170 1234567", "x"), (2, None, "x"), (3, "", "x"), (None, "jane[at]ex.org", "x"), (4, long, "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in digests(personal_data.find_personal_data(df), personal_data.BASE_KINDS).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].found) == (1, 1, True) and got[2].spans == got[3].spans == "" and not got[2].found
    assert got[None].spans == "hidden_email:0:14" and got[None].found and got[4].spans == f"hidden_email:{len(long) - 14}:{len(long)}"
    texts = [(r.doc_id, r.text) for r in personal_data.redact_personal_data(df).collect() if r.doc_id != 4]
    assert sorted(texts, key=str) == sorted([(1, "to [EMAIL] or [PHONE]")] * 2 + [(2, None), (3, ""), (None, "[EMAIL]")], key=str)
    assert personal_data.find_personal_data(df.limit(0)).collect() == [] == personal_data.redact_personal_data(df.limit(0)).collect()


WORD = "Zq9x-Lm44-tbbK7"


@pytest.mark.parametrize(
    "text,found",
    [
        ('passphrase = ("Zq9xKpLm"\n   b"Lm-44tbb")', ["Zq9xKpLm", "Lm-44tbb"]),
        (f'passphrase = b"{WORD}"', [WORD]),
        (f"passphrase = rf'{WORD}'", [WORD]),
        (f'passphrase: str = "{WORD}"', [WORD]),
        (f'passphrase: Optional[dict[str, str]] = "{WORD}"', [WORD]),
        (f'{{"passphrase": {{"value": "{WORD}"}}}}', [WORD]),
        (f'a, passphrase = "x", "{WORD}"', [WORD]),
        (f'passphrase, a = "{WORD}", "x"', [WORD]),
        (f'title, body = "x", "{WORD}"', []),
        (f'<add key="passphrase" value="{WORD}"/>', [WORD]),
        (f'<add key="colour" value="{WORD}"/>', []),
        (f'- name: DB_PASSPHRASE\n  value: {WORD}\n', [WORD]),
        (f'setPassphrase("{WORD}")', [WORD]),
        (f'conf.put("passphrase", "{WORD}")', [WORD]),
        (f'print("passphrase is", "{WORD}")', []),
        (f'{{"passphrase": {{"hint": "{WORD}"}}}}', []),
    ],
)
def test_everyday_syntax(text, found):
    assert [text[a:b] for _, a, b in sorted(secret_scan.literal_spans(text), key=lambda s: s[1])] == found


def test_constants_of_outer_scopes_come_back():
    """The innermost scope's constant holds until its brace closes."""
    text = f'k = "{WORD}"; {{ k = "Another-9Value7"; passphrase = k }} secret_word = k'
    assert [text[a:b] for _, a, b in sorted(secret_scan.literal_spans(text), key=lambda s: s[1])] == [WORD, "Another-9Value7"]
    text = f'{{ k = "{WORD}" }} passphrase = k'
    assert secret_scan.literal_spans(text) == []


@pytest.mark.parametrize(
    "module,text",
    [
        (secret_scan, "{" * 100_000 + "\n" + "a=b\n" * 230_000),
        (secret_scan, "{ a=b\n" * 170_000),
        (secret_scan, "a, " * 340_000 + "x = 1"),
        (secret_scan, "x = ('a'\n" * 110_000),
        (secret_scan, "x: a[" * 200_000),
        (secret_scan, "f('a', 'b' " * 90_000),
        (personal_data, "".join(f"u{i}@ex.com x{i} [at] ex [dot] com\n" for i in range(28_000))),
        (personal_data, "one two three four five six seven eight nine 1 2 3 4 5 6 7\n" * 17_000),
    ],
    ids=["open", "nested", "names", "parentheses", "annotations", "calls", "addresses", "numbers"],
)
def test_a_megabyte_takes_seconds(module, text):
    import time

    began = time.process_time()
    module.find(text)
    assert len(text) > 900_000 and time.process_time() - began < 8


def test_hidden_spans_against_a_plain_check():
    """What is known already, and what overlaps, as a look at every span tells it."""
    rng = random.Random(21)
    parts = ["a@b.co", "x [at] y [dot] z", " one two three four five six seven eight nine zero ", "+49 30 1234567", "4111 1111 1111 1111", "four", "1.2.3.4", "1 dot 2", " ", "\n", "aѕ@b.co", "+", "7"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        known = personal_data.base_spans(text)
        hidden = personal_data.hidden_spans(text, known)
        for kind, s, e in hidden:
            assert not any(personal_data.HIDDEN[k] == kind and a <= s and e <= b for k, a, b in known)
        every = personal_data.hidden_spans(text, [])
        assert hidden == [h for h in every if not any(personal_data.HIDDEN[k] == h[0] and a <= h[1] and h[2] <= b for k, a, b in known)]
