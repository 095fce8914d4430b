"""Brute force, round trips and edge rows: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import math
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import op1_ngram, op2_sharding, op3_quality, op4_simhash, op5_decontam, op6_packing, op7_bitpack, op8_toxicity, op9_pii, op10_langid
from tidelog.llm.eliasfano import EliasFano, Level, Trie, load, save
from tidelog.llm.tokens import Encoder

random.seed(3)
WORDS = ["the", "of", "Berg", "été", "x,y", "<|endoftext|>", "12", "a b", "it's", "niño"]
TEXTS = [None, "", " \n ", "one", "word " * 30_000] + [" ".join(random.choices(WORDS, k=random.randint(1, 80))) + random.choice(["", "\n", "  "]) for _ in range(60)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (None, "no id here")]
SCHEMA = "doc_id long, text string, score double, part int, sequence_id string, h string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, 1, "s", "h") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("order,shard_tokens", [(2, op1_ngram.SHARD_TOKENS), (3, op1_ngram.SHARD_TOKENS), (3, 400), (2, 400), (3, 60)])
def test_ngram(docs, none, order, shard_tokens):
    """The small shards make some words hot, whose windows are dealt to all shards."""
    held = "crc32(coalesce(cast(doc_id as string), '')) % 7 = 2"
    got = {(r.doc_id, r.n_tokens): r for r in op1_ngram.score(docs, held, order, block_bytes=4000, shard_tokens=shard_tokens).collect()}
    assert op1_ngram.score(docs, held, order).count() == len(ROWS)
    one, ctx, kinds = Counter(), Counter(), Counter()
    grams = Counter()
    for i, t in ROWS:
        if op1_ngram.crc_text(i) % 7 != 2:
            w = ["<", "<", *_words(t), ">"]
            one.update(w[2:])
            for k in range(2, len(w)):
                for n in range(1, order):
                    grams[tuple(w[k - n : k + 1])] += 1
    for g, n in grams.items():
        ctx[g[:-1]] += n
        kinds[g[:-1]] += 1
    total, v = sum(one.values()), len(one)
    for i, t in ROWS:
        w, s, b = ["<", "<", *_words(t), ">"], 0.0, 0.0
        for k in range(2, len(w)):
            p = (one[w[k]] + 1) / (total + v + 1)
            b += math.log10(p)
            for n in range(1, order):
                h = tuple(w[k - n : k])
                if ctx[h]:
                    p = (grams[(*h, w[k])] + kinds[h] * p) / (ctx[h] + kinds[h])
            s += math.log10(p)
        r = got[i, len(w) - 2]
        assert r.train_tokens == total and abs(r.base_score - b) < 1e-6 * max(1, -b) and abs(r.score - s) < 1e-3 * len(w)
    assert op1_ngram.score(none, held).count() == 0


def test_ngram_query_uses_two_words_of_context(spark, tmp_path):
    texts = ["red river runs", "old river rests", "red river runs", "red river rests"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs, held = spark.read.parquet(str(tmp_path / "documents.parquet")), "crc32(cast(doc_id as string)) % 7 = 2"
    scores = lambda df: {r.doc_id: round(r.score, 9) for r in df.collect()}
    got = scores(op1_ngram.query(spark, str(tmp_path)))
    assert got == scores(op1_ngram.score(docs, held, 3)) != scores(op1_ngram.score(docs, held, 2))


def test_ngram_looks_each_window_of_a_shard_up_once(spark, monkeypatch):
    """Twenty blocks with the same words ask for the same windows; the trie is searched for the distinct ones."""
    text = "the river runs to the sea and the river rests"
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").repartition(20, "doc_id")
    table, *_, hot = op1_ngram.numbered(docs, "doc_id % 2 = 1", len(text), op1_ngram.SHARD_WORDS, op1_ngram.SHARD_TOKENS)
    assert table.count() == 20
    asked = pa.Table.from_batches(list(op1_ngram._messages(3, 1, hot)(table.toArrow().to_batches())))
    searched, find = [], Trie.after_pair
    monkeypatch.setattr(Trie, "after_pair", lambda self, pair, *more: searched.append(len(pair)) or find(self, pair, *more))
    answers = op1_ngram._answers(hot)(asked)
    words = ["<", "<", *text.split(), ">"]
    assert sum(searched) == len(set(zip(words, words[1:], words[2:]))) == 11
    assert answers.num_rows == 20 and len(set(answers.column("body").to_pylist())) == 1


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (500, 10_000), (1000, 1 << 60), (700, 700), (40_000, 200_000), (-900, 1 << 40)):
        x = np.unique(rng.integers(0, u, n, dtype=np.uint64)) if n > 0 else np.arange(-n, dtype=np.uint64) + np.uint64(5)  # the last: all in one bucket
        x = x[x < u]
        save(str(tmp_path / "f"), EliasFano.build(x, u))
        e = EliasFano(load(str(tmp_path / "f")))
        probe = np.concatenate([x, rng.integers(0, u, 200, dtype=np.uint64)])
        assert (e.successor(probe) == np.searchsorted(x, probe)).all()
        assert (e.find(probe) == np.where(np.isin(probe, x), np.searchsorted(x, probe), -1)).all()
        assert (e.access(np.arange(len(x))) == x).all()
    none = np.zeros(0, np.int64)
    assert Trie(Trie.build(np.array([3], np.uint64), np.zeros(1, bool), (none,) * 4, (none,) * 3)).n == 1


def test_level_finds_children(tmp_path):
    rng = np.random.default_rng(4)
    have = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 300), rng.integers(0, 100, 300)) if a % 7})
    owner, child = (np.array(x, np.int64) for x in zip(*have))
    save(str(tmp_path / "l"), Level.build(owner, child, 45, 100))
    level = Level(load(str(tmp_path / "l")))
    node, probe = (x.ravel() for x in np.meshgrid(np.arange(45), np.arange(100), indexing="ij"))
    at, begin = level.find(node, probe)
    place = {x: i for i, x in enumerate(have)}
    assert at.tolist() == [place.get(x, -1) for x in zip(node.tolist(), probe.tolist())]
    assert (begin == np.searchsorted(owner, node)).all()
    assert (level.pointers.access(np.arange(46)) == np.searchsorted(owner, np.arange(46))).all()


def test_sharding(docs, none, spark):
    rows = op2_sharding.shard(docs).collect()
    assert len(rows) == len(ROWS)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t in ROWS)
    hot = spark.createDataFrame([(i, "same text" if i < 900 else f"text number {i}") for i in range(2000)], "doc_id long, text string")
    size = Counter()
    for r in op2_sharding.shard(hot).collect():
        size[r.shard] += r.size
    assert max(size.values()) < 1.15 * sum(size.values()) / 8
    assert op2_sharding.shard(none).count() == 0


def _balanced(rows, most=1.1):
    size, where = Counter(), {}
    for r in rows:
        size[r.shard] += r.size
        where.setdefault(r.text_crc32, set()).add(r.shard)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert max(size.values()) <= most * sum(size.values()) / 8 and len(size) == 8
    return where


def test_shards_of_middling_groups(spark):
    """Groups of equal texts, each below a range's share, and many to a range; all rows of a group in one shard."""
    rng = random.Random(31)
    texts = [f"text {k} " + "x" * rng.randint(0, 60) for k in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(6000)]
    got = op2_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), ranges_each=4).collect()
    where = _balanced(got)
    assert all(len(x) == 1 for x in where.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)


def test_overfull_ranges_are_cut(spark, monkeypatch):
    """With a sample of no use, all rows begin in one range."""
    monkeypatch.setattr(op2_sharding, "_splitters", lambda rows, total, ranges: [])
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(8000)], "doc_id long, text string")
    assert all(len(x) == 1 for x in _balanced(op2_sharding.shard(df).collect()).values())


def test_a_heavy_group_of_repeated_rows(spark):
    df = spark.createDataFrame([(7 if i < 1500 else None, "same text") if i < 3000 else (i, f"text number {i}") for i in range(4000)], "doc_id long, text string")
    rows = op2_sharding.shard(df).collect()
    where = _balanced(rows, 1.15)
    assert len(rows) == 4000 and all(len(x) == 1 for k, x in where.items() if k != zlib.crc32(b"same text"))


def _plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(three)
    covered = {k + j for k, w in enumerate(three) if often[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts_equal_plain_ones(spark):
    rng = random.Random(33)
    texts = [t for _, t in ROWS] + ["".join(rng.choices(["a", "b ", "é#", "\n", "a b a", " ", "|", "\t", "\r\n"], k=rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op3_quality.judged(df, None, ["doc_id"]).collect():
        n, *rest = want = _plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) == (not r.kept)


def test_forest_equals_plain_trees():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 3)), np.repeat(rng.normal(size=(1, 3)), 30, axis=0)])  # with ties
    forest = op3_quality.Forest(x, trees=20, psi=64)

    def mean_path(n):
        return 0 if n <= 1 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def path(t, row):
        node = 0
        for _ in range(forest.depth):
            node = 2 * node + 1 + (row[forest.feature[t, node]] >= forest.cut[t, node])
        return forest.path[t, node]

    want = [2 ** (-np.mean([path(t, row) for t in range(20)]) / mean_path(64)) for row in x]
    assert np.allclose(forest.score(x), want)
    # A tree's leaves: as deep as their splits, and further by what their rows are worth.
    some = x[np.random.default_rng(op3_quality.SEED).choice(len(x), 64, replace=False)]
    assert abs(np.mean([path(0, row) for row in some]) - mean_path(64)) < 3


def test_quality_verdict_is_calibrated_apart(spark):
    """Good texts of plain words, bad ones of few; the verdict is the plain rule over the forest's scores."""
    rng = random.Random(34)
    words = [f"w{k}" for k in range(500)]
    text = lambda bad: " ".join(rng.choices(words[:9] if bad else words, k=120)) + (" ###" * 60 if bad else "")
    rows = [(i, text(i % 10 == 0), int(i % 10 != 0)) for i in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, 1), (None, 0), (5, None)], "doc_id long, quality int")
    forest, least = model = op3_quality.fit(docs, labels)
    out = op3_quality.judged(docs, model, ["doc_id"]).collect()
    assert all(r.kept == (not r.base_failed and r.anomaly < least) for r in out)
    good = {i for i, _, q in rows if q}
    apart = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 2]
    assert sum(not r.kept for r in apart if r.doc_id in good) <= 0.005 * len(apart)
    assert sum(not r.kept for r in out if r.doc_id not in good) > 0.8 * 120
    tie = op3_quality.threshold(np.array([0.5, 0.5, 0.6, 0.6]), np.array([True, True, False, False]))
    assert 0.5 < tie <= 0.6


def test_quality_learns_from_all_labelled_rows(spark):
    """More rows of a label than any bound: leaves and threshold are those of all rows, by plain counts."""
    rng = random.Random(35)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words[: 20 if i % 4 else 300], k=rng.randint(50, 70))) + " #" * rng.randint(0, 9), int(i % 4 == 0 or i % 16 == 1)) for i in range(18_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "quality")
    forest, least = model = op3_quality.fit(docs, labels, trees=8, psi=64)
    table = op3_quality.judged(docs.join(labels, "doc_id"), model, ["doc_id", "quality"]).where("not base_failed").toPandas()
    grows = np.array([zlib.crc32(str(i).encode()) % 2 == 0 for i in table.doc_id])
    good = table.quality.to_numpy() != 0
    assert min((good & grows).sum(), (~good & ~grows).sum()) > 2000 and (~good).sum() > 8000
    assert least == op3_quality.threshold(table.anomaly.to_numpy()[~grows], good[~grows])
    n = np.where(good, 1.0, round(int((good & grows).sum()) * op3_quality.MIXED) / (~good & grows).sum())
    x = op3_quality.features({k: table[k].to_numpy() for k in op3_quality.BASE + op3_quality.MORE})
    for t, node in enumerate(forest.leaves(x[grows])):
        mass = np.bincount(node, n[grows], len(forest.path[t]))
        assert np.isclose(mass.sum(), n[grows].sum())
        for leaf in np.flatnonzero(mass):
            size = mass[leaf] / mass.sum() * 64
            a, b = (op3_quality._mean_path(int(size) + k) for k in (0, 1))
            assert abs(forest.path[t, leaf] - forest.steps[t, leaf] - (a + (b - a) * (size - int(size)))) < 1e-9


@pytest.mark.parametrize("steps,spare", [(3, 0.3), (40, 0.005), (40, 0.5), (10**9, 0.01), (1, 0.1)])
def test_quality_threshold_of_bins_is_that_of_all(spark, steps, spare):
    rng = np.random.default_rng(steps)
    good = rng.random(3000) < 0.8
    score = np.ceil(rng.random(3000) * 0.9 * steps) / steps
    df = spark.createDataFrame(list(zip(good.tolist(), score.tolist())), "good boolean, anomaly double").repartition(7)
    assert op3_quality._calibrated(df, spare) == op3_quality.threshold(score, good, spare)


def test_quality(docs, none, spark):
    got = op3_quality.judged(docs, None, ["doc_id"]).collect()
    assert len(got) == len(ROWS) and {r.doc_id for r in got if r.kept} <= {i for i, t in ROWS if t and len(t.encode().split()) >= 50}
    assert op3_quality.judged(none, None, ["doc_id"]).count() == 0
    assert op3_quality.fit(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int")) is None
    s = op3_quality.statistics(pa.array(["a b c a b c d\na b\n\na b\n# x", "", "one"], pa.string()))
    assert s["n_repeat_words"].tolist() == [6, 0, 0]
    assert s["n_dup_lines"].tolist() == [1, 0, 0] and s["n_symbols"].tolist() == [1, 0, 0] and s["n_words"].tolist() == [13, 0, 1]


def test_forest_finds_outliers():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 4)), rng.normal(8, 1, size=(5, 4))])
    score = op3_quality.Forest(x).score(x)
    assert score[500:].min() > np.quantile(score[:500], 0.98)


@pytest.mark.parametrize("chunk", [op4_simhash.CHUNK, 3])
def test_simhash(spark, none, chunk):
    base = [" ".join(random.choices(WORDS + list("abcdefgh"), k=60)) for _ in range(12)]
    rows = list(ROWS[:20]) + [(100 + k, b.replace(" ", "  ", 3) + " tail" * (k % 3)) for k, b in enumerate(base * 4)]
    got = op4_simhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int"), chunk=chunk).collect()
    fp = {}
    for i, t in rows:
        w = _words(t)
        sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in fp}
    for _ in range(len(fp)):
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
        if all((fp[i] ^ fp[j]).bit_count() > 4 or group[i] == group[j] for i in fp for j in fp):
            break
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", group[i]) for i in fp}
    assert op4_simhash.near_duplicates(none).count() == 0


def test_hashes_equal_the_library():
    data = [random.randbytes(n) for n in [*range(0, 70), 95, 96, 97, 200, 1000]]
    ends = np.cumsum([len(x) for x in data])
    buf = np.frombuffer(b"".join(data) + bytes(16), np.uint8)
    for seed in (0, 42):
        got = op4_simhash.xxh64(buf, ends - [len(x) for x in data], ends, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(x, seed) for x in data]


def test_decontamination(spark, docs, none):
    item = "What is the name of the river that runs through the old town. It is the long green river of the north"
    long = " ".join(f"w{k}" for k in range(300))
    items = spark.createDataFrame([(1, item), (2, long + ". the answer is here now"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    texts = spark.createDataFrame([(1, "pre text " * 90 + item.upper() + " more words" * 50), (2, item.split(".")[0]), (3, "x " + long + ". the answer is here now"), (4, None), (5, "other words " * 100), (1, item)], "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in op5_decontam.leaks(texts, items, part_bytes=1).collect())
    assert got == Counter({(1, 1): 2, (1, 5): 2, (3, 2): 1})
    assert sorted(r.doc_id for r in op5_decontam.without_leaks(texts, items).collect()) == [2, 4, 5]
    assert op5_decontam.leaks(docs, items.limit(0)).count() == 0 and op5_decontam.leaks(none, items).count() == 0


def _bm25(items, texts):
    """(doc, item): best score over passages, of all that reach the item's threshold, by the plain formula."""
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    own = {i: Counter(words(t)) for i, t in items}
    lens = {i: sum(c.values()) for i, c in own.items()}
    n, mean, df = len(items), sum(lens.values()) / len(items), Counter(w for c in own.values() for w in c)
    impact = {i: {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * lens[i] / mean)) for w, k in c.items()} for i, c in own.items()}
    out = {}
    for d, t in texts:
        w = words(t)
        for at in range(0, max(len(w) - 32, 1), 32):
            passage = set(w[at : at + 64])
            for i in own:
                surely = lens[i] if lens[i] <= 32 else min(16 + lens[i] / 2, 64)
                score = sum(x for k, x in impact[i].items() if k in passage)
                if lens[i] and score >= 0.6 * sum(impact[i].values()) * surely / lens[i]:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def test_retrieval_equals_plain_bm25(spark):
    rng = random.Random(11)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 90)))) for i in range(150)]
    texts = [(d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 300))) + " " + (items[d % 150][1].upper() if d % 3 == 0 else "")) for d in range(60)]
    want = _bm25(items, texts)
    df = spark.createDataFrame(items, "item_id long, text string")
    for part_bytes in (op5_decontam.PART_BYTES, 40_000):
        got = {}
        for index in op5_decontam.parts(df, part_bytes):
            words = op5_decontam.Words(pa.array([t for _, t in texts]), op5_decontam.PLAIN)
            for r, i, s in zip(*index.retrieve(index.term_of(words.hashes()), words.first)):
                got[int(r), int(index.ids[i])] = s
        assert got.keys() == want.keys() and len(want) > 20
        assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_leaks_whatever_the_parts(spark):
    rng = random.Random(12)
    items = [(i, " ".join(f"v{rng.randint(0, 300)}" for _ in range(rng.randint(8, 80))) + f". answer number {i} is here") for i in range(60)]
    texts = [(d, f"pre {d} " + items[d % 60][1] + " post" * (d % 50)) for d in range(40)] + [(99, "v1 v2 v3")]
    df = spark.createDataFrame([(i, t, 1, 0.5) for i, t in items], "item_id long, text string, row int, df double")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in op5_decontam.leaks(docs, df, part_bytes=k).collect()) for k in (op5_decontam.PART_BYTES, 20_000)]
    assert rows[0] == rows[1] and [x[:2] for x in rows[0]] == [(d, d) for d in range(40)]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, spaced):
    texts = [t or "" for t in TEXTS if t is None or len(t) < 5000] + ["".join(random.choices(" \n\tab'é1.<|　", k=random.randint(0, 30))) for _ in range(500)]
    e, t = Encoder(P.path(name), spaced), Tokenizer.from_file(P.path(name))
    for _ in range(2):
        ids, first = e.ids(pa.array(texts, pa.string()))
        assert all(ids[first[i] : first[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts))


def test_packing(docs, none):
    rows = op6_packing.pack(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= sum(r.length for r in rows) / 64 * 1.05 + 1
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in ROWS)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == Counter({k: sum(n * c for (i, n), c in want.items() if i == k) for k in {i for i, _ in ROWS}})
    assert op6_packing.pack(none, P.path("word_bpe_49k.json")).count() == 0


def test_fullest_is_best():
    for _ in range(60):
        c = {random.randint(1, 40): random.randint(1, 3) for _ in range(5)}
        cap, sums = random.randint(1, 90), {0}
        for k, n in c.items():
            sums = {s + j * k for s in sums for j in range(n + 1)}
        use = op6_packing.fullest(c, cap)
        assert sum(k * n for k, n in use) == max(s for s in sums if s <= cap) and all(n <= c[k] for k, n in use)


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_bit_image(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 3000, dtype=np.uint64).astype(np.uint32)
    counts = np.array([0, 1000, 1, 1999])
    f = op7_bitpack.Image(op7_bitpack.image(np.arange(4), counts, ids, width, block=256))
    assert (f.ids(0, 3000) == ids).all() and (f.document(3) == ids[1001:]).all() and len(f.document(0)) == 0 and (f.ids(500, 700) == ids[500:1200]).all()


def test_token_files(docs, none, tmp_path, monkeypatch):
    monkeypatch.setattr(op7_bitpack, "STEP_BYTES", 2000)
    folder = f"file://{tmp_path}/files"
    files = op7_bitpack.encode_files(docs, folder, P.path("byte_bpe_50k.json"), 2, 50257, file_ids=500)
    rows = op7_bitpack.decode_files(files, folder, op7_bitpack.crc).orderBy("start").collect()
    t, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    want, whole = sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0])), []
    for r, (i, x) in zip(rows, want, strict=True):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        whole.append(ids)
    there = sorted((tmp_path / "files").glob("*"))
    assert len(there) == files.count() > 3 and all(x.suffix == ".tlbp" for x in there)
    images = [op7_bitpack.Image(x.read_bytes()) for x in there]
    assert (np.concatenate([f.ids(0, f.n) for f in images]) == np.concatenate(whole)).all()
    empty = f"file://{tmp_path}/empty"
    assert op7_bitpack.decode_files(op7_bitpack.encode_files(none, empty, P.path("byte_bpe_50k.json"), 2, 50257), empty).count() == 0


def test_encoder_starts_anew(monkeypatch):
    texts = [f"word{k} {k * 7919} été{k}" for k in range(3000)]
    small, large = Encoder(P.path("byte_bpe_50k.json"), True, most=100, most_ids=500), Encoder(P.path("byte_bpe_50k.json"), True)
    for k in range(0, 3000, 300):
        some = pa.array(texts[k : k + 300])
        assert (small.ids(some)[0] == large.ids(some)[0]).all()
    assert small.known.n < large.known.n


def test_toxicity(spark, docs, none):
    rows = [(i, " ".join(random.choices(["sun", "sea", "tree", "hill"], k=40)) + (" vile! awful vile" if i % 4 == 0 else "")) for i in range(400)]
    texts = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(900, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in op8_toxicity.passages(texts, op8_toxicity.fit(texts, labels)).collect()}
    assert all((got[i].score >= 0.3) == (i % 4 == 0) for i in range(300, 400)) and 0 <= got[900].score < 0.3
    assert [(p.first, p.end) for p in got[304].passages] == [(40, 43)]
    assert op8_toxicity.passages(none, op8_toxicity.Model()).count() == 0
    assert op8_toxicity.passages(docs, op8_toxicity.fit(docs, labels.limit(0))).where("score <> 0").count() == 0


def test_segments_are_maximal():
    for _ in range(200):
        n = random.randint(1, 12)
        value = [random.choice([-0.5, -0.5, 1.0, 2.0, 0.4]) for _ in range(n)]
        at = [i for i, v in enumerate(value) if v > 0]
        got = op8_toxicity.segments(at, [value[i] for i in at], 0.5)

        def brute(a, b):
            best = max(((sum(value[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if not best or best[0] <= 0:
                return []
            *_, i, j = best
            return brute(a, i) + [(i, j)] + brute(j, b)

        assert abs(max((s for *_, s in got), default=0) - max((sum(value[i:j]) for i, j in brute(0, n)), default=0)) < 1e-9
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        assert all(abs(sum(value[a:b]) - s) < 1e-9 for a, b, s in got)
        if len(set(value)) == n or not any(abs(sum(value[i:j])) < 1e-9 for i in range(n) for j in range(i + 1, n + 1)):  # no ties of sums
            assert [x[:2] for x in got] == brute(0, n)


def test_all_maximal_segments_of_real_scores():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(1, 25)
        at = sorted(rng.sample(range(n), rng.randint(1, n)))
        score = {i: rng.uniform(0.05, 2.0) for i in at}
        value = [score.get(i, -0.35) for i in range(n)]

        def brute(a, b):
            best = max(((sum(value[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            return brute(a, best[1]) + [best[1:]] + brute(best[2], b) if best[0] > 0 else []

        assert [x[:2] for x in op8_toxicity.segments(at, [score[i] for i in at], 0.35)] == brute(0, n)


def test_segments_in_linear_time():
    def took(n):
        # Every search meets many segments: sums fall, and rise again at the end.
        places, scores = list(range(0, 40 * n, 40)), [1.0 + (k % 7) / 10 for k in range(n)]
        t = time.perf_counter()
        op8_toxicity.segments(places, scores, 0.15)
        op8_toxicity.segments(list(range(n)), scores, 0.15)
        return time.perf_counter() - t

    assert min(took(160_000) for _ in range(3)) < 20 * min(took(20_000) for _ in range(3))


def test_evidence_is_the_best_sum():
    m = op8_toxicity.Model(lam=0.8, log_k=-3.0)
    scores, n = [9.0, 4.0, 8.5, 0.5], 200
    x = sorted((0.8 * s + 3.0 - math.log(n) for s in scores), reverse=True)
    want = []
    for r in range(1, 5):
        t = sum(x[:r])
        if r == 1 or x[r - 1] > 0:
            p = math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))
            want.append(-math.log(p * 2**r))
    assert abs(m.aggregate(scores, n) - max(want)) < 1e-9
    assert m.aggregate([9.0, 8.5], n) > m.aggregate([9.0], n) == m.aggregate([9.0, 0.1], n)


def test_pii(spark, docs, none):
    texts = {
        1: "mail a.b@c.de now, ip 10.0.0.255 not 10.0.0.256", 2: "card 4111 1111 1111 1111. and é +1 (017) 555-7713", 3: None, 4: "", 5: "x@y.zz" * 300, 6: "1 " * 20_000, 7: "9" * 50_000 + "@", 8: "token a@b.c_d@e.fg",
    }
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.base] for r in op9_pii.found(df, {}).collect()}
    assert got[1] == [("email", 5, 13), ("ip", 22, 32)] and got[2] == [("card", 5, 24), ("phone", 32, 49)] and got[3] == got[4] == got[6] == got[7] == []
    assert len(op9_pii.redact(df, {}).where("doc_id = 1").collect()) == 2
    assert op9_pii.redact(df, {}).where("doc_id = 2").first().text == "card [CARD]. and é [PHONE]"
    assert op9_pii.fit(none) == {} and op9_pii.found(none, {}).count() == 0 and op9_pii.found(docs, op9_pii.fit(docs)).count() == len(ROWS)


def test_language(spark, docs, none):
    path = P.path("piece_bpe_32k.model")
    say = {"en": "the house and the green hill with water", "de": "das Haus und der grüne Hügel mit Wasser"}
    rows = [(i, " ".join(random.choices(say[k].split(), k=12)), k) for i, k in enumerate(["en", "de"] * 30)]
    model = op10_langid.fit(spark.createDataFrame([*rows, (99, "x", None), (98, None, "en")], "doc_id long, text string, lang string"), path)
    got = op10_langid.predict(spark.createDataFrame([(1, "THE water!"), (2, "Wasser; Hügel"), (3, None), (4, "12 !"), (5, "q" * 500)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:4]] == ["en", "de", "und", "und"] and all(0 <= r.score <= 1 for r in got)
    assert op10_langid.predict(none, model).count() == 0 and op10_langid.predict(docs, model).count() == len(ROWS)
    blank = op10_langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), path)
    assert {r.lang_pred for r in op10_langid.predict(docs, blank).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    theta = np.array([[0.3], [0.2], [0.2], [0.2], [0.1], [1e-9]])
    got = np.exp(op10_langid.Lattice(["ab"], op10_langid.prefixes_of(pieces), 5).likelihood(theta)[0, 0])
    assert abs(got - (0.3 * 0.2 * 0.2 + 0.3 * 0.2 + 0.1 * 0.2)) < 1e-12


def _plain_log(run, pieces, theta):
    """log of the sum over all segmentations, in exact fractions."""
    from fractions import Fraction

    x, alpha = "▁" + run, [Fraction(1)] + [Fraction(0)] * (len(run) + 1)
    for end in range(1, len(x) + 1):
        for start in range(max(0, end - 8), end):
            p = pieces.get(x[start:end], len(pieces) if end - start == 1 else None)
            if p is not None:
                alpha[end] += alpha[start] * Fraction(float(theta[p]))
    return math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)


def test_runs_of_any_length():
    rng = np.random.default_rng(8)
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "c", "ab", "▁a", "abc", "ca", "bcab", "▁cab"])}
    theta = rng.random((len(pieces) + 1, 2)) / 50
    words = ["".join(rng.choice(list("abcx"), n)) for n in (1, 2, 23, 24, 25, 60, 60, 400)]
    got = np.zeros((len(words), 2))
    for some, lattice in op10_langid.lattices(words, op10_langid.prefixes_of(pieces), len(pieces), 2):
        got[some] = lattice.likelihood(theta)
    assert all(abs(got[i, c] - _plain_log(w, pieces, theta[:, c])) < 1e-7 * max(1, -got[i, c]) for i, w in enumerate(words) for c in (0, 1))
    # Expected uses: every letter is in one piece.
    lattice = op10_langid.Lattice(words, op10_langid.prefixes_of(pieces), len(pieces))
    use = lattice.expected(theta[:, 0], np.ones(len(words)))
    size = np.array([*map(len, pieces), 1])
    assert abs((use * size).sum() - sum(len(w) + 1 for w in words)) < 1e-6


def test_language_of_long_texts_and_ties(spark):
    path = P.path("piece_bpe_32k.model")
    long = {"ja": "これは長い文です" * 4000, "en": "the house and the green hill " * 4000}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(long.items())] + [(9, "the house and the green hill", "en2")], "doc_id long, text string, lang string")
    model = op10_langid.fit(docs, path)
    assert model[0] == ["en", "en2", "ja"]
    twice = (["b", "a"], np.repeat(model[1][:, :1], 2, axis=1), model[2])
    asked = spark.createDataFrame([(1, "これは長い文です" * 9)], "doc_id long, text string")
    assert op10_langid.predict(asked, model).first().lang_pred == "ja" and op10_langid.predict(asked, twice).first().lang_pred == "b"


def test_pii_windows(spark):
    texts = {"card": ["2024 4111 1111 1111 1111", "6304 0000 0000 0000 000 1", "3782 822463 10005"], "phone": ["01 23 45 67 89", "+49 30 1234567"], "ip": ["1.10.0.0.7"]}
    want = {"card": ["4111 1111 1111 1111", "6304 0000 0000 0000 000", "3782 822463 10005"], "phone": ["01 23 45 67 89", "+49 30 1234567"], "ip": ["10.0.0.7"]}
    for kind, of in texts.items():
        df = spark.createDataFrame([("é " + t + " on",) for t in of], "text string")
        got = {r.text: {r.text[x.start : x.end] for x in r.c} for r in df.select("text", op9_pii.candidates(F.col("text"), kind).alias("c")).collect()}
        assert all(w in got["é " + t + " on"] for t, w in zip(of, want[kind])), got
    # Trees that go by the check digit alone: of overlapping windows the right one is taken, though another begins before it.
    k = op9_pii.FEATURES.index("luhn")
    trees = op9_pii.Trees(np.array([[16 if i == 0 else int(i == k) * v for i in range(len(op9_pii.FEATURES))] for v in (0, 1)]), np.array([0.0, 50.0]), np.array([50.0, 0.0]))
    df = spark.createDataFrame([("pay 2024 4111 1111 1111 1111 now",)], "text string")
    assert [r.spans for r in op9_pii.found(df, {"card": (trees, 0.5)}).collect()] == [[("card", 9, 28)]]


def _plain_base(text):
    """The base spans by the contract's patterns, with Python's expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        d = [int(c) for c in reversed(m[0]) if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(21)
    pieces = ["4111 1111 1111 1111", "4111111111111111", "10.0.0.255", "1.2.3.4.5", "256.1.1.1", "a.b@c.de", "x@y.zz", "@", ".", "+", "+1 (017) 555-7713", "+49-30-1234567", "1", "22", "é", " ", "-", "6304000000000000000", "0", "a", "\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(600)]
    texts += [" ".join(rng.choices(pieces, k=400)) for _ in range(3)] + ["a@b" + ".c" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.base] for r in op9_pii.found(df, {}).collect()}
    assert got == {i: _plain_base(t) for i, t in enumerate(texts)}


def test_pii_nearness(spark):
    rng = random.Random(22)
    for _ in range(3):
        cuts = sorted(rng.sample(range(3000), 600))
        others = [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        spans = [(a, a + rng.randint(1, 12)) for a in rng.sample(range(3000), 500)] + rng.sample(others, 50)
        df = spark.createDataFrame([(spans, others)], "s array<struct<start:int,end:int>>, o array<struct<start:int,end:int>>")
        got = df.select(op9_pii.nearness(F.col("s"), F.col("o")).alias("n")).first().n
        assert got == [op9_pii.EQUAL if x in others else op9_pii.TOUCHES if any(x[0] < b and a < x[1] for a, b in others) else op9_pii.FREE for x in spans]


@pytest.fixture(scope="module")
def pii_model(spark):
    docs = spark.createDataFrame([(i, f"ab cd {i} on 2024-01-{10 + i % 19} write a{i}@b.org or 10.0.0.{i % 250} order 4031065727380220") for i in range(300)], "doc_id long, text string")
    return op9_pii.fit(docs)


def test_pii_trees_add_and_reject(spark, pii_model):
    added = {
        1: ("reach me: jane.doe (at) mail (dot) org today", "email", "jane.doe (at) mail (dot) org"), 2: ("paid 2024 4111 1111 1111 1111 now", "card", "4111 1111 1111 1111"),
        3: ("é call (017) 555-7713 tonight", "phone", "(017) 555-7713"), 4: ("amex card 3782 822463 10005.", "card", "3782 822463 10005"),
    }
    left = {10: "born on 2024-01-15, moved 12.03.1999", 11: "it cost 1.299.000 or 12 345 678 in all", 12: "version 3.14159265358 of 2019-2023", 13: "order 4031065727380221 item 978-3-16-148410-0", 14: "300.1.2.3 and 1.2.3.4.5.6"}
    df = spark.createDataFrame([(k, x[0]) for k, x in added.items()] + list(left.items()), "doc_id long, text string")
    got = {r.doc_id: [(x.kind, r.text[x.start : x.end]) for x in r.spans] for r in op9_pii.found(df, pii_model).collect()}
    assert {k: got[k] for k in added} == {k: [(kind, s)] for k, (_, kind, s) in added.items()}
    assert {k: got[k] for k in left} == {k: [] for k in left}


def test_pii_long_texts_in_seconds(spark, pii_model):
    many = " ".join(f"a{i}@b{i}.org" for i in range(100_000))
    table = "\n".join(" ".join(f"{i * 37 % 9999}" for i in range(k, k + 6)) for k in range(0, 6000, 6))
    df = spark.createDataFrame([(1, many, "x", 1), (2, table, "x", 1)], "doc_id long, text string, base string, spans int")
    op9_pii.redact(df.limit(1), pii_model).collect()
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in op9_pii.redact(df, pii_model).collect()}
    assert time.perf_counter() - began < 60
    assert got[1] == " ".join(["[EMAIL]"] * 100_000) and len(got[2]) > 1000
