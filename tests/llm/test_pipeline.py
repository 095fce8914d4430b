"""The pipeline against a plain version of each stage, on a small table with nulls, copies, leaks, personal data and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import op10_langid

SAY = {"en": "the house and the green hill with water under some old bridge near our town", "de": "das Haus und der grüne Hügel mit Wasser unter einer alten Brücke bei unserer Stadt"}
ITEM = "What is the name of the river that runs through the old town. It is the long green river of the north"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, base string, spans int, base_email string, component_id long, fp string, `a.b` int, sequence_id string"
PII = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "IP": r"[0-9]+(?:\.[0-9]+){3}"}


def _rows():
    rng = random.Random(5)
    made = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        made.append((i, " ".join(rng.choices(SAY[lang].split(), k=rng.randint(30, 90))), lang))
    made += [(200, made[4][1], "en"), (201, made[4][1].upper(), "en"), (202, made[7][1] + " Wasser", "de")]
    made += [(210, made[8][1] + " " + ITEM + " " + made[10][1], "en"), (211, ITEM.split(".")[0] + " " + made[12][1], "en")]
    made += [(220 + k, f"{made[20 + k][1]} write to me{k}@mail.example.org or 10.0.{k}.7 today", None) for k in range(8)]
    made += [(230, None, "en"), (231, "", None), (232, "12 ½ ! 345", "en"), (233, "the green hill " * 9000, "en"), (None, made[30][1] + " near", "en"), (5, made[5][1], "de")]
    return [(i, t, lang, "s", None if t is None else len(t), 0.1, "xx", "b", 3, "e", 9, "f", 4, "q") for i, t, lang in made]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def _language(rows, model):
    langs, theta, pieces = model
    longest = max(map(len, pieces))

    def log_of(run, c):
        x, alpha = "▁" + run, [1.0] + [0.0] * (len(run) + 1)
        for end in range(1, len(x) + 1):
            for start in range(max(0, end - longest), end):
                p = pieces.get(x[start:end], len(pieces) if end - start == 1 else None)
                if p is not None:
                    alpha[end] += alpha[start] * theta[p, c]
        return np.log(alpha[-1])

    known, out = {}, []
    for r in rows:
        runs = Counter(s for w in re.split(r"[ \t-\r]+", r[1] or "") for s in re.findall(r"[^\W\d_]+", w.lower()) if s.isalpha())
        for s in runs:
            known.setdefault(s, np.array([log_of(s, c) for c in range(len(langs))]))
        if runs:
            total = sum(n * known[s] for s, n in runs.items())
            if 1 / np.exp(total - total.max()).sum() >= 0.5:
                out.append((*r[:2], r[2] if r[2] is not None else langs[int(total.argmax())], *r[3:]))
    return out


def _near(rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    of = {r: fp(r[1]) for r in rows}
    group = {f: f for f in of.values()}
    changed = True
    while changed:
        changed = False
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = defaultdict(list)
    for r, f in of.items():
        least[group[f]] += [r[0]] if r[0] is not None else []
    return list({(r[0], r[1]): r for r in rows if r[0] is not None and r[0] == min(least[group[of[r]]])}.values()) + [r for r in rows if r[0] is None]


def _clean(rows):
    def shingles(text):
        w = re.findall(r"[a-z0-9]+", text.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    parts = [shingles(x) for x in ITEM.split(". ")]
    return [r for r in rows if any(len(p & shingles(r[1] or "")) < 0.8 * len(p) for p in parts)]


def _redacted(rows):
    out = []
    for r in rows:
        t = r[1]
        for kind, pattern in PII.items():
            t = t and re.sub(pattern, f"[{kind}]", t)
        out.append((r[0], t, *r[2:4], r[4] if t is None else len(t), *r[5:]))
    return out


def _key(r):
    return tuple((x is not None, str(x)) for x in r)


def test_each_stage(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    assert Counter(rows) == Counter(_rows())
    model = op10_langid.fit(docs, P.path("piece_bpe_32k.model"))
    plain = [lambda x: _language(x, model), _near, _clean, _redacted]
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain):
        before = len(rows)
        got = stage(spark, docs, table)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        rows = want(rows)
        assert sorted(map(tuple, got.collect()), key=_key) == sorted(rows, key=_key), name
        assert name == "PII" or 0 < len(rows) < before, name
        docs = spark.createDataFrame(rows, SCHEMA)
    ids = {r[0] for r in rows}
    assert not ids & {200, 201, 210, 230, 231, 232} and {4, 211, 220, 233, None} <= ids

    t, want, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter(), defaultdict(list)
    for r in rows:
        whole = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for p, at in enumerate(range(0, len(whole), 4096)):
            want[r[0], p, at, len(whole[at : at + 4096]), zlib.crc32(whole[at : at + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, table).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        pieces[r.sequence_id].append((r.offset, r.length))
    for bin in pieces.values():
        ends = [0, *np.cumsum([n for _, n in sorted(bin)]).tolist()]
        assert [o for o, _ in sorted(bin)] == ends[:-1] and ends[-1] <= 4096
    assert len(pieces) == -(-sum(r.length for r in got) // 4096)


def test_empty_table(spark, table, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{table}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
