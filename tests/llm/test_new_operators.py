"""Decontamination, importance resampling, hard negatives, and long texts of line dedup, against brute-force versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import decontaminate as module
from stratum.llm import negatives
from stratum.llm.decontaminate import contamination, decontaminate
from stratum.llm.line_dedup import remove_boilerplate
from stratum.llm.negatives import hard_negatives
from stratum.llm.queries import op12_hard_negatives
from stratum.llm.resample import crc_ring, importance_scores, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORDS.findall((text or "").translate(UPPER))


def prose(n, seed, letters="abcdeéß"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(n))


ITEM, OTHER = prose(30, 1), prose(14, 2)
DOCS = [
    (1, f"{prose(40, 3)}. {ITEM.upper().replace('É', 'é')}! {prose(9, 4)}", "x", 5), (2, " ".join(ITEM.split()[:9]), "x", 5), (3, " ".join(ITEM.split()[5:16]), "x", 5), (4, None, "x", 5),
    (5, "", None, None), (6, "?!", "x", 5), (7, f"Tiny,  ITEM {OTHER}", "x", 5), (8, f"{OTHER} {OTHER}", "x", 5), (9, prose(4000, 5) + f" {ITEM} " + prose(4000, 6), "y", 5),
    (10, prose(60, 7), "y", 5), (10, prose(60, 7), "y", 5), (None, f"a {ITEM}", "y", 5), (None, None, "y", 5), (11, " ".join(["na"] * 300), "y", 5), (12, "a–b c", "y", 5),
]
ITEMS = [("b2", ITEM), ("b10", OTHER), ("b10", OTHER), ("short", "tiny item"), ("none", None), ("empty", "..."), (None, "c d e f g"), ("na", " ".join(["na"] * 10))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, text_hash string, row int").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string").repartition(2)


def brute_contamination(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(n, len(v))
        windows = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
        for k in range(len(w) - size + 1) if v else []:
            if tuple(w[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found |= {item} - {None}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), hit


@pytest.mark.parametrize("most", [module.BROADCAST_WINDOWS, 7])
def test_contamination_equals_brute_force(docs, items, most, monkeypatch):
    """Also with a hash set that has to be dealt to several scans."""
    monkeypatch.setattr(module.find_windows, "__defaults__", (*module.find_windows.__defaults__[:-1], most))
    got = contamination(docs, items)
    want = Counter((i, *brute_contamination(t, ITEMS)[:5]) for i, t, *_ in DOCS)
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert contamination(docs.where("doc_id < 0"), items).count() == 0
    assert contamination(docs, items.where("item_id = 'x'")).where("n_hit > 0 OR n_items > 0").count() == 0


def test_no_python_runs_in_contamination(docs, items):
    assert "Python" not in contamination(docs, items)._jdf.queryExecution().toString()


def test_spans_and_documents_are_removed(docs, items):
    clean = decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(DOCS)
    kept = Counter((r.doc_id, r.text) for r in clean.collect())
    want = Counter()
    for i, t, *_ in DOCS:
        hit = brute_contamination(t, ITEMS)[5]
        if hit:
            pieces = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)
            t = "".join(p for k, p in enumerate(pieces) if k not in hit) + re.search(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\Z", t)[0]
        want[i, t] += 1
    assert kept == want
    left = decontaminate(docs, items, remove="documents")
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, t, *_ in DOCS if not brute_contamination(t, ITEMS)[4])
    with pytest.raises(ValueError, match="remove"):
        decontaminate(docs, items, remove="all")


def test_lines_and_spans_of_long_texts_take_linear_time(spark, items):
    """A text of 50,000 lines that loses one: the lines of a text are cut once, not once for each line."""
    body = [f"line {k} of its own" for k in range(50_000)]
    rows = [(k, "\n".join([*body[: 25_000 + k], "all sites say this", *body[25_000 + k :]]) if k < 2 else f"all sites say this\n{k}", f"s{k}") for k in range(6)]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: r for r in remove_boilerplate(data, sites=5).collect()}
    assert time.time() - began < 60
    assert got[0].text == "\n".join(body) and got[1].n_lines == 50_001 and got[5].text == "5"
    began = time.time()
    cut = decontaminate(spark.createDataFrame([(1, f"{prose(50_000, 99)} {ITEM}")], "doc_id long, text string"), items).first().text
    assert time.time() - began < 60 and len(words(cut)) == 50_000


def test_ring_of_states():
    for n in (1, 2, 3, 5):
        w = [b"aa", b"b", b"aa", b"c", b"dddd", b"b"]
        want = sorted(zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, n + 1) for i in range(len(w) - k + 1))
        assert sorted(crc_ring(w, n)) == want and crc_ring([], n) == []


def brute_scores(docs, target, percent, least, buckets=10_000, n=2, seed=7):
    def features(text):
        w = [x.encode() for x in words(text)]
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, order[: percent * len(order) // 100], order


@pytest.mark.parametrize(("n", "buckets", "percent"), [(2, 10_000, 25), (3, 70_000, 60), (1, 7, 100)])
def test_scores_equal_brute_force(docs, items, n, buckets, percent):
    got = importance_scores(docs, items, n=n, buckets=buckets, percent=percent, min_words=5).collect()
    every, drawn, _ = brute_scores([r[:2] for r in DOCS], [t for _, t in ITEMS], percent, 5, buckets, n)
    text = lambda i: None if i is None else str(i)
    assert Counter((r.id, r.n_features, r.weight, r.score) for r in got) == Counter((text(i), *r) for i, *r, _ in every)
    ranks = sorted((r.rank, r.id) for r in got if r["rank"] is not None)
    assert ranks == [(k, text(r[0])) for k, r in enumerate(drawn, 1)]


def test_drawn_documents_keep_their_columns(docs, items):
    out = resample(docs, items, percent=50, min_words=5)
    _, drawn, order = brute_scores([r[:2] for r in DOCS], [t for _, t in ITEMS], 50, 5)
    ids = {r[0] for r in drawn}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ids
    assert resample(docs.where("doc_id < 0"), items).count() == 0
    none = importance_scores(docs, items.where("item_id = 'x'"), min_words=5)
    assert none.count() == len(DOCS) and none.where("rank IS NOT NULL").count() == 25 * len(order) // 100


def brute_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((k, i, [math.floor(scale * x) for x in v], label))
    out = []
    place = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for k, i, v, label in ok:
        if not is_anchor(i):
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, lab) for m, j, w, lab in ok if m != k and len(w) == len(v)), key=place)
        for score, j, _ in [s for s in scored if s[2] == label][:positives]:
            band = [s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score][:negatives]
            out += [(i, j, r, s[1], score, s[0]) for r, s in enumerate(band, 1)]
    return Counter(out)


def vectors(seed, n=160, dim=6, spread=0.4):
    r = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in np.float32(r.normal(1, spread, dim))], int(r.integers(0, 3))) for k in range(n)]
    same = rows[3][1]
    rows += [(1000 + k, same, k % 3) for k in range(40)] + [(2000, None, 1), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2002, [float("nan")] * 6, 1), (2003, [1.0] * 6, None), (2004, [float("inf")] * 6, 0)]
    return rows + [(None, same, 0), (2005, [1.0, 2.0], 0), (2010, [1.0, 2.0], 0), (2020, [2.0, 0.5], 1), (2030, [], 2)]


@pytest.mark.parametrize(("block", "size"), [(4096, 1 << 16), (16, 50)])
def test_negatives_equal_brute_force(spark, block, size, monkeypatch):
    """Ties, repeated vectors, lengths that differ, rows that take no part; in one block and in many."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "SLICE_ROWS", size)
    rows = vectors(1)
    data = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, row string").repartition(5)
    got = hard_negatives(data, F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i is not None and i % 10 == 0)
    wide = hard_negatives(data, F.col("vec_id") % 25 == 0, positives=2, negatives=9, low=0, high=100, scale=1000)
    assert Counter(map(tuple, wide.collect())) == brute_negatives(rows, lambda i: i is not None and i % 25 == 0, 2, 9, 0, 100, 1000)
    assert hard_negatives(data.where("vec_id < 0"), F.lit(True)).count() == 0
    assert hard_negatives(data, F.lit(False)).count() == 0


def test_large_components(spark):
    rows = [(k, [5e4 * (k + 1), -3e4, 2.5], k % 2) for k in range(20)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(map(tuple, hard_negatives(data, F.col("vec_id") % 5 == 0).collect())) == brute_negatives(rows, lambda i: i % 5 == 0)
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives(data.withColumn("embedding", F.array(F.lit(1e12), F.lit(1.0), F.lit(1.0))), F.lit(True)).collect()


def test_labels_move_in_the_query(spark):
    raw = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in raw]
    assert Counter(map(tuple, op12_hard_negatives(spark, SMALL).collect())) == brute_negatives(moved, lambda i: i % 50 == 0)
