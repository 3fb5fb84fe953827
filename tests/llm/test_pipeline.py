"""The pipeline and the queries against brute-force versions and SQL."""

from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from stratum.llm.quality import CompressionLimits, base_counts, compression
from stratum.llm.queries import oracle_sql, queries

from .test_text_operators import components, library_ids, normal

SMALL = "/root/testdata/sf0.001"


def test_stages_are_the_ones_wanted():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "packing"]


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = []
    for i, t in rows:
        flat = np.frombuffer((t or "").encode(), np.uint8)
        n, c = base_counts(flat, np.asarray([0, len(flat)])), compression(flat, np.asarray([0, len(flat)]), CompressionLimits())
        if n["n_words"][0] >= 20 and 100 * n["n_repeat_words"][0] <= 30 * n["n_words"][0] and not c["outside_band"][0]:
            good.append((i, t))
    first = {}
    for i, t in sorted(good):
        first.setdefault(normal(t), (i, t))
    exact = sorted(first.values())
    kept = [(i, t) for (i, t), (_, _, least) in zip(exact, components(exact, 80)) if i == least]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {p.doc_id for p in got} == {i for i, _ in kept}
    lengths = defaultdict(int)
    for p in got:
        lengths[p.doc_id] += p.length
    assert lengths == {i: len(library_ids("byte_bpe_50k.json", t)) + 1 for i, t in kept}
    filled = Counter()
    for p in got:
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 3


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    got = queries()[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
