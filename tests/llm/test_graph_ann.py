import numpy as np
import pytest

from spoor.llm import graph_ann

SCHEMA = "vec_id long, embedding array<float>, id string, v string, cid string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, query, own, k):
    scores = []
    for i, v in rows:
        if i != own and len(v) == len(query):
            a, b = np.asarray(v, float), np.asarray(query, float)
            scores.append((-float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), i))
    return sorted((round(s, 12), i) for s, i in scores)[:k]


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 32)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=32)).astype(np.float32).tolist()) for i in range(1500)]
    df = table(spark, rows)
    out = graph_ann.nearest(df, df.where("vec_id % 50 = 0"), 5, shard_rows=500).collect()
    hits = 0
    for q in range(0, 1500, 50):
        got = {r["vec_id"] for r in out if r["query_id"] == q}
        assert sorted(r["rank"] for r in out if r["query_id"] == q) == [1, 2, 3, 4, 5]
        hits += len(got & {i for _, i in brute(rows, rows[q][1], q, 5)})
    assert hits >= 0.97 * 150


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 0, -1)]
    rows += [(200, [1.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0]), (201, [0.0, 1.0]), (202, [1.0, 1.0])]
    bad = [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 0.0]), (303, [float("nan"), 1.0, 1.0]),
           (304, [float("inf"), 1.0, 1.0]), (305, []), (None, [1.0, 2.0, 3.0])]
    df = table(spark, rows + bad)
    out = graph_ann.nearest(df, df.where("vec_id IN (50, 200, 201, 300, 303)"), 5).collect()
    of = lambda q: [(r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(50) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert [v for _, v in of(200)] == [1, 2, 3, 4, 5]
    assert of(201) == [(1, 202)]
    assert {r["query_id"] for r in out} == {50, 200, 201}
    assert [r["score"] for r in out if r["query_id"] == 201] == [pytest.approx(2**-0.5, abs=1e-15)]


def test_empty_tables(spark):
    df = table(spark, [])
    assert graph_ann.nearest(df, df).count() == 0
    one = table(spark, [(1, [1.0])])
    assert graph_ann.nearest(one, one).count() == 0
