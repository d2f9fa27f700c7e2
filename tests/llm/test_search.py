"""Nearest vectors against brute force: recall, exact scores, order and odd rows."""

import math

import numpy as np

from claimweave.llm import collision_search, queries


def brute(ids, x, query_ids, k=20):
    out = {}
    for qi in query_ids:
        q = x[ids == qi][0]
        s = (x * q).sum(1)
        keep = ids != qi
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[qi] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def test_recall_and_scores(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toArrow()
        ids = rows.column(0).to_numpy()
        x = np.array(rows.column(1).to_pylist(), float)
        want = brute(ids, x, ids[ids % 20 == 0])
        got = {}
        for r in queries.op8_collision_search(spark, sf).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hit = 0
        for qi, found in got.items():
            found.sort()
            assert [f[0] for f in found] == list(range(1, 21))
            assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
            for _, v, s in found:
                assert math.isclose(s, float((x[ids == v][0] * x[ids == qi][0]).sum()), rel_tol=1e-12)
            hit += len({f[1] for f in found} & {w[0] for w in want[qi]})
        assert hit / (20 * len(want)) > 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (9, [3.0, 4.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (41, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in collision_search.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 3.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 4, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 0, -1.0), (20, 4, 9, -3.0), (40, 1, 41, 1.0)]
    assert collision_search.nearest(df.limit(0), df).count() == 0
    assert collision_search.nearest(df, df.limit(0)).count() == 0


def test_many_copies(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "array(0.6D, 0.8D, 0D) AS embedding")
    got = collision_search.nearest(df, df.where("vec_id % 1000 = 0"), k=5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] + [0, 1, 2, 3, 4] * 2


def test_recall_in_any_dimension_and_of_any_norms():
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(3000, 64))
    outlier = plain.copy()
    outlier[7] *= 10
    cases = [rng.normal(size=(3000, d)) for d in (16, 64, 128, 384)] + [outlier, plain * rng.lognormal(size=(3000, 1)), plain * 1e150, np.ones((300, 8))]
    for x in cases:
        ids, asked = np.arange(len(x)), np.arange(0, len(x), 50)
        query, row, score = collision_search.search_block(ids, x, asked, x[asked], 20)
        want = brute(ids, x, asked)
        hit = sum(len(set(row[query == k].tolist()) & {v for v, _ in want[q]}) for k, q in enumerate(asked))
        assert hit / (20 * len(asked)) >= 0.9
        assert np.allclose(score, (x[row] * x[asked][query]).sum(1))


def test_tiny_and_huge_vectors_end(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4))
    x[3], x[5], x[20], x[40] = [1e-200, 2e-200, 0, 0], [1e200, -1e200, 0, 1], [1e-200, 0, 0, 0], [-1e200, 1e200, 1, 0]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in collision_search.nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    with np.errstate(over="ignore", invalid="ignore"):
        for q, rows in found.items():
            rows.sort()
            assert len(rows) == 20 and all(np.isclose(s, (x[v] * x[q]).sum(), equal_nan=True) for _, v, s in rows)
            s = np.where(np.isnan(s := (np.delete(x, q, 0) * x[q]).sum(1)), -np.inf, s)
            assert np.isclose(rows[0][2], s.max())
    assert set(found) == set(range(0, 400, 20))


def test_shorter_blocks_are_left_out(spark):
    """Blocks of short vectors can't better the longest ones' products, and results stay those of brute force."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(600, 8)) * 100, rng.normal(size=(2000, 8))])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in collision_search.nearest(df, df.where("vec_id % 100 = 0"), k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(len(x)), x, np.arange(0, len(x), 100), 5)
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9
