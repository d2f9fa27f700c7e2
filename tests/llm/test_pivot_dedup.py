"""Near-duplicate vectors against all pairs: recall, counts, components, long lists, balls, odd rows."""

import numpy as np
import pytest

from claimweave.llm import pivot_dedup, queries


def brute(ids, labels, x, threshold=0.98):
    """(links, component) by row."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    root = ids.copy()
    while True:
        new = np.array([min([root[k], *root[linked[k]]]) for k in range(len(ids))])
        if (new == root).all():
            return linked.sum(1), root
        root = new


def run(spark, ids, labels, x, **more):
    rows = [(int(i), [float(c) for c in v], int(g)) for i, v, g in zip(ids, x, labels)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_dedup.near_duplicates(df, **more).collect()}


def near(rng, x, cosine):
    u = rng.normal(size=x.shape)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * u


@pytest.mark.parametrize("dim,clustered", [(3, False), (16, True), (64, False), (384, False)])
def test_recall(spark, dim, clustered):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(400, dim)) * (0.5 if clustered else 1) + (rng.normal(size=(1, dim)) if clustered else 0)
    x = np.concatenate([base, near(rng, base[:200], 0.98 + 1e-9), near(rng, base[200:300], 0.99), 3 * base[:5]])
    ids, labels = rng.permutation(len(x)) + 1, np.concatenate([np.arange(400) % 2] + [np.arange(200) % 2, np.arange(200, 300) % 2, np.arange(5) % 2])
    links, root = brute(ids, labels, x)
    got = run(spark, ids, labels, x)
    mine = np.array([got[i][0] for i in ids])
    assert (mine <= links).all() and mine.sum() >= 0.97 * links.sum()
    if mine.sum() == links.sum():
        assert [got[i][1] for i in ids] == root.tolist()
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_long_lists_and_balls(spark):
    """Groups of copies, tight groups and wide ones, by blocks of a few rows."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(1, 24))
    tight, wide = near(rng, np.repeat(centre, 90, 0), 0.9995), near(rng, np.repeat(-centre, 70, 0), 0.991)
    copies = np.repeat(rng.normal(size=(1, 24)), 60, 0)
    x = np.concatenate([tight, wide, copies, rng.normal(size=(100, 24))])
    ids, labels = rng.permutation(len(x)), np.zeros(len(x), int)
    links, root = brute(ids, labels, x)
    for block in (8, 512):
        got = run(spark, ids, labels, x, block=block)
        assert [got[i][0] for i in ids] == links.tolist() and [got[i][1] for i in ids] == root.tolist()


def test_a_chain_makes_one_component(spark):
    angles = np.arange(40) * 0.19
    x = np.stack([np.cos(angles), np.sin(angles)], 1)
    ids = np.random.default_rng(2).permutation(40)
    links, root = brute(ids, np.zeros(40, int), x)
    got = run(spark, ids, np.zeros(40, int), x, block=4)
    assert [got[i][0] for i in ids] == links.tolist() and [got[i][1] for i in ids] == root.tolist()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (10, [nan, 1.0], 1),
        (11, [inf, 0.0], 1), (12, [None, 1.0], 1), (13, [1e200, 0.0], 1), (14, [1e-200, 0.0], 1), (15, [1.0, 0.0, 0.0], 1), (16, [-1.0, 0.0], 1), (17, [0.0, 1.0], 1), (17, [0.0, 1.0], 1), (17, [-1.0, -0.01], 1), (18, [-0.0, 1.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, component_id string, cls string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivot_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([
        (5, 3, 3, False), (3, 3, 3, True), (13, 3, 3, False), (14, 3, 3, False), (9, 0, 9, True), (4, 0, 4, True), (None, 0, None, True), *((k, 0, k, True) for k in (6, 7, 8, 10, 11, 12, 15)),
        (16, 1, 16, True), (17, 1, 16, False), (17, 2, 17, True), (17, 2, 17, True), (18, 2, 17, False),
    ], key=str)
    assert pivot_dedup.near_duplicates(df.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toArrow()
    ids, labels, x = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), np.array(rows["embedding"].to_pylist(), float)
    links, root = brute(ids, labels, x)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op13_pivot_dedup(spark, sf).collect()}
    assert got == {i: (n, c, i == c) for i, n, c in zip(ids.tolist(), links.tolist(), root.tolist())}
