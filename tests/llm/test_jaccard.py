"""The join against all pairs on small tables, and PartEnum's guarantee on random sets."""

import random

import numpy as np
import pyarrow as pa

from claimweave.llm import jaccard_join, queries
from claimweave.llm import textbatch as tb
from claimweave.llm.shingles import shingle_sets


def brute(rows):
    """(doc_id, n_shingles, component_id) by plain sets."""
    import re

    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        for w in s:
            by.setdefault(w, []).append(k)
    tried = set()
    for same in by.values():
        for i in same:
            for j in same:
                if i < j and (i, j) not in tried and rows[i][0] is not None and rows[j][0] is not None:
                    tried.add((i, j))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                        a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                        parent[b] = a
    return sorted((d if d is not None else -1, len(s), root(d) if d is not None else -1) for (d, _), s in zip(rows, sets))


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=50)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a B"), (5, "a b c d"), (6, "a  b\tc\nd E"), (7, "x " * 30000), (7, "one more with this id now"), (8, "One more with this id NOW")]
    rows += [(None, "null id text of some words"), (20, "null id text of some words"), (21, "null id text of some words")]
    k = 100
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([5, 6, 7, 8, 9, 12, 20, 40, 90, 200]))
        for _ in range(rng.choice([1, 2, 3, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(words))
                kind = rng.random()
                words[at : at + 1] = [] if kind < 0.3 and len(words) > 1 else [rng.choice(vocabulary)] * (1 if kind < 0.7 else 2)
            if rng.random() < 0.3:
                words += passage
            rows.append((k, " ".join(words)))
            k += 1
    return rows


def test_small_tables(spark):
    for seed in range(2):
        rows = near_copies(seed)
        docs = spark.createDataFrame([(d, t, 3, 4) for d, t in rows], "doc_id long, text string, n int, component_id int").repartition(3)
        assert result(jaccard_join.classes(docs)) == brute(rows)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op7_jaccard_join(spark, sf)) == brute(rows)


def test_empty(spark):
    assert jaccard_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert result(jaccard_join.classes(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string"))) == [(1, 0, 1), (2, 0, 2)]


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        pool = tb.mix(rng.integers(0, 1 << 62, 2 * n + 2).astype(np.uint64))
        common = int(rng.integers(max(1, n // 2), n + 1))
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([pool[:common], pool[n : n + int(rng.integers(0, n // 3 + 1))]]))
        inter = len(np.intersect1d(a, b))
        if 4 * inter < 3 * (len(a) + len(b) - inter):
            continue
        rare = lambda s: (s % np.uint64(3) == 0).astype(float)
        of_a, of_b = ({int(v) for _, values in jaccard_join.signatures(s, rare(s)) for v in values} for s in (a, b))
        assert of_a & of_b or len(a) == len(b) == inter
        assert 7 * jaccard_join.apart(jaccard_join.parities(a), jaccard_join.parities(b)) <= len(a) + len(b)


def test_least_common_signatures():
    """The bound on common signatures, over random changes of whole signature sets."""
    rng = np.random.default_rng(6)
    for _ in range(400):
        n = int(rng.integers(4, 80))
        a = np.unique(tb.mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))
        for instance, _, d in jaccard_join.instances(len(a)):
            b = np.union1d(a[d // 2 :], tb.mix(rng.integers(0, 1 << 62, d - d // 2).astype(np.uint64)))
            everything = {}
            p = jaccard_join.partitions(instance)
            for name, own in (("a", a), ("b", b)):
                cell = ((own * jaccard_join._odd(2 * instance)) >> np.uint64(20)) % np.uint64(3 * p)
                everything[name] = {(q, left): frozenset(own[(cell // np.uint64(3) == q) & (cell % np.uint64(3) != left)].tolist()) for q in range(p) for left in range(3)}
            common = sum(everything["a"][k] == everything["b"][k] for k in everything["a"])
            assert common >= jaccard_join.least_common(p, len(np.setxor1d(a, b))) >= 1


def test_hot_signatures_and_any_ids(spark, monkeypatch):
    """Few rows a flush and a low bound: groups meet over salted buckets; ids may be negative or very large."""
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 2)
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 40)
    monkeypatch.setattr(jaccard_join, "FLUSH_ROWS", 150)
    rows = [((-1) ** k * ((1 << 62) + d) if d is not None and k % 3 else d, t) for k, (d, t) in enumerate(near_copies(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, want = result(jaccard_join.classes(docs)), brute(rows)
    assert got == want


def test_families_by_blocks(spark, monkeypatch):
    """Without first partners, all links are found block by block."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "first_pairs", lambda members: members.sparkSession.createDataFrame([], "a long, b long"))
    rows = near_copies(4)
    assert result(jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))) == brute(rows)


def test_shingles_by_document():
    data, offsets = tb.text_buffer(pa.array(["a b c d e f", None, "A B C D E", "a b c d e", "x", "a b c d e f a b c d e f"]))
    sets = shingle_sets(data, offsets)
    assert [len(s) for s in sets] == [2, 0, 1, 1, 1, 6]
    assert (sets[2] == sets[3]).all() and sets[2][0] in sets[0]
