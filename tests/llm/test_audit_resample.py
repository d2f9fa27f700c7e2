"""The filter audit and the importance draw against plain Python and SQL, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import filter_audit, importance_resampling as ir, queries

DOCS = "doc_id long, text string, source string, part string, rank string"


def plain(rows, columns):
    return sorted(tuple(map(str, r)) for r in zip(*(rows.column(c).to_pylist() for c in columns)))


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_importance_resampling"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).to_arrow_table()
    got = queries.queries()[name](spark, sf).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert plain(got, want.column_names) == plain(want, want.column_names)


# ---- the audit ----

def odd_documents(spark):
    long = " ".join(f"w{k}" for k in range(60))
    same = "echo " * 60
    rows = [
        (1, long, "a"), (2, long, "b"), (2, long, "b"), (3, long, None), (None, long, "a"), (4, None, "a"), (5, "", ""), (6, same, "a"), (7, same.upper(), "a"),
        (8, long + " #", "b"), (9, "É" * 300 + " A", "b"), (10, "é x y " * 60, "b"), (11, "\x0bword\x0c\tword\r\n" * 40, ""), (12, "x" * 200_000 + " " + long, "c"), (13, long.replace(" ", "\x1f"), "c"),
        (14, " ".join(["dup"] * 40 + [f"v{k}" for k in range(60)]), "c"), (0, "the last", "c"), (20, "the last", "a"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (20, 1, 1)]
    return rows, labels


def fails(doc_id, text, rows):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    first = min((r[0] for r in rows if r[0] is not None and (r[1] or "") == text), default=None)
    return "".join(x for x, f in zip("ABCDE", (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and doc_id > first,
    )) if f)


def test_audit_by_brute_force(spark):
    rows, labels = odd_documents(spark)
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged = filter_audit.failures(docs, marks)
    got = {}
    for r in filter_audit.audit(filter_audit.mask_counts(judged)).collect():
        got[r.part, r.filter_order, r.step] = tuple(r)[3:]
    want, by_letter = {}, {}
    known = {k: (any(q == 1 for i, q, _ in labels if i == k), any(t == 1 for i, _, t in labels if i == k)) for k in {i for i, *_ in labels if i is not None}}
    for part in {r[2] or "" for r in rows}:
        mine = [(fails(r[0], r[1], rows), known.get(r[0], (False, False))) for r in rows if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[0]]
                left = [m for m in left if x not in m[0]]
                want[part, order, step] = (len(left), len(gone), sum(x in m[0] for m in mine) - len(gone), sum(m[0] == x for m in mine), sum(m[1][0] for m in gone), sum(m[1][1] for m in gone))
                by_letter[part, x] = by_letter.get((part, x), 0) + len(gone)
    assert got == {k: (*v, by_letter[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_polynomial():
    rng = random.Random(3)
    for k in (1, 3, 4):
        counts = {m: rng.randrange(10) for m in range(1 << k)}
        p = filter_audit.RemovalPolynomial(counts, k)
        for s in range(1 << k):
            assert p.corner(s) == sum(n for m, n in counts.items() if m & s)
        # By orders, and by the polynomial's own derivative at rational points of the diagonal (Simpson is exact up to cubes).
        for i in range(k):
            orders = list(itertools.permutations(range(k)))
            alone = sum(sum(n for m, n in counts.items() if m >> i & 1 and not any(m >> j & 1 for j in o[: o.index(i)])) for o in orders)
            assert p.shapley(i) == Fraction(alone, len(orders))
            slope = lambda t: sum(n * (1 - t) ** (m.bit_count() - 1) for m, n in counts.items() if m >> i & 1)
            assert p.shapley(i) == (slope(Fraction(0)) + 4 * slope(Fraction(1, 2)) + slope(Fraction(1))) / 6


def test_empty_audit(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(filter_audit.failures(docs, labels))).count() == 0


# ---- the draw ----

def features(text, order):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[k : k + n]) for n in range(1, order + 1) for k in range(len(words) - n + 1)]


def test_checksums():
    rng = random.Random(1)
    spans = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 3, 47, 48, 49, 50, 200, 100_000] * 3]
    data, lengths = np.frombuffer(b"".join(spans), np.uint8), np.array([len(s) for s in spans])
    assert ir.checksums(data, np.cumsum(lengths) - lengths, lengths).tolist() == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("order", [1, 2])
def test_scores_by_brute_force(spark, order):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "γάμμα", "x1", "Über", "z" * 70, "日本語", "don't", "a-b", "_", "é"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(40))), "s") for k in range(60)] + [(None, "alpha beta", None), (7, "alpha", "s"), (100, None, ""), (101, "", ""), (102, "x" * 300_000 + " beta", ""), (103, "---", "")]
    target = [(0, "alpha beta alpha"), (1, None), (None, "Über x1")]
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], DOCS)
    got = sorted((tuple(r) for r in ir.resample(docs, spark.createDataFrame(target, "item_id long, text string"), percent=25, least=10, order=order, buckets=16, seed=5).collect()), key=str)
    bucket = lambda f: zlib.crc32(f.encode()) % 16
    s, t = [[0] * 16 for _ in range(2)]
    for counts, texts in ((s, [r[1] for r in rows]), (t, [r[1] for r in target])):
        for x in texts:
            for f in features(x, order):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 16) / ((s[b] + 1) * (sum(t) + 16)))) for b in range(16)]
    scored = []
    for doc_id, text, _ in rows:
        fs = features(text, order)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"5:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in scored if r[1] >= 10), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = eligible[: 25 * len(eligible) // 100]
    left = list(scored)
    for r in drawn:
        left.remove(r)
    assert drawn and got == sorted([(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in left], key=str)


@pytest.mark.parametrize("percent,range_rows,run_rows", [(10, 7, 13), (50, 1, 5), (100, 64, 1 << 20), (33, 1 << 20, 50)])
def test_draw_with_ties(spark, percent, range_rows, run_rows, monkeypatch):
    monkeypatch.setattr(ir, "LEAST_ROWS", 1)
    rng = random.Random(percent)
    rows = [(rng.choice([k, k % 5, None]) if k % 3 == 0 else k, rng.choice([5, 20, 30]), k, rng.choice([1000, 1000, 1000, rng.randrange(-50, 3000)])) for k in range(400)]
    from claimweave.llm.storage import stored

    scored = stored(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(3), "test-scored")
    got = [tuple(r) for r in ir.draw_highest(scored, percent, 20, range_rows, run_rows).collect()]
    assert sorted((r[:4] for r in got), key=str) == sorted(rows, key=str)
    eligible = sorted(((-r[3], r[0] is None, r[0] or 0) for r in rows if r[1] >= 20))
    drawn = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in drawn] == list(range(1, percent * len(eligible) // 100 + 1))
    assert [(-r[3], r[0] is None, r[0] or 0) for r in drawn] == eligible[: len(drawn)] and all(r[1] >= 20 for r in drawn)


def test_loser_tree():
    rng = random.Random(6)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20), rng.randrange(3)) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert [key for _, key in ir.LoserTree([iter(r) for r in runs])] == sorted(x for r in runs for x in r)


def test_empty_draws(spark):
    docs, target = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert ir.resample(docs, target).count() == 0
    few = spark.createDataFrame([(1, "one two", "s", "p", "r"), (2, None, None, None, None)], DOCS)
    got = {tuple(r) for r in ir.resample(few, target).select("doc_id", "n_features", "rank").collect()}
    assert got == {(1, 2, None), (2, 0, None)}
    assert ir.resample(few.select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("weight")), target).count() == 2
