"""Quality rules and toxicity: base statistics against plain Python, trees' shape, held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from claimweave.llm import quality, queries, toxicity
from claimweave.llm import textbatch as tb

TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "line\nline\n\nline \n x", "é ü é ü é x " * 30, "## $$ | <x> & %\n" * 3, "w " * 200,
    "aa bb aa bb aa bb cc", " ".join(f"word{i}" for i in range(120)), "x\r\ny\r\nx\r\n", "long" * 5000, "\n\n\n", "é\x0b\x0cz",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n)


def test_base_statistics(spark, sf):
    rows = spark.createDataFrame([(i, t, True) for i, t in enumerate(TEXTS)] + [(None, "dup", False)] * 2, "doc_id long, text string, kept boolean")
    got = quality.judge(rows, None).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = brute("dup" if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[5])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_quality_rules(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def walked(trees, x):
    """Margins by walking each tree node by node."""
    out = []
    for row in x.tolist():
        total = trees.start
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = int(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node])
            total += trees.value[node]
        out.append(total)
    return out


def keeps(trees, texts):
    """The verdict by plain base figures and walked trees."""
    data, offsets = tb.text_buffer(pa.array(texts, pa.string()))
    _, x = quality.statistics(data, offsets)
    return [not brute(t)[5] and (trees is None or 1 / (1 + math.exp(-m)) < 0.5) for t, m in zip(texts, walked(trees, x) if trees else [0] * len(texts))]


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def toxic_score(text, model):
    """The score by a plain walk over the text's n-grams."""
    chars = []
    for c in text or "":
        if c < "\x80":
            chars.append(c.lower() if c.isalnum() else " ")
        else:
            chars.append(chr(ord(c) + 32) if 0xC0 <= ord(c) < 0xDF and ord(c) != 0xD7 else c)
    said, found = " " + "".join(chars) + " ", set()
    for n in toxicity.SIZES:
        for i in range(len(said) - n + 1):
            gram = said[i : i + n]
            if " " not in gram[1:-1]:
                value = n
                for c in gram:
                    value = (value * 0x9E3779B97F4A7C15 + _mix(ord(c) + 1)) % 2**64
                found.add(_mix(value) >> 64 - toxicity.BITS)
    return 1 / (1 + math.exp(-max(-500, min(500, model.intercept + sum(float(model.weights[b]) for b in sorted(found))))))


def test_scores_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(i, t) for i, t in enumerate(TEXTS + ["ÀÉ×ß Idiot! ÞÐ", "x", "ab c"])] + [(1000 + r.doc_id, r.text) for r in docs.limit(60).collect()]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    assert (model.weights != 0).any()
    got = {r.doc_id: r.score for r in toxicity.score(some, model).collect()}
    for i, t in rows:
        assert math.isclose(got[i], toxic_score(t, model), rel_tol=1e-9, abs_tol=1e-12)
    trees = quality.fit(docs, labels)
    kept = {r.doc_id: r.kept for r in quality.judge(some, trees).collect()}
    assert [kept[i] for i, _ in rows] == keeps(trees, [t for _, t in rows]) and len(set(kept.values())) == 2


def test_ratios_and_gradient_by_hand():
    """The fit's ratios are smoothed shares, and its weights stand where the penalised likelihood has no slope."""
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.4).astype(float)
    rows = [np.flatnonzero(np.where(np.arange(30) % 2 == 0, rng.random(30) < 0.2 + 0.5 * label, rng.random(30) < 0.7 - 0.5 * label)).astype("<u4") for label in y]
    model = toxicity.fit_linear(rows, y, telling=0.0, negligible=0.0)
    present = np.zeros((400, 30))
    for k, own in enumerate(rows):
        present[k, own] = 1
    toxic, other = 1 + present[y == 1].sum(0), 1 + present[y == 0].sum(0)
    size = 1 << toxicity.BITS
    ratio = np.log(toxic / (toxic.sum() + size - 30)) - np.log(other / (other.sum() + size - 30))
    used = model.weights[:30] != 0
    w = np.where(used, model.weights[:30] / ratio, 0)
    p = 1 / (1 + np.exp(-(present @ (w * ratio) + model.intercept)))
    slope = ratio * (present.T @ (p - y)) + w
    assert used.any() and np.abs(slope[used]).max() < 0.5 and abs((p - y).sum()) < 0.5


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    signs = np.array([f in quality.RISING for f in quality.FEATURES])
    y = (np.sin(3 * x[:, 2]) + x[:, 0] + rng.normal(size=3000) > 0.7).astype(float)
    trees = quality.fit_trees(x, y, signs)
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.75
    for f in np.flatnonzero(signs):
        grid = np.repeat(x[:20], 60, axis=0)
        grid[:, f] = np.tile(np.linspace(-4, 4, 60), 20)
        assert (np.diff(trees.margin(grid).reshape(20, 60), axis=1) >= -1e-9).all()
    leaf = trees.left == np.arange(len(trees.left))
    assert (trees.right[leaf] == np.flatnonzero(leaf)).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.fit(docs, labels.where("doc_id % 3 != 0"))
    judged = quality.judge(docs, trees).join(labels.where("doc_id % 3 = 0"), "doc_id").select("bad_score", "quality").collect()
    right = np.mean([(r.bad_score < 0.5) == (r.quality == 1) for r in judged])
    assert right > 0.97


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, sf)
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert right > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_scoring_odd_rows(spark):
    rows = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(TEXTS)] + [(None, "idiot", 0.5)] * 2, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1, None), (10, 0, 1), (6, 0, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for model in (toxicity.fit(rows, labels), toxicity.fit(rows, labels.limit(0))):
        assert toxicity.score(rows, model).count() == len(TEXTS) + 2
        assert toxicity.score(rows.limit(0), model).count() == 0
        assert set(toxicity.clean_rows(rows, model).columns) == {"doc_id", "text", "score"}
    assert quality.fit(rows, labels.where("quality = 0")) is None
    assert quality.judge(rows.limit(0), None).count() == 0
    assert quality.kept_rows(rows, None).count() == sum(not brute(t)[5] for t in TEXTS)


@pytest.mark.parametrize("text, n", [("ab", 1), ("", 0), ("abcd efgh", 6 + 6), ("a", 0)])
def test_n_grams_stay_within_words(text, n):
    raw = np.frombuffer(text.encode(), np.uint8)
    documents, buckets = toxicity.n_gram_buckets(raw, np.array([0, len(raw)]))
    assert len(buckets) == n and (documents == 0).all()
