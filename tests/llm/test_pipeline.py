"""The stages against plain Python over their own inputs, and on odd rows."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from claimweave.llm import quality, queries, toxicity
from test_jaccard import brute
from test_scores import keeps, toxic_score


def tokens_of(texts):
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    return [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check_pieces(pieces, docs):
    """Pieces cover each document's ids once, and sequences from 0 without gaps, all but the last full."""
    want = dict(zip((d for d, _ in docs), tokens_of(t for _, t in docs)))
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = want[d][at : at + r.length]
            assert r.start == at and r.doc_tokens == len(want[d]) and np.frombuffer(r.ids, "<u4").tolist() == ids
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r.length
        assert at == len(want[d])
    for k, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or k == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = corpus_pipeline.quality_rules(spark, docs, sf)
    assert left.schema == docs.schema
    rows = docs.collect()
    verdicts = keeps(quality.fit(docs, labels), [r.text for r in rows])
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r, good in zip(rows, verdicts) if good}

    clean = corpus_pipeline.toxicity_filter(spark, left, sf)
    model = toxicity.fit(left, labels)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in left.collect() if toxic_score(r.text, model) < 0.5}

    kept = corpus_pipeline.near_duplicates(spark, clean, sf)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute([(r.doc_id, r.text) for r in clean.collect()]) if d == c}
    assert {r.doc_id for r in kept.collect()} == want

    pieces = corpus_pipeline.pack(spark, kept, sf).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def test_odd_rows(spark, sf):
    good = " ".join(f"plain words of prose number {k} go here" for k in range(40))
    other = good.replace("prose", "verse")
    rows = [(5, good, 1), (5, good, 2), (5, other, 3), (9, good + " end", 4), (None, good, 5), (None, None, 6), (7, None, 7), (8, "", 8), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = sorted(r.component_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert kept in ([1, 3, 6, 7, 8, 8], [2, 3, 6, 7, 8, 8])  # equal rows of one id: either stays
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.toxicity_filter, corpus_pipeline.near_duplicates):
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert stage(spark, docs.unionByName(docs), sf).count() >= 0
    assert corpus_pipeline.toxicity_filter(spark, docs, sf).count() == len(rows)
    assert corpus_pipeline.quality_rules(spark, docs, sf).where("text IS NULL OR text = ''").count() == 0
    assert corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.pack(spark, docs, sf).count() >= len(rows)
