"""Token output, counts and packing against the tokenizer library itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from claimweave.llm import packing, queries, token_counts, token_output
from claimweave.llm.storage import new_path

TEXTS = [
    None, "", " ", "\n\n", "a", "don't we'll  x\t\ty \n z", "Überraschung für die Straße\u00a0hier \u2003 weit",
    "x<|endoftext|>  y <|endoftext|><|endoftext|>", "日本語 のテキスト、 です。\u3000全角", "e\u0301 clair \U0001f600 \U0001f468\u200d\U0001f469",
    "  lead", "trail   ", "1234 5678,9.0", "a" * 3000, "word " * 4000, "tab\tand\r\nlines\x0b\x0c\x1c\x85end", "same", "same", "é\u2028 é\xa0 é",
]
PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k else None, t, "clash", 7) for k, t in enumerate(TEXTS)] + [(5, "again the same id", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


def expected(library, text, *end):
    return library.encode(text or "", add_special_tokens=False).ids + list(end)


def test_chunks_keep_the_library_s_ids(library):
    from claimweave.llm.tokenizing import encoded

    for _, _, ids, counts in encoded(pa.array(TEXTS), PATH, 0):
        got = np.split(ids, np.cumsum(counts)[:-1])
        for text, own in zip(TEXTS, got):
            assert own.tolist() == expected(library, text, 0)


def test_token_output(spark, docs, library):
    folder = new_path(spark, "t")
    manifest = token_output.write_tokens(docs, folder, PATH, 0, 50_257, sequence_length=64)
    got = sorted(token_output.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(TEXTS) + 1
    at, last = 0, -1
    texts = {}
    for k, t in enumerate(TEXTS):
        texts.setdefault(k if k else None, []).append(t)
    texts[5].append("again the same id")
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and (r.doc_id if r.doc_id is not None else -1) >= last
        assert ids in [expected(library, t, 0) for t in texts[r.doc_id]]
        at, last = at + len(ids), r.doc_id if r.doc_id is not None else -1
    shard = manifest.orderBy("n_ids", ascending=False).first()
    tokens, mask = token_output.ShardReader(shard.path).sequence(0)
    assert len(tokens) == len(mask) == 64 and mask.sum() == min(64, shard.n_ids)


def test_shards_of_one_task(spark, library):
    texts = [None, "", "a b c"] + [f"Überraschung {k} für die Straße " * 60_000 for k in range(4)] + ["x" * 100_000]
    folder = new_path(spark, "t")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    shards = token_output.write_tokens(df, folder, PATH, 0, 50_257, shard_ids=1000).orderBy("shard").collect()
    assert len(shards) > 1 and sum(r.n_docs for r in shards) == len(texts)
    got = token_output.read_tokens(spark, folder).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [expected(library, t, 0) for t in texts]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    for r in shards:
        reader = token_output.ShardReader(r.path)
        rows = [reader.sequence(k) for k in range(-(-r.n_ids // 2048))]
        assert sum(int(m.sum()) for _, m in rows) == r.n_ids
        assert np.concatenate([t[m] for t, m in rows]).tolist() == reader.ids(0, r.n_ids).tolist()


def test_token_counts(docs, library):
    got = token_counts.count_tokens(docs, PATH, budget=10).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r.doc_id or 0] if r.doc_id != 5 or r.n_bytes == len((TEXTS[5] or "").encode()) else "again the same id"
        n = len(expected(library, text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 10)
        if n <= 10:
            assert r.budget_bytes == r.n_bytes
        else:
            (text.encode()[: r.budget_bytes]).decode()


def test_every_prefix_count_is_exact(library):
    text = "Überlegen wir's nicht mal, thing123 ... anonwh"
    counts = token_counts.prefix_counts(text, PATH)
    raw = text.encode()
    assert len(counts) == len(raw)
    for i in range(1, len(raw) + 1):
        prefix = raw[:i]
        try:
            own = prefix.decode()
        except UnicodeDecodeError:
            continue
        if own[-1:] == " ":
            continue  # a trailing space joins the next word
        assert counts[i - 1] == len(expected(library, own)), own


def test_packing(docs, library):
    got = packing.pack(docs, PATH, 1, window=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in by.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or k == max(by)
    for k, text in enumerate(TEXTS):
        if k not in (0, 5):
            own = sorted((r.start, r.length, r.ids, r.doc_tokens) for r in got if r.doc_id == k)
            ids = np.frombuffer(b"".join(x[2] for x in own), "<u4").tolist()
            assert ids == expected(library, text, 1) and {x[3] for x in own} == {len(ids)}
            assert [x[0] for x in own] == np.cumsum([0] + [x[1] for x in own])[:-1].tolist()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH, 1).count() == 0
    assert token_counts.count_tokens(empty, PATH, 10).count() == 0
    assert token_output.token_digests(spark, empty, PATH, 0, 50_257).count() == 0


def test_queries(spark, sf, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in sorted(queries.op4_token_output(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = expected(library, rows[r.doc_id], 0)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, sf).collect()} == {k: len(expected(library, t)) for k, t in rows.items()}
    pieces = queries.op6_packing(spark, sf).collect()
    for r in pieces:
        ids = expected(library, rows[r.doc_id], 1)[r.start : r.start + r.length]
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sum(r.length for r in pieces) == sum(len(expected(library, t, 1)) for t in rows.values())
