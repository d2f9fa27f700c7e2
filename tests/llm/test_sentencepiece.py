"""The transducer against the sentencepiece library: ids, decoding, and a unigram lattice by hand."""

import numpy as np
import sentencepiece

from claimweave.llm import queries, sentencepiece_fst as fst

PATH = queries.tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "  a  b   c", "hello world", "don't <s> </s> <unk> <0x0A>", "日本語\n\n のテ", "\t\t x y", "▁▁x ▁ y ▁", "😀👨‍👩", "a" * 300,
    " " * 37 + "x", "x" + " " * 100, "Überraschung für dich   x", "\u0000 a", "1234567", "===== -----     |||", "word " * 3000, "é̂",
]


def test_ids_and_decoding(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(k if k else None, t, "x") for k, t in enumerate(TEXTS)] + [(3, "twice", "x")], "doc_id long, text string, ids string")
    encoded = fst.encode(docs, PATH)
    rows = fst.decode(encoded, PATH).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = "twice" if r.text == "twice" else TEXTS[r.doc_id or 0] or ""
        ids = library.encode(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.text == library.decode(ids) == text.replace(fst.SPACE, " ")


def test_whole_table(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, sf).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        ids = library.encode(text)
        assert (got[k].n_tokens, got[k].ids_crc32, got[k].decoded_chars) == (len(ids), fst.crc(ids), len(text))


def test_empty(spark):
    assert fst.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_unigram_takes_the_shortest_path():
    made = fst.Machine(PATH)
    made.kind, made.states = fst.UNIGRAM, {}
    made.ids = {"▁": 3, "a": 4, "b": 5, "ab": 6, "▁a": 7, "bb": 8}
    made.scores = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁a": -1.2, "bb": -1.1}
    made.lengths = {"ab": (2, 1), "▁a": (2, 1), "bb": (2, 1)}
    assert made.path("▁abb") == [7, 8]
    assert made.path("▁ab") == [7, 5]
    assert made.path("é")[0] == made.byte_ids[0xC3]


def test_normaliser_rules():
    class Spec(fst.Normaliser):
        def __init__(self):
            self.prefix, self.squeeze, self.escape = True, True, True
            self.rules, self.longest = {"ﬁ": "fi", "ab": "X", "abc": "Y"}, 3

    assert Spec()(" ﬁ  abcab ") == " fi YX"
    assert Spec()(None) == ""
