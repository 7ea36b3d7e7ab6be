"""Counts, ids and files against the libraries on whole texts."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelmart.llm import queries, token_files
from parcelmart.llm.pieces import Encoder, Vocabulary, encode_and_decode, processor, vocabulary
from parcelmart.llm.token_counts import Counter, token_counts, whole_tokens

PIECES, BYTES = queries.tokenizer_path(queries.PIECES), queries.tokenizer_path(queries.BYTES)
ODD = [
    "", " ", "  a  b ", "▁x▁▁y", "a\n b\n\n  c", "日本語テキスト 😀", "<s> </s> <unk> <0x41>", "\x00a", "a" * 3000,
    "1234 5678.90", " lead", "trail ", "\t\ttab", " " * 17 + "x", "éé😀😀 😀", "it's a'll 's", "a \n \n b", "x,y ,. z", "a\x1c b",
    "<|endoftext|> a", "word,word. Word!!! (word)", "naïve.\nÑandú", "漢字" * 500,
    "one.\nTwo, three!!\nfour <|endoftext|>\nfive\nsix<|endoftext|> x\n<|endoftext|>y", "a\n'll 1\n2,3\n'\nß.",
]
ALPHABET = st.text(alphabet=st.sampled_from("ab he\u2581 .,\n\t\u00a0\u3000éñ1😀<>|'#"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=4))
def test_pieces_and_counts_equal_the_library(texts):
    want = processor(PIECES).encode(texts, num_threads=1) if texts else []
    encoder = Encoder(PIECES)
    assert encoder.texts(texts) == want
    assert encoder.differences == 0
    assert Counter(PIECES).texts(texts) == [len(i) for i in want]


def byte_ids(texts):
    return [np.frombuffer(i, np.int32).tolist() for i in token_files.Encoder(BYTES).texts(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=4))
def test_byte_level_ids_equal_the_library(texts):
    want = [e.ids for e in token_files.tokenizer(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert byte_ids(texts) == want


def test_odd_texts():
    want = processor(PIECES).encode(ODD, num_threads=1)
    assert Encoder(PIECES).texts(ODD) == want
    assert Counter(PIECES).texts(ODD) == [len(i) for i in want]
    want = [e.ids for e in token_files.tokenizer(BYTES).encode_batch(ODD, add_special_tokens=False)]
    assert byte_ids(ODD) == want


def test_letters_are_remembered_without_the_marks_behind_them():
    encoder = token_files.Encoder(BYTES)
    texts = ["", "one", "a one. one, one!! one\none. one?! \u6f22\u5b57. \u6f22\u5b57,", "x one. 1. 1, one.two. 's. "]
    want = [e.ids for e in token_files.tokenizer(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, np.int32).tolist() for i in encoder.texts(texts)] == want
    known = set(encoder.known)
    assert {"one", "\u6f22\u5b57"} <= known and not known & {"one.", "one,", "one!!", "one?!", "\u6f22\u5b57.", "\u6f22\u5b57,"}


def test_heap_and_matrix_agendas_agree_and_whole_tokens_are_proven():
    v: Vocabulary = vocabulary(PIECES)
    chunks = ["▁hello", "▁▁▁▁▁x", "▁internationalization", "éèê", "▁" + "thereof" * 4, "▁" * 31]
    assert v.encode_many(chunks) == {c: v.encode(c) for c in chunks}
    whole = whole_tokens(PIECES)
    assert len(whole) > 30_000
    assert all(v.merge(p) == [p] for p in list(whole)[:2000])


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "no id", "en"), (7, None, None), (7, None, None), (3, "again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_round_trip_frame(odd_docs):
    found = encode_and_decode(odd_docs, PIECES).collect()
    lib = processor(PIECES)
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert sorted((r["ids"], r["decoded"]) for r in found) == sorted((i, lib.decode(i)) for i in lib.encode(texts))


def test_queries_on_the_small_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    texts = docs["text"].fillna("").tolist()
    lib = processor(PIECES)
    ids = lib.encode(texts, num_threads=1)
    counts = queries.op1_token_counts(spark, folder).toPandas().sort_values("doc_id")
    assert counts["n_tokens"].tolist() == [len(i) for i in ids]
    assert counts["n_bytes"].tolist() == [len(t.encode()) for t in texts]
    assert counts["over_limit"].tolist() == [len(i) > 4096 for i in ids]
    found = queries.op8_sentencepiece(spark, folder).toPandas().sort_values("doc_id")
    assert found["ids_sha256"].tolist() == [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert found["decoded_sha256"].tolist() == [hashlib.sha256(lib.decode(i).encode()).hexdigest() for i in ids]
    assert found["n_differences"].sum() == 0


def test_token_files_on_the_small_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    want = [e.ids + [0] for e in token_files.tokenizer(BYTES).encode_batch(docs["text"].fillna("").tolist(), add_special_tokens=False)]
    found = queries.op4_token_files(spark, folder).toPandas().sort_values("doc_id")
    sizes = np.array([len(i) for i in want])
    assert found["n_tokens"].tolist() == sizes.tolist()
    assert found["start"].tolist() == (np.cumsum(sizes) - sizes).tolist()
    assert found["ids_crc32"].tolist() == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in want]


def test_token_files_layout_and_selective_reads(spark, odd_docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    folder = str(tmp_path / "tokens")
    token_files.write_tokens(odd_docs, BYTES, folder)
    rows = token_files.read_tokens(spark, folder)
    assert rows.count() == odd_docs.count()
    part = token_files.read_tokens(spark, folder, 3, 5)
    assert sorted(r["doc_id"] for r in part.collect()) == [3, 3, 4, 5]
    ids = {r["doc_id"]: r["ids"] for r in part.where("doc_id = 4").collect()}
    assert ids[4] == token_files.tokenizer(BYTES).encode(ODD[4], add_special_tokens=False).ids + [0]
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(i) for f in glob.glob(folder + "/*.parquet")[:1] for i in range(5)]
    assert "DELTA_BINARY_PACKED" in columns[0].encodings and columns[0].has_offset_index
    assert any("DICTIONARY" in e for e in columns[4].encodings)
    starts = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.with_starts(rows, rows).collect()]
    assert sum(n for _, _, n in starts) == max(s + n for _, s, n in starts)
    null_first = min(starts, key=lambda r: r[1])
    assert null_first[0] is None


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(none, PIECES).count() == 0
    assert encode_and_decode(none, PIECES).count() == 0
    assert token_files.token_file_report(none, BYTES).count() == 0
