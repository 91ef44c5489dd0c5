"""Chunked encoding, token files and packing against the tokenizer on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import token_files as tf
from colloquy.llm.packing import SEQUENCE, pack
from colloquy.llm.tokens import ChunkEncoder, piece_family

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", " a ", "a  b", "a\n\nb", "a\n b \n", "\t\tx\r\ny", "It's we'll 'tis DON'T",
    "x <|endoftext|> y<|startoftext|>", "naïve ÅNGSTRÖM é ́x", "a b　c  d",
    "\x1c\x1d a\x1eb", "2024-01-01 3.14 ①½", "日本語 テキスト", "😀😀 👩‍👩", "a" * 300, "x\x00y", "ΣΑΣ İI",
]
SCHEMA = "doc_id long, text string, n_tokens int, ids string, part string, source string"


def brute(path, texts):
    whole = Tokenizer.from_file(path)
    return [np.asarray([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]


def encode(encoder, texts):
    ids, offsets = encoder(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@pytest.mark.parametrize("name", FILES)
def test_equal_to_whole_texts(name):
    path = public_tokenizers.path(name)
    encoder = ChunkEncoder(path, known=20)
    want = [x[:-1].tolist() for x in brute(path, TEXTS)]
    for _ in range(2):
        assert encode(encoder, TEXTS) == want
        for text, ids in zip(TEXTS, want, strict=True):
            assert encode(encoder, [text]) == [ids], repr(text)


@pytest.mark.parametrize("name", FILES)
def test_every_latin_character(name):
    path = public_tokenizers.path(name)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x252)
             for a, b in (("", ""), ("x ", "y"), ("1", "  z"), ("'", "'s"), (" ", "'ll"), ("'r", "e"))]
    assert encode(ChunkEncoder(path), texts) == [x[:-1].tolist() for x in brute(path, texts)]


@pytest.mark.parametrize("name", FILES)
def test_documents(name, sf_dir):
    path = public_tokenizers.path(name)
    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    assert encode(ChunkEncoder(path), texts) == [x[:-1].tolist() for x in brute(path, texts)]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return ChunkEncoder(path), Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab'sTrelvm1²., \n \t \u0085\x1céÀĂİ中|<"), max_size=30), max_size=4))
def test_any_text(both, texts):
    encoder, whole = both
    assert encode(encoder, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_unknown_rules_use_the_whole_tokenizer():
    assert piece_family({"pre_tokenizer": {"type": "Whitespace"}}) is None and piece_family({}) is None


def rows():
    texts = [*TEXTS, None, "word " * 5000]
    ids = [7 * i % 23 for i in range(len(texts) - 2)] + [None, None]
    return [(d, t, 1, "i", "p", None) for d, t in zip(ids, texts, strict=True)]


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path(FILES[0])
    out = str(tmp_path / "tokens")
    tf.write_token_files(spark.createDataFrame(rows(), SCHEMA), out, path)
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in tf.document_digests(spark, out).collect())
    at = 0
    for start, n, _, _ in got:
        assert start == at
        at += n
    order = [r[3] for r in got]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    want = sorted(zlib.crc32(x) for x in brute(path, [r[1] or "" for r in rows()]))
    assert sorted(r[2] for r in got) == want
    assert sorted((r.start, r.n_tokens) for r in tf.document_index(spark, out).collect()) == [r[:2] for r in got]
    some = tf.read_tokens(spark, out, F.col("doc_id").between(3, 5), ("doc_id", "ids"))
    assert sorted(r.doc_id for r in some.collect()) == [3, 4, 5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "n_tokens" not in plan


def test_files_have_indexes_and_encodings(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    out = str(tmp_path / "tokens")
    tf.write_token_files(spark.createDataFrame(rows(), SCHEMA), out, public_tokenizers.path(FILES[0]))
    meta = pq.ParquetFile(glob.glob(f"{out}/part-*")[0]).metadata.row_group(0)
    ids = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema.startswith("ids"))
    assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
    assert ids.has_offset_index and ids.has_column_index


@pytest.mark.parametrize("length", [SEQUENCE, 7])
def test_packing(spark, length):
    path = public_tokenizers.path(FILES[1])
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = pack(docs, path, length=length, with_ids=True).collect()
    by_place = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for sequence, offset, n in by_place:
        assert sequence * length + offset == at and n > 0 and offset + n <= length
        at += n
    whole = brute(path, [r[1] or "" for r in rows()])
    assert at == sum(map(len, whole))
    assert all(r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4")) for r in got)
    texts = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        begin = r.sequence_id * length + r.offset - r.start
        texts.setdefault(begin, []).extend(r.ids)
    assert sorted(map(tuple, texts.values())) == sorted(map(tuple, (x.tolist() for x in whole)))


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    path = public_tokenizers.path(FILES[1])
    assert pack(none, path).count() == 0
    tf.write_token_files(none, str(tmp_path / "none"), path)
    assert tf.document_digests(spark, str(tmp_path / "none")).count() == 0
