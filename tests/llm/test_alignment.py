"""Alignment of two tokenizers against whole-text encoding and plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import alignment as al
from colloquy.llm.queries import op13_alignment

PATH_A, PATH_B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, batch string, place int, radix string, groups long, n_a string"
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "the cat sat", "It's we'll 'tis", "\n", "a\nb \n c", "\t x\r\ny",
    "x <|endoftext|> </s> y <s>[INST]", "naïve café", "日本語 テキスト 中文", "😀 👩‍👩 x", "a▁b", "x\x00y", "é  z",
    "a" * 300, "　x 　 y", "0123 4.5", "the the the the", "﻿x", "<0x41> <unk>",
]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    from colloquy.llm.tokens import byte_letters
    byte_of = {v: k for k, v in byte_letters().items()}

    def piece(i):
        p = b.id_to_piece(i)
        if len(p) == 6 and p.startswith("<0x"):
            return bytes([int(p[3:5], 16)])
        return p.replace("▁", " ").encode()

    def one(text):
        """(A ids, B ids, groups, links) by walking the bytes of the whole text."""
        if not text:
            return [], [], "", []
        raw = f" {text}".encode()
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return [], [], "", []
        owner_a = [i for i, x in enumerate(bytes_a) for _ in x]
        owner_b = [i for i, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, ga, gb = [], [], []
        for at in range(len(raw)):
            last_a = at + 1 == len(raw) or owner_a[at + 1] != owner_a[at]
            last_b = at + 1 == len(raw) or owner_b[at + 1] != owner_b[at]
            ga += [ids_a[owner_a[at]]] * last_a
            gb += [ids_b[owner_b[at]]] * last_b
            if last_a and last_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        return ids_a, ids_b, ";".join(groups), [(ids_a[i], ids_b[j]) for i, j in links]
    return one


def expected(plain, rows):
    done = [(d, *plain(t)) for d, t in rows]
    counts = Counter(p for *_, links in done for p in set(links))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return counts, sorted(
        (d if d is not None else -1, len(a), len(b), len(g.split(";")) if g else 0, len(links),
         sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), g)
        for d, a, b, g, links in done)


def found(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best,
                   r.count_sum, r.groups) for r in rows)


@pytest.mark.parametrize("radixes,fan_in,batch", [(16, 64, 1000), (3, 2, 4)])
def test_alignment(spark, plain, radixes, fan_in, batch):
    rows = [(None if i % 7 == 3 else i // 2, t) for i, t in enumerate(TEXTS + TEXTS[4:16])]
    docs = spark.createDataFrame([(d, t, "b", 1, "r", 2, "n") for d, t in rows], SCHEMA).repartition(3)
    got = al.align(docs, PATH_A, PATH_B, radixes=radixes, fan_in=fan_in, batch_documents=batch)
    counts, want = expected(plain, rows)
    assert found(got.scores().collect()) == want
    pairs = {(r.a_id, r.b_id): r.n_documents for r in got.pair_counts().collect()}
    assert pairs == counts


def test_query(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    _, want = expected(plain, [(r.doc_id, r.text) for r in docs])
    got = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                 for r in op13_alignment(spark, sf_dir).collect())
    assert got == [(*x[:7], hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "") for x in want]


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.sampled_from("ab'sTrelvm1²., \n \t \u0085\x1céÀĂİ中|<▁ \x00"), max_size=40))
def test_any_text(plain, text):
    table = al.units_of(PATH_A, PATH_B)
    units, _ = table.look_up([text])
    a, b, groups, links = plain(text)
    if not table.good[units].all():
        assert (a, b) == ([], [])
        return
    assert table.counts[units].sum(axis=0).tolist()[:2] == [len(a), len(b)]
    assert ";".join(table.groups[u] for u in units.tolist()) == groups
    mine = Counter(int(table.pairs[k]) for u in units.tolist()
                   for k in table.links[table.first[u]:table.first[u] + table.counts[u, 3]])
    assert mine == Counter(x << 32 | y for x, y in links)


def test_table_starts_anew_when_full(plain):
    table = al.UnitTable(PATH_A, PATH_B, known=2)
    for text in ("one two three", "one four", "five six one", "one two three"):
        units, _ = table.look_up([text])
        assert ";".join(table.groups[u] for u in units.tolist()) == plain(text)[2]


@given(values=st.lists(st.integers(0, 2**62), max_size=30))
def test_numbers_round_trip(values):
    x = np.array(values, dtype=np.int64)
    assert al.unpack_numbers(al.pack_numbers(x)).tolist() == values
    assert al.unpack_numbers(al.pack_numbers(np.sort(x), True), True).tolist() == sorted(values)


@given(runs=st.lists(st.dictionaries(st.integers(0, 20), st.integers(1, 9), max_size=8), max_size=6))
def test_merge(runs):
    sides = [(np.array(sorted(r), dtype=np.int64), np.array([r[k] for k in sorted(r)], dtype=np.int64)) for r in runs]
    pairs, counts = al.merge_runs(sides)
    want = Counter()
    for r in runs:
        want.update(r)
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == want and (np.diff(pairs) > 0).all()


def test_hot_texts_and_long_words(spark, plain):
    rows = [(i, "the same words") for i in range(60)] + [(99, "x" * 100_000), (100, "the " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = al.align(docs, PATH_A, PATH_B, batch_documents=7, fan_in=3).scores().drop("groups").collect()
    _, want = expected(plain, rows)
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got) == [
        x[:7] for x in want]


def test_empty_table(spark):
    got = al.align(spark.createDataFrame([], SCHEMA), PATH_A, PATH_B)
    assert got.scores().collect() == [] and got.pair_counts().collect() == []
