"""Patterns against plain regular expressions, and term verdicts against a direct count."""

import hashlib
import math
import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import privacy as pv
from colloquy.llm.common import ROW

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    digits = [(m.span(), re.sub("[ -]", "", m.group())) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) < 256 for p in m.group().split("."))],
        "card": [s for s, d in digits if 16 <= len(d) <= 19 and luhn(d)],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub(r"\D", "", m.group())) <= 15],
    }


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"a.@-+%0123 (", "4539578763621486", "192.168.0.1", "x@y.z", "+1 (663) 555-6869",
                                 "300.1", "é", "256", "25.", "4111 1111-1111 1111"]), max_size=14).map("".join))
def test_patterns(text):
    assert pv.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "a@" * 500_000, "+1" * 500_000):
        pv.base_spans(text)


SCHEMA = "doc_id long, text string, spans string, base string, kind int"


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        body = rng.choices(words, k=40)
        if d % 10 == 0:
            body[20:20] = ["Zorro", "bob@mail.example.com,", "rides" if d % 20 else "w1"]
        if d % 15 == 0:
            body[5:5] = ["call", "+1 (663) 555-6869"]
        rows.append((d, " ".join(body), "c", "b", 1))
    return [*rows, *[rows[10]] * 4, (None, None, None, None, None), (7, "", "", "", 0), (None, "é bob@mail.example.com", "", "", 0)]


def expected(rows, context, min_texts, share):
    texts = {r[1] or "" for r in rows}
    near, ne, nt = {}, {}, {}
    def spans(t):
        return [(f"{k}:" + (t[a:b].lower() if k == "email" else t[a:b] if k == "ip" else re.sub(r"\D", "", t[a:b])), a, b)
                for k, v in plain(t).items() for a, b in v]
    def around(t):
        found = spans(t)
        for e, a, b in found:
            for m in pv.TERM.finditer(t):
                x, y = m.span()
                if (a - context <= x and y <= a or b <= x and y <= b + context) and not any(
                        x < q and p < y for _, p, q in found):
                    yield e, m.group(), x, y
    for t in texts:
        for e in {e for e, _, _ in spans(t)}:
            ne[e] = ne.get(e, 0) + 1
        for w in set(pv.TERM.findall(t)):
            nt[w] = nt.get(w, 0) + 1
        for key in {(e, w) for e, w, _, _ in around(t)}:
            near[key] = near.get(key, 0) + 1
    out = []
    for d, t, *_ in rows:
        t = t or ""
        kinds = {}
        for e, w, x, y in around(t):
            n, whole = near[e, w], math.log(len(texts) / ne[e])
            got = math.log(len(texts) * n / (ne[e] * nt[w]))
            if n >= min_texts and got >= share * whole > 0:
                kinds[x, y] = max(kinds.get((x, y), ""), "removed" if got >= whole - 1e-9 else "generalised")
        base = ",".join(f"{k}:{a}:{b}" for k, v in plain(t).items() for a, b in v)
        added = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted((k, a, b) for (a, b), k in kinds.items()))
        out.append((d, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for x in (base, added) if x)))
    return out


@pytest.mark.parametrize("context", [12, 200])
def test_disclosing_terms(spark, context):
    rows = corpus()
    found = pv.find_personal(spark.createDataFrame(rows, SCHEMA), context=context, share=0.5)
    got = [tuple(r) for r in found.select(f"{ROW}.doc_id", "base_sha256", "spans").collect()]
    want = expected(rows, context, pv.MIN_TEXTS, 0.5)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any("removed" in w[2] for w in want)


def test_rare_entities(spark):
    """An entity in one text, with copies of other texts, is judged like any other."""
    rows = [(i, f"all the w{i % 7} words", "", "", 1) for i in range(40)]
    rows += [(50, "all the Zorro jane@mail.example.com rides", "", "", 1)]
    found = pv.find_personal(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: (r.n_terms, r.spans) for r in found.select(f"{ROW}.doc_id", "n_terms", "spans").collect()}
    assert got[50] == (2, "email:14:35,removed:8:13,removed:36:41")
    assert {d: s for d, (_, s) in got.items()} == {d: s for d, _, s in expected(rows, 200, 1, pv.SHARE)}


def test_list_of_addresses():
    """A long list is scanned in time that grows with its length, in batches of bounded size."""
    text = " ".join(f"w{i} a{i}@mail.example.com" for i in range(20_000))
    batch = pa.RecordBatch.from_pydict({"text": ["", text, "x a@b.c"], ROW: [{"d": i} for i in range(3)],
                                        "text_id": [0, 1, 2], "uid": [4, 5, 6]})
    begin = time.process_time()
    out = list(pv._scan(60, at_once=1_000)(iter([batch])))
    assert time.process_time() - begin < 20
    assert max(sum(map(len, b["mentions"].to_pylist())) for b in out) <= 1_000
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r[ROW], r["uid"], r["n_email"]) for r in rows if r["base"] is not None] == [
        ({"d": 0}, 4, 0), ({"d": 1}, 5, 20_000), ({"d": 2}, 6, 1)]
    got = [(r["uid"], m["entity"], m["term"]) for r in rows for m in r["mentions"]]
    assert len(got) == len(set(got)) and (6, "email:a@b.c", "x") in got
    assert all((5, f"email:a{i}@mail.example.com", f"w{j}") in got for i in (1, 19_998) for j in (i, i + 1))


def test_redacted(spark):
    rows = spark.createDataFrame([("me a@b.c Zorro w", "email:3:8,removed:9:14,generalised:15:16")], "t string, s string")
    assert rows.select(pv.redacted(F.col("t"), F.col("s"))).first()[0] == "me [email]  [generalised]"


def test_empty(spark):
    assert pv.find_personal(spark.createDataFrame([], SCHEMA)).count() == 0
