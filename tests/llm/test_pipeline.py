"""Every stage of the pipeline, and its run, against a brute-force version."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from colloquy.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def base_failed(text):
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def quality(rows):
    failed = [base_failed(r["text"] or "") for r in rows]
    host = defaultdict(list)
    for r, f in zip(rows, failed, strict=True):
        host[r["source"]].append(f)
    m = sum(failed) / len(failed)
    rates = [sum(f) / len(f) for f in host.values()]
    mean = sum(rates) / len(rates)
    between = (sum((x - mean) ** 2 for x in rates) / len(rates)
               - m * (1 - m) * sum(1 / len(f) for f in host.values()) / len(host))
    weight = max(m * (1 - m) / between - 1, 0) if between > 0 else None
    rate = {h: m if weight is None else (sum(f) + m * weight) / (len(f) + weight) for h, f in host.items()}
    return [r for r, f in zip(rows, failed, strict=True) if not f and rate[r["source"]] <= 0.5]


def exact(rows):
    best = {}
    for r in rows:
        key = r["text"] or ""
        if key not in best or (-1 if r["doc_id"] is None else r["doc_id"]) > best[key]["doc_id"]:
            best[key] = r
    return list(best.values())


def near(rows):
    sets = []
    for r in rows:
        w = WORD.findall(r["text"] or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    have = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            have[g].append(i)
    common = Counter((a, b) for ids in have.values() for a in ids for b in ids if a < b)
    group = list(range(len(rows)))
    links = [p for p, n in common.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8]
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    classes = defaultdict(list)
    for i, g in enumerate(group):
        classes[g].append(i)
    return [min((rows[i] for i in c), key=lambda r: r["doc_id"]) for c in classes.values()]


def mixed(rows):
    size = [len(WORD.findall(r["text"] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r["source"]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size)
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        for s in over or free:
            target[s] = 3 * total[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    out = []
    for s in order:
        own = [(int(hashlib.md5(f"7:{r['doc_id']}:{n}".encode()).hexdigest()[:15], 16), n, r)
               for r, n in zip(rows, size, strict=True) if r["source"] == s]
        epochs, rest = divmod(int(target[s] + 1e-6), total[s])
        for _, n, r in sorted(own, key=lambda x: x[:2]):
            out += [(r["doc_id"], r["text"], r["n_chars"])] * epochs
            part = min(n, max(0, rest))
            rest -= n
            if part == n:
                out.append((r["doc_id"], r["text"], r["n_chars"]))
            elif part:
                text = r["text"][:[m.end() for m in WORD.finditer(r["text"])][part - 1]]
                out.append((r["doc_id"], text, len(text)))
    return Counter(out)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = cp.materialise(stage(spark, docs, sf_dir), "stage")
        out[name] = docs
    return {k: [r.asDict() for r in v.collect()] for k, v in out.items()}


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_filters(stages):
    for before, after, rule in (("documents", "quality rules", quality), ("quality rules", "exact dedup", exact),
                                ("exact dedup", "near dedup", near)):
        assert ids(stages[after]) == ids(rule(stages[before])), after
        assert list(stages[after][0]) == COLUMNS
        assert len(stages[after]) < len(stages[before])
        was = {r["doc_id"]: r for r in stages[before]}
        assert all(was[r["doc_id"]] == r for r in stages[after])


def test_mixing(stages):
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in stages["mixing"]) == mixed(stages["near dedup"])


def test_packing_and_run(spark, sf_dir, stages):
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = Counter()
    for r in stages["mixing"]:
        texts[r["doc_id"], tuple(whole.encode(r["text"], add_special_tokens=False).ids) + (1,)] += 1
    total = sum(len(k[1]) * n for k, n in texts.items())
    for pieces in (stages["packing"], [r.asDict() for r in cp.run(spark, sf_dir).collect()]):
        pieces = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
        got, at = defaultdict(list), 0
        for p in pieces:
            place = p["sequence_id"] * 2048 + p["offset"]
            assert place == at and p["offset"] + p["length"] <= 2048
            got[p["doc_id"], place - p["start"], p["doc_tokens"]].append(p)
            at += p["length"]
        assert at == total
        want = Counter((d, len(i)) for (d, i), n in texts.items() for _ in range(n))
        assert Counter((d, n) for d, _, n in got) == want
        sums = Counter()
        for (d, i), n in texts.items():
            sums[d, zlib.crc32(np.asarray(i, "<u4"))] += n
        single = Counter((d, p[0]["ids_crc32"]) for (d, _, _), p in got.items() if len(p) == 1)
        assert not single - sums


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, id int, maybe boolean"


def test_odd_rows(spark, sf_dir):
    """Nulls everywhere, repeated rows, clashing names and an empty table pass all stages."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", "a", 400, 1, "h", 1, None), (1, good, "en", "a", 400, 1, "h", 1, None),
            (None, None, None, None, None, None, None, None, None), (2, "", "en", None, 0, 1, "", 2, True),
            (None, good + " x y z", None, None, None, None, None, None, None), (3, good + " q", "fr", "b", 1, 1, "", 1, False),
            (4, " ".join(f"other{i}" for i in range(70_000)), "de", "b", 5, 1, "", 1, False)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, SCHEMA)
        for _, stage in cp.STAGES[:-1]:
            docs = cp.materialise(stage(spark, docs, sf_dir), "odd")
            assert docs.columns == SCHEMA.replace(",", "").split()[::2]
        assert (cp.packing(spark, docs, sf_dir).count() > 0) == bool(data)
        if data:
            assert {r.doc_id for r in docs.collect()} <= {1, 3, 4, None}
