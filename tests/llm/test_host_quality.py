"""Host-level quality rules against a direct count and a direct prior."""

import re
from collections import Counter, defaultdict

import pytest

from colloquy.llm.host_quality import METRICS, host_quality, kept_rows

SCHEMA = "doc_id long, source string, text string, host string, kept boolean, n_words string"
GOOD = " ".join(f"w{i}" for i in range(60))


def texts():
    spam = "buy it now " * 30
    return [(1, "a", GOOD), (2, "a", GOOD), (3, "a", "short"), (4, "b", spam), (5, "b", spam), (6, "b", "x"),
            (7, "b", GOOD), (8, None, GOOD), (9, None, None), (10, "c", ""), (None, "c", GOOD),
            (11, "a", "# one\n# one\n\x0b\n # one\n" + GOOD), (12, "a", GOOD + " é😀 <|>"), (12, "a", GOOD + " é😀 <|>"),
            (13, "a", "the same few words " * 20000), *[(20 + i, "b", "no") for i in range(8)]]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(again))


def brute(rows):
    failed, hosts = [], defaultdict(list)
    for _, host, text in rows:
        n, *_, again = counts(text)
        failed.append(n < 50 or 100 * again > 50 * n)
        hosts[host].append(failed[-1])
    m = sum(failed) / len(failed)
    rates = {h: sum(f) / len(f) for h, f in hosts.items()}
    mean = sum(rates.values()) / len(rates)
    spread = sum((r - mean) ** 2 for r in rates.values()) / len(rates)
    between = spread - m * (1 - m) * sum(1 / len(f) for f in hosts.values()) / len(hosts)
    weight = max(m * (1 - m) / between - 1, 0) if between > 0 else None
    rate = {h: m if weight is None else (sum(f) + m * weight) / (len(f) + weight) for h, f in hosts.items()}
    return [(d, *counts(t), f, not f and rate[h] <= 0.5, pytest.approx(rate[h])) for (d, h, t), f in zip(rows, failed)]


@pytest.mark.parametrize("part", [slice(None), slice(0, 3), slice(3, 8)])
def test_against_direct_counts(spark, part):
    rows = texts()[part]
    docs = spark.createDataFrame([(*r, "h", None, "n") for r in rows], SCHEMA)
    got = host_quality(docs).select("_row.doc_id", *METRICS, "base_failed", "kept", "host_rate").collect()
    order = lambda r: tuple((x is None, x or 0) for x in r[:8])
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows), key=order)
    kept = kept_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[7] for r in brute(rows))


def test_empty(spark):
    assert host_quality(spark.createDataFrame([], SCHEMA)).count() == 0
