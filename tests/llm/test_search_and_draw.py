"""Ranked search and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondel.llm import importance, lexical

DOCS = "doc_id bigint, text string, score string, rank string, term string, row int, n int, bucket int"
ITEMS = "item_id bigint, text string, slot int, w int"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", *(f"w{i}" for i in range(80)), "Äpfel", "ÄPFEL", "naïve", "x1y2", "日本"]
    weights = [40, 30, *[1.0 + 20 / (i + 1) for i in range(len(vocabulary) - 2)]]
    texts = ["".join(w + rng.choice([" ", ", ", "-", "\n", "__"]) for w in rng.choices(vocabulary, weights, k=rng.randint(1, 90))) for _ in range(n)]
    texts += [texts[0], texts[0].upper(), "", None, "...", "The", "w3 " * 3000, "W1\x00w2"]
    return list(enumerate(texts)) + [(5, texts[5]), (5, "the the w1"), (None, "the w2"), (None, None)]


def terms(text, pattern=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_score(rows, items, top):
    counted = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for d, c in counted:
            if not c:
                continue
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=str)


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "s", "r", "t", 1, 2, 3) for d, t in rows], DOCS).repartition(3)


ITEM_ROWS = [(1, "the w1 w2 Äpfel"), (2, "w70 w79"), (3, ""), (4, None), (5, "nowhere"), (6, "W3 w3 naïve"), (6, "x1y2"), (None, "日本 of")]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_search_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", broadcast)
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEM_ROWS], ITEMS)
    for top in (5, 50):
        got = lexical.ranked(docs_of(spark, corpus()), items, top)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == by_score(corpus(), ITEM_ROWS, top)


def test_search_in_empty_tables(spark):
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEM_ROWS], ITEMS)
    assert lexical.ranked(docs_of(spark, corpus()).limit(0), items).count() == 0
    assert lexical.ranked(docs_of(spark, corpus()), items.limit(0)).count() == 0
    assert lexical.ranked(docs_of(spark, [(1, None), (2, "")]), items).count() == 0


def test_filter_of_terms_lets_false_positives_go(spark, monkeypatch):
    postings = lexical.postings
    monkeypatch.setattr(lexical, "postings", lambda docs, slots: postings(docs, np.ones_like(slots)))
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEM_ROWS], ITEMS)
    got = lexical.ranked(docs_of(spark, corpus()), items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_score(corpus(), ITEM_ROWS, 50)


def test_a_hot_term_is_dealt_to_all_parts(spark):
    rows = [(i, "common " + "x" * (i % 7)) for i in range(400)]
    slots = [True] * lexical.SLOTS
    index = lexical.postings(docs_of(spark, rows).repartition(8), np.array(slots))
    parts = index.filter("term = 'common'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 80


def words(text):
    return terms(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bucketed(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def drawn(rows, target):
    s, t = (Counter(b for text in texts for b in bucketed(text)) for texts in ([x for _, x in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (total_s + 10000)) / ((s[b] + 1) * (total_t + 10000))))
    out = []
    for d, text in rows:
        f = bucketed(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    eligible = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(eligible[: 25 * len(eligible) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


TARGET = ["the w1 w2", "of w1 Äpfel naïve", None, ""]


@pytest.mark.parametrize("block,rows", [(4096, 1 << 18), (2, 3)])
def test_draw_equals_brute_force(spark, monkeypatch, block, rows):
    monkeypatch.setattr(importance, "BLOCK_ROWS", block)
    monkeypatch.setattr(importance, "RANGE_ROWS", rows)
    table = [r for r in corpus(n=200) if r[0] != 5]
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    got = importance.resampled(docs_of(spark, table), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(table, TARGET)


def test_draw_of_repeated_and_empty_rows(spark):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    long = " ".join(f"v{i}" for i in range(25))
    got = importance.resampled(docs_of(spark, [(1, long)] * 9 + [(2, long), (3, None)]), target).collect()
    assert len(got) == 11 and sorted(r.rank for r in got if r.rank) == [1, 2]
    best = max(r.score for r in got if r.n_features)
    assert all(r.score == best for r in got if r.rank)
    assert all(r.rank is None and r.weight == 0 for r in got if r.doc_id == 3)
    assert importance.resampled(docs_of(spark, []), target).count() == 0
    assert [r.rank for r in importance.resampled(docs_of(spark, [(1, "a b"), (2, None)]), target.limit(0)).collect()] == [None, None]


def test_features_go_on_across_stretches(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "c", "äö", "12"], k=50))
    whole = sorted(bucketed(text))
    for size in (1, 2, 7, 49, 50):
        monkeypatch.setattr(importance, "_WORDS_AT_ONCE", size)
        assert sorted(b for _, part in importance.features(text.encode()) for b in part.tolist()) == whole


@pytest.mark.parametrize("seed", range(6))
def test_tournament_merges_runs(seed):
    rng = random.Random(seed)
    blocks, everything = [], []
    for run in range(rng.choice([1, 2, 9, 40])):
        rows = sorted(((rng.randint(0, 50), rng.randint(0, 9)), run, i) for i in range(rng.randint(0, 60)))
        everything += [r[0] for r in rows]
        while rows:
            size = rng.randint(1, 8)
            blocks.append((rows[0][0], run, len(blocks), rows[:size]))
            rows = rows[size:]
    blocks.sort(key=lambda b: (b[0], b[1], b[2]))
    assert [r[0] for r in importance.merged((k, run, rows) for k, run, _, rows in blocks)] == sorted(everything)


def test_ranges_end_with_the_draw():
    histogram = [(9, 2), (8, 1), (5, 4), (3, 1), (1, 7)]
    assert importance.ranges(histogram, 7, 3) == [(8, 9, 0), (5, 5, 3)]
    assert importance.ranges(histogram, 8, 100) == [(3, 9, 0)]
    assert importance.ranges([], 0, 5) == []
