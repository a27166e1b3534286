"""Near-duplicate classes against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondel.llm import minhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 160))) for _ in range(30)]
    for base in list(texts[:12]):
        for edits in (0, 1, 2, 4, 8):
            words = base.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    return texts + ["", None, "  ", "one two", "One  two\n", "one two three", "\n"]


def shingles(text):
    words = (text or "").lower().split()
    if not words:
        return Counter()
    if len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    sets = [shingles(t) for t in texts]
    df = Counter(s for c in sets for s in c)
    n = len(texts)
    weight = {s: 1 + 0.5 * np.log1p(n / d) / np.log1p(n) for s, d in df.items()}
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = []
    for i in range(n):
        for j in range(i):
            both = sets[i] | sets[j]
            similarity = sum(weight[s] * min(sets[i][s], sets[j][s]) for s in both) / sum(weight[s] * max(sets[i][s], sets[j][s]) for s in both) if both else 0
            if (texts[i] or "") == (texts[j] or "") or similarity >= minhash.SIMILARITY:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            near.append(abs(similarity - minhash.SIMILARITY))
    assert min(near) > 1e-3  # no pair so near the threshold that hashed weights could tip it
    return [find(i) for i in range(n)]


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_rows_null_ids_and_extra_columns(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (2, "x y z u v w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).withColumn("label", F.lit("x")).withColumn("class_id", F.lit(0))
    got = sorted(minhash.near_duplicates(docs).collect(), key=str)
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter({(1, 1): 2, (None, 1): 1, (3, 3): 1, (2, 2): 1})
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f g"), (2, "x y z u v w"), (3, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(docs).count() == 0
    assert minhash.deduplicated(docs).count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.class_id for r in minhash.near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize("rows,size", [(512, 4 << 20), (7, 4 << 20), (512, 4000)])
def test_tiles_find_the_links_of_all_pairs(spark, monkeypatch, rows, size):
    """Members that a bucket's least node doesn't join, in one block or many."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    rng = random.Random(3)
    base, texts = [f"w{i}" for i in range(100)], []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(100)] = f"x{rng.randrange(60)}"
        texts.append(" ".join(words + words[:7] * (i % 3)))
    counts = np.ones(minhash.FEATURES)
    weights = spark.sparkContext.broadcast(minhash.feature_weights(40, counts))
    members = spark.createDataFrame([(1, bytes([i]), bytes([i]), t) for i, t in enumerate(texts)], "bucket bigint, node binary, label binary, text string")
    found = minhash.components(minhash.tile_links(members, weights))
    got = {bytes(r.node)[0]: bytes(r.label)[0] for r in found.collect()}
    label = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                a, b = shingles(texts[i]), shingles(texts[j])
                if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                    label[i] = min(label[i], label[j])
    assert [got.get(i, i) for i in range(40)] == label and len(set(label)) > 1


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_samples_agree_as_often_as_the_weighted_sets_do(share):
    rng = np.random.default_rng(3)
    n, k = 400, 2048
    key = np.arange(n, dtype=np.uint64) * np.uint64(2654435761)
    weight = rng.uniform(0.5, 8, n).astype(np.float32)
    part = int(n * share)
    a = minhash.weighted_samples(np.zeros(n, np.int64), key, weight, 1, k)
    b = minhash.weighted_samples(np.zeros(part, np.int64), key[:part], weight[:part], 1, k)
    assert abs((a == b).mean() - weight[:part].sum() / weight.sum()) < 0.05
    c = minhash.weighted_samples(np.zeros(n, np.int64), key, weight * 2, 1, k)
    assert abs((a == c).mean() - 0.5) < 0.05


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(20)] + [(b"x", b"y")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in minhash.components(links).collect()}
    assert got == {bytes([i]): b"\0" for i in range(21)} | {b"x": b"x", b"y": b"x"}
