"""Surnames that stand alone, very long texts, and formats that are full."""

import re

import pytest
from pyspark.sql import functions as F

from rondel.llm import pii
from rondel.llm.shared import spread_join


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in pii.surrogates(docs).collect()}


def test_texts_of_any_length_and_bare_surnames(spark):
    texts = [
        "a@" + "b." * 100_000, "x" * 50_000 + "@mail.example.com.", "0a" * 5_000, "Mr John Smith met Jane Doe; Smith left, Smithers and Doe's dog stayed.",
        "Akira Tanaka, Fatima Khan and fe80::1ff:fe23:4567:890a at 12:30:45", "marks \x01 and \x02 and \x02\x04 by a@b.example.com \x01", "1" * 300_000, "a" * 1_000_000,
    ]
    rows = replaced(spark, texts)
    assert rows[0].text == texts[0] and rows[7].text == texts[7]
    assert rows[1].n_entities == 1 and len(rows[1].text) == len(texts[1]) and not rows[1].text.startswith("xxxx") and rows[1].text.endswith("example.com.")
    assert rows[2].n_entities == 1 and len(rows[2].text) == 10_000 and rows[2].text != texts[2]
    surname, other = re.fullmatch(r"Mr \S+ (\w+) met \w+ (\w+); \1 left, Smithers and \2's dog stayed\.", rows[3].text).groups()
    assert surname != "Smith" and other != "Doe" and surname != other
    assert not set("Akira Tanaka Fatima Khan fe80::1ff:fe23:4567:890a".split()) & set(rows[4].text.split()) and rows[4].text.endswith(" at 12:30:45")
    assert re.fullmatch("marks \x01 and \x02 and \x02\x04 by \\w@\\w\\.example\\.com \x01", rows[5].text)


def test_full_format_widens(spark):
    """All 256 addresses of a small private range are entities, and none may be a surrogate."""
    values = [f"192.168.{a}.{b}" for a in (0, 1) for b in range(256)] + [f"{i:03}-{j:02}-{k:04}" for i, j, k in ((1, 2, 3), (4, 5, 6))]
    kinds = ["ip" if "." in v else "ssn" for v in values]
    drawn = spark.createDataFrame([(k, v, n) for k, v in zip(kinds, values) for n in (0, pii.WIDER, 2 * pii.WIDER, 2 * pii.WIDER + 5)], "kind string, value string, attempt int")
    rows = drawn.select("kind", "value", "attempt", pii.surrogate(F.col("kind"), F.col("value"), F.col("attempt"), "k").alias("s")).collect()
    for r in rows:
        if r.kind == "ip":
            assert re.fullmatch({0: r"192\.168\.\d+\.\d+", pii.WIDER: r"10\.\d+\.\d+\.\d+"}.get(r.attempt, "fd[0-9a-f]{2}(:[0-9a-f]{4}){7}"), r.s)
        else:
            assert re.fullmatch(r"\d{3}-\d\d-\d{4}" + r"\d" * 2 * max(0, r.attempt - 2 * pii.WIDER + 1), r.s)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, how):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i int, k string")
    few = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    got = spread_join(rows, few, ["k"], ["i"], how)
    want = rows.join(few, "k", how).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
