"""Surrogates, mixing and the pipeline."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from rondel.llm import mixing, pii


def luhn(digits):
    return sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(int(c) for c in digits.zfill(20))) % 10


def replaced(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in pii.surrogates(docs, **more).collect()}


def test_each_type_keeps_its_format(spark):
    texts = [
        "write to Jane.Doe42@mail7.example.com now", "at 192.168.4.77 and 8.8.4.4, ok", "call +1 (017) 555-7713 or (212) 555-0199.",
        "card 4111 1111 1111 1111, 9807915762804490", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "iban DE89 3704 0044 0532 0130 00!", "ssn 078-05-1120",
        "Mr. John Smith met Mrs Mary Smith", "госпожа нет, Госпожа Ольга Иванова", None, "", "nothing private, 12 apples",
    ]
    rows = replaced(spark, texts)
    forms = [
        r"write to [A-Z][a-z]{3}\.[A-Z][a-z]{2}\d\d@[a-z]{4}\d\.example\.com now", r"at 192\.168\.\d+\.\d+ and \d+\.\d+\.\d+\.\d+, ok", r"call \+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4}\.",
        r"card 4\d{3} \d{4} \d{4} \d{4}, 9\d{15}", r'token = "[0-9a-f]{40}" end', r"iban DE\d\d (\d{4} ){4}\d\d!", r"ssn \d{3}-\d\d-\d{4}",
        r"Mr\. \w+ (\w+) met Mrs \w+ \1", r"госпожа нет, Госпожа [А-я]+ [А-я]+",
    ]
    for i, form in enumerate(forms):
        assert re.fullmatch(form, rows[i].text), rows[i].text
        assert rows[i].text != texts[i] and rows[i].n_entities >= 1
    assert [rows[i].text for i in (9, 10, 11)] == texts[9:12] and [rows[i].n_entities for i in (9, 10, 11)] == [0, 0, 0]
    assert luhn(re.search(r"4[\d ]{18}", rows[3].text)[0].replace(" ", "")) == 0
    token = re.search("[0-9a-f]{40}", rows[4].text)[0]
    assert replaced(spark, [texts[4], texts[4].upper()])[1].text == f'TOKEN = "{token.upper()}" END'
    account = re.search(r"DE[\d ]+", rows[5].text)[0].replace(" ", "").strip()
    assert int(account[4:] + "1314" + account[2:4]) % 97 == 1
    man, woman = re.match(r"Mr\. (\w+) \w+ met Mrs (\w+)", rows[7].text).groups()
    assert man in pii.GIVEN["male", "latin"] and woman in pii.GIVEN["female", "latin"]


def test_coreference_and_distinctness(spark):
    rng = random.Random(2)
    people = [f"user{i}@mail{i % 3}.example.org" for i in range(300)]
    phones = [f"+1 ({rng.randrange(1000):03}) 555-{rng.randrange(10**4):04}" for _ in range(300)]
    texts = [f"from {rng.choice(people)} and {rng.choice(people).upper()} by {rng.choice(phones)}" for _ in range(400)]
    rows = replaced(spark, texts)
    seen = {}
    for i, text in enumerate(texts):
        before, after = re.fullmatch(r"from (\S+) and (\S+) by (.*)", text).groups(), re.fullmatch(r"from (\S+) and (\S+) by (.*)", rows[i].text).groups()
        for old, new in zip(before, after):
            assert seen.setdefault(old.lower(), new.lower()) == new.lower()
            assert old.isupper() == new.isupper() or "+" in old
    assert len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())
    domains = {}
    for old, new in seen.items():
        if "@" in old:
            assert domains.setdefault(old.split("@")[1], new.split("@")[1]) == new.split("@")[1]
    other = replaced(spark, texts[:5], key="another")
    assert all(other[i].text != rows[i].text for i in range(5))


def test_small_space_is_filled_without_merging(spark):
    """Names of one pool: more people than names."""
    surnames = [s + t for s in ("Ald", "Ber", "Cor", "Dun", "Eri", "Fal") for t in ("son", "well", "ing", "ton", "ley", "mar", "rick", "ford")]
    given = pii.GIVEN["male", "latin"]
    texts = [f"{given[i % len(given)]} {s} spoke" for i, s in enumerate(surnames)]
    rows = replaced(spark, texts)
    first, last = {}, {}
    for i, text in enumerate(texts):
        a, b = text.split()[:2]
        x, y = rows[i].text.split()[:2]
        assert first.setdefault(a, x) == x and last.setdefault(b, y) == y
    assert len(set(first.values())) == len(first) and len(set(last.values())) == len(last)
    assert not set(first) & set(first.values())


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b@c.example.com", "x", None), (1, "a b@c.example.com", "x", None), (2, "none", None, 5)], "doc_id bigint, text string, digest string, n_entities int")
    out = pii.pseudonymised(docs)
    assert out.columns == ["doc_id", "text", "digest", "n_entities"] and out.count() == 3
    assert pii.surrogates(docs.limit(0)).count() == 0


def mixed_corpus(spark):
    rng = random.Random(4)
    words = {"en": ["the", "of", "and", "that", "river", "stone"], "de": ["der", "die", "und", "über", "größe"], "fr": ["le", "la", "les", "été", "où"], "es": ["el", "que", "los", "año", "ñandú"]}
    rows, labels = [], []
    for i in range(600):
        lang = rng.choices(list(words), [6, 2, 1, 1])[0]
        low = rng.random() < 0.2
        text = " ".join(rng.choices(words[lang], k=rng.randint(30, 120)))
        rows.append((i, text.replace(" ", "### ") if low else text, lang))
        if i % 3 == 0:
            labels.append((i, 0 if low else 1, 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_rates_meet_targets_and_equal_brute_force(spark):
    docs, labels = mixed_corpus(spark)
    rows = sorted(mixing.mixing_rates(docs, labels).collect(), key=lambda r: r.doc_id)
    domains = sorted(mixing.TARGETS)
    p, n, x = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows], float), np.array([r.rate for r in rows])
    assert np.allclose(p.sum(1), 1) and (x >= 0).all() and (x <= mixing.MAX_RATE).all()
    goal = np.array([mixing.TARGETS[d] for d in domains]) / sum(mixing.TARGETS.values()) * n.sum()
    natural = n @ p
    assert np.abs((x * n) @ p - goal).max() <= 2 * mixing.PRECISION * natural.max()
    y = np.ones(len(n))
    for _ in range(mixing.STEPS):
        now = (y * n) @ p
        if (np.abs(now - goal) <= mixing.PRECISION * np.maximum(goal, natural)).all():
            break
        y = np.clip(y - mixing.STEP * p @ ((now - goal) / natural), 0, mixing.MAX_RATE)
    assert np.allclose(x, y, atol=1e-6)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    clean = [r for r in rows if r.domain != mixing.LOW]
    assert np.mean([r.domain == truth[r.doc_id] for r in clean]) > 0.97


def test_mixed_keeps_clean_rows(spark):
    docs, labels = mixed_corpus(spark)
    docs = docs.withColumn("rate", F.lit("kept"))
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    likely = {r.doc_id: r.domain for r in mixing.mixing_rates(docs, labels).collect()}
    ids = [r.doc_id for r in out.collect()]
    assert {i for i, d in likely.items() if d != mixing.LOW} <= set(ids)
    assert len(ids) != docs.count()


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b"), (3, "x " * 9000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = mixing.mixing_rates(docs, labels).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("1", 0), ("2", 0), ("3", 9000), ("None", 2)]
    assert mixing.mixing_rates(docs.limit(0), labels).count() == 0
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_pipeline_runs_and_each_stage_acts(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns and after.dtypes == docs.dtypes, name
        path = f"{tmp_path}/{name}"
        after.write.parquet(path)
        after = spark.read.parquet(path)
        if name == "toxicity":
            assert 0 < after.count() <= before.count()
        if name == "minhash_near_dedup":
            assert after.count() < before.count() and after.select("doc_id").distinct().count() == after.count()
        if name == "pii_surrogates":
            assert after.count() == before.count() and after.select("text").exceptAll(before.select("text")).count() > 0
        before = after
    last = cp.STAGES[-1][1](spark, before, sf)
    want = before.select("doc_id", F.sha2("text", 256).alias("decoded_sha256"))
    assert last.select("doc_id", "decoded_sha256").exceptAll(want).count() == 0 and last.count() == before.count()
