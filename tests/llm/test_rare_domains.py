"""Domains far under their target."""

import random
import warnings

import numpy as np
import pytest

from rondel.llm import mixing

WORDS = {"en": ["the", "of", "and", "that", "river", "stone"], "de": ["der", "die", "und", "über", "größe"], "fr": ["le", "la", "les", "été", "où"], "es": ["el", "que", "los", "año", "ñandú"]}


def corpus(spark, rare):
    """Each domain has its target's share but es, which has ``rare`` documents of 600."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        lang = "es" if i < rare else rng.choices(["en", "de", "fr"], [4, 1, 1])[0]
        low = i >= rare and rng.random() < 0.1
        text = " ".join(rng.choices(WORDS[lang], k=80))
        rows.append((i, text.replace(" ", "### ") if low else text, lang))
        labels.append((i, 0 if low else 1, 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def shares(rows):
    p, n, x = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows], float), np.array([r.rate for r in rows])
    goal = np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)]) / sum(mixing.TARGETS.values()) * n.sum()
    return ((x * n) @ p - goal) / goal, x


def test_rare_domain_reaches_its_target(spark):
    docs, labels = corpus(spark, 4)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rows = mixing.mixing_rates(docs, labels).collect()
    off, x = shares(rows)
    assert np.abs(off).max() < 0.02 and x.max() > 8 and (x >= 0).all()
    assert all(r.residual == rows[0].residual for r in rows) and np.allclose(rows[0].residual, off, atol=1e-6)


def test_missed_targets_are_told(spark):
    docs, _ = corpus(spark, 4)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    with pytest.warns(UserWarning, match="targets not met"):
        rows = mixing.mixing_rates(docs, none).collect()
    off, _ = shares(rows)
    assert np.abs(off).max() > 0.5 and np.allclose(rows[0].residual, off, atol=1e-6)
