"""Tables with repeated rows."""

import numpy as np

from rondel.llm import mixing


def test_totals_count_every_row(spark):
    words = {"en": "the river of stone and that ", "de": "der die und größe über ", "fr": "le la les été où ", "es": "el que los año ñandú "}
    rows = [(i, words[lang] * (5 + i % 7), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 40)]
    rows = [(i, text.replace(" ", "### ") if i % 11 == 0 else text, lang) for i, text, lang in rows]
    labels = spark.createDataFrame([(i, 0 if i % 11 == 0 else 1, 0) for i, _, _ in rows], "doc_id bigint, quality int, toxic int")
    repeated = [r for r in rows for _ in range(9 if r[2] == "de" else 1)]
    got = mixing.mixing_rates(spark.createDataFrame(repeated, "doc_id bigint, text string, lang string"), labels).collect()
    assert sum(r.n_rows for r in got) == len(repeated) and {r.doc_id: r.n_rows for r in got} == {i: 9 if lang == "de" else 1 for i, _, lang in rows}
    p, n, x = np.array([r.posterior for r in got]), np.array([r.n_tokens * r.n_rows for r in got], float), np.array([r.rate for r in got])
    goal = np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)]) / sum(mixing.TARGETS.values()) * n.sum()
    assert np.abs(((x * n) @ p - goal) / goal).max() < 0.02
