"""Labels that only a pair of terms tells, and what a fit is bounded by."""

import numpy as np
import pyarrow as pa

from rondel.llm import toxicity
from rondel.llm.shared import slices


def counted(texts):
    (_, _, data, offsets), out = next(slices(pa.array(texts), 1 << 30)), []
    of, term, x = toxicity._counted(*toxicity.term_buckets(data, offsets), toxicity.BUCKETS)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [(term[a:b].astype(np.int32), x[a:b].astype(np.float32)) for a, b in zip(cut, cut[1:])]


def test_a_pair_that_neither_term_tells_is_learnt():
    """Label 1 if both or neither occur: no linear weights can do this."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for a, b in (rng.random((1800, 2)) < 0.5).tolist():
        texts.append(" ".join([*rng.choice([f"filler{i}" for i in range(200)], 12), *["insult"] * a, *["group"] * b]))
        y.append(float(a == b))
    rows, y = counted(texts), np.array(y)
    machine = toxicity.fit(rows[:1200], y[:1200])
    scores = []
    for term, x in rows[1200:]:
        at = machine.slot[term]
        scores.append(toxicity._score(machine.bias, machine.w, machine.v, at[at >= 0], x[at >= 0], np.zeros((at >= 0).sum(), int), 1)[0][0])
    assert np.mean((np.array(scores) > 0) == (y[1200:] == 1)) > 0.95


def test_rows_that_share_an_id_teach_once(spark):
    docs = spark.createDataFrame([(1, "vile text"), (1, "vile text"), (2, "kind text"), (None, "x"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, None)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0
