"""Steps whose work must not grow faster than the rows."""

from pyspark.sql import functions as F

from rondel.operators import kernels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_next_greater_streams_cases(spark):
    rows = [(1, 0, 3), (1, 1, None), (1, 2, 3), (1, 3, 9), (2, 0, 7), (2, 1, 5), (None, 0, 1), (None, 1, 2)]
    found = kernels.next_greater(spark.createDataFrame(rows, "case_id long, i int, x long"))
    got = {(r.case_id, r.i): (r.distance, r.value) for r in found.collect()}
    assert got == {(1, 0): (3, 9.0), (1, 1): (None, None), (1, 2): (1, 9.0), (1, 3): (None, None), (2, 0): (None, None), (2, 1): (None, None), (None, 0): (None, None), (None, 1): (None, None)}
    assert "FlatMapGroups" not in plan(found)
    # A case longer than a batch, and more cases than a call each would bear.
    long = spark.range(30_000).select(F.lit(1).alias("case_id"), F.col("id").alias("i"), (-F.col("id")).alias("x"))
    many = spark.range(200_000).select((F.col("id") + 2).alias("case_id"), F.lit(0).alias("i"), F.col("id").alias("x"))
    assert kernels.next_greater(long.union(many)).filter("distance is null").count() == 230_000
    assert kernels.next_greater(long.withColumn("x", F.when(F.col("i") == 29_999, 1).otherwise(F.col("x")))).agg(F.max("distance")).first()[0] == 29_999


def test_fingerprints_sum_their_bytes_once(monkeypatch):
    """However many levels the phrases have, the bytes' prefix sums are worked out once for a slice."""
    from rondel.llm import fingerprint, shared

    calls, whole = [], shared.prefix_sums
    counted = lambda data: calls.append(len(data)) or whole(data)
    monkeypatch.setattr(shared, "prefix_sums", counted)
    monkeypatch.setattr(fingerprint, "prefix_sums", counted)
    texts = [bytes((i * i + i // 7) % 251 for i in range(5000)), b"", b"aaaa", b"abc" * 500]
    found = fingerprint.signatures(texts)
    assert len(calls) == 1
    alone = [fingerprint.signatures([t])[0].tolist() for t in texts]
    assert [f.tolist() for f in found] == alone and all(a == sorted(set(a)) for a in alone)


def test_transducer_keeps_its_states_small():
    """States are rows of fields and moves one table; forgetting keeps both in step, and the encoding as it was."""
    from rondel.llm import bpe

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"cab": 259, b"abcab": 260}
    merges = bpe.Merges(ranks)
    small = bpe.Transducer(merges)
    assert isinstance(small.moves, dict)
    words = [w.encode() for w in ("abcabcab", "bcabca", "cabcab", "xabcabx", "a", "")]
    want = [[ranks[p] for p in merges.merge(w)] for w in words]
    assert [list(small.encode(w)) for w in words] == want
    kept, bpe.STATES_KEPT = bpe.STATES_KEPT, 4
    try:
        assert [list(small.encode(w)) for w in words * 3] == want * 3
    finally:
        bpe.STATES_KEPT = kept
    small._forget()
    assert all(key >> 8 < len(small.states) for key in small.moves)


def test_neighbours_are_dealt_out(spark):
    """Pairs cost processors, not bytes: merging partitions by their bytes left one task with all of them."""
    from rondel import queries

    for name in ("page_tree_similarity", "token_tiling"):
        found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1, name


def test_tree_distance_in_groups(monkeypatch):
    import random

    import numpy as np

    from rondel.operators import structure

    def brute(a, b, known):
        # Forests as tuples of (label, forest).
        if not a or not b:
            return sum(1 + brute(kids, (), known) for _, kids in a) + sum(1 + brute((), kids, known) for _, kids in b)
        if (a, b) not in known:
            (x, xs), (y, ys) = a[-1], b[-1]
            known[a, b] = min(brute(a[:-1] + xs, b, known) + 1, brute(a, b[:-1] + ys, known) + 1, brute(a[:-1], b[:-1], known) + brute(xs, ys, known) + (x != y))
        return known[a, b]

    def forest(n):
        out = []
        while n > 0:
            k = random.randint(1, n)
            out.append((random.choice("ab"), forest(k - 1)))
            n -= k
        return tuple(out)

    events = lambda f: [e for label, kids in f for e in ("<" + label, *events(kids), ">" + label)]
    random.seed(1)
    for cells in (1, 30, 1 << 21):
        monkeypatch.setattr(structure, "_CELLS", cells)
        for _ in range(60):
            a, b = forest(random.randint(0, 8)), forest(random.randint(0, 8))
            b = a[:1] + b + a[1:] if random.random() < 0.5 else b
            assert structure.tree_distance(structure.tree(events(a))[:2], structure.tree(events(b))[:2]) == brute(a, b, {})
    # No more columns at once than cells allow for, and each key root in one group.
    first = structure.tree(events(forest(60)))[1]
    groups = structure._root_groups(first, 40)
    assert sorted(j for g in groups for level in g for j in level) == structure._roots(first)
    assert all(len(g) == len(g[0]) == 1 or sum(int(j - first[j]) + 2 for level in g for j in level) <= 40 for g in groups)
    assert structure._differing(*[(np.array([1, 2, 3, 9]), np.array([0, 1, 0, 0]))] * 2)[0][0].tolist() == [-1]


def test_tiling_numbers_no_longer_runs_than_needed(monkeypatch):
    """Two texts without a common run of the least length need the numbers of runs up to it, however long they are."""
    import numpy as np

    from rondel.operators import structure

    asked, level = [], structure.Runs._level
    monkeypatch.setattr(structure.Runs, "_level", lambda self, k: asked.append(k) or level(self, k))
    a, b = np.arange(3000).astype(str).astype(object), np.arange(5000, 9000).astype(str).astype(object)
    assert structure.tiles(a, b) == [] and max(asked) == 3
    asked.clear()
    b[100:112], b[200:209] = a[50:62], a[1000:1009]
    assert structure.tiles(a, b) == [(50, 100, 12), (1000, 200, 9)] and max(asked) <= 5


def test_campaign_records_are_not_joined_again(spark, monkeypatch):
    """Outcomes and steps are written in one row; before, each of the rules' passes joined them, repeated records twice."""
    from rondel import record_queries
    from rondel.operators import constraints

    told, real = [], constraints.campaign_violations
    monkeypatch.setattr(constraints, "campaign_violations", lambda records, *rest: told.append(records) or real(records, *rest))
    assert record_queries.campaign_violations(spark, "/root/testdata/sf0.001").count() > 0
    assert "Join" not in plan(told[0])


def test_replay_meets_its_records_in_one_join(spark):
    from rondel.operators import folds, replay

    steps = spark.createDataFrame([(t, 1, "r", n, n % 2 == 0, "success", 0.9, "cpp", "s", "s") for t in range(4) for n in range(1, 13)], "trial long, problem int, route string, step int, restored boolean, status string, similarity double, language string, state string, seed_state string")
    protocol = folds.hops_protocol([0.7, 0.8, 0.9], 0.80)
    chains = folds.collected(steps)
    recorded = spark.createDataFrame([(0, "passed"), (1, "failed"), (2, None), (9, "passed")], "trial long, confirmation string")
    found = replay.replayed(recorded, steps, protocol, ["confirmation"])
    text = plan(replay.replayed_chains(recorded, chains, protocol, ["confirmation"]))
    assert text.count("FullOuter") == 1 and "LeftOuter" not in text
    got = {r.trial: (r.reason, r.matches, [tuple(d) for d in r.differences]) for r in found.collect()}
    assert got == {
        0: (None, True, []), 1: (None, False, [("confirmation", "failed", "passed")]), 2: (None, False, [("confirmation", None, "passed")]),
        3: ("not_recorded", False, [("confirmation", None, "passed")]), 9: ("no_steps", False, [("confirmation", "passed", None)]),
    }


def test_top_words_are_not_shuffled(spark):
    from rondel.operators import diagnostics

    rows = [(1, "bb a bb int cc cc"), (1, "cc x1 x1 x1"), (2, "a b 1"), (3, None), (4, "zz yy"), (None, "nn"), (4, "yy")]
    sources = spark.createDataFrame(rows, "k long, source string")
    found = diagnostics.top_word(sources, "k")
    assert sorted((r.k or 0, r.word, r.n) for r in found.collect()) == [(0, "nn", 1), (1, "cc", 3), (4, "yy", 2)]
    steps = diagnostics.top_word(sources, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("RepartitionByExpression") == 1 and "Generate" not in steps and "Aggregate" not in steps


def test_a_response_is_parsed_once(spark):
    from rondel.functions import responses

    raw = '{"id":"r1","model":"m","choices":[{"message":{"content":"t"},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"cost":0.5}}'
    rows = spark.createDataFrame([(raw,), ("[1]",), (None,)], "raw string")
    found = rows.select(responses.normalised_response(F.col("raw")).alias("n")).select("n.*")
    got = [(r.protocol, r.status, r.text, r.prompt_tokens, r.cost_usd) for r in found.collect()]
    assert got == [("chat_completions", "ok", "t", 3, 0.5), (None, "not_an_object", None, None, None), (None, "not_an_object", None, None, None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") == 1


def test_sum_targets_keeps_one_case(spark):
    """Against all pairs, in one grouping by case: no table of all sums, no join of the cases."""
    import random

    random.seed(2)
    rows = [(c, i, None if random.random() < 0.1 else random.randint(-2, 3)) for c in range(6) for i in range(30)] + [(None, 0, 2), (9, 0, None)]
    for target in (0, 2):
        want = {None: 0, 9: 0}
        for c in range(6):
            sums, total = [0], None
            for x in (x for of, _, x in rows if of == c):
                total = total if x is None else (total or 0) + x
                sums.append(total)
            want[c] = sum(b is not None and b - a == target for k, b in enumerate(sums) for a in sums[:k] if a is not None)
        frame = spark.createDataFrame(rows, "case_id long, i int, x long")
        assert {r.case_id: r.n for r in kernels.sum_targets(frame, target).collect()} == want
        steps = kernels.sum_targets(frame, target)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in steps and "Window" not in steps
