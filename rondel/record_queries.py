"""Registered queries on records of runs: replay and resume, selection, integrity, constraints, responses and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rondel.functions import labels, responses
from rondel.functions.text import extracted_code
from rondel.operators import audits, chains, constraints, diagnostics, folds, gates, integrity, outcomes, replay, schedules, selection
from rondel.plans.views import OUTCOMES_SQL, STEPS_SQL, table
from rondel.plans.views import outcomes as outcome_view
from rondel.plans.views import steps as step_view
from rondel.queries import _HOPS, _OK, _W, _WH, SQL, THRESHOLDS, query
from rondel.sources import evidence
from rondel.sources.tables import outcome_rows, written


@query(SQL["hops_state_fold"])
def hops_resumed(spark, sf):
    """Decisions after states were stored at a step that differs by chain, and folded on from there."""
    protocol, steps = folds.hops_protocol(THRESHOLDS, 0.80), step_view(spark, sf).filter("step <= 12")
    before = written(replay.states(steps.filter("step <= trial % 7"), protocol), "decision-states")
    out = protocol.decided(replay.resumed(before, steps, protocol))
    return out.select("route", "confirmation", F.explode("outcomes").alias("o")).groupBy("route", "o.threshold", "o.category", "o.reached_step", "confirmation").agg(F.count("*").alias("n"))


@query(
    f"""WITH {STEPS_SQL}, m AS (SELECT trial, step, min(CASE WHEN cost IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trial ORDER BY step) AS ok FROM steps),
    k AS (SELECT trial, count(*) AS n, coalesce(max(step) FILTER (ok = 1), 0) AS kept FROM m GROUP BY trial)
    SELECT k.trial, kept::INT AS kept, kept::INT + 1 AS start, coalesce(status, 'running') AS previous_status, n - kept AS dropped FROM k LEFT JOIN steps s ON s.trial = k.trial AND s.step = kept"""
)
def resume_plan(spark, sf):
    """A step without a cost isn't complete."""
    return replay.resume_plan(step_view(spark, sf), F.col("cost").isNotNull())


@query(
    f"""WITH {STEPS_SQL}, {_OK}, {_HOPS.replace("step <= 10 AND", "step <= 6 AND")}, r AS (SELECT trial, threshold, reached_step FROM hop_reach),
    a AS (SELECT trial, count(*) FILTER (reached_step IS NOT NULL) AS told FROM r GROUP BY trial),
    whole AS (SELECT trial, min(step) FILTER (NOT functional) AS f, count(*) AS n FROM steps WHERE step <= 12 GROUP BY trial)
    SELECT n, f IS NOT NULL AS failed, sum(told) AS reached, count(*) AS chains FROM a JOIN whole USING (trial) GROUP BY ALL"""
)
def reach_within_six(spark, sf):
    """What a history saved up to step 6 tells, beside the whole chain's length and failure."""
    protocol, steps = folds.hops_protocol(THRESHOLDS, 0.80), step_view(spark, sf).filter("step <= 12")
    early = protocol.decided(replay.states(steps.filter("step <= 6"), protocol)).select("trial", F.size(F.filter("outcomes", lambda o: o["reached_step"].isNotNull())).alias("told"))
    whole = steps.groupBy("trial").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(~F.col("functional")), F.lit(False)).alias("failed"))
    return early.join(whole, "trial").groupBy("n", "failed").agg(F.sum("told").alias("reached"), F.count("*").alias("chains"))


@query(
    f"""WITH {STEPS_SQL}, r AS (SELECT trial, (step + 1) // 2 AS iteration, count(*) AS n, arg_min(status, step) FILTER (status <> 'success') AS failed, arg_max(state, step) AS hash FROM steps GROUP BY ALL),
    s AS (SELECT trial, iteration, hash, coalesce(failed, CASE WHEN n = 2 THEN 'success' ELSE 'incomplete' END) AS status, n = 2 AND failed IS NULL AS passed FROM r)
    SELECT trial, iteration, status, passed, row_number() OVER (PARTITION BY trial, hash ORDER BY iteration) > 1 AS duplicate, coalesce(lag(status) OVER (PARTITION BY trial ORDER BY iteration), 'running') AS from_status FROM s"""
)
def iteration_outcomes(spark, sf):
    rows = step_view(spark, sf).select("trial", F.floor((F.col("step") + 1) / 2).alias("iteration"), "step", "status", F.col("state").alias("hash"))
    return replay.iteration_outcomes(rows)


_RUNS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    f"""WITH a AS (SELECT o_orderpriority AS run, o_custkey AS problem, c_nationkey AS target, o_orderkey AS attempt, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'api_error' ELSE 'running' END AS status, CASE WHEN o_orderkey % 53 = 0 THEN 'x' ELSE 'c' END AS h, o_orderkey % 59 = 0 AS tool FROM orders JOIN customer ON o_custkey = c_custkey),
    i AS (SELECT run, problem, target, CASE WHEN problem % 41 = 0 THEN 'z' ELSE 'c' END AS h, min(attempt) FILTER (status = 'success') AS sel, CASE WHEN problem % 37 = 0 THEN -1 ELSE max(attempt) FILTER (status <> 'success') END AS act, true AS indexed FROM a GROUP BY run, problem, target),
    p AS (SELECT run, c_custkey AS problem, c_nationkey AS target FROM customer, (SELECT unnest([{", ".join(f"'{r}'" for r in _RUNS)}]) AS run)),
    j AS (SELECT p.*, i.h, sel, act, coalesce(indexed, false) AS indexed, s.status, s.h AS sh, s.tool, coalesce(sel, act) AS wanted FROM p LEFT JOIN i USING (run, problem, target) LEFT JOIN a s ON s.attempt = coalesce(sel, act) AND s.run = p.run AND s.problem = p.problem),
    f AS (SELECT *, CASE WHEN NOT indexed THEN NULL WHEN h <> 'c' THEN 'index_condition_mismatch' WHEN sel IS NULL AND status IS NULL THEN 'invalid_active_attempt' WHEN sel IS NOT NULL AND sh <> 'c' THEN 'manifest_identity_mismatch' WHEN sel IS NOT NULL AND tool THEN 'unevaluable_attempt' END AS fault FROM j)
    SELECT run, problem, target, CASE WHEN fault IS NULL THEN sel END AS attempt, CASE WHEN fault IS NULL AND sel IS NOT NULL THEN status END AS status,
    CASE WHEN fault IS NOT NULL THEN NULL WHEN NOT indexed THEN 'incomplete' WHEN sel IS NULL THEN CASE WHEN status = 'api_error' THEN 'infrastructure' ELSE 'incomplete' END END AS reason, fault FROM f"""
)
def selected_slots(spark, sf):
    """Orders as attempts of a slot (priority, customer, nation); some carry another condition, lack a tool, or have a broken index."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("problem"), F.col("c_nationkey").alias("target"))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "api_error").otherwise("running")
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("problem"), F.col("o_orderkey").alias("attempt"), status.alias("status"), F.when(F.col("o_orderkey") % 53 == 0, "x").otherwise("c").alias("condition_hash"), F.lit("v").alias("validation_hash"), (F.col("o_orderkey") % 59 == 0).alias("missing_toolchain"))
    attempts = orders.join(customers, "problem")
    done, none = F.col("status") == "success", F.col("problem") % 37 == 0
    index = attempts.groupBy(*selection.SLOT).agg(F.min(F.when(done, F.col("attempt"))).alias("selected"), F.max(F.when(~done, F.col("attempt"))).alias("active"))
    index = index.withColumns({"condition_hash": F.when(F.col("problem") % 41 == 0, "z").otherwise("c"), "active": F.when(none, -1).otherwise(F.col("active"))})
    plan = customers.withColumn("run", F.explode(F.array(*map(F.lit, _RUNS))))
    runs = spark.createDataFrame([(r, "c", "v", "main") for r in _RUNS], "run string, condition_hash string, validation_hash string, phase string")
    return selection.selected(plan, runs, index, attempts)


_PAYLOAD = "concat(event_type, ':', user_id, ':', k)"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS chain, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, {_PAYLOAD} AS payload FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
    s AS (SELECT chain, event_id, seq, payload, sha256(chr(10) || payload) AS digest FROM e WHERE seq = 1
      UNION ALL SELECT e.chain, e.event_id, e.seq, e.payload, sha256(s.digest || chr(10) || e.payload) FROM s JOIN e ON e.chain = s.chain AND e.seq = s.seq + 1),
    c AS (SELECT chain, seq, CASE WHEN event_id % 97 = 5 THEN payload || '!' ELSE payload END AS payload, CASE WHEN event_id % 101 = 9 THEN NULL ELSE digest END AS digest FROM s WHERE event_id % 89 <> 7
      UNION ALL SELECT chain, seq, payload, '0' FROM s WHERE event_id % 103 = 11),
    l AS (SELECT *, lag(digest) OVER w AS before, lag(seq) OVER w AS before_seq FROM c WINDOW w AS (PARTITION BY chain ORDER BY seq, digest NULLS FIRST)),
    f AS (SELECT chain, seq, CASE WHEN seq = before_seq THEN 'duplicate_number' WHEN seq > before_seq + 1 THEN 'gap' WHEN digest IS NULL OR digest <> sha256(coalesce(before, '') || chr(10) || payload) THEN 'digest' END AS fault FROM l)
    SELECT * FROM f WHERE fault IS NOT NULL"""
)
def event_chain_faults(spark, sf):
    """Chains of each user's events, sealed, and then with payloads changed, digests lost, records lost and records doubled."""
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    order = "row_number() over (partition by user_id order by event_id)"
    rows = rows.select(F.col("user_id").alias("chain"), "event_id", F.expr(order).alias("seq"), F.expr(_PAYLOAD).alias("payload"))
    sealed = integrity.sealed_chain(rows.select("chain", "seq", "payload")).join(rows.select("chain", "seq", "event_id"), ["chain", "seq"])
    kept = sealed.filter("event_id % 89 <> 7").withColumns({"payload": F.expr("if(event_id % 97 = 5, concat(payload, '!'), payload)"), "digest": F.expr("if(event_id % 101 = 9, null, digest)")})
    doubled = sealed.filter("event_id % 103 = 11").withColumn("digest", F.lit("0"))
    return integrity.broken_links(kept.unionByName(doubled), rows=16)


_LINE_PARTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
_TEXT_SQL = "concat_ws(';', {})".format(", ".join(f"coalesce('{c}=' || length({c}::VARCHAR) || ':' || {c}::VARCHAR, '{c}-')" for c in sorted([*_LINE_PARTS, "part"])))
_BUILD_SQL = f"first_build AS (SELECT l_partkey % 25 AS part, {', '.join(_LINE_PARTS)} FROM lineitem)"
_DIGEST_SQL = "SELECT part, count(*) AS rows, " + " || '-' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::HUGEINT)::VARCHAR" for i in range(4)) + f" AS digest FROM (SELECT part, sha256({_TEXT_SQL}) AS h FROM {{}}) GROUP BY part"


def _build(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 25).alias("part"), *_LINE_PARTS)


@query(f"WITH {_BUILD_SQL} {_DIGEST_SQL.format('first_build')}")
def table_digests(spark, sf):
    return integrity.multiset_digest(_build(spark, sf), "part")


@query(
    f"""WITH {_BUILD_SQL}, second_build AS (
      SELECT part, l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN part = 8 AND l_orderkey % 5 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus FROM first_build WHERE part <> 11 AND NOT (part = 3 AND l_orderkey % 7 = 0)
      UNION ALL SELECT * FROM first_build WHERE part = 5 AND l_orderkey % 3 = 0 UNION ALL SELECT part + 100, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus FROM first_build WHERE part = 1),
    a AS ({_DIGEST_SQL.format('first_build')}), b AS ({_DIGEST_SQL.format('second_build')})
    SELECT part, CASE WHEN b.rows IS NULL THEN 'missing' WHEN a.rows IS NULL THEN 'unexpected' ELSE 'changed' END AS fault, a.rows AS rows, b.rows AS rows_again FROM a FULL JOIN b USING (part) WHERE a.rows IS NULL OR b.rows IS NULL OR a.digest <> b.digest OR a.rows <> b.rows"""
)
def rebuilt_table(spark, sf):
    """A table built twice, the second time with rows lost, doubled and changed in some parts, a part lost and one too many."""
    first = _build(spark, sf)
    second = first.filter("part <> 11 and not (part = 3 and l_orderkey % 7 = 0)").withColumn("l_returnflag", F.expr("if(part = 8 and l_orderkey % 5 = 0, 'X', l_returnflag)"))
    second = second.unionByName(first.filter("part = 5 and l_orderkey % 3 = 0")).unionByName(first.filter("part = 1").withColumn("part", F.col("part") + 100))
    # Rows go elsewhere and come in another order.
    return integrity.rebuilt_differences(first, second.repartition("l_suppkey"), "part")


_PATH = "concat(coalesce(source, ''), '/', coalesce(lang, ''), '/', doc_id)"
_TREE_SQL = f"""inv AS (SELECT {_PATH} AS path, sha256(coalesce(text, '')) AS digest FROM documents),
l2 AS (SELECT substr(sha256(path), 1, 2) AS node, sha256(string_agg(path || '=' || digest, chr(10) ORDER BY path || '=' || digest)) AS digest FROM inv GROUP BY ALL),
l1 AS (SELECT substr(node, 1, 1) AS node, sha256(string_agg(node || '=' || digest, chr(10) ORDER BY node || '=' || digest)) AS digest FROM l2 GROUP BY substr(node, 1, 1)),
l0 AS (SELECT '' AS node, sha256(string_agg(node || '=' || digest, chr(10) ORDER BY node || '=' || digest)) AS digest FROM l1)"""


def _evidence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(_PATH).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


@query(f"WITH {_TREE_SQL} SELECT 0 AS level, node, digest FROM l0 UNION ALL SELECT 1, node, digest FROM l1 UNION ALL SELECT 2, node, digest FROM l2")
def evidence_tree(spark, sf):
    inventory, _ = integrity.bundle(_evidence(spark, sf))
    return integrity.inventory_tree(inventory, 2)


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS paths, any_value(length(coalesce(text, ''))) AS characters FROM documents GROUP BY 1")
def evidence_store(spark, sf):
    """Equal contents are stored once."""
    inventory, store = integrity.bundle(_evidence(spark, sf))
    return inventory.groupBy("digest").agg(F.count("*").alias("paths")).join(store.select("digest", F.length("content").cast("bigint").alias("characters")), "digest")


@query(f"SELECT {_PATH} AS path, CASE WHEN doc_id % 89 = 3 THEN 'missing' ELSE 'changed' END AS fault FROM documents WHERE doc_id % 89 = 3 OR (doc_id % 97 = 5 AND length(coalesce(text, '')) > 0) UNION ALL SELECT concat('new/', doc_id), 'unexpected' FROM documents WHERE doc_id % 83 = 1")
def evidence_changes(spark, sf):
    """Documents lost, changed and added, found by going down two trees."""
    before = _evidence(spark, sf)
    after = before.filter("doc_id % 89 <> 3").withColumn("content", F.expr("if(doc_id % 97 = 5 and content <> '', concat(content, '.'), content)"))
    after = after.unionByName(before.filter("doc_id % 83 = 1").withColumn("path", F.expr("concat('new/', doc_id)")))
    inventories = [written(integrity.bundle(x)[0], "inventory") for x in (before, after)]
    trees = [written(integrity.inventory_tree(i, 2), "inventory-tree") for i in inventories]
    return integrity.changed_entries(*inventories, tuple(trees), 2)


# Responses in three forms, made from events; both engines build the same texts.
_RAW = """CASE event_id % 7
WHEN 0 THEN concat('{"id":"r', event_id, '","model":"m1","choices":[{"index":0,"finish_reason":"stop","message":{"role":"assistant","content":"', event_type, '"}}],"usage":{"prompt_tokens":', k, ',"completion_tokens":', user_id, '}}')
WHEN 1 THEN concat('{"id":"r', event_id, '","model":"m2","status":"completed","output":[{"type":"message","content":[{"type":"output_text","text":"', event_type, '"},{"type":"output_text","text":"!"}]},{"type":"reasoning"}],"usage":{"input_tokens":', k, ',"output_tokens":3,"total_tokens":', k + 3, '}}')
WHEN 2 THEN concat('{"text":"', event_type, '","finish_reason":"stop","model":null,"usage":{"cost":', k, '.5,"opencode":{"estimated":', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, '}}}')
WHEN 3 THEN concat('{"id":"r', event_id, '","model":"m1","choices":[{"index":0,"message":{"role":"assistant","content":"a"}},{"index":1,"message":{"role":"assistant","content":"b"}}]}')
WHEN 4 THEN concat('{"id":', event_id)
WHEN 5 THEN concat('{"output":[],"status":"', CASE WHEN user_id % 2 = 0 THEN 'incomplete' ELSE 'failed' END, '","incomplete_details":{"reason":"max_output_tokens"},"usage":{"input_tokens":-', k, '}}')
ELSE concat('{"id":"r', event_id, '","model":" ","choices":[{"index":0,"message":{"role":"assistant","content":"', event_type, '"}}],"usage":{"prompt_tokens":"', k, '","completion_tokens":-1}}') END"""
_RAW_SQL = f"e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT event_id, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM (SELECT event_id, {_RAW} AS raw FROM e))"


def _raw(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select("event_id", F.expr(_RAW).alias("raw"))


def _tokens_sql(name, other=None, least=None):
    whole = lambda n: f"CASE WHEN json_type(j, '$.usage.{n}') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.usage.{n}')::BIGINT END"
    value = f"CASE WHEN json_exists(j, '$.usage.input_tokens') THEN {whole(other)} ELSE {whole(name)} END" if other else whole(name)
    return f"CASE WHEN ({value}) >= {least} THEN {value} END" if least is not None else value


@query(
    f"""WITH {_RAW_SQL}, p AS (SELECT *, CASE WHEN json_exists(j, '$.choices') THEN 'chat_completions' WHEN json_exists(j, '$.output') THEN 'responses' WHEN json_exists(j, '$.text') THEN 'copilot_sdk' END AS protocol FROM r),
    s AS (SELECT *, CASE WHEN j IS NULL THEN 'not_an_object' WHEN json_array_length(j, '$.choices') > 1 THEN 'multiple_choices' WHEN protocol = 'responses' AND j->>'$.status' = 'failed' THEN 'not_completed' ELSE 'ok' END AS status FROM p),
    n AS (SELECT event_id, protocol, status, CASE protocol WHEN 'chat_completions' THEN j->>'$.choices[0].message.content' WHEN 'responses' THEN array_to_string(json_extract_string(j, '$.output[*].content[*].text'), '') ELSE j->>'$.text' END AS text,
      CASE protocol WHEN 'chat_completions' THEN j->>'$.choices[0].finish_reason' WHEN 'responses' THEN CASE WHEN j->>'$.status' = 'completed' THEN 'stop' WHEN j->>'$.incomplete_details.reason' = 'max_output_tokens' THEN 'length' END ELSE j->>'$.finish_reason' END AS finish_reason,
      j->>'$.id' AS request_id, j->>'$.model' AS actual_model, {_tokens_sql("prompt_tokens", "input_tokens")} AS prompt_tokens, {_tokens_sql("completion_tokens", "output_tokens")} AS completion_tokens, {_tokens_sql("total_tokens", "total_tokens")} AS total_tokens,
      (j->>'$.usage.cost')::DOUBLE AS cost_usd, CASE WHEN json_exists(j, '$.usage.cost') THEN CASE WHEN j->>'$.usage.opencode.estimated' = 'true' THEN 'provider_estimated' ELSE 'reported' END END AS cost_source FROM s)
    SELECT event_id, protocol, status, {", ".join(f"CASE WHEN status = 'ok' THEN {c} END AS {c}" for c in ("text", "finish_reason", "request_id", "actual_model", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "cost_source"))} FROM n"""
)
def normalised_responses(spark, sf):
    return _raw(spark, sf).select("event_id", responses.normalised_response(F.col("raw")).alias("n")).select("event_id", "n.*")


@query(
    f"""WITH {_RAW_SQL}, s AS (SELECT *, CASE WHEN j IS NULL THEN 'not_an_object' WHEN coalesce(trim(j->>'$.id'), '') = '' THEN 'no_id' WHEN coalesce(trim(j->>'$.model'), '') = '' THEN 'no_model' WHEN coalesce(json_array_length(j, '$.choices'), 0) = 0 THEN 'no_choices' ELSE 'ok' END AS status FROM r)
    SELECT event_id, status, CASE WHEN status = 'ok' THEN j->>'$.id' END AS request_id, CASE WHEN status = 'ok' THEN array_to_string(json_extract_string(j, '$.choices[*].message.content'), '|') END AS contents,
    CASE WHEN status = 'ok' THEN coalesce(j->>'$.choices[0].finish_reason', 'stop') END AS finish_reason, CASE WHEN status = 'ok' THEN {_tokens_sql("prompt_tokens", None, 0)} END AS prompt_tokens FROM s"""
)
def strict_responses(spark, sf):
    found = _raw(spark, sf).select("event_id", responses.strict_response(F.col("raw")).alias("n"))
    contents = F.when(F.col("n.choices").isNotNull(), F.array_join(F.col("n.choices")["content"], "|"))
    return found.select("event_id", "n.status", "n.request_id", contents.alias("contents"), F.col("n.choices")[0]["finish_reason"].alias("finish_reason"), "n.prompt_tokens")


# Constraints

_LINE_RULES = [
    {"column": "l_quantity", "min": 2, "max": 49, "required": True},
    {"column": "l_returnflag", "one_of": ["A", "N"], "when": "l_quantity > 48"},
    {"column": "l_linestatus", "pattern": "O|X"},
    {"column": "l_returnflag", "name": "long_flag", "length": (2, 3), "when": "l_orderkey % 50 = 0"},
    {"name": "discount_and_tax", "holds": "l_discount + l_tax < 0.17"},
    {"column": "l_partkey", "name": "part_repeats", "unique": True, "by": ["l_orderkey"]},
    {"column": "l_suppkey", "name": "foreign_supplier", "in_table": ("suppliers", "s_suppkey")},
]


@query(
    """WITH v AS (SELECT 'l_quantity_min' AS rule, l_orderkey AS k FROM lineitem WHERE l_quantity < 2 UNION ALL SELECT 'l_quantity_max', l_orderkey FROM lineitem WHERE l_quantity > 49
    UNION ALL SELECT 'l_quantity_required', l_orderkey FROM lineitem WHERE l_quantity IS NULL UNION ALL SELECT 'l_returnflag_one_of', l_orderkey FROM lineitem WHERE l_quantity > 48 AND l_returnflag NOT IN ('A', 'N')
    UNION ALL SELECT 'l_linestatus_pattern', l_orderkey FROM lineitem WHERE NOT regexp_full_match(l_linestatus, 'O|X') UNION ALL SELECT 'long_flag', l_orderkey FROM lineitem WHERE l_orderkey % 50 = 0 AND length(l_returnflag) NOT BETWEEN 2 AND 3
    UNION ALL SELECT 'discount_and_tax', l_orderkey FROM lineitem WHERE NOT l_discount + l_tax < 0.17 UNION ALL SELECT 'part_repeats', l_orderkey FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem) WHERE n > 1
    UNION ALL SELECT 'foreign_supplier', l_orderkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20))
    SELECT rule, count(*) AS n, min(k) AS first_order, sum(k)::BIGINT AS orders FROM v GROUP BY rule"""
)
def line_constraints(spark, sf):
    found = constraints.violations(table(spark, sf, "lineitem"), _LINE_RULES, ["l_orderkey"], {"suppliers": table(spark, sf, "supplier").filter("s_nationkey < 20")})
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"), F.sum("l_orderkey").alias("orders"))


_CAMPAIGN_SQL = f"""base AS (SELECT h.trial, h.route, h.threshold, h.threshold::DOUBLE AS th, h.reached_step AS r0, w.n, w.f, CASE WHEN h.reached_step IS NOT NULL THEN 'success' WHEN f <= 10 THEN 'functional_failure' WHEN n >= 10 THEN 'hop_limit' ELSE 'incomplete' END AS c0 FROM hop_reach h JOIN w USING (trial)),
rec AS (SELECT trial, threshold, th, n, f, CASE WHEN trial % 19 = 3 THEN 'strange' ELSE c0 END AS category, (c0 = 'success') <> (trial % 17 = 2) AS success, CASE WHEN c0 = 'success' AND trial % 13 = 1 THEN r0 + 2 ELSE r0 END AS reached, trial % 23 = 4 AS old, trial % 29 = 5 AS other, trial % 31 = 6 AS longer, trial % 37 = 7 AS distance FROM base),
good AS (SELECT *, NOT old AND category = 'success' AND reached IN (2, 4, 6, 8, 10) AS asked FROM rec),
founded AS (SELECT *, asked AND reached <= n AND (f IS NULL OR f > reached) AS firm FROM good),
sim AS (SELECT g.trial, g.threshold, s.similarity AS at_reach FROM founded g JOIN steps s ON s.trial = g.trial AND s.step = g.reached WHERE firm),
early AS (SELECT DISTINCT g.trial, g.threshold FROM founded g JOIN steps s ON s.trial = g.trial AND s.step < g.reached AND s.step % 2 = 0 AND s.similarity >= g.th WHERE asked),
v AS (SELECT 'protocol' AS rule, trial FROM rec WHERE old UNION ALL SELECT 'contract_hash', trial FROM rec WHERE other UNION ALL SELECT 'step_numbering', trial FROM rec WHERE NOT old AND (longer OR n > 12) UNION ALL SELECT 'foreign_distance', trial FROM rec WHERE distance
UNION ALL SELECT 'known_category', trial FROM rec WHERE category = 'strange' UNION ALL SELECT 'success_flag', trial FROM rec WHERE success <> (category = 'success') UNION ALL SELECT 'reached_range', trial FROM rec WHERE category = 'success' AND reached NOT IN (2, 4, 6, 8, 10)
UNION ALL SELECT 'unfounded_reach', trial FROM founded WHERE asked AND NOT firm UNION ALL SELECT 'similarity_at_reach', g.trial FROM founded g JOIN sim USING (trial, threshold) WHERE firm AND NOT coalesce(at_reach >= th, false) UNION ALL SELECT 'earlier_reach', trial FROM early
UNION ALL SELECT 'reach_without_success', trial FROM rec WHERE category <> 'success' AND reached IS NOT NULL UNION ALL SELECT 'repeated_slot', trial FROM rec WHERE trial % 43 = 9 UNION ALL SELECT 'unplanned_slot', trial FROM rec WHERE trial % 41 = 8 UNION ALL SELECT 'unplanned_slot', trial FROM rec WHERE trial % 41 = 8 AND trial % 43 = 9
UNION ALL SELECT 'mixed_phase', NULL FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM rec WHERE trial % 47 = 10)),
doubled AS (SELECT rule, trial FROM v UNION ALL SELECT rule, trial FROM v WHERE trial % 43 = 9 AND rule NOT IN ('repeated_slot', 'unplanned_slot'))"""


@query(f"WITH {STEPS_SQL}, {_OK}, {_HOPS}, {_CAMPAIGN_SQL} SELECT rule, count(*) AS n, sum(trial)::BIGINT AS trials FROM doubled GROUP BY rule")
def campaign_violations(spark, sf):
    """Outcomes of the hop fold with planted faults, against the rules of a campaign."""
    steps = F.transform("steps", lambda s: F.struct(s["step"].alias("step"), s["status"].alias("evaluation_status"), F.when(s["restored"], s["similarity"]).alias("sym_adj")))
    # Outcomes and steps of a chain are written in one row, so no rule has to join them again.
    told = written(folds.hops_protocol(THRESHOLDS, 0.80).fold(folds.collected(step_view(spark, sf)), "steps").select("trial", "problem", "route", "outcomes", steps.alias("steps")), "outcomes")
    rows = told.select("trial", "problem", "route", F.explode("outcomes").alias("o"), "steps").select("trial", "problem", "route", "o.*", "steps")
    hit = F.col("category") == "success"
    rows = rows.select(
        "problem", "route", F.col("trial").alias("attempt"), F.col("threshold").cast("double").alias("threshold"), F.expr("if(trial % 19 = 3, 'strange', category)").alias("category"), (hit != (F.col("trial") % 17 == 2)).alias("success"),
        F.when(hit & (F.col("trial") % 13 == 1), F.col("reached_step") + 2).otherwise(F.col("reached_step")).alias("reached_step"), F.expr("if(trial % 37 = 7, 3, null)").alias("d_n"), F.lit("hops").alias("protocol"),
        F.expr("if(trial % 23 = 4, 'old', 'observation')").alias("schema_version"), F.expr("if(trial % 29 = 5, 'other', 'c')").alias("contract_hash"), F.lit("c").alias("contract"), F.expr("trial % 23 <> 4").alias("strict"),
        F.expr("size(steps) + if(trial % 31 = 6, 1, 0)").alias("translation_steps"), "steps", F.expr("if(trial % 47 = 10, 'pilot', 'main')").alias("phase"),
    )
    records = rows.unionByName(rows.filter("attempt % 43 = 9"))
    found = constraints.campaign_violations(records, rows.filter("attempt % 41 <> 8").select("problem", "route", "attempt"), "hops", "observation")
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.sum("attempt").alias("trials"))


# Schedules


def _walk_sql(source: str, key: str) -> str:
    """``walk``: (item, x) with x the place of each item of ``source`` (item, idx) in the keyed order."""
    draw = lambda i, v, size: f"('0x' || substr(sha256('{key}:{i}:' || {v}), 1, 12))::BIGINT % {size}"
    rounds, l, r = [], "l0", "r0"
    for i in range(6):
        if i % 2 == 0:
            rounds.append(f"LATERAL (SELECT ({l} + {draw(i, r, 'a')}) % a AS l{i + 1})")
            l = f"l{i + 1}"
        else:
            rounds.append(f"LATERAL (SELECT ({r} + {draw(i, l, 'b')}) % b AS r{i + 1})")
            r = f"r{i + 1}"
    made = f"LATERAL (SELECT x // b AS l0, x % b AS r0), {', '.join(rounds)}"
    return f"""size_ AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM {source})),
    walk AS (SELECT item, idx AS x, 0 AS k FROM {source} UNION ALL SELECT item, {l} * b + {r}, k + 1 FROM walk, size_, {made} WHERE k = 0 OR x >= n),
    placed AS (SELECT item, x AS position FROM walk, size_ WHERE k > 0 AND x < n)"""


@query(f"WITH RECURSIVE src AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part), {_walk_sql('src', 'plan')} SELECT item AS p_partkey, position, position % 3 = 1 AS second_shard FROM placed")
def keyed_order(spark, sf):
    placed = schedules.shuffled(table(spark, sf, "part").select("p_partkey"), "plan", "p_partkey")
    return placed.select("p_partkey", "position", (F.col("position") % 3 == 1).alias("second_shard"))


_TARGETS = ["c", "java", "python", "cpp"]


@query(
    f"""WITH RECURSIVE src AS (SELECT s_suppkey AS item, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier), {_walk_sql('src', 'rotation')}
    SELECT item AS problem, repeat, slot, [{", ".join(f"'{t}'" for t in _TARGETS)}][(position + repeat - 1 + slot) % 4 + 1] AS target FROM placed, (SELECT unnest(range(1, 5)) AS repeat), (SELECT unnest(range(0, 4)) AS slot)"""
)
def balanced_rotation(spark, sf):
    problems = schedules.shuffled(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("problem")), "rotation", "problem")
    return schedules.rotated(problems, _TARGETS, 4)


# Diagnostics

_CHECKED = "CASE WHEN cost IS NULL THEN 'not_evaluated' WHEN similarity > 0.8 THEN 'failed' ELSE 'passed' END AS compile_status, CASE WHEN cost IS NULL THEN '' WHEN functional THEN 'passed' ELSE 'failed' END AS functionality_status, CASE WHEN cost IS NOT NULL THEN functional END AS functionality_passed, CASE WHEN cost IS NOT NULL AND trial % 3 = 0 THEN status END AS execution_status"


def _checked(spark, sf):
    names = ("compile_status", "functionality_status", "functionality_passed", "execution_status")
    cost, ok = F.col("cost").isNotNull(), F.col("functional")
    columns = (F.when(~cost, "not_evaluated").when(F.col("similarity") > 0.8, "failed").otherwise("passed"), F.when(~cost, "").when(ok, "passed").otherwise("failed"), F.when(cost, ok), F.when(cost & (F.col("trial") % 3 == 0), F.col("status")))
    return step_view(spark, sf).withColumns(dict(zip(names, columns)))


@query(
    f"""WITH {STEPS_SQL}, c AS (SELECT trial, step, status, {_CHECKED} FROM steps),
    m AS (SELECT *, compile_status <> 'not_evaluated' OR functionality_status NOT IN ('', 'not_evaluated') AS tested, coalesce(NOT functionality_passed, false) AND functionality_status = 'failed' AS bad, max(step) OVER (PARTITION BY trial) AS n FROM c),
    g AS (SELECT trial, bool_or(tested) AS any_, coalesce(bool_or(functionality_passed) FILTER (step = n), false) AS passed, coalesce(bool_or(bad) FILTER (step < n), false) AS before, bool_or(tested) FILTER (step = n) AS last_tested,
      max(coalesce(nullif(execution_status, ''), CASE WHEN compile_status = 'failed' THEN 'compile_failed' END, nullif(functionality_status, ''), status)) FILTER (step = n) AS told FROM m GROUP BY trial)
    SELECT trial, CASE WHEN NOT any_ THEN 'not_evaluated' WHEN passed AND before THEN 'degraded' WHEN passed THEN 'pass' ELSE 'fail' END AS status, any_ AND passed AS final_passed, any_ AND before AS degraded,
    CASE WHEN NOT any_ THEN 'no_evaluation_results' WHEN passed AND before THEN 'route_degraded' WHEN NOT passed THEN CASE WHEN last_tested THEN told ELSE 'route_incomplete' END END AS reason FROM g"""
)
def semantic_preservation(spark, sf):
    return diagnostics.semantic_preservation(_checked(spark, sf))


@query(
    f"""WITH {STEPS_SQL}, c AS (SELECT route, {_CHECKED} FROM steps), t AS (SELECT route, 'compile' AS "check", compile_status AS status, 1 AS n FROM c UNION ALL SELECT route, 'functionality', functionality_status, 1 FROM c
    UNION ALL SELECT route, "check", status, 0 FROM (SELECT DISTINCT route FROM c), (VALUES ('compile', 'passed'), ('compile', 'failed'), ('compile', 'skipped'), ('compile', 'not_evaluated'), ('functionality', 'passed'), ('functionality', 'failed'), ('functionality', 'not_run'), ('functionality', 'not_evaluated')) v("check", status))
    SELECT route, "check", status, sum(n)::BIGINT AS n FROM t WHERE status <> '' GROUP BY ALL"""
)
def check_counts(spark, sf):
    return diagnostics.check_counts(_checked(spark, sf), "route")


@query(
    f"""WITH {STEPS_SQL}, l AS (SELECT route, status, language, step FROM steps QUALIFY step = max(step) OVER (PARTITION BY trial))
    SELECT route, CASE WHEN language <> 'cpp' THEN 'intermediate' ELSE 'restored' END || '@' || CASE WHEN step = 1 THEN '1' WHEN step = 2 THEN '2' ELSE '3+' END AS position, count(*) AS n FROM l WHERE status <> 'success' GROUP BY ALL"""
)
def stop_positions(spark, sf):
    steps = step_view(spark, sf).select("trial", "route", F.struct("status", "language", "step").alias("at"), "step")
    last = steps.groupBy("trial").agg(F.first("route").alias("route"), F.max_by("at", "step").alias("at")).select("route", "at.*")
    return diagnostics.stop_positions(last.filter("status <> 'success'"))


@query(
    f"""WITH {STEPS_SQL}, m AS (SELECT trial, route, step, CASE WHEN restored AND functional THEN similarity END AS x FROM steps), c AS (SELECT trial, route, arg_min(x, step) FILTER (x IS NOT NULL) AS first, max(x) AS most FROM m GROUP BY ALL),
    a AS (SELECT route, count(x) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(count(*) FILTER (x = 0) / count(x), 6) AS share_zero, round(count(*) FILTER (x >= 0.85) / count(x), 6) AS share_high FROM m WHERE x IS NOT NULL GROUP BY route)
    SELECT a.*, chains, first_median, most_median FROM a JOIN (SELECT route, count(first) AS chains, round(quantile_cont(first, 0.5), 6) AS first_median, round(quantile_cont(most, 0.5), 6) AS most_median FROM c GROUP BY route) USING (route)"""
)
def similarity_profile(spark, sf):
    return diagnostics.similarity_profile(step_view(spark, sf).withColumn("similarity", F.when(F.col("restored") & F.col("functional"), F.col("similarity"))))


@query(f"WITH {STEPS_SQL} SELECT route, CASE WHEN language <> 'cpp' THEN 'cpp->' || language ELSE route || '->cpp' END AS direction, count(*) FILTER (status = 'success') AS passed, count(*) AS steps, round(count(*) FILTER (status = 'success') / count(*), 6) AS rate FROM steps GROUP BY ALL")
def direction_rates(spark, sf):
    return diagnostics.direction_rates(step_view(spark, sf).withColumn("target", F.col("route")))


@query(
    f"""WITH {STEPS_SQL}, it AS (SELECT trial, 0 AS iteration, min(seed_state) AS hash, NULL AS failure FROM steps GROUP BY trial UNION ALL SELECT trial, step // 2, CASE WHEN functional THEN state END, CASE WHEN NOT functional THEN status END FROM steps WHERE restored),
    k AS (SELECT *, CASE WHEN failure IS NOT NULL THEN NULL WHEN hash = lag(hash) OVER w THEN 'fixed_point' WHEN hash = lag(hash, 2) OVER w AND lag(hash) OVER w = lag(hash, 3) OVER w THEN 'oscillation' ELSE 'continue' END AS convergence FROM it WINDOW w AS (PARTITION BY trial ORDER BY iteration)),
    o AS (SELECT *, coalesce(bool_or(iteration > 0 AND (failure IS NOT NULL OR convergence <> 'continue')) OVER (PARTITION BY trial ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM k)
    SELECT trial, iteration, convergence, CASE WHEN failure IS NOT NULL THEN failure WHEN convergence = 'oscillation' THEN 'oscillation' WHEN convergence = 'continue' AND iteration = 4 THEN 'max_iter_no_convergence' ELSE 'success' END AS status FROM o WHERE NOT over_ AND iteration > 0"""
)
def iteration_convergence(spark, sf):
    steps = step_view(spark, sf)
    seeds = steps.groupBy("trial").agg(F.lit(0).cast("bigint").alias("iteration"), F.min("seed_state").alias("hash"), F.lit(None).cast("string").alias("failure"))
    ok = F.col("functional")
    rows = steps.filter("restored").select("trial", F.floor(F.col("step") / 2).alias("iteration"), F.when(ok, F.col("state")).alias("hash"), F.when(~ok, F.col("status")).alias("failure"))
    return diagnostics.convergence(seeds.unionByName(rows), 4)


@query(
    """WITH w AS (SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS x FROM documents)),
    c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w WHERE length(word) >= 2 GROUP BY ALL)
    SELECT doc_id, word, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1"""
)
def top_words(spark, sf):
    return diagnostics.top_word(table(spark, sf, "documents"), "doc_id", "text")


@query(
    """SELECT o_orderkey, concat_ws('/', 'c', o_orderstatus, o_custkey::VARCHAR, 'cpp-via-' || lower(o_orderpriority), (o_custkey % 5)::VARCHAR, (o_orderkey % 12)::VARCHAR) AS call_id, 'cpp' AS seed, lower(o_orderpriority) AS target FROM orders"""
)
def call_names(spark, sf):
    name = labels.route_name(F.lit("cpp"), F.lower("o_orderpriority"))
    rows = table(spark, sf, "orders").select("o_orderkey", labels.call_id(F.lit("c"), F.col("o_orderstatus"), F.col("o_custkey"), name, F.col("o_custkey") % 5, F.col("o_orderkey") % 12).alias("call_id"), labels.route_pair(name).alias("p"))
    return rows.select("o_orderkey", "call_id", "p.seed", "p.target")


# Gates


@query(
    r"""WITH c AS (SELECT conv_id AS problem, role = 'assistant' AS held, text, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda t: t <> ''), ' ') AS key FROM conversations),
    s AS (SELECT problem, coalesce(key, '') AS key, count(*) FILTER (held) AS held, count(*) FILTER (NOT held) AS shown, count(*) FILTER (text IS NULL) AS lacking FROM c GROUP BY ALL),
    p AS (SELECT problem, sum(held) AS e, sum(greatest(held - 1, 0)) AS r, count(*) FILTER (held > 0 AND shown > 0) AS u, sum(lacking) AS m FROM s GROUP BY problem)
    SELECT problem, 'evaluation_count' AS fault, e::BIGINT AS n FROM p WHERE e <> 2 UNION ALL SELECT problem, 'repeated_input', r::BIGINT FROM p WHERE r > 0 UNION ALL SELECT problem, 'public_input', u FROM p WHERE u > 0 UNION ALL SELECT problem, 'missing_side', m::BIGINT FROM p WHERE m > 0"""
)
def corpus_faults(spark, sf):
    """Conversations as problems: answers are evaluation inputs, of which each should have two, other turns examples."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("problem"), F.when(F.col("role") == "assistant", "evaluation").otherwise("prompt_examples").alias("role"), F.col("text").alias("input"), F.col("text").alias("expected"))
    return gates.corpus_faults(rows, 2)


@query(
    f"""WITH {OUTCOMES_SQL}, c AS (SELECT route, count(*) FILTER (category = 'success') AS hits, count(*) FILTER (category IN ('success', 'functional_failure', 'hop_limit')) AS valid, count(*) AS planned, sum(reached_step) FILTER (category = 'success') AS hops FROM outcomes GROUP BY route),
    f AS (SELECT *, hits / valid AS p, hops / hits AS h FROM c)
    SELECT route, 'valid' AS field, valid + 1.0::DOUBLE AS reported, valid::DOUBLE AS recomputed FROM f WHERE route LIKE '1%' UNION ALL SELECT route, 'D', round(h / p, 2) + 0.01, h / p FROM f WHERE route LIKE '2%'"""
)
def reported_differences(spark, sf):
    """Reported metrics of the routes, one with a wrong denominator, one with a wrong distance."""
    seen = outcome_view(spark, sf)
    hit = F.col("category") == "success"
    sums = seen.groupBy("route").agg(F.count_if(hit).alias("hits"), F.count("*").alias("valid"), F.count("*").alias("planned"), F.sum(F.when(hit, F.col("reached_step"))).alias("hops"))
    p, h = F.col("hits") / F.col("valid"), F.col("hops") / F.col("hits")
    told = sums.select("route", "hits", F.expr("valid + if(route like '1%', 1, 0)").alias("valid"), "planned", p.alias("P"), h.alias("H"), F.when(F.col("route").like("2%"), F.round(h / p, 2) + 0.01).otherwise(h / p).alias("D"))
    return gates.reported_differences(told, seen)


@query(
    """WITH r AS (SELECT event_type, 1 + user_id % 3 AS attempts, CASE WHEN k % 5 > 0 THEN value END AS cost, CASE k % 3 WHEN 0 THEN 'reported' WHEN 1 THEN 'estimated' ELSE 'provider_estimated' END AS source, CASE WHEN k % 7 > 0 THEN k END AS prompt, user_id AS completion FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))
    SELECT event_type, count(*) AS logical_requests, sum(attempts)::BIGINT AS transport_attempts, count(*) FILTER (cost IS NULL) AS unknown_cost_requests, round(coalesce(sum(cost) FILTER (source <> 'reported'), 0), 6) AS estimated_cost_usd, round(sum(cost) FILTER (source = 'reported'), 6) AS reported_cost_usd,
    sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens FROM r GROUP BY event_type"""
)
def ledger_split(spark, sf):
    k = F.col("k")
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    source = F.when(k % 3 == 0, "reported").when(k % 3 == 1, "estimated").otherwise("provider_estimated")
    rows = rows.select("event_type", (1 + F.col("user_id") % 3).alias("attempts"), F.when(k % 5 > 0, F.col("value")).alias("cost_usd"), source.alias("cost_source"), F.when(k % 7 > 0, k).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return gates.ledger_split(rows, "event_type")


@query(
    f"""WITH {OUTCOMES_SQL}, s AS (SELECT route, category, CASE WHEN attempt % 4 > 0 THEN price END AS x, CASE WHEN attempt % 3 > 0 THEN 'timeout' END AS reason FROM outcomes)
    SELECT route, coalesce(reason, 'not_processed') AS reason, count(*) AS n FROM s WHERE category = 'success' AND x IS NULL GROUP BY ALL"""
)
def exclusions_by_reason(spark, sf):
    rows = outcome_view(spark, sf).withColumns({"x": F.when(F.col("attempt") % 4 > 0, F.col("price")), "why": F.when(F.col("attempt") % 3 > 0, "timeout")})
    return gates.exclusions(rows, "x", "why", "route")


@query(
    f"""WITH {STEPS_SQL}, r AS (SELECT route, step, count(*) FILTER (functional) AS passed, count(*) AS steps FROM steps WHERE step <= 2 GROUP BY ALL)
    SELECT a.route, a.passed AS passed_1, a.steps AS steps_1, b.passed AS passed_2, b.steps AS steps_2 FROM r a JOIN r b ON a.route = b.route AND a.step = 1 AND b.step = 2"""
)
def first_round_trip(spark, sf):
    """The first step and the second, side by side."""
    rows = step_view(spark, sf).filter("step <= 2").groupBy("route", F.col("step").cast("string").alias("step")).agg(F.count_if("functional").alias("passed"), F.count("*").alias("steps"))
    return gates.side_by_side(rows, "route", "step", ["1", "2"], ["passed", "steps"])


@query(
    f"""WITH {OUTCOMES_SQL}, s AS (SELECT 'all' AS subset, * FROM outcomes UNION ALL SELECT 'without_pilot', * FROM outcomes WHERE attempt % 10 <> 0 UNION ALL SELECT 'first_problems', * FROM outcomes WHERE problem < 3)
    SELECT subset, route, count(*) AS n, count(*) FILTER (category = 'success') AS hits FROM s GROUP BY ALL"""
)
def sensitivity_subsets(spark, sf):
    rows = gates.subsets(outcome_view(spark, sf), {"all": "true", "without_pilot": "attempt % 10 <> 0", "first_problems": "problem < 3"})
    return rows.groupBy("subset", "route").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "success").alias("hits"))


# Records in their nested form


@query(
    f"""WITH {STEPS_SQL}, {_OK}, {_HOPS} SELECT h.route, h.threshold, CASE WHEN h.reached_step IS NOT NULL THEN 'success' WHEN f <= 10 THEN 'functional_failure' WHEN n >= 10 THEN 'hop_limit' ELSE 'incomplete' END AS category, count(*) AS n, sum(h.reached_step)::BIGINT AS hops
    FROM hop_reach h JOIN w USING (trial) GROUP BY ALL"""
)
def outcomes_of_records(spark, sf):
    """Outcomes by threshold in a map, as records have them, and back in rows."""
    folded = folds.hops(folds.collected(step_view(spark, sf), 12), THRESHOLDS, 0.80)
    one = lambda o: F.struct(o["threshold"].alias("key"), F.struct((o["category"] == "success").alias("success"), F.when(o["category"] != "incomplete", o["category"]).alias("category"), o["reached_step"].alias("reached_step"), F.lit(None).cast("int").alias("d_n"), F.lit(None).cast("double").alias("sym_adj"), F.lit(None).cast("string").alias("reason")).alias("value"))
    records = folded.select(F.col("problem").cast("string").alias("problem_id"), "route", F.col("trial").alias("attempt"), F.lit(None).cast("bigint").alias("repeat"), F.map_from_entries(F.transform("outcomes", one)).alias("outcomes"))
    rows = outcome_rows(records)
    return rows.groupBy("route", "threshold", "category").agg(F.count("*").alias("n"), F.sum("reached_step").alias("hops"))


@query(
    """WITH f AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
    SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2"""
)
def first_distinct_statuses(spark, sf):
    return chains.first_distinct(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey"], "o_orderstatus", "o_orderkey", 2)


@query(
    """SELECT l_suppkey AS fault, coalesce(bool_or(l_returnflag <> 'N') FILTER (l_linestatus = 'O'), false) AS detected_before, coalesce(bool_or(l_returnflag <> 'N') FILTER (l_linestatus <> 'O'), false) AS detected_after FROM lineitem GROUP BY 1"""
)
def mutant_panel(spark, sf):
    suite = F.when(F.col("l_linestatus") == "O", "before").otherwise("after")
    return audits.mutant_panel(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("fault"), suite.alias("suite"), F.col("l_returnflag").alias("actual"), F.lit("N").alias("expected")))


_FPS_OUTCOMES = "s AS (SELECT problem, route, CASE WHEN attempt % 6 = 0 AND category <> 'success' THEN 'invalid' ELSE category END AS category, reached_step AS d_n, attempt % 3 AS duplicate_steps, attempt % 12 AS translation_steps, CASE WHEN attempt % 4 > 0 AND route NOT LIKE '3%' THEN price END AS cost_usd FROM outcomes)"


@query(
    f"""WITH {OUTCOMES_SQL}, {_FPS_OUTCOMES}, c AS (SELECT route, problem, count(*) AS recorded, count(*) FILTER (category <> 'invalid') AS valid, count(*) FILTER (category = 'success') AS hits, count(*) FILTER (category = 'invalid') AS invalid, sum(duplicate_steps) AS dup, sum(translation_steps) AS tr, sum(cost_usd) AS cost FROM s GROUP BY ALL),
    r AS (SELECT route, sum(recorded)::BIGINT AS recorded, sum(valid)::BIGINT AS valid, sum(hits)::BIGINT AS hits, sum(invalid)::BIGINT AS invalid, round(avg(hits / nullif(valid, 0)), 6) AS p_sf, count(nullif(valid, 0)) AS p_sf_problems, count(*) FILTER (hits > 0) AS d_n_problems, sum(dup)::BIGINT AS duplicate_steps, sum(tr)::BIGINT AS translation_steps, round(sum(cost), 4) AS cost_usd FROM c GROUP BY route)
    SELECT route, 100000::BIGINT AS planned, recorded, 100000 - recorded AS incomplete, valid, hits AS success, invalid, p_sf, p_sf_problems, round(hits / valid, 6) AS p_sf_pooled, round(greatest(0.0, {_W} - {_WH}), 6) AS wilson_low, round(least(1.0, {_W} + {_WH}), 6) AS wilson_high, d_n_problems, duplicate_steps, translation_steps, cost_usd FROM r"""
)
def fps_route_totals(spark, sf):
    """Outcomes of orders as those of the state-distance protocol."""
    seen = outcome_view(spark, sf)
    invalid = (F.col("attempt") % 6 == 0) & (F.col("category") != "success")
    rows = seen.select("problem", "route", F.when(invalid, "invalid").otherwise(F.col("category")).alias("category"), F.col("reached_step").alias("d_n"), (F.col("attempt") % 3).alias("duplicate_steps"), (F.col("attempt") % 12).alias("translation_steps"), F.when((F.col("attempt") % 4 > 0) & ~F.col("route").like("3%"), F.col("price")).alias("cost_usd"))
    return outcomes.fps_totals(rows, 100_000)


@query(
    """WITH a AS (SELECT o_custkey AS pair, count(*) AS n, max(o_orderkey) AS raw FROM orders WHERE o_orderkey % 7 > 0 GROUP BY 1), b AS (SELECT o_custkey AS pair, count(*) AS n, max(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 ELSE o_orderkey END) AS measured FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1),
    j AS (SELECT pair, CASE WHEN a.n IS NULL THEN 'no_raw_output' WHEN b.n IS NULL THEN 'not_recorded' WHEN a.n > 1 OR b.n > 1 THEN 'repeated' WHEN raw <> measured THEN 'other_value' END AS fault, raw, measured FROM a FULL JOIN b USING (pair))
    SELECT * FROM j WHERE fault IS NOT NULL"""
)
def measurement_faults(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("pair"), F.col("o_orderkey").alias("value"))
    recorded = orders.filter("value % 5 > 0").withColumn("value", F.expr("if(value % 11 = 0, value + 1, value)"))
    return gates.measurement_faults(orders.filter("value % 7 > 0"), recorded, ["pair"])


@query("SELECT 'spend' AS figure, o_orderpriority AS series, o_orderstatus AS x, avg(o_totalprice) AS y, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL")
def figure_inputs(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("y"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return evidence.figure_inputs(rows, "spend", "o_orderpriority", "o_orderstatus", "y", "low", "high")


@query(
    f"""WITH {STEPS_SQL}, {_OK}, {_HOPS}, a AS (SELECT trial, count(reached_step) = {len(THRESHOLDS)} AS whole FROM hop_reach GROUP BY trial),
    e AS (SELECT t.trial, t.confirmation, f IS NOT NULL OR (t.confirmation IS NOT NULL AND (whole OR n >= 10)) OR (n >= 10 AND due IS NULL) AS ended FROM told t JOIN a ON a.trial = t.trial)
    SELECT trial, CASE WHEN trial % 13 = 0 THEN 'not_recorded' WHEN NOT ended THEN 'saved_history_exhausted' END AS reason, trial % 13 <> 0 AND NOT (trial % 11 = 0 AND confirmation IS DISTINCT FROM 'passed') AS matches FROM e"""
)
def replayed_decisions(spark, sf):
    """Recorded confirmations, some changed and some lost, against decisions from the saved steps."""
    protocol, steps = folds.hops_protocol(THRESHOLDS, 0.80), step_view(spark, sf).filter("step <= 12")
    chains = written(folds.collected(steps), "chains")
    recorded = protocol.fold(chains).select("trial", "confirmation").filter("trial % 13 <> 0")
    recorded = recorded.withColumn("confirmation", F.when(F.col("trial") % 11 == 0, "passed").otherwise(F.col("confirmation")))
    return replay.replayed_chains(recorded, chains, protocol, ["confirmation"]).select("trial", "reason", "matches")


@query("WITH n AS (SELECT n_nationkey AS nation, n_name AS name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 5, 'second') SELECT c_custkey, c_nationkey AS nation, CASE WHEN c_nationkey NOT IN (3, 5) THEN n_name END AS name, CASE c_nationkey WHEN 3 THEN 'none' WHEN 5 THEN 'several' ELSE 'one' END AS found FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def looked_up_nations(spark, sf):
    """A lookup table that lacks a key and has another twice."""
    entries = table(spark, sf, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    entries = entries.unionByName(entries.filter("nation = 5").withColumn("name", F.lit("second")))
    return gates.looked_up(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), entries, ["nation"])


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities FROM orders GROUP BY 1")
def distinct_priorities(spark, sf):
    found = diagnostics.distinct_values(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")
    return found.select("o_custkey", F.array_join("values", ",").alias("priorities"))


_FENCED = "CASE doc_id % 4 WHEN 0 THEN concat('Here:\n```cpp\n', text, '\n```\ndone') WHEN 1 THEN concat('```\n', lang, '\n```\nor\n```\n', lang, '\n```\n') WHEN 2 THEN concat(text, '\n') ELSE '```cpp\n \n```' END"


@query(
    rf"""WITH r AS (SELECT doc_id, {_FENCED} AS response FROM documents), b AS (SELECT doc_id, response, regexp_extract_all(response, '(?s)```[^\n]*\n(.*?)```', 1) AS blocks FROM r),
    c AS (SELECT doc_id, len(blocks) AS n, regexp_replace(CASE WHEN len(blocks) = 1 THEN blocks[1] ELSE response END, '^\n+|\n+\z', '', 'g') AS body FROM b),
    s AS (SELECT doc_id, body, CASE WHEN n > 1 THEN 'multiple_blocks' WHEN regexp_replace(body, '\s', '', 'g') = '' THEN 'empty' ELSE 'ok' END AS status FROM c)
    SELECT doc_id, status, CASE WHEN status = 'ok' THEN sha256(body) END AS digest FROM s"""
)
def extracted_sources(spark, sf):
    """The source in each response; responses are documents in one fence, in two, in none, and an empty fence."""
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_FENCED.replace("\n", "\\n")).alias("response"))
    found = rows.select("doc_id", extracted_code(F.col("response")).alias("e"))
    return found.select("doc_id", "e.status", F.sha2("e.code", 256).alias("digest"))


@query(
    """SELECT conv_id, turn, sha256('Source language: cpp' || chr(10) || 'Target language: ' || role || chr(10) || 'Specification:' || chr(10) || text || chr(10) || 'Public examples:' || chr(10) || '[{"input": ' || to_json(text) || ', "output": ' || to_json(role) || '}, {"input": ' || to_json(role) || ', "output": ' || to_json(text) || '}]' || chr(10) || 'Source code:' || chr(10) || text) AS digest FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL"""
)
def example_prompts(spark, sf):
    """Prompts with two distinct examples of three."""
    rows = table(spark, sf, "conversations").filter("text is not null and role is not null")
    examples = F.array(*[F.struct(F.col(a).alias("input"), F.col(b).alias("output")) for a, b in (("text", "role"), ("text", "role"), ("role", "text"))])
    return rows.select("conv_id", "turn", F.sha2(labels.example_prompt(F.col("text"), examples, F.col("text"), F.lit("cpp"), F.col("role")), 256).alias("digest"))


@query(
    """WITH f AS (SELECT count(*) AS observed, count(DISTINCT o_orderstatus) AS kinds, sum(o_totalprice) AS cost, count(DISTINCT o_custkey) AS problems FROM orders)
    SELECT observed > 0 AND kinds = 3 AND cost <= 1 AND problems > 5 AS open, array_to_string(list_filter([CASE WHEN NOT observed > 0 THEN 'observed' END, CASE WHEN NOT kinds = 3 THEN 'kinds' END, CASE WHEN NOT cost <= 1 THEN 'budget' END, CASE WHEN NOT problems > 5 THEN 'problems' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f"""
)
def freeze_gate(spark, sf):
    facts = table(spark, sf, "orders").agg(F.count("*").alias("observed"), F.count_distinct("o_orderstatus").alias("kinds"), F.sum("o_totalprice").alias("cost"), F.count_distinct("o_custkey").alias("problems"))
    told = gates.gate(facts, {"observed": "observed > 0", "kinds": "kinds = 3", "budget": "cost <= 1", "problems": "problems > 5"})
    return told.select("open", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT count(DISTINCT l_suppkey) AS pilot_problems, sum(l_linenumber)::DOUBLE AS pilot_cost, round(sum(l_linenumber)::DOUBLE * 500 / count(DISTINCT l_suppkey), 6) AS projected, sum(l_linenumber)::DOUBLE * 500 / count(DISTINCT l_suppkey) <= 1000 AS within FROM lineitem")
def pilot_projection(spark, sf):
    pilot = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("problem"), F.col("l_linenumber").cast("double").alias("cost"))
    return diagnostics.pilot_projection(pilot, 500, 1000.0).withColumn("projected", F.round("projected", 6))


@query(
    """WITH m AS (SELECT event_type AS language, v AS variant, CASE WHEN v = 'identical' THEN CASE WHEN event_id % 50 > 0 THEN 1.0 ELSE 0.5 END WHEN v = 'short' THEN CASE WHEN event_id % 40 = 0 THEN 0.1 END ELSE CASE WHEN event_id % 9 > 0 THEN (k % 10) / 10.0 END END::DOUBLE AS value
      FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), (SELECT unnest(['identical', 'short', 'comment']) AS v)),
    g AS (SELECT variant, language, count(*) AS n, count(value) AS measured, count(*) - count(value) AS na, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max FROM m GROUP BY ALL)
    SELECT variant, language, n, measured, na, round(mean, 6) AS mean, round(median, 6) AS median, min, max, round(CASE WHEN bool_and(mean IS NOT NULL) OVER w THEN max(mean) OVER w - min(mean) OVER w END, 6) AS spread FROM g WINDOW w AS (PARTITION BY variant)"""
)
def analyzer_check(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("variant", F.explode(F.array(*map(F.lit, ("identical", "short", "comment")))))
    value = F.expr("case when variant = 'identical' then if(event_id % 50 > 0, 1.0d, 0.5d) when variant = 'short' then if(event_id % 40 = 0, 0.1d, null) else if(event_id % 9 > 0, cast(k % 10 as double) / 10, null) end")
    found = diagnostics.analyzer_check(rows.select("variant", F.col("event_type").alias("language"), value.alias("value")))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "median", "spread")})
