"""A small language of constraints, compiled to column expressions that one pass over a table evaluates.

A rule set is a list of dicts, each for one column (``column``) or a condition (``holds``, SQL):

=============  ==========================================================
required       the value is not null (without it, a null value is right)
type           the text can be read as this SQL type
min, max       bounds, both allowed
length         (least, most) characters of text, entries of an array
pattern        a pattern that the whole text matches
one_of         the values that are allowed
each           a dict of these keys for every entry of an array
distinct       the entries of an array differ
ascending      the entries of an array rise strictly
holds          an SQL condition on the row
when           an SQL condition; other rows are not asked
unique         no other row has the value (with ``by``: of the same group)
in_table       (table, column): the value occurs there
=============  ==========================================================

``name`` names the rule; else the column and the key do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that need other rows, and keys that say whom a rule asks.
_ACROSS, _ABOUT = ("unique", "in_table"), ("column", "when", "name", "by", "each")


def _tests(value: Column, rule: dict) -> dict[str, Column]:
    """What must be true of ``value``, by key."""
    made = {
        "required": lambda on: value.isNotNull() if on else F.lit(True),
        "type": lambda kind: value.try_cast(kind).isNotNull(),
        "min": lambda bound: value >= bound,
        "max": lambda bound: value <= bound,
        "pattern": lambda pattern: value.rlike(rf"\A(?:{pattern})\z"),
        "one_of": lambda values: value.isin(*values),
        "distinct": lambda on: (F.size(F.array_distinct(value)) == F.size(value)) == on,
        "ascending": lambda on: F.forall(F.zip_with(F.slice(value, F.lit(1), F.greatest(F.size(value) - 1, F.lit(0))), F.slice(value, F.lit(2), F.greatest(F.size(value) - 1, F.lit(0))), lambda a, b: a < b), lambda x: x) == on,
        "holds": F.expr,
    }
    out = {key: made[key](told) for key, told in rule.items() if key in made}
    unknown = set(rule) - set(made) - set(_ABOUT) - set(_ACROSS) - {"length"}
    if unknown:
        raise ValueError(f"unknown keys of a constraint: {sorted(unknown)}")
    return out


def _length(value: Column, kind: str, bounds: tuple[int, int]) -> Column:
    size = F.size(value) if kind.startswith("array") else F.length(value)
    return size.between(*bounds)


def _entry_test(rule: dict, key: str):
    return lambda x: F.coalesce(_tests(x, rule)[key], F.lit(key != "required"))


def compiled(rules: list[dict], df: DataFrame) -> dict[str, Column]:
    """rule -> condition that a row breaks, for the rules that a row alone can break."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out: dict[str, Column] = {}
    for rule in rules:
        column = rule.get("column")
        value = F.col(column) if column else F.lit(None)
        tests = _tests(value, rule)
        if "length" in rule:
            tests["length"] = _length(value, kinds[column], rule["length"])
        for inner in rule.get("each", ()):
            tests[f"each_{inner}"] = F.forall(value, _entry_test(rule["each"], inner))
        asked = F.expr(rule["when"]) if "when" in rule else F.lit(True)
        for key, test in tests.items():
            # A null value breaks ``required`` and ``holds`` only.
            right = F.coalesce(test, F.lit(key not in ("required", "holds")))
            name = rule.get("name") or f"{column}_{key}"
            if name in out:
                raise ValueError(f"two constraints are named {name}")
            out[name] = F.coalesce(asked, F.lit(False)) & ~right
    return out


def violations(df: DataFrame, rules: list[dict], keys: list[str], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, keys) of each rule that a row of ``df`` breaks.

    All rules on rows are one pass without a shuffle; each ``unique`` and ``in_table`` adds a grouping or a join by its value. Nulls are
    neither repeated nor missing from a table. A row that breaks several rules is told for each.
    """
    broken = compiled(rules, df)
    rows = [df.select(F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in broken.items()]), lambda r: r.isNotNull())).alias("rule"), *keys)] if broken else []
    for rule in rules:
        column, name = rule.get("column"), rule.get("name")
        asked = df.filter(rule.get("when", "true")).filter(F.col(column).isNotNull()) if any(k in rule for k in _ACROSS) else None
        if rule.get("unique"):
            of = [*rule.get("by", []), column]
            repeated = asked.groupBy(*of).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
            rows.append(asked.join(repeated, of, "left_semi").select(F.lit(name or f"{column}_unique").alias("rule"), *keys))
        if "in_table" in rule:
            table, other = rule["in_table"]
            known = tables[table].select(F.col(other).alias(column)).distinct()
            rows.append(asked.join(known, column, "left_anti").select(F.lit(name or f"{column}_in_table").alias("rule"), *keys))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def canonical_arguments(arguments: Column) -> Column:
    """sha256 of an argument list, to find cases that repeat: its JSON, without spaces."""
    return F.sha2(F.to_json(arguments), 256)


#: The hop protocol's rules on one observation and threshold; ``strict`` rows are records of its own schema, whose steps are evidence.
_CATEGORIES = ["success", "functional_failure", "hop_limit", "invalid", "incomplete"]
_REACHED = "category = 'success' and reached_step in (2, 4, 6, 8, 10)"
_RULES = [
    {"name": "contract_hash", "holds": "contract_hash <=> contract", "when": "contract is not null"},
    {"name": "step_numbering", "holds": "translation_steps <=> size(steps) and size(steps) <= 12 and forall(transform(steps, (s, i) -> s.step <=> i + 1), x -> x)", "when": "strict"},
    {"name": "foreign_distance", "holds": "d_n is null"},
    {"name": "category", "column": "category", "required": True},
    {"name": "known_category", "column": "category", "one_of": _CATEGORIES},
    {"name": "success_flag", "holds": "coalesce(success, false) = coalesce(category = 'success', false)"},
    {"name": "reached_range", "holds": "coalesce(reached_step, 0) in (2, 4, 6, 8, 10)", "when": "category = 'success'"},
    {"name": "unfounded_reach", "holds": "reached_step <= size(steps) and forall(slice(steps, 1, greatest(reached_step, 0)), s -> s.evaluation_status <=> 'success')", "when": f"strict and {_REACHED}"},
    {"name": "similarity_at_reach", "holds": "try_element_at(steps, greatest(reached_step, 1)).sym_adj >= threshold", "when": f"strict and {_REACHED} and reached_step <= size(steps) and forall(slice(steps, 1, greatest(reached_step, 0)), s -> s.evaluation_status <=> 'success')"},
    {"name": "earlier_reach", "holds": "not exists(slice(steps, 1, greatest(reached_step - 1, 0)), s -> coalesce(s.step, 1) % 2 = 0 and s.sym_adj is not null and s.sym_adj >= threshold)", "when": f"strict and {_REACHED}"},
    {"name": "reach_without_success", "holds": "reached_step is null", "when": "not coalesce(category = 'success', false)"},
]


def campaign_rules(protocol: str, schema: str) -> list[dict]:
    """The rules, for records of this protocol and schema; a record that tells neither is taken to be of them."""
    return [{"name": "protocol", "holds": f"coalesce(protocol, '{protocol}') = '{protocol}' and coalesce(schema_version, '{schema}') = '{schema}'"}, *_RULES]


#: Columns in which all observations of a campaign agree.
ONE_VALUE = ("profile_id", "campaign_id", "phase", "provider", "model")


def campaign_violations(records: DataFrame, slots: DataFrame, protocol: str, schema: str) -> DataFrame:
    """(rule, problem, route, attempt, threshold): what a campaign's observations break.

    ``records``: one row for each slot and threshold: slot, threshold, category, success, reached_step, d_n, protocol, schema_version,
    contract_hash, contract (the campaign's), strict, translation_steps, steps, and such of ``ONE_VALUE`` as there are. ``slots``: what was planned.
    Slots recorded twice at a threshold, slots that weren't planned, and fields in which records differ are told too, the latter without a slot.
    """
    slot = ["problem", "route", "attempt"]
    keys = [*slot, "threshold"]
    found = violations(records, campaign_rules(protocol, schema), keys)
    twice = records.groupBy(*keys).count().filter("count > 1").select(F.lit("repeated_slot").alias("rule"), *keys)
    strange = records.join(slots.select(*slot).distinct(), slot, "left_anti").select(F.lit("unplanned_slot").alias("rule"), *keys)
    out = found.unionByName(twice).unionByName(strange)
    shared = [c for c in ONE_VALUE if c in records.columns]
    if shared:
        differing = records.agg(*[(F.min(c) != F.max(c)).alias(c) for c in shared])
        told = differing.select(F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(f"mixed_{c}")) for c in shared]), lambda r: r.isNotNull())).alias("rule"))
        kinds = {f.name: f.dataType for f in records.schema}
        out = out.unionByName(told.select("rule", *[F.lit(None).cast(kinds[k]).alias(k) for k in keys]))
    return out
