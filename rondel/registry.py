"""Registries of metrics, policies, aggregators and profiles: what a user plugs in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondel.functions import text
from rondel.operators import folds, outcomes, structure


@dataclass(frozen=True)
class Metric:
    """build(a, b) gives the value of two source columns; languages and scopes empty: all; requires: columns that must be there and filled."""

    name: str
    version: str
    unit: str
    build: Callable[[Column, Column], Column]
    languages: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    """decide(chains, config) gives an outcome of each chain; validate(config) raises on a wrong one."""

    name: str
    version: str
    decide: Callable[[DataFrame, dict], DataFrame]
    validate: Callable[[dict], None] = lambda config: None


@dataclass(frozen=True)
class Aggregator:
    name: str
    version: str
    compute: Callable[[DataFrame, dict], DataFrame]


@dataclass(frozen=True)
class Profile:
    """Settings by name; ``extends`` names the profile that they change."""

    name: str
    settings: dict = field(default_factory=dict)
    extends: str | None = None


METRICS: dict[str, Metric] = {}
POLICIES: dict[str, Policy] = {}
AGGREGATORS: dict[str, Aggregator] = {}
PROFILES: dict[str, Profile] = {}


def register(item) -> None:
    """Add to the registry of the item's kind; a name is given once."""
    target = {Metric: METRICS, Policy: POLICIES, Aggregator: AGGREGATORS, Profile: PROFILES}[type(item)]
    if item.name in target:
        raise ValueError(f"{item.name} is registered already")
    target[item.name] = item


def measured(pairs: DataFrame, names: list[str], language: str | None = None, scope: str | None = None) -> DataFrame:
    """Long table (pairs' columns, metric, status, value, reason) of the metrics of source columns a and b.

    A metric that isn't for the language or scope (``adjacent``, ``origin``, ...), that isn't registered, or whose sources or required columns are
    missing, gives a row that says so, never an error.
    """
    items = []
    for name in names:
        metric = METRICS.get(name)
        if metric is None:
            reason, value = F.lit("unknown_metric"), F.lit(None).cast("double")
        else:
            lacking = F.lit(False)
            for column in metric.requires:
                lacking = lacking | (F.col(column).isNull() if column in pairs.columns else F.lit(True))
            wrong = bool(metric.languages) and language not in metric.languages
            elsewhere = bool(metric.scopes) and scope is not None and scope not in metric.scopes
            reason = F.when(F.lit(wrong), "unsupported_language").when(F.lit(elsewhere), "unsupported_scope").when(F.col("a").isNull() | F.col("b").isNull(), "missing_source").when(lacking, "missing_requirement")
            value = F.when(reason.isNull(), metric.build(F.col("a"), F.col("b")).cast("double"))
        items.append(F.struct(F.lit(name).alias("metric"), F.when(reason.isNull() & value.isNotNull(), "measured").otherwise("unavailable").alias("status"), value.alias("value"), reason.alias("reason")))
    return pairs.select("*", F.explode(F.array(*items)).alias("m")).select(*pairs.columns, "m.*")


def profile(name: str) -> dict:
    """Settings of a profile over those that it extends; nested ones are merged."""

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    own = PROFILES[name]
    return merge(profile(own.extends), own.settings) if own.extends else dict(own.settings)


def _needs(*keys: str) -> Callable[[dict], None]:
    def validate(config: dict) -> None:
        if lacking := [k for k in keys if k not in config]:
            raise ValueError(f"the policy lacks {lacking}")

    return validate


register(Metric("source_identity", "1", "share", text.source_identity))
register(Metric("byte_delta", "1", "bytes", text.byte_delta))
register(Metric("token_dice", "1", "share", lambda a, b: text.dice(text.c_tokens(a), text.c_tokens(b)), ("c", "cpp", "java")))
register(Metric("sequence_ratio", "1", "share", lambda a, b: text.sequence_ratio(text.c_tokens(a), text.c_tokens(b)), ("c", "cpp", "java")))
register(Metric("token_tiling", "1", "share", lambda a, b: structure.tiling_similarity(text.c_tokens(a), text.c_tokens(b)), ("c", "cpp", "java")))
register(Metric("tree_similarity", "1", "share", lambda a, b: structure.tree_similarity()(structure.source_events(text.c_tokens(a)), structure.source_events(text.c_tokens(b)))["value"], ("c", "cpp", "java")))
register(Policy("threshold", "1", lambda chains, c: folds.threshold_policy(chains, c["threshold"], c["max_steps"]), _needs("threshold", "max_steps")))
register(Policy("normalized_fixed_point", "1", lambda chains, c: folds.fixed_point_policy(chains, c.get("confirmations", 0), c["max_steps"]), _needs("max_steps")))
register(Policy("fps", "2", lambda chains, c: folds.fps(chains, c["thresholds"], c["max_states"], c["max_steps"]), _needs("thresholds", "max_states", "max_steps")))
register(Policy("hops", "1", lambda chains, c: folds.hops(chains, c["thresholds"], c["primary"], c["max_hops"]), _needs("thresholds", "primary", "max_hops")))
register(Aggregator("reach", "1", lambda rows, c: outcomes.reach_metrics(rows, *c.get("by", ["route"]))))
register(Aggregator("research", "1", lambda rows, c: outcomes.research_estimates(rows, c.get("weighting", "pooled"))))
register(Profile("base", {"policy": {"name": "threshold", "threshold": 0.85, "max_steps": 20}, "bootstrap": {"replicates": 1000, "seed": 0}}))
register(Profile("strict", {"policy": {"name": "normalized_fixed_point", "confirmations": 1}}, "base"))
register(Profile("states", {"policy": {"name": "fps", "thresholds": [0.8, 0.85, 0.9], "max_states": 10}}, "base"))


def with_settings(name: str, new: str, **settings) -> Profile:
    """A new profile that changes another."""
    made = replace(PROFILES[name], name=new, settings=settings, extends=name)
    register(made)
    return made
