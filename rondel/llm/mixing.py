"""Mixing sources to target weights, by DataFrame functions alone.

1. A classifier gives each document posteriors over domains. It is a Gaussian
   naive Bayes over shares of characters and function words, whose means and
   variances are aggregates over all labelled rows. The labelled table holds
   quality and documents tell the language: a row of quality 0 is of domain
   ``LOW``, any other of its language's.
2. Rates x >= 0 are fitted so that expected domain totals, the sum of
   x_d * tokens_d * posterior_d,k, meet target_k: projected gradient descent on
   sum_k (total_k - target_k)**2 / (2 N_k), N_k being the total at rates of 1.
   Each step sums K numbers over all documents; the gradient is taken in the
   metric of the documents' tokens, in which steps under 2 are stable. What is
   left of the way to the targets is told with the rates.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import written

LOW = "low"
#: Share of the tokens that each domain is to have; the domains are the keys.
TARGETS = {"en": 0.54, "de": 0.15, "fr": 0.15, "es": 0.10, LOW: 0.06}
STEP, STEPS, PRECISION = 1.5, 60, 1e-3
#: Rates have no upper bound, so that the rarest domain can reach its target.
MAX_RATE = math.inf
#: Posterior of ``LOW`` from which a row may vanish.
CLEAR = 0.99
#: From ``STEPS`` on, steps go on while each ``STRIDE`` of them take this share off the loss.
GAIN, STRIDE = 0.1, 6

# Frequent function words, and characters, that tell languages and junk apart.
FUNCTION_WORDS = {"en": ("the", "of", "and", "that"), "de": ("der", "die", "und", "von"), "fr": ("de", "le", "la", "les"), "es": ("el", "que", "los", "no")}
CHARACTERS = {"german": "äöüßÄÖÜ", "french": "éèêàùçîÉÈÊÇ", "spanish": "ñóíáúÑÓÍÁ", "capital": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "mark": "#$%&*|<>{}[]=\\^~_+@!", "digit": "0123456789", "stop": ".,;:", "line": "\n"}


#: Share of the words that a text has of a language's function words, and of the characters of a class, are told by these.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _among(words: tuple[str, ...]):
    return lambda w: w.isin(list(words))


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (with text, not null) with n_tokens (words) and f0, f1, ...: shares on a logarithmic scale, and the mean word's length.

    Each text is split into words once, and its lower-case letters and spaces are
    dropped once; function words are counted among the few words that are any, and
    character classes in what is left, where each class is one letter.
    """
    every = [w for words in FUNCTION_WORDS.values() for w in words]
    classes = "".join(CHARACTERS.values())
    letters = "".join(_LETTERS[i] * len(c) for i, c in enumerate(CHARACTERS.values()))
    rows = rows.withColumn("__words", F.split("text", r"\s+")).withColumn("__known", F.filter("__words", lambda w: w.isin(["", *every])))
    rows = rows.withColumn("__size", F.size("__words")).withColumn("__rest", F.translate(F.regexp_replace("text", "[a-z ]+", ""), classes, letters))
    empty = F.size(F.filter("__known", lambda w: w == ""))
    n, words = F.greatest(F.length("text"), F.lit(1)), F.col("__size") - empty
    shares = [(F.length("__rest") - F.length(F.replace("__rest", F.lit(_LETTERS[i]), F.lit("")))) / n for i in range(len(CHARACTERS))]
    shares += [F.size(F.filter("__known", _among(own))) / F.greatest(words, F.lit(1)) for own in FUNCTION_WORDS.values()]
    features = [F.log(x + 0.002) for x in shares] + [F.log(n / (words + 1))]
    return rows.select("*", words.cast("double").alias("n_tokens"), *[f.alias(f"f{i}") for i, f in enumerate(features)]).drop("__words", "__known", "__size", "__rest")


N_FEATURES = len(CHARACTERS) + len(FUNCTION_WORDS) + 1


def train(rows: DataFrame, labels: DataFrame, domains: list[str]) -> dict[str, tuple[float, list[float], list[float]]]:
    """domain -> (prior, means, variances), from ``rows`` (doc_id, lang, f0, f1, ...) with a label.

    Domains without labelled rows are left out; labels of quality null teach nothing.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().dropDuplicates(["doc_id"])
    rows = rows.join(known, "doc_id").withColumn("domain", F.when(F.col("quality") == 0, LOW).otherwise(F.col("lang")))
    sums = [f(f"f{i}").alias(f"{name}{i}") for i in range(N_FEATURES) for name, f in (("m", F.avg), ("v", F.var_pop))]
    found = rows.filter(F.col("domain").isin(domains)).groupBy("domain").agg(F.count("*").alias("n"), *sums).collect()
    total = sum(r.n for r in found)
    return {r.domain: (r.n / total, [r[f"m{i}"] for i in range(N_FEATURES)], [r[f"v{i}"] + 0.05 for i in range(N_FEATURES)]) for r in sorted(found, key=lambda r: r.domain)}


def posteriors(model: dict, domains: list[str]) -> list[Column]:
    """Chance of each domain, from f0, f1, ...; without a model all are equal. Log likelihoods are tempered by the number of features."""
    if not model:
        return [F.lit(1.0 / len(domains)) for _ in domains]
    temper = 2 / math.sqrt(N_FEATURES)
    scores = {}
    for domain, (prior, means, variances) in model.items():
        terms = [-((F.col(f"f{i}") - m) * (F.col(f"f{i}") - m)) / (2 * v) - 0.5 * math.log(v) for i, (m, v) in enumerate(zip(means, variances))]
        scores[domain] = math.log(prior) + temper * reduce(lambda a, b: a + b, terms)
    top = F.greatest(*scores.values(), F.lit(-1e300)) if len(scores) > 1 else next(iter(scores.values()))
    parts = F.array(*[F.exp(scores[d] - top) if d in scores else F.lit(0.0) for d in domains])
    return [parts, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)]


@dataclass(frozen=True)
class Fit:
    """What rates follow from: the classifier, and the pull on each domain in each step of the descent."""

    domains: list[str]
    model: dict
    pulls: list[list[float]]
    residual: list[float | None]


def _base(docs: DataFrame) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    text = F.coalesce("text", F.lit(""))
    return with_features(docs.select("doc_id", lang, text.alias("text"))).withColumn("row_key", row_key("doc_id", "text")).drop("text")


def _with_posteriors(rows: DataFrame, model: dict, domains: list[str]) -> DataFrame:
    """``rows`` with p0, p1, ... in place of the features."""
    found = posteriors(model, domains)
    if model:
        rows = rows.withColumn("__parts", found[0]).withColumn("__sum", found[1])
        shares = [(F.col("__parts")[k] / F.col("__sum")).alias(f"p{k}") for k in range(len(domains))]
    else:
        shares = [p.alias(f"p{k}") for k, p in enumerate(found)]
    return rows.select("*", *shares).drop("__parts", "__sum", *[f"f{i}" for i in range(N_FEATURES)])


def _descend(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, keep: bool) -> tuple[Fit, DataFrame]:
    """The fit, and (row_key, doc_id, n_tokens, p0, p1, ..., n_rows, rate) of each distinct row."""
    targets = targets or TARGETS
    domains = sorted(targets)
    rows = written(_base(docs), "features")
    model = train(rows, labels, domains)
    ks = range(len(domains))
    once = [F.first(c).alias(c) for c in ("doc_id", "n_tokens", *(f"p{k}" for k in ks))]
    state = _with_posteriors(rows, model, domains).groupBy("row_key").agg(*once, F.count("*").alias("n_rows"))
    state = written(state.withColumn("rate", F.lit(1.0)), "rates")

    def totals(frame: DataFrame) -> list[float]:
        got = frame.agg(*[F.sum(F.col("rate") * F.col("n_rows") * F.col("n_tokens") * F.col(f"p{k}")).alias(f"t{k}") for k in ks]).first()
        return [got[k] or 0.0 for k in ks]

    natural = totals(state)
    whole = sum(targets.values())
    share = [targets[d] / whole for d in domains]
    live = [k for k in ks if natural[k] > 0]
    kept_domains = [k for k in live if domains[k] != LOW and share[k] > 0]
    budget = max([natural[k] / share[k] for k in kept_domains], default=sum(natural)) if keep else sum(natural)
    goal = [share[k] * budget for k in ks]
    pulls, losses = [], []
    while True:
        now = totals(state)
        met = all(abs(now[k] - goal[k]) <= PRECISION * max(goal[k], natural[k]) for k in live)
        losses.append(sum((now[k] - goal[k]) ** 2 / natural[k] for k in live))
        if met or len(pulls) >= STEPS and losses[-1] > (1 - GAIN) * losses[-1 - STRIDE]:
            break
        pulls.append([STEP * (now[k] - goal[k]) / natural[k] if k in live else 0.0 for k in ks])
        pull = reduce(lambda a, b: a + b, [F.lit(pulls[-1][k]) * F.col(f"p{k}") for k in ks])
        state = state.withColumn("rate", F.when(F.col("n_tokens") > 0, F.greatest(F.lit(0.0), F.col("rate") - pull)).otherwise(F.col("rate")))
        if len(pulls) % STRIDE == 0:
            state = written(state, "rates")
    residual = [(now[k] - goal[k]) / goal[k] if goal[k] else None for k in ks]
    if live and (not met or len(live) < len([k for k in ks if goal[k]])):
        warnings.warn(f"targets not met after {len(pulls)} steps; by domain, total over target less 1: {dict(zip(domains, residual))}", stacklevel=3)
    return Fit(domains, model, pulls, residual), written(state, "rates")


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: bool = False) -> DataFrame:
    """(row_key, doc_id, n_tokens, n_rows, domain, posterior array<double>, rate, residual array<double>) of each distinct (doc_id, text).

    n_rows: rows that are equal; each of them counts in the totals and has the rate.

    targets: domain -> share of the tokens. The budget is the corpus's tokens. With
    ``keep`` it is the least with which no domain but ``LOW`` has to shrink. Rates
    are 0 or more. A target for a domain that no document is likely to be of can't
    be met and is left out. Texts without words have 0 tokens and keep rate 1.

    residual: by sorted domain, expected total less target at the returned rates, as
    a share of the target (null for a target of 0); the same in every row. If one
    isn't met within ``PRECISION``, a warning tells it too.
    """
    fit, state = _descend(docs, labels, targets, keep)
    shares = F.array(*[f"p{k}" for k in range(len(fit.domains))])
    likeliest = F.element_at(F.array(*map(F.lit, fit.domains)), F.array_position(shares, F.array_max(shares)).cast("int"))
    return state.select("row_key", "doc_id", "n_tokens", "n_rows", likeliest.alias("domain"), shares.alias("posterior"), "rate", F.array(*[F.lit(r).cast("double") for r in fit.residual]).alias("residual"))


def _rate(fit: Fit) -> Column:
    """The rate of a row with n_tokens and p0, p1, ...: the steps of the descent, taken again."""
    own = F.array(*[F.col(f"p{k}") for k in range(len(fit.domains))])
    if not fit.pulls:
        return F.lit(1.0)
    pulls = F.array(*[F.array(*map(F.lit, p)) for p in fit.pulls])

    def descended(p: Column) -> Column:
        dot = lambda pull: reduce(lambda a, b: a + b, [pull[k] * p[k] for k in range(len(fit.domains))])
        return F.aggregate(pulls, F.lit(1.0), lambda x, pull: F.greatest(F.lit(0.0), x - dot(pull)))

    # Posteriors are bound by a lambda, so that the steps don't work them out again.
    return F.when(F.col("n_tokens") > 0, F.transform(F.array(own), descended)[0]).otherwise(1.0)


def row_key(doc_id: str, text: str) -> Column:
    """Tells rows apart; equal rows share it, and with it their rate."""
    return F.md5(F.concat_ws("\u0001", F.coalesce(F.col(doc_id).cast("string"), F.lit("\u0002")), F.coalesce(text, F.lit(""))))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_rows, domain, posterior, rate, residual) of each distinct row of ``docs``.

    posterior and residual are in the order of the sorted domains. Rows with equal doc_id and text
    are one, of n_rows; null texts are empty; an empty table gives no rows; other columns but
    lang are ignored.
    """
    return fitted(docs, labels, targets).drop("row_key").withColumn("n_tokens", F.col("n_tokens").cast("long"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all their columns.

    A row of rate x comes floor(x) times, and once more with chance x - floor(x), by
    a hash of the row. Rows stay at least once unless their posterior of ``LOW`` is
    ``CLEAR`` or more. Rates follow from a row's own text and the steps of the
    descent, so the texts are neither joined nor shuffled.

    Null texts are empty; an empty table gives no rows; equal rows come equally often.
    """
    fit, _ = _descend(docs, labels, targets, keep=True)
    own = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__row")
    lang = ["lang"] if "lang" in docs.columns else []
    rows = docs.select(own, "doc_id", *lang, F.coalesce("text", F.lit("")).alias("text"))
    rows = with_features(rows).withColumn("__key", row_key("doc_id", "text")).select("__row", "__key", "n_tokens", *[f"f{i}" for i in range(N_FEATURES)])
    rows = _with_posteriors(rows, fit.model, fit.domains).withColumn("__rate", _rate(fit))
    chance = F.pmod(F.xxhash64("__key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("__rate") + chance).cast("int")
    if LOW in fit.domains:
        copies = F.when(F.col(f"p{fit.domains.index(LOW)}") >= CLEAR, copies).otherwise(F.greatest(copies, F.lit(1)))
    else:
        copies = F.greatest(copies, F.lit(1))
    # Rows of no copies go after the explosion: a filter before it would be pushed down to the
    # scan with all that it is worked out from, and each text would be looked through twice.
    told = rows.select("__row", copies.alias("__copies")).select("__row", F.explode_outer(F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies")))).alias("__copy"))
    return told.filter("__copy is not null").select(*[F.col("__row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
