"""URL filters: block and allow rules first, else a logistic regression.

The regression reads hashed character n-grams of host and path, kept apart, and
is fitted on the driver on a small labelled URL table (its size is the caller's;
``LABELLED`` is the default). Rules and judging need no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import slices, span_hashes

#: Bytes of the n-grams, and hashed features.
GRAMS, BUCKETS = (3, 4, 5), 1 << 16
#: Chance of label 1 from which a url is blocked.
THRESHOLD = 0.5

# Rule (host and path) -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

# A small labelled table; 1: unwanted.
LABELLED = (
    ("http://www.cheap-pills.example.com/en/450", 1), ("https://cheap-pills.example.org/fr/176/", 1), ("http://buy-pills-online.example.com/order", 1),
    ("https://www.casino-win.example.org/en/14", 1), ("http://casino-royal.example.com/slots", 1), ("https://play.casino-bonus.example.org/spin?x=1", 1),
    ("http://m.free-bets.example.com/en/27", 1), ("https://free-bets.example.org/odds/today", 1), ("http://best-bets.example.com/free/tips", 1),
    ("https://ads-track.example.org/en/584", 1), ("http://ads-track.example.com/click?id=9", 1), ("https://track-ads.example.com/pixel", 1),
    ("https://spam-farm.example.org/en/728", 1), ("http://spam-farm.example.com/links/77.html", 1), ("http://link-farm.example.org/spam/list", 1),
    ("http://win-money-fast.example.com/now", 1), ("https://adult-cam.example.org/live", 1), ("http://xxx-video.example.com/watch/12", 1),
    ("http://warez-crack.example.org/keygen", 1), ("https://payday-loans.example.com/apply", 1), ("https://replica-watches.example.org/sale", 1),
    ("https://blog.example.org/en/853/", 0), ("http://www.example.com/en/148.html", 0), ("https://news.example.org/world/2020/article", 0),
    ("https://m.example.com/es/797", 0), ("http://blog.gardening.example.com/en/960", 0), ("https://docs.library.example.org/guide/intro", 0),
    ("https://www.university.example.org/research/paper.html", 0), ("http://museum.example.com/fr/138", 0), ("https://weather.example.org/en/city/12", 0),
    ("http://recipes.example.com/en/474.html", 0), ("https://history.example.org/de/252", 0), ("http://www.thering.example.com/en/328/", 0),
    ("https://blog.theren.example.org/en/455", 0), ("http://thether.example.com/es/384", 0), ("https://ththat.example.org/en/217", 0),
    ("https://www.therwith.example.com/en/671", 0), ("http://tionable.example.org/en/334/", 0), ("https://m.thinor.example.com/en/9", 0),
    ("https://science.example.org/en/977", 0), ("http://blog.thereat.example.com/es/575", 0), ("https://www.thhouse.example.org/en/471", 0),
)

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the url's or above it and whose path begins the url's; null if none.

    Rules of equal length are taken in order of their text.
    """
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, path_begin = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + path_begin)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _features(data: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed n-gram) of rows whose texts have a mark at both ends."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, found = [], []
    for n in GRAMS:
        start = np.arange(len(data))
        inside = start + n <= offsets[row + 1]
        rows.append(row[inside])
        found.append(span_hashes(data, start[inside], start[inside] + n) ^ np.uint64(salt * 0x9E3779B9))
    return np.concatenate(rows), (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _marked(texts: list[str]) -> pa.Array:
    return pa.array([f"^{t}$" for t in texts], pa.string())


def _table(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), distinct."""
    rows, found = [], []
    for salt, texts in ((1, hosts), (2, paths)):
        for first, _, data, offsets in slices(_marked(texts)):
            row, feature = _features(data, offsets, salt)
            rows.append(row + first)
            found.append(feature)
    key = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(found)) if rows else np.zeros(0, np.int64)
    return key // BUCKETS, key % BUCKETS


def train(labelled, epochs: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch gradient descent from rows (url, label); no rows: nothing is blocked."""
    if not labelled:
        return np.zeros(BUCKETS, np.float32), -1.0
    hosts, paths = zip(*(_split(url) for url, _ in labelled))
    y = np.array([label for _, label in labelled], float)
    row, feature = _table(list(hosts), list(paths))
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(y)))[row]
    kept, at = np.unique(feature, return_inverse=True)
    w, bias = np.zeros(len(kept)), 0.0
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(bias + np.bincount(row, w[at] * scale, len(y))))) - y
        w -= rate * (np.bincount(at, error[row] * scale, len(kept)) + decay * w)
        bias -= rate * error.mean()
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = w
    return weights, float(bias)


def _split(url: str) -> tuple[str, str]:
    """Host and path of a url, as ``host_of`` and ``path_of`` give them."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(str.maketrans(*_LOWER)), slash + path


def judged(pages: DataFrame, rules: dict[str, str] | None = None, labelled=LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of ``pages``.

    verdict is the rule's, else block from a score of ``THRESHOLD``, else allow. A
    null url, or one without ://, has empty host and path and is judged like any
    other. Repeated rows give repeated results, an empty table none; other columns,
    the html too, are not read.
    """
    rules = RULES if rules is None else rules
    weights, bias = train(labelled)
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    kind = pages.schema["page_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            row, feature = _table(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            n = np.maximum(np.bincount(row, minlength=batch.num_rows), 1)
            total = np.bincount(row, shared.value[feature].astype(float), batch.num_rows) / np.sqrt(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-(bias + total))))], names=[*batch.schema.names, "score"])

    found = base.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, score double")
    told = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", told.alias("verdict"), "score")
