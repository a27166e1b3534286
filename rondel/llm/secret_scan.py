"""Secrets in texts: fixed patterns, and strings that look random, by DataFrame functions only.

1. ``looked_through``: one pass over the texts finds the fixed kinds with their places, and candidates: longest runs of encoded characters.
2. ``tested``: a candidate's encoding is inferred, and a battery asks whether its symbols are random: chi-squared for the alphabet's
   uniformity, runs of the alphabet's lower and upper half, correlation of neighbours. The three p-values are combined; the result is kept as
   a whole number, ``bin``, that is low for random strings.
3. Natural text gets the same tests: one window of each document, cut to each encoding's symbols and to one length, is a decoy.
4. ``limits``: for each encoding and class of lengths the decoys tell how often natural text gets as low a ``bin``; Benjamini and Hochberg's rule on
   these p-values gives the bins that are called secret, so that at most ``RATE`` of the found strings of a class are expected to be natural. Short
   strings, where natural text can pass, need more than long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import written

#: Fixed kinds, in the order in which they are listed: pattern, and the least length of what counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ASSIGN_LENGTH = 12
# A longest run that is long enough is what the pattern with the least length finds too.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: A run of encoded characters, and what it may not hold as the fixed kinds have it.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
HELD = f"{HEX}|{ACCESS}"

_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order in which they are tried: symbols, and the pattern of a string in it. A string without letters has none.
ENCODINGS = {
    "hex": (_DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    "base32": (_UP + "234567", "^[A-Z2-7]+$"),
    "base36": (_DIGITS + _LOW, "^(?:[0-9a-z]+|[0-9A-Z]+)$"),
    "base62": (_DIGITS + _UP + _LOW, "^[0-9A-Za-z]+$"),
    "base64": (_UP + _LOW + _DIGITS + "+/", "."),
}
#: Least lengths of the classes of lengths; a decoy has just that length.
LENGTHS = (16, 20, 24, 32, 48, 64)
#: False discoveries among the strings found, in each class.
RATE = 0.05
#: Characters of the window for each symbol of a decoy.
WINDOW = 12
_TINY = 1e-12


def running(steps: Column, block: int = 512) -> Column:
    """Prefix sums of an array, by blocks, so that long arrays don't cost their square."""

    def sums(array: Column) -> Column:
        return F.aggregate(array, F.array().cast("array<bigint>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("bigint")) + x)))

    count = F.ceil(F.size(steps) / block).cast("int")
    blocks = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda b: sums(F.slice(steps, b * block + 1, block)))
    ends = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
    return F.flatten(F.zip_with(blocks, ends, lambda b, end: F.transform(b, lambda x: x + end - F.element_at(b, -1))))


def places(pieces: Column, found: Column) -> Column:
    """Ends of the matches ``found``, between which ``pieces`` stand."""
    return running(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda piece, match: (F.length(piece) + F.length(match)).cast("bigint")))


def _spans(text: Column, pattern: str) -> Column:
    """(start, end, token) of all matches, end exclusive, in code points from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.zip_with(places(F.split(text, pattern, -1), found), found, lambda end, token: F.struct((end - F.length(token)).alias("start"), end.alias("end"), token.alias("token")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,token:string>>"))


def _staged(array: Column, keep: tuple[str, ...], **new) -> Column:
    """Each entry with some of its fields and new ones, functions of the entry."""
    return F.transform(array, lambda t: F.struct(*[t[k].alias(k) for k in keep], *[f(t).alias(name) for name, f in new.items()]))


def _by_encoding(encoding: Column, values: list) -> Column:
    out = values[-1] if isinstance(values[-1], Column) else F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(encoding == i, values[i]).otherwise(out)
    return out


def _in_alphabet(value: Column, encoding: Column) -> Column:
    """``value`` with the letters and signs of the encoding's alphabet."""
    upper, lower = F.translate(value, _LOW, _UP), F.translate(value, _UP, _LOW)
    return _by_encoding(encoding, [upper, upper, lower, value, F.translate(value, "-_", "+/")])


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS[1:], 1):
        out = F.when(n >= least, i).otherwise(out)
    return out


def tested(values: Column, keep: tuple[str, ...] = ()) -> Column:
    """The battery on an array of (encoding, value, ...): entries with ``keep``, stratum and bin.

    A value is a string of 16 symbols or more of its encoding's alphabet. bin is floor(-100 ln p) of the combined p-value
    under randomness. stratum numbers encoding and class of lengths.
    """
    number = lambda x: x.cast("double")
    staged = _staged(values, (*keep, "encoding", "value"), alphabet=lambda t: _by_encoding(t["encoding"], [a for a, _ in ENCODINGS.values()]), n=lambda t: F.length(t["value"]))
    staged = _staged(
        staged, (*keep, "encoding", "n"), k=lambda t: F.length(t["alphabet"]),
        squares=lambda t: F.aggregate(
            F.transform(F.split(t["alphabet"], ""), lambda s: number(F.length(t["value"]) - F.length(F.replace(t["value"], s, F.lit(""))))), F.lit(0.0), lambda a, c: a + c * c),
        halves=lambda t: F.call_function("translate", t["value"], t["alphabet"], F.concat(F.repeat(F.lit("L"), F.floor(F.length(t["alphabet"]) / 2).cast("int")), F.repeat(F.lit("H"), F.floor(F.length(t["alphabet"]) / 2).cast("int")))),
        x=lambda t: F.transform(F.split(t["value"], ""), lambda c: number(F.instr(t["alphabet"], c) - 1)),
    )
    add = lambda a, x: a + x
    staged = _staged(
        staged, (*keep, "encoding", "n"), k=lambda t: number(t["k"]), m=lambda t: number(t["n"]), squares=lambda t: t["squares"],
        low=lambda t: number(F.length(F.replace(t["halves"], F.lit("H"), F.lit("")))),
        runs=lambda t: 1 + (2 * t["n"] - F.length(F.replace(t["halves"], F.lit("LH"), F.lit(""))) - F.length(F.replace(t["halves"], F.lit("HL"), F.lit("")))) / 2.0,
        sum=lambda t: F.aggregate(t["x"], F.lit(0.0), add), sum2=lambda t: F.aggregate(t["x"], F.lit(0.0), lambda a, x: a + x * x),
        next=lambda t: F.aggregate(F.zip_with(t["x"], F.concat(F.slice(t["x"], F.lit(2), t["n"]), F.slice(t["x"], 1, 1)), lambda a, b: a * b), F.lit(0.0), add),
    )
    both = lambda t: 2 * t["low"] * (t["m"] - t["low"])
    spread = lambda t: t["m"] * t["sum2"] - t["sum"] * t["sum"]
    staged = _staged(
        staged, (*keep, "encoding", "n"),
        chi=lambda t: (t["k"] / t["m"] * t["squares"] - t["m"] - (t["k"] - 1)) / F.sqrt(2 * (t["k"] - 1) * (1 - 1 / t["m"])),
        runs=lambda t: F.when(both(t) > 0, F.abs(t["runs"] - both(t) / t["m"] - 1) / F.sqrt(both(t) * (both(t) - t["m"]) / (t["m"] * t["m"] * (t["m"] - 1)))).otherwise(9.0),
        serial=lambda t: F.when(spread(t) > 0, F.abs((t["m"] * t["next"] - t["sum"] * t["sum"]) / spread(t) + 1 / (t["m"] - 1)) * (t["m"] - 1) * F.sqrt(t["m"] - 2) / t["m"]).otherwise(9.0),
    )
    staged = _staged(staged, (*keep, "encoding", "n"), chi=lambda t: F.when(t["chi"] < 0, 1 - _tail(-t["chi"])).otherwise(_tail(t["chi"])), runs=lambda t: 2 * _tail(t["runs"]), serial=lambda t: 2 * _tail(t["serial"]))
    staged = _staged(staged, (*keep, "encoding", "n"), h=lambda t: -sum((F.log(F.least(F.lit(1.0), F.greatest(F.lit(_TINY), t[p]))) for p in ("chi", "runs", "serial")), F.lit(0.0)))
    # The sum of three such logarithms has a tail of e^-h (1 + h + h^2/2).
    return _staged(staged, keep, stratum=lambda t: t["encoding"] * len(LENGTHS) + _length_class(t["n"]), bin=lambda t: F.floor(100 * (t["h"] - F.log(1 + t["h"] + t["h"] * t["h"] / 2))).cast("int"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, to within 1e-7 (formula 26.2.17 of Abramowitz and Stegun)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _encoding(token: Column) -> Column:
    out = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern) in reversed(list(enumerate(ENCODINGS.values()))):
        out = F.when(token.rlike(pattern), i).otherwise(out)
    return out


def decoys(text: Column) -> Column:
    """(encoding, value) of natural text: a window of ``text``, without its candidates, in each encoding's symbols.

    A digest of the text tells the length and place, so equal texts have equal decoys. Every other window has its words begin with capitals, as
    names in code do. A text that is too short has fewer.
    """
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    size = F.element_at(F.array(*[F.lit(n) for n in LENGTHS]), (drawn % len(LENGTHS) + 1).cast("int"))
    window = F.substring(text, (F.floor(drawn / len(LENGTHS)) % F.greatest(F.length(text) - WINDOW * size, F.lit(1)) + 1).cast("int"), WINDOW * size)
    window = F.regexp_replace(window, "[A-Za-z0-9+/_-]{16,}", "")
    capital = F.array_join(F.transform(F.split(window, " "), lambda w: F.concat(F.translate(F.substring(w, 1, 1), _LOW, _UP), F.substring(w, 2, WINDOW * LENGTHS[-1]))), "")
    window = F.array(F.struct(F.when(drawn >= 1 << 31, capital).otherwise(window).alias("window"), size.alias("size")))
    each = F.flatten(F.transform(window, lambda w: F.array(*[
        F.struct(F.lit(i).alias("encoding"), F.substring(F.regexp_replace(_in_alphabet(w["window"], F.lit(i)), f"[^{alphabet}]", ""), F.lit(1), w["size"]).alias("value"), w["size"].alias("size"))
        for i, (alphabet, _) in enumerate(ENCODINGS.values())
    ])))
    return F.filter(each, lambda d: F.length(d["value"]) == d["size"])


def looked_through(docs: DataFrame, *own: str) -> DataFrame:
    """``own``, assign, access, hex (start, end), candidates (start, end, digest, stratum, bin) and decoys (stratum, bin) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["end"]))
    rows = docs.select(*own, text.alias("__text"))
    assign = F.when(F.col("__text").rlike(ASSIGN), F.struct(F.split("__text", ASSIGN, -1).alias("pieces"), F.regexp_extract_all("__text", F.lit(ASSIGN), F.lit(0)).alias("found"), F.transform(F.regexp_extract_all("__text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v)).alias("sizes")))
    rows = rows.withColumn("__assign", assign)
    kept = F.zip_with("__assign.found", "__assign.sizes", lambda match, size: F.when(size >= ASSIGN_LENGTH, F.repeat(F.lit(" "), F.length(match))).otherwise(match))
    # What an assignment covers is blank for the candidates; places stay.
    rest = F.concat(F.array_join(F.zip_with(F.slice("__assign.pieces", F.lit(1), F.size("__assign.found")), kept, lambda piece, match: F.concat(piece, match)), ""), F.element_at("__assign.pieces", -1))
    ends = F.zip_with(places(F.col("__assign.pieces"), F.col("__assign.found")), F.zip_with("__assign.found", "__assign.sizes", lambda f, s: F.struct(F.length(f).alias("all"), s.alias("value"))), lambda end, s: F.struct((end - s["all"]).alias("start"), end.alias("end"), s["value"].alias("value")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rows = rows.withColumns({"assign": F.when(F.col("__assign").isNull(), none).otherwise(bare(F.filter(ends, lambda s: s["value"] >= ASSIGN_LENGTH))), "__rest": F.coalesce(F.when(F.col("__assign").isNotNull(), rest), F.col("__text"))})
    found = F.filter(_spans(F.col("__rest"), CANDIDATE), lambda s: s["token"].rlike("[A-Za-z]") & ~s["token"].rlike(HELD))
    found = F.transform(found, lambda s: F.struct(s["start"], s["end"], F.rtrim(s["token"], F.lit("=")).alias("token")))
    found = _staged(found, ("start", "end", "token"), encoding=lambda t: _encoding(t["token"]))
    found = _staged(found, ("start", "end", "encoding"), digest=lambda t: F.xxhash64(t["token"]), value=lambda t: _in_alphabet(t["token"], t["encoding"]))
    return rows.select(*own, "assign", bare(_spans(F.col("__text"), ACCESS)).alias("access"), bare(_spans(F.col("__text"), HEX)).alias("hex"), tested(found, ("start", "end", "digest")).alias("candidates"), tested(decoys(F.col("__text"))).alias("decoys"))


def limits(held: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The highest bin that is called secret, for each stratum that has one.

    There are ``len(ENCODINGS) * len(LENGTHS)`` strata and a bounded number of bins, whatever ``held`` has. Equal strings count once.
    """
    strings = held.select(F.explode("candidates").alias("c")).select("c.stratum", "c.bin", "c.digest").distinct()
    cells = strings.groupBy("stratum", "bin").agg(F.count("*").alias("found"), F.lit(0).cast("bigint").alias("natural"))
    natural = held.select(F.explode("decoys").alias("d")).select("d.stratum", "d.bin").groupBy("stratum", "bin").agg(F.lit(0).cast("bigint").alias("found"), F.count("*").alias("natural"))
    cells = cells.unionByName(natural).groupBy("stratum", "bin").agg(F.sum("found").alias("found"), F.sum("natural").alias("natural"))
    up = "over (partition by stratum order by bin)"
    cells = cells.select("stratum", "bin", F.expr(f"sum(found) {up}").alias("found"), F.expr(f"sum(natural) {up}").alias("natural"), F.expr("sum(found) over (partition by stratum)").alias("all_found"), F.expr("sum(natural) over (partition by stratum)").alias("all_natural"))
    p = (1.0 + F.col("natural")) / (1.0 + F.col("all_natural"))
    passed = cells.filter((F.col("found") > 0) & (p * F.col("all_found") <= rate * F.col("found")))
    return {r[0]: r[1] for r in passed.groupBy("stratum").agg(F.max("bin")).collect()}


def _ranked(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _listed(*spans: tuple[str, Column]) -> Column:
    """kind:start:end of all spans, by start, then kind as listed, joined by commas."""
    whole = F.array_sort(F.concat(*[_ranked(found, kind) for kind, found in spans]))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(whole, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scanned(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """The secrets of each row of ``docs``: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    docs: (doc_id, text); other columns play no part. Fixed kinds and their lengths are those above. A string that the battery
    calls random is a span of kind ``random`` unless a fixed kind overlaps it; its padding belongs to it. Places are code points from 0, ends exclusive.

    Null and empty texts have no spans (``base_sha256`` is that of the empty string, ``spans`` empty). Repeated rows give
    repeated results; an empty table gives none. Texts count whole, whatever their length. In a class without enough natural windows
    of its length (fewer than 1/rate - 1) nothing is called random, so very small tables yield the fixed kinds only.
    """
    held = written(looked_through(docs, "doc_id"), "secret-candidates")
    highest = limits(held, rate)
    base = [(k, F.col(k)) for k in KINDS[:3]]
    random = F.filter("candidates", lambda c: _below(c, highest))
    return held.select("doc_id", *[F.size(c).cast("bigint").alias(f"n_{k}") for k, c in base], F.sha2(_listed(*base), 256).alias("base_sha256"), _listed(*base, ("random", random)).alias("spans"))


def _below(candidate: Column, highest: dict[int, int]) -> Column:
    out = F.lit(False)
    for stratum, limit in highest.items():
        out = out | ((candidate["stratum"] == stratum) & (candidate["bin"] <= limit))
    return out
