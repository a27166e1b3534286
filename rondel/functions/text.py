"""Text normalisation, hashing, extraction and token similarity as column expressions."""

from __future__ import annotations

import difflib
import io
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from rondel.operators.structure import sequence_ratio  # noqa: F401

# The tokens of C-like languages; what matches none of them is skipped.
# Literals are matched by possessive loops, which take no stack however long they are.
C_TOKENS = (
    r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r"|[A-Za-z_][A-Za-z0-9_]*"
    r"|0[xX][0-9A-Fa-f]+[A-Za-z0-9_]*"
    r"|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[A-Za-z0-9_]*"
    r"|::|->\*|->|\+\+|--|<<=|>>=|==|!=|<=|>=|&&|\|\||<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.\."
    r"|[#{}\[\]();,.:?~<>+\-*/%=!&|^\\]"
)
#: A quoted literal (kept), or a comment (dropped). Both may be unterminated.
QUOTE_OR_COMMENT = r"""("[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\z)|'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+(?:'|\z))|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"""
#: A fenced block: opening line with an optional language, body, closing fence.
FENCE = r"(?s)```[^\n]*+\n(.*?)```"


def strip_comments(source: Column) -> Column:
    """C-like source without comments; quotes guard what they hold."""
    return F.regexp_replace(source, QUOTE_OR_COMMENT, "$1 ")


def c_tokens(source: Column) -> Column:
    return F.regexp_extract_all(strip_comments(source), F.lit(C_TOKENS), F.lit(0))


def normalised(tokens: Column) -> Column:
    return F.concat_ws(" ", tokens)


def token_hash(tokens: Column) -> Column:
    """Digest of the tokens joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", tokens), 256)


def unix_lines(source: Column) -> Column:
    return F.regexp_replace(source, "\r\n?", "\n")


def state_hash(source: Column) -> Column:
    """Digest of a source; only the kind of line end doesn't count."""
    return F.sha2(unix_lines(source), 256)


def source_identity(a: Column, b: Column) -> Column:
    return F.when(unix_lines(a) == unix_lines(b), 1.0).when(a.isNotNull() & b.isNotNull(), 0.0)


def byte_delta(a: Column, b: Column) -> Column:
    return F.octet_length(b) - F.octet_length(a)


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def canonical_output(out: Column) -> Column:
    """Output stripped at both ends, and each line at its right end."""
    return stripped(F.regexp_replace(unix_lines(out), r"(?m)(?<![ \t\f\x0B])[ \t\f\x0B]++$", ""))


def words(text: Column) -> Column:
    """White-space separated words; none of blank text."""
    trimmed = stripped(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def same_words(a: Column, b: Column) -> Column:
    """The looser comparison: line structure doesn't count."""
    return words(a) == words(b)


def normalised_input(text: Column, mode: str) -> Column:
    """Input to compare for leaks: ``tokens`` or ``line``."""
    return F.concat_ws(" ", words(text)) if mode == "tokens" else F.regexp_replace(text, r"\n\z", "")


def fenced_blocks(response: Column) -> Column:
    return F.regexp_extract_all(response, F.lit(FENCE), F.lit(1))


def extracted_code(response: Column) -> Column:
    """struct(status, code): one fence gives its body, more are an error, none gives the whole text."""
    blocks = fenced_blocks(response)
    body = F.regexp_replace(F.when(F.size(blocks) == 1, blocks[0]).otherwise(response), r"^\n+|\n+\z", "")
    status = F.when(F.size(blocks) > 1, "multiple_blocks").when(F.regexp_replace(body, r"\s", "") == "", "empty").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", body).alias("code"))


# How lines of code begin, or what they hold.
CODE_PREFIXES = (
    "#include", "import ", "from ", "def ", "class ", "public ", "private ", "protected ", "int ", "long ", "double ", "float ", "for ", "while ", "if ", "else", "return",
)
CODE_MARKS = (";", "{", "}", "(", ")", "=", "->", "::")
_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def is_code_line(line: Column) -> Column:
    """A line that begins or is marked like code."""
    trimmed = stripped(line)
    out = F.lit(False)
    for test in [trimmed.startswith(p) for p in CODE_PREFIXES] + [trimmed.contains(m) for m in CODE_MARKS]:
        out = out | test
    return out


def longest_code_span(response: Column) -> Column:
    """struct(status, code) of text without a fence.

    Runs of code lines that only blank lines part are one; of several, the longest
    counts, which needs two lines and no other run of its length.
    """
    lines = F.split(stripped(response), _LINE_END)
    # One letter for each line: code, blank or other.
    kinds = F.array_join(F.transform(lines, lambda x: F.when(is_code_line(x), "c").when(stripped(x) == "", "b").otherwise("o")), "")
    core = F.btrim(kinds, F.lit("bo"))
    runs = F.transform(F.split(core, "[bo]+"), F.length)
    most = F.array_max(runs)
    together = ~core.contains("o")
    status = F.when(core == "", "no_code").when(together, "ok").when(most < 2, "no_code").when(F.size(F.filter(runs, lambda n: n == most)) > 1, "ambiguous").otherwise("ok")
    first = F.when(together, F.instr(kinds, "c")).otherwise(F.position(F.repeat(F.lit("c"), most), kinds))
    code = F.array_join(F.slice(lines, first, F.when(together, F.length(core)).otherwise(most)), "\n")
    return F.struct(status.alias("status"), F.when(status == "ok", code).alias("code"))


def _shared(a: Column, b: Column) -> Column:
    count = lambda items, t: F.size(F.filter(items, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def dice(a: Column, b: Column) -> Column:
    """Multiset Dice of two short token arrays; two empty ones are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * _shared(a, b) / F.nullif(total, F.lit(0)))


def pair_dice(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` (pair_id, a, b: token arrays) with dice: counts meet by (pair, token), so arrays of any length do."""
    counts = [pairs.select("pair_id", F.explode(c).alias("token")).groupBy("pair_id", "token").agg(F.count("*").alias(f"n_{i}")) for i, c in enumerate((a, b))]
    shared = counts[0].join(counts[1], ["pair_id", "token"]).groupBy("pair_id").agg(F.sum(F.least("n_0", "n_1")).alias("shared"))
    total = F.size(a) + F.size(b)
    return pairs.join(shared, "pair_id", "left").withColumn("dice", F.when(total == 0, 1.0).otherwise(2.0 * F.coalesce("shared", F.lit(0)) / F.nullif(total, F.lit(0)))).drop("shared")


def residual(source_a: Column, source_b: Column, similarity: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """struct(status, value, reason): like Dice, but no tokens on both sides, or blank source, can't be measured."""
    blank = (F.trim(F.coalesce(source_a, F.lit(""))) == "") | (F.trim(F.coalesce(source_b, F.lit(""))) == "")
    reason = F.when(blank, "blank_source").when(F.size(tokens_a) + F.size(tokens_b) == 0, "zero_token_denominator")
    return F.struct(F.when(reason.isNull(), "measured").otherwise("unavailable").alias("status"), F.when(reason.isNull(), similarity).alias("value"), reason.alias("reason"))


@F.pandas_udf(ArrayType(StringType()))
def python_tokens(source: pd.Series) -> pd.Series:
    """Tokens of Python source without comments, line ends and indentation; null if it can't be tokenised."""
    ignored = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}

    def one(text):
        try:
            return [t.string for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in ignored]
        except (tokenize.TokenError, SyntaxError):
            return None

    return source.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), lineterm="")) for x, y in zip(a, b)])


def mutations(source: Column) -> Column:
    """array(struct(name, source)): variants to probe a similarity with."""
    kinds = {
        "whitespace": F.regexp_replace(source, " ", "  "),
        "comment": F.concat(F.lit("// note\n"), source),
        "identifier": F.regexp_replace(source, r"\b([a-z_])\b", "$1_renamed"),
        "operator": F.regexp_replace(source, r"\+", "-"),
        "line_drop": F.regexp_replace(source, r"\A[^\n]*\n", ""),
    }
    return F.array(*[F.struct(F.lit(k).alias("name"), v.alias("source")) for k, v in kinds.items()])
