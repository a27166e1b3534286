"""DuckDB SQL of the queries that SQL can state on whole tables."""

from __future__ import annotations

from rondel.llm.secret_scan import ACCESS, ASSIGN_LENGTH, ENCODINGS, HELD, HEX, LENGTHS, RATE, WINDOW

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
lengths AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM sizes, totals),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

#: The checksum's table is made by its rule, and each distinct feature is folded byte by byte.
OP13 = rf"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, repeat([0::BIGINT], 8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
listed AS (
  SELECT side, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
found AS (SELECT side, doc_id, f, count(*) AS c FROM listed GROUP BY ALL),
names AS (SELECT DISTINCT f FROM found),
bytes AS (
  SELECT f, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS b FROM names),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)])), 4294967295) % 10000 AS bucket FROM bytes, steps),
placed AS (SELECT side, doc_id, bucket, sum(c)::BIGINT AS c FROM found JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT sum(c) FILTER (side = 'd') AS s_all, coalesce(sum(c) FILTER (side = 't'), 0) AS t_all FROM placed),
counts AS (SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 't'), 0) AS t FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, sums),
weights AS (
  SELECT doc_id, sum(c)::BIGINT AS n_features, floor(sum(c * gain)::DOUBLE / sum(c))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
ordered AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ordered USING (doc_id)
"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def op12() -> str:
    """Spans by relations: characters, symbols and neighbours of each string are rows."""
    keys = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
    assign = rf"({keys})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    alphabets = ", ".join(f"({i}, '{name}', '{alphabet}')" for i, (name, (alphabet, _)) in enumerate(ENCODINGS.items()))
    encoding = "CASE " + " ".join(f"WHEN regexp_matches(token, '{pattern}') THEN {i}" for i, (_, pattern) in enumerate(ENCODINGS.values())) + " END"
    cased = lambda v, e: f"CASE WHEN {e} < 2 THEN translate({v}, '{_LOW}', '{_UP}') WHEN {e} = 2 THEN translate({v}, '{_UP}', '{_LOW}') WHEN {e} = 4 THEN translate({v}, '-_', '+/') ELSE {v} END"
    level = " + ".join(f"(n >= {least})::INT" for least in LENGTHS[1:])

    def spans(name: str, source: str, pattern: str, group: int = 0) -> str:
        return f"""
{name}_cut AS (SELECT doc_id, string_split_regex({source}, '{pattern}') AS pieces, regexp_extract_all({source}, '{pattern}') AS found, regexp_extract_all({source}, '{pattern}', {group}) AS vals FROM {'texts' if source == 'text' else 'rests'}),
{name}_at AS (SELECT doc_id, pieces, found, vals, unnest(range(1, len(found) + 1)) AS i FROM {name}_cut),
{name} AS (
  SELECT doc_id, found[i] AS token, vals[i] AS val, length(array_to_string(pieces[1:i], '')) + length(array_to_string(found[1:i], '')) AS stop, stop - length(found[i]) AS start FROM {name}_at),"""

    tail = lambda z: f"(exp(-{z} * {z} / 2) * 0.3989422804014327::DOUBLE * ({_poly(f'(1 / (1 + 0.2316419::DOUBLE * {z}))')}))"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{spans('assign', 'text', assign, 2)}{spans('access', 'text', ACCESS)}{spans('hexes', 'text', HEX)}
rests AS (
  SELECT doc_id, array_to_string(list_transform(range(1, len(found) + 1), lambda i: pieces[i] || CASE WHEN length(vals[i]) >= {ASSIGN_LENGTH} THEN repeat(' ', length(found[i])) ELSE found[i] END), '') || pieces[-1] AS rest
  FROM assign_cut),
{spans('runs_', 'rest', '[A-Za-z0-9+/_-]{16,}={0,2}')}
alphabets AS (SELECT * FROM (VALUES {alphabets}) AS v(e, name, alphabet)),
strings AS (
  SELECT doc_id, start, stop, rtrim(token, '=') AS token, {encoding.replace('token', "rtrim(token, '=')")} AS e FROM runs_
  WHERE regexp_matches(token, '[A-Za-z]') AND NOT regexp_matches(token, '{HELD}')),
drawn AS (SELECT doc_id, text, ('0x' || substr(sha256(text), 1, 8))::BIGINT AS d, [{', '.join(map(str, LENGTHS))}][d % {len(LENGTHS)} + 1] AS size FROM texts),
cut AS (
  SELECT doc_id, d, size, regexp_replace(substring(text, (d // {len(LENGTHS)}) % greatest(length(text) - {WINDOW} * size, 1) + 1, {WINDOW} * size), '[A-Za-z0-9+/_-]{{16,}}', '', 'g') AS win FROM drawn),
windows AS (
  SELECT doc_id, size, CASE WHEN d >= 2147483648 THEN array_to_string(list_transform(string_split(win, ' '), lambda w: translate(substring(w, 1, 1), '{_LOW}', '{_UP}') || substring(w, 2)), '') ELSE win END AS win FROM cut),
natural_ AS (
  SELECT doc_id, e, size, substring(regexp_replace({cased('win', 'e')}, CASE e {' '.join(f"WHEN {i} THEN '[^{a}]'" for i, (a, _) in enumerate(ENCODINGS.values()))} END, '', 'g'), 1, size) AS value
  FROM windows, alphabets),
every AS (
  SELECT row_number() OVER () AS id, * FROM (
    SELECT true AS real, doc_id, start, stop, token, e, {cased('token', 'e')} AS value FROM strings
    UNION ALL SELECT false, doc_id, NULL, NULL, NULL, e, value FROM natural_ WHERE length(value) = size)),
symbols AS (
  SELECT id, i, n, k, (instr(alphabet, substring(value, i, 1)) - 1)::DOUBLE AS x
  FROM (SELECT id, value, alphabet, length(value) AS n, length(alphabet) AS k, unnest(range(1, length(value) + 1)) AS i FROM every JOIN alphabets USING (e))),
pairs AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS y, (x < k / 2)::INT AS low, lead((x < k / 2)::INT) OVER w AS next_low FROM symbols WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
squares AS (SELECT id, sum(c * c)::DOUBLE AS squares FROM (SELECT id, x, count(*) AS c FROM symbols GROUP BY id, x) GROUP BY id),
sums AS (
  SELECT id, any_value(n) AS n, any_value(n)::DOUBLE AS m, any_value(k)::DOUBLE AS k, sum(low)::DOUBLE AS low, 1.0::DOUBLE + count(*) FILTER (low <> next_low) AS runs, sum(x) AS s1, sum(x * x) AS s2, sum(x * y) AS sxy
  FROM pairs GROUP BY id),
scores AS (
  SELECT id, n, (k / m * squares - m - (k - 1)) / sqrt(2 * (k - 1) * (1 - 1 / m)) AS zc,
    2 * low * (m - low) AS ab, CASE WHEN ab > 0 THEN abs(runs - ab / m - 1) / sqrt(ab * (ab - m) / (m * m * (m - 1))) ELSE 9.0 END AS zr,
    m * s2 - s1 * s1 AS v, CASE WHEN v > 0 THEN abs((m * sxy - s1 * s1) / v + 1 / (m - 1)) * (m - 1) * sqrt(m - 2) / m ELSE 9.0 END AS zs
  FROM sums JOIN squares USING (id)),
logs AS (
  SELECT id, n, -(ln(least(1, greatest(1e-12, CASE WHEN zc < 0 THEN 1 - {tail('(-zc)')} ELSE {tail('zc')} END)))) - ln(least(1, greatest(1e-12, 2 * {tail('zr')}))) - ln(least(1, greatest(1e-12, 2 * {tail('zs')}))) AS h
  FROM scores),
binned AS (
  SELECT every.*, e * {len(LENGTHS)} + {level} AS stratum, floor(100 * (h - ln(1 + h + h * h / 2)))::INT AS bin FROM every JOIN logs USING (id)),
cells AS (
  SELECT stratum, bin, count(DISTINCT token) FILTER (real) AS found, count(*) FILTER (NOT real) AS nat FROM binned GROUP BY ALL),
risen AS (
  SELECT stratum, bin, sum(found) OVER w AS found, sum(nat) OVER w AS nat, sum(found) OVER a AS all_found, sum(nat) OVER a AS all_nat
  FROM cells WINDOW w AS (PARTITION BY stratum ORDER BY bin), a AS (PARTITION BY stratum)),
limits AS (
  SELECT stratum, max(bin) AS most FROM risen WHERE found > 0 AND (1.0 + nat)::DOUBLE / (1.0 + all_nat)::DOUBLE * all_found <= {RATE} * found GROUP BY stratum),
spans AS (
  SELECT doc_id, start, stop, 0 AS o, 'assign' AS kind FROM assign WHERE length(val) >= {ASSIGN_LENGTH}
  UNION ALL SELECT doc_id, start, stop, 1, 'access' FROM access UNION ALL SELECT doc_id, start, stop, 2, 'hex' FROM hexes
  UNION ALL SELECT doc_id, start, stop, 3, 'random' FROM binned JOIN limits USING (stratum) WHERE real AND bin <= most),
told AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (o < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)
"""


def _poly(t: str) -> str:
    return f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"


def queries() -> dict[str, str]:
    return {"op11_lexical": OP11, "op12_secrets": op12(), "op13_importance": OP13}
