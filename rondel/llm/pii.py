"""Surrogates for personal data, by DataFrame functions alone.

Detected: secrets, e-mail and IP addresses, phone, card, account and social
security numbers, and names after a title or a known given name. Each entity gets
one surrogate in the whole corpus, drawn from a hash of a key and its value, so
mentions of one entity stay mentions of one; a surname that a document's names tell
is replaced where it stands alone in that document, too. Surrogates keep what the
type asks for: length, letter case, script and separators, a card's or account's
check digits, an address's range, a given name's gender.

Distinct entities keep distinct surrogates, none of which is an entity of the
corpus: ``surrogate_table`` draws again where a draw collides, and from ``WIDER``
draws on in a wider format, so that no number of entities fills it. Only texts
with entities are written and shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import spread_join, written

#: Draws of an entity in its own format. Then private addresses leave their prefix, at twice as
#: many draws they become unique local IPv6 ones, and all other types get further digits.
WIDER = 6
#: Session setting that holds the secret key; without it surrogates are repeatable, not secret.
KEY_SETTING, OPEN_KEY = "spark.rondel.pii.key", "rondel"

# What names are found by and made of. Titles and given names tell the gender.
TITLES = {
    "male": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "female": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"],
    "any": ["Dr", "Prof", "Professor", "Doktor"],
}
GIVEN = {
    ("male", "latin"): ["James", "Robert", "Michael", "William", "Richard", "Joseph", "Charles", "Matthew", "Anthony", "Jürgen", "Wolfgang", "Klaus", "Pierre", "Jacques", "Carlos", "Miguel", "John", "David", "Thomas", "Daniel", "Andrew", "Akira", "Hiroshi", "Kenji", "Ahmed", "Mohammed", "Omar", "Hassan", "Ravi", "Arjun", "Wei", "Kwame"],
    ("female", "latin"): ["Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Margaret", "Dorothy", "Ursula", "Monika", "Sabine", "Camille", "Brigitte", "Lucía", "Pilar", "Jane", "Sarah", "Karen", "Emily", "Laura", "Yuki", "Sakura", "Fatima", "Aisha", "Layla", "Priya", "Ananya", "Mei", "Ling", "Amara", "Zainab"],
    ("male", "cyrillic"): ["Иван", "Сергей", "Дмитрий", "Алексей", "Николай", "Михаил", "Павел", "Андрей"],
    ("female", "cyrillic"): ["Анна", "Мария", "Ольга", "Татьяна", "Наталья", "Елена", "Светлана", "Ирина"],
    ("male", "greek"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Παύλος", "Ανδρέας"],
    ("female", "greek"): ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Δήμητρα", "Άννα"],
}
SYLLABLES = {
    "latin": ["bar", "cal", "dor", "fen", "gar", "hol", "jen", "kes", "lam", "mor", "nor", "pel", "quin", "ros", "sel", "tar", "vel", "wes"],
    "cyrillic": ["бар", "вол", "гор", "дан", "жар", "кол", "лаз", "мор", "нов", "пет", "ром", "сол", "тар", "фед"],
    "greek": ["βασ", "γερ", "δημ", "καλ", "λαμ", "μαν", "νικ", "παπ", "ραφ", "σαρ", "ταλ", "φιλ"],
}
ACCENTED = "àâáäçéèêëîïíñôöóùûúüß"

_ALL_TITLES = [t for names in TITLES.values() for t in names]
_ALL_GIVEN = [n for names in GIVEN.values() for n in names]
_WORD = r"\p{Lu}(?:\p{L}++|(?=['’]\p{Lu}))(?:['’-]\p{Lu}\p{L}++)*+"
_V4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_V6 = r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
# How each type looks. The first that fits a place counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,24}(?![A-Za-z])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?:sk|pk|ghp|xox[bp])[_-](?=[_-]*[A-Za-z0-9])[A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16}|(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,}+|(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": f"{_V4}|{_V6}",
    "card": r"(?<![\d+.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,5}){2,4}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "name": rf"(?<![\p{{L}}])(?:(?:{'|'.join(_ALL_TITLES)})\.? {_WORD}(?: {_WORD}){{0,2}}|(?:{'|'.join(_ALL_GIVEN)}) {_WORD})",
}
_CAPITALS = "".join(sorted({n[0] for n in [*_ALL_TITLES, *_ALL_GIVEN]}))
# Most places fail the two guards, so that no type is tried there.
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}])(?:" + "|".join([*(f"(?:{PATTERNS[k]})" for k in ("email", "secret", "iban")), _V6, f"(?=[{_CAPITALS}])(?:{PATTERNS['name']})"]) + ")",
    "(?=[0-9+(])(?:" + "|".join([_V4, *(f"(?:{PATTERNS[k]})" for k in ("card", "ssn", "phone"))]) + ")",
])
#: A text in which neither is found holds no entity; they are cheaper to look for. Names are tried at capitals only.
_HINTS = (r"[0-9@]|(?:sk|pk|ghp|xox[bp])[_-][A-Za-z0-9_-]{16}", rf"(?=[A{_CAPITALS}])(?:AKIA[A-Z0-9]{{16}}|(?:{'|'.join([*_ALL_TITLES, *_ALL_GIVEN])})[. ])")
_HINT = "|".join(_HINTS)
# What marks the matches of a text, and stands for a character of the text that is itself one of these.
_MARK, _ESCAPE = "\u0001", "\u0002"


def hinted(text: Column) -> Column:
    return text.rlike(_HINTS[0]) | text.rlike(_HINTS[1])


def matches(text: Column) -> Column:
    """All entities of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(hinted(text), found).otherwise(F.array().cast("array<string>"))


def cut(text: Column) -> Column:
    """The text as array: what stands before the first match, the match, what follows it, the next match, ...; one entry if there is none."""
    safe = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "\u0003")), F.lit(_MARK), F.lit(_ESCAPE + "\u0004"))
    return F.split(F.regexp_replace(safe, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE + "\u0004"), F.lit(_MARK)), F.lit(_ESCAPE + "\u0003"), F.lit(_ESCAPE))


def _is(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{PATTERNS[kind]})$")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(first: Column) -> Column:
    """By the match's first word, a title or a given name."""
    word = F.regexp_replace(first, r"\.$", "")
    told = F.lit("any")
    for gender in ("male", "female"):
        told = F.when(word.isin(TITLES[gender] + [n for (g, _), names in GIVEN.items() if g == gender for n in names]), gender).otherwise(told)
    return told


def _kind(value: Column) -> Column:
    """Type of a match that is no name."""
    return reduce(lambda rest, kind: F.when(_is(value, kind), kind).otherwise(rest), [k for k in reversed(PATTERNS) if k != "name"], F.lit("name"))


def parts(match: Column) -> Column:
    """The match as array of (kind, value): what joins to it by spaces; kind null: kept as it is.

    A name is its words: a title is kept, the last word is the surname, words
    between are given names. Any other match is one part.
    """

    def of_name(match: Column) -> Column:
        words = F.split(match, " ")
        first = F.element_at(words, 1)
        titled = F.regexp_replace(first, r"\.$", "").isin(_ALL_TITLES)

        def part(word: Column, i: Column) -> Column:
            given = F.concat_ws(":", F.lit("given"), _gender(first), _script(word))
            kind = F.when(titled & (i == 0), None).when(i == F.size(words) - 1, F.concat_ws(":", F.lit("surname"), _script(word))).otherwise(given)
            return F.struct(kind.alias("kind"), word.alias("value"))

        return F.transform(words, part)

    kind = _kind(match)
    return F.when(kind == "name", of_name(match)).otherwise(F.array(F.struct(kind.alias("kind"), match.alias("value"))))


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common."""
    caseless = (kind == "email") | ((kind == "secret") & value.rlike("^[0-9A-F]+$"))
    return F.when(caseless, F.lower(value)).when(kind.isin("card", "iban", "phone"), F.regexp_replace(value, r"[ .()-]", "")).otherwise(value)


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _pick(seed: Column, i: Column, choice: list[str] | str) -> Column:
    return F.element_at(F.array(*map(F.lit, choice)), _draw(seed, i, len(choice)) + 1)


def _char(c: Column, seed: Column, i: Column, hexadecimal: Column) -> Column:
    """Another character of the same class."""
    out = F.when(hexadecimal & c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), _draw(seed, i, 16) + 1, 1))
    for pattern, letters in (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{Ll}", ACCENTED), (r"\p{Lu}", ACCENTED[:-1].upper())):
        out = out.when(c.rlike(pattern), F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, 1))
    return out.otherwise(c)


def _mapped(value: Column, seed: Column, keep: Column, hexadecimal: Column | None = None, tail_seed: Column | None = None, tail: Column | None = None) -> Column:
    """``value`` with each character after the first ``keep`` replaced; from place ``tail`` on by ``tail_seed``, counted from there."""

    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal

    def one(c: Column, at: Column) -> Column:
        i = at + 1
        if tail is None:
            return F.when(i <= keep, c).otherwise(_char(c, seed, i, hexadecimal))
        return F.when(i <= keep, c).when(i >= tail, _char(c, tail_seed, i - tail, hexadecimal)).otherwise(_char(c, seed, i, hexadecimal))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digits(value: Column) -> Column:
    return F.split(F.regexp_replace(value, r"\D", ""), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits whose last is the check digit."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _mod97(text: Column) -> Column:
    """The number of an account (letters count 10 to 35), mod 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The draw for an entity in its canonical form."""
    # Bound by a lambda, so that what reads the whole value is worked out once and not for every character.
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 256)
    domain = F.substring(value, F.instr(value, "@") + 1, F.length(value))
    hexadecimal = value.rlike("^[0-9a-f]+$")
    prefix = F.when(hexadecimal, 0).otherwise(F.length(F.regexp_extract(value, "^(?:[a-z]+[_-]|AKIA)", 0)))
    bound = F.struct(kind.alias("kind"), value.alias("value"), attempt.alias("attempt"), seed.alias("seed"), domain.alias("domain"), F.sha2(F.concat(F.lit(key), domain), 256).alias("domain_seed"), F.instr(value, "@").alias("at"), hexadecimal.alias("hexadecimal"), prefix.alias("prefix"))
    return F.transform(F.array(bound), _drawn)[0]


def _drawn(b: Column) -> Column:
    kind, value, attempt, seed, domain, domain_seed, at, hexadecimal, prefix = (b[c] for c in ("kind", "value", "attempt", "seed", "domain", "domain_seed", "at", "hexadecimal", "prefix"))
    # Addresses of one domain stay of one domain; the last two labels are kept.
    kept = F.regexp_extract(domain, r"[^.]+\.[^.]+$", 0)
    inner = F.length(value) - F.length(kept)
    email = F.concat(_mapped(F.substring(value, F.lit(1), inner), seed, F.lit(0), tail_seed=domain_seed, tail=at), kept)
    hashed = F.sha2(F.concat(seed, F.lit("v6")), 256)
    local = F.concat(F.lit("fd"), F.substring(hashed, 1, 2), *[F.concat(F.lit(":"), F.substring(hashed, 3 + 4 * g, 4)) for g in range(7)])
    private = value.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
    octets = F.when(private & (attempt >= WIDER), F.regexp_replace(value, r"^\d+", "10")).otherwise(value)
    ip = F.array_join(
        F.transform(
            F.split(octets, r"\."),
            lambda o, i: F.when(octets.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.") & ((i == 0) | ((i == 1) & ~octets.rlike(r"^1(?:0|27)\."))), o).when(i == 0, (F.lit(1) + _draw(seed, i, 223)).cast("string")).otherwise(_draw(seed, i, 256).cast("string")),
        ),
        ".",
    )
    ip = F.when(value.contains(":") | (attempt >= 2 * WIDER), local).otherwise(ip)
    card = _mapped(value, seed, F.lit(1))
    due = (10 - _luhn(F.split(F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.lit("0")), "")) % 10) % 10
    card = F.when(_luhn(_digits(value)) % 10 == 0, F.concat(F.substring(card, F.lit(1), F.length(card) - 1), due.cast("string"))).otherwise(card)
    body = F.substring(_mapped(value, seed, F.lit(4)), F.lit(5), F.length(value))
    country = F.substring(value, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)
    phone = _mapped(value, seed, F.when(value.startswith("+1"), 2).when(value.startswith("+"), 3).otherwise(0))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone)
    out = out.when(kind == "ssn", _mapped(value, seed, F.lit(0))).when(kind == "secret", _mapped(value, seed, prefix, hexadecimal))

    def drawn_from(choice: list[str], n: Column, joint: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: _pick(seed, i, choice)), joint)

    for script, syllables in SYLLABLES.items():
        out = out.when(kind == f"surname:{script}", F.initcap(drawn_from(syllables, F.lit(3) + F.floor(attempt / 8), "")))
        every = [n for (g, s), names in GIVEN.items() if s == script for n in names]
        for gender in ("male", "female", "any"):
            names = GIVEN.get((gender, script), every)
            # After the first draws a second given name of the same gender keeps names apart.
            drawn = F.when(attempt < 2, _pick(seed, F.lit(0), names)).otherwise(drawn_from(names, F.lit(2) + F.floor(attempt / 4), "-"))
            out = out.when(kind == f"given:{gender}:{script}", drawn)
    out = out.otherwise(_mapped(value, seed, F.lit(0)))
    more = F.substring(F.translate(F.sha2(F.concat(seed, F.lit("more")), 256), "abcdef", "012345"), F.lit(1), F.lit(2) * (attempt - (2 * WIDER - 1)))
    widened = F.when(kind == "email", F.concat(more, out)).when((kind == "ip") | kind.contains(":"), out).otherwise(F.concat(out, more))
    return F.when(attempt >= 2 * WIDER, widened).otherwise(out)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value), with distinct surrogates in a kind, none of them a value of the kind.

    In each round, of the entities that share a surrogate the one of the least
    value keeps it, and one whose surrogate is a value keeps none; the others draw
    again, with the next ``attempt``. Formats widen with the attempts (``WIDER``), so
    rounds end however many entities there are. Each draw is made once, by all tasks.
    """
    spark = entities.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    open_ = written(entities.distinct().withColumn("attempt", F.lit(0)), "entities")
    # Given names of all genders share one space, so that no two merge.
    space = F.split("kind", ":")[0].alias("space")
    taken = open_.select(space, F.col("value").alias("surrogate"))
    settled = None
    while True:
        drawn = open_.repartition(tasks, "kind", "value").select("kind", "value", "attempt", space, surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key).alias("surrogate"))
        drawn = written(drawn, "draws")
        claims = drawn.select("space", "surrogate", F.struct("kind", "value").alias("claim")).unionByName(taken.withColumn("claim", F.lit(None).cast("struct<kind:string,value:string>")))
        owners = claims.groupBy("space", "surrogate").agg(F.min("claim").alias("owner"), F.max(F.col("claim").isNull()).alias("is_taken"))
        told = spread_join(drawn, owners, ["space", "surrogate"], ["kind", "value"])
        told = written(told.select("kind", "value", "attempt", "space", "surrogate", (~F.col("is_taken") & (F.col("owner") == F.struct("kind", "value"))).alias("own")), "draws")
        kept = told.filter("own").select("kind", "value", "surrogate", "space")
        settled = kept if settled is None else settled.unionByName(kept)
        taken = taken.unionByName(kept.select("space", "surrogate"))
        open_ = told.filter("not own").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            return settled.select("kind", "value", "surrogate")


def _formatted(kind: Column, value: Column, drawn: Column) -> Column:
    """The canonical form's surrogate in the mention's letter case and separators."""
    cased = F.array_join(F.zip_with(F.split(value, ""), F.split(F.substring(drawn, F.lit(1), F.length(value)), ""), lambda c, d: F.when(c != F.lower(c), F.upper(d)).otherwise(d)), "")
    spaced = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike(r"[ .()-]"), F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))).otherwise(F.struct(F.concat(a["out"], F.substring(drawn, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))),
        lambda a: F.concat(a["out"], F.substring(drawn, a["at"], F.length(drawn))),
    )
    cased = F.concat(cased, F.substring(drawn, F.length(value) + 1, F.length(drawn)))
    capital = (kind == "secret") & value.rlike("^[0-9A-F]+$")
    return F.when(capital, F.upper(drawn)).when(kind == "email", cased).when(kind.isin("card", "iban", "phone"), spaced).otherwise(drawn)


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in text and a column n_entities; all rows and other columns are kept.

    Null and empty texts stay as they are, with 0 entities. Repeated rows give
    repeated results, an empty table none. Columns named n_entities are replaced.
    n_entities counts the matches, without surnames that stand alone. Texts may be of
    any length: no pattern recurses over what it matches. ``key``, else the session's
    ``KEY_SETTING``, must be kept secret for the surrogates to be.

    Texts are looked through once; those with entities are written, cut at them.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, OPEN_KEY)
    docs = docs.drop("n_entities")
    own = [c for c in docs.columns if c != "text"]
    names = {c: f"c{i}" for i, c in enumerate(own)}
    held = docs.filter(hinted(F.col("text"))).select(*[F.col(c).alias(n) for c, n in names.items()], F.sha2("text", 256).alias("digest"), cut(F.col("text")).alias("parts"))
    held = written(held.filter(F.size("parts") > 1), "held")
    odd = lambda array: F.filter(array, lambda x, i: i % 2 == 0)
    found = held.select("digest", F.filter("parts", lambda x, i: i % 2 == 1).alias("found")).dropDuplicates(["digest"])
    mentions = found.select("digest", F.posexplode("found").alias("m", "match")).select("digest", "m", F.posexplode(parts(F.col("match"))).alias("p", "part"))
    mentions = written(mentions.select("digest", "m", "p", "part.kind", "part.value", canonical(F.col("part.kind"), F.col("part.value")).alias("entity")), "mentions")
    table = surrogate_table(mentions.filter("kind is not null").select("kind", F.col("entity").alias("value")), key)
    drawn = spread_join(mentions, table.select("kind", F.col("value").alias("entity"), "surrogate"), ["kind", "entity"], ["digest", "m"], "left")
    surname = F.when(F.col("kind").startswith("surname:"), F.struct(F.col("value").alias("old"), F.col("surrogate").alias("new")))
    drawn = drawn.select("digest", "m", "p", F.coalesce(_formatted(F.col("kind"), F.col("value"), F.col("surrogate")), "value").alias("new"), surname.alias("surname"))
    words = drawn.groupBy("digest", "m").agg(F.array_sort(F.collect_list(F.struct("p", "new"))).alias("words"), F.max("surname").alias("surname"))
    words = words.select("digest", "surname", F.struct("m", F.array_join(F.col("words")["new"], " ").alias("new")).alias("mention"))
    replaced = words.groupBy("digest").agg(F.array_sort(F.collect_list("mention"))["new"].alias("new_"), F.array_sort(F.collect_set("surname")).alias("surnames"))
    told = spread_join(held, written(replaced, "replacements"), ["digest"], list(names.values()))
    # Surnames alone: in what stands between the matches only.
    between = F.aggregate(
        "surnames", F.array_join(odd(F.col("parts")), _MARK), lambda text, s: F.regexp_replace(text, F.concat(F.lit(r"(?<!\p{L})"), s["old"], F.lit(r"(?!\p{L})")), s["new"]),
    )
    pieces = F.split(between, _MARK, -1)
    text = _unescaped(F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(F.slice(pieces, 2, F.size("new_")), "new_", lambda piece, new: F.concat(new, piece)), "")))
    changed = told.select(*[F.col(n).alias(c) for c, n in names.items()], text.alias("text"), F.size("new_").alias("n_entities"))
    plain = docs.filter(F.col("text").isNull() | ~hinted(F.col("text")) | ~F.col("text").rlike(PATTERN)).select(*own, "text", F.lit(0).alias("n_entities"))
    return plain.unionByName(changed).select(*docs.columns, "n_entities")


def surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_entities) of each row of ``docs``."""
    return pseudonymised(docs.select("doc_id", "text"), key)
