"""PII: detected entities get keyed surrogates of their own type and format.

Numbers go through a keyed Feistel permutation of their digits, addresses through one of their 32 bits: a
permutation can't give two entities one surrogate. Mail addresses, secrets and the words of names take letters
from a keyed hash (SHA-256). Entities that share a surrogate, or whose surrogate stands in the corpus, are drawn again, they
alone and in rounds, until none is left. An entity has the same surrogate wherever it stands, also in other case.
"""

from __future__ import annotations

import itertools
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.llm.common import join_small, let, materialize, table

KEY_CONF = "graincast.pii.key"
#: From this round on numbers and addresses get more digits: their format has no room for all entities.
FULL = 16

MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
#: With an area code in brackets; 3-3-4 digits with - or . between; with + and country code, in groups or at a stretch.
PHONE = (
    r"(?<![\p{L}\p{N}+])(?:(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d][.-])(?:\+?\d{1,3}[ .-])?\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![.-]?\d)"
    r"|\+(?=(?:[ .-]?\d){8})\d{1,3}(?:[ .-]\d{2,5}){0,3}[ .-]\d{3,8}(?!\d)|\+\d{8,15}(?!\d))"
)
#: Hexadecimal digits in any case, known prefixes, and mixed letters and digits after a key word.
_KEYED = r"[A-Za-z0-9_+/-]"
SECRET = (
    r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![\p{L}\p{N}])"
    r"|(?<=[:=][\"' ]{0,2})(?=" + _KEYED + r"*[A-Za-z])(?=" + _KEYED + r"*\d)(?<=(?i:key|secret|token|password|passwd|pwd)[\"' ]{0,2}[:=][\"' ]{0,2})" + _KEYED + r"{8,128}(?!" + _KEYED + r")"
)
HEX = r"^[0-9a-fA-F]+$"
CARD = r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,16})(?!\d)"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
#: What a phone number starts with that stays, and addresses whose parts are below 256.
COUNTRY = r"^(\+?\d{1,3}[ .-]?(?=\()|\+\d{1,3}[ .-]|\d{1,3}[ .-](?=\d{3}[.-]\d{3}[.-]))"
FITS = r"^(?:0*(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|$)){4}$"
#: Titles that tell a name and its gender. Fixed values.
MALE = ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Господин")
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа")
#: Titles that tell a name but not its gender. Fixed values.
NEUTRAL = ("Dr.", "Dr", "Prof.", "Prof")
#: A word of a name, with what hyphens and apostrophes join to it.
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:['’-]\p{L}+)*"
NAME = r"(?<!\p{L})(?:" + "|".join(t.replace(".", r"\.") for t in FEMALE + MALE + NEUTRAL) + rf") {WORD}(?: {WORD})?"
ENTITY = "|".join([MAIL, PHONE, SECRET, CARD, ADDRESS, NAME])
TYPES = ("mail", "phone", "secret", "card", "address", "name")
GIVEN = {("latin", "m"): ["Adrian", "Bruno", "Carlo", "David", "Emil", "Felix", "Hugo", "Ivan"], ("latin", "f"): ["Alma", "Berta", "Clara", "Diana", "Elsa", "Flora", "Greta", "Ida"], ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб"], ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Ирина"]}
GIVEN |= {(script, "n"): GIVEN[script, "m"] + GIVEN[script, "f"] for script in ("latin", "cyrillic")}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "zu", "ka"], "cyrillic": ["ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "во", "зу", "ка"]}


def check_digit(body: Column) -> Column:
    """Luhn's digit of the digits in a text: every other one from the last on counts twice, less nine if it has two digits then."""
    back = F.reverse(F.regexp_replace(body, r"[^0-9]", ""))
    at = lambda d, i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = let(back, lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(at(d, i))).otherwise(at(d, i))))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def checked(card: Column) -> Column:
    """Whether a card's last digit is that of the others."""
    return F.substring(card, -1, 1) == check_digit(F.substring(card, F.lit(1), F.length(card) - 1))


def type_of(entity: Column) -> Column:
    """What a found entity is; a secret may be one only by what stands before it. Digits like a card's that fail its check digit are a number, which stays."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    named = whole(NAME)
    return F.when(entity.contains("@"), F.lit("mail")).when(whole(PHONE), F.lit("phone")).when(whole(CARD), F.when(checked(entity), F.lit("card")).otherwise(F.lit("number"))).when(whole(ADDRESS), F.lit("address")).when(named, F.lit("name")).otherwise(F.lit("secret"))


def _keyed(text: Column, keyed: str) -> Column:
    """60 bits of a keyed SHA-256 of a text, as a long."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(keyed + "/"), text).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _feistel(high: Column, low: Column, size_high: Column, size_low: Column, keyed: str, then) -> Column:
    """``then(high, low)`` after four keyed rounds; each adds a hash of one half to the other, so it can be undone."""
    f = lambda x, size, r: F.pmod(_keyed(x.cast("string"), f"{keyed}/{r}"), size)
    return let(F.pmod(high + f(low, size_high, 1), size_high), lambda a: let(F.pmod(low + f(a, size_low, 2), size_low), lambda b: let(F.pmod(a + f(b, size_high, 3), size_high), lambda c: then(c, F.pmod(b + f(c, size_low, 4), size_low)))))


def _digits(value: Column, keyed: str) -> Column:
    """The value with its digits permuted; what stands between them stays."""
    plain = F.regexp_replace(value, r"[^0-9]", "")
    n = F.length(plain)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    high, low = F.substring(plain, F.lit(1), half).cast("long"), F.substring(plain, half + 1, n - half).cast("long")
    joined = _feistel(high, low, power(half), power(n - half), keyed, lambda h, w: F.concat(F.lpad(h.cast("string"), half, F.lit("0")), F.lpad(w.cast("string"), n - half, F.lit("0"))))
    nth = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^0-9]", ""))
    here = lambda i: F.substring(value, i, F.lit(1))
    return let(joined, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(here(i).rlike("[0-9]"), F.substring(d, nth(i), F.lit(1))).otherwise(here(i))), ""))


def _address(value: Column, keyed: str) -> Column:
    part = lambda i: F.split(value, r"\.")[i].cast("long")
    size = F.lit(1 << 16)
    dotted = lambda h, w: F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for x in (h, w) for s in (8, 0)])
    return _feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), size, size, keyed, dotted)


def _letters(value: Column, keyed: str, n: int) -> Column:
    """``n`` syllables (64 at most) in the script of ``value``."""
    made = F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("".join(SYLLABLES["cyrillic"]))).otherwise(F.lit("".join(SYLLABLES["latin"])))
    digest = F.sha2(F.concat(F.lit(keyed + "/"), value).cast("binary"), 256)
    at = lambda d, i: F.conv(F.substring(d, i, F.lit(1)), 16, 10).cast("int") * 2 + 1
    return let(F.struct(digest.alias("d"), made.alias("s")), lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(min(n, 64))), lambda i: F.substring(x["s"], at(x["d"], i), F.lit(2))), ""))


def units(entity: Column) -> Column:
    """What is drawn for an entity, as ``kind:value``: the entity, or the last and the first word of a name without its title."""
    parts = F.split(entity, " ")
    gender = F.when(parts[0].isin(*FEMALE), F.lit("given_f:")).when(parts[0].isin(*NEUTRAL), F.lit("given_n:")).otherwise(F.lit("given_m:"))
    given = F.concat(gender, F.get(parts, F.lit(1)))
    name = F.concat(F.array(F.concat(F.lit("last:"), F.element_at(parts, -1))), F.when(F.size(parts) > 2, F.array(given)).otherwise(F.array().cast("array<string>")))
    return let(type_of(entity), lambda kind: F.when(kind == "name", name).when(kind == "number", F.array().cast("array<string>")).otherwise(F.array(F.concat(kind, F.lit(":"), entity))))


def _drawn(kind: Column, value: Column, key: str, salt: int) -> Column:
    """The surrogate of a unit in round ``salt``; each round of letters has more room than the last."""
    keyed, low = f"{key}/{salt}", F.lower(value)
    number = lambda n: F.lpad(F.pmod(_keyed(low, f"{keyed}/number"), F.lit(10**n)).cast("string"), n, "0")
    # letters of a mail are Latin: its hash stands for it
    mail = F.concat(_letters(F.md5(low.cast("binary")), keyed, 12 + salt), F.lit("."), number(2), F.lit("@example.org"))
    digest = lambda v, n: F.sha2(F.concat(F.lit(f"{keyed}/{n}"), v).cast("binary"), 512)
    cut = lambda made: F.substring(made, F.lit(1), F.length(value))
    hexed = F.when(value.rlike("[A-F]"), F.upper(cut(digest(low, "")))).otherwise(cut(digest(low, "")))
    mixed = F.translate(F.concat(*[F.base64(F.unhex(digest(value, n))) for n in (1, 2)]), "+/=\r\n", "xY")
    secret = F.when(value.rlike(HEX), hexed).otherwise(cut(mixed))
    country = F.when(kind == "phone", F.regexp_extract(value, COUNTRY, 1)).otherwise(F.lit(""))
    digits = let(country, lambda c: F.concat(c, _digits(F.substring(value, F.length(c) + 1, F.length(value)), keyed)))
    more = F.concat(F.lit("-"), number(min(4 + salt - FULL, 18))) if salt >= FULL else F.lit("")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    lists = F.create_map(*[x for (sc, g), names in GIVEN.items() for x in (F.lit(f"{sc} given_{g}"), F.array(*map(F.lit, names)))])
    pick = let(lists[F.concat_ws(" ", script, kind)], lambda names: F.element_at(names, F.pmod(_keyed(low, f"{keyed}/name"), F.size(names)).cast("int") + 1))
    body = _digits(F.substring(value, F.lit(1), F.length(value) - 1), keyed)
    card = let(body, lambda b: F.concat(b, check_digit(b)))  # the other digits tell cards apart
    out = F.when(kind == "mail", mail).when(kind == "secret", secret).when(kind == "phone", F.concat(digits, more)).when(kind == "card", F.concat(card, more))
    out = out.when(kind == "address", F.concat(F.when(value.rlike(FITS), _address(value, keyed)).otherwise(digits), more))
    return out.when(kind.startswith("given_"), F.concat(pick, _letters(low, keyed, 4 + salt))).otherwise(F.initcap(_letters(low, keyed, 8 + salt)))


def surrogate(entity: Column, key: str, salt: int = 0, redrawn: Column | None = None) -> Column:
    """The replacement of an entity: same type and format, under ``key``; ``redrawn`` is a map of units to use instead."""

    def of(unit: Column) -> Column:
        value = F.substring(unit, F.locate(":", unit) + 1, F.length(unit))
        made = let(F.substring_index(unit, ":", 1), lambda kind: let(value, lambda v: _drawn(kind, v, key, salt)))
        return made if redrawn is None else F.coalesce(F.try_element_at(redrawn, unit), made)

    name = lambda made: F.concat_ws(" ", F.substring_index(entity, " ", 1), F.array_join(F.reverse(made), " "))
    return let(units(entity), lambda us: let(F.transform(us, of), lambda made: F.when(F.startswith(F.get(us, F.lit(0)), F.lit("last:")), name(made)).otherwise(F.coalesce(F.get(made, F.lit(0)), entity))))


def _same(kind: Column, value: Column) -> Column:
    """Equal for spellings of one entity: case doesn't count, nor do the signs between the digits of a number."""
    return F.when(kind.isin("phone", "card"), F.regexp_replace(value, r"[^0-9]", "")).when((kind == "secret") & ~value.rlike(HEX), value).otherwise(F.lower(value))


def redraw(entities: DataFrame, key: str) -> DataFrame | None:
    """``unit, made`` for the ``unit`` rows that can't have their first surrogate; None if all can.

    Surrogates of different entities are different and none is an entity. In each round all that clash, but one
    of those that share a surrogate, are drawn again. ``unit`` rows are distinct, in a scratch table; a round is one
    aggregation and two joins on surrogates, and rounds after the first are over what clashed.
    """
    kind, value = F.substring_index("unit", ":", 1), F.expr("substring(unit, locate(':', unit) + 1)")
    known = entities.select(_same(kind, value).alias("low")).distinct()
    taken, pending, rounds = known, entities.select("unit"), []
    for salt in itertools.count():
        made = pending.select("unit", F.concat(kind, F.lit(":"), _same(kind, value)).alias("of"), let(kind, lambda k: let(value, lambda v: _drawn(k, v, key, salt))).alias("made"))
        made = made.withColumn("low", _same(kind, F.col("made")))
        first = made.groupBy("low").agg(F.min("of").alias("first"))
        judged = made.join(first, "low").join(taken.withColumn("taken", F.lit(True)), "low", "left")
        judged = materialize(judged.select("unit", "made", "low", ((F.col("of") != F.col("first")) | F.col("taken").isNotNull()).alias("lost")), "surrogates")
        pending = judged.filter("lost").select("unit")
        rounds.append(judged.filter("not lost"))
        if not pending.limit(1).count():
            break
        taken = taken.union(rounds[-1].select("low")).distinct()
    out = None
    for more in rounds[1:]:
        out = more.select("unit", "made") if out is None else out.union(more.select("unit", "made"))
    return out


def _is(kind: str):
    return lambda k: k == kind


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and counts ``n_<type>`` of what the patterns found. Null texts stay null with zero counts.

    Digits like a card's that fail its check digit stay and don't count. An empty table gives none. A name of two words that has a title somewhere in a text gets its surrogate also where it stands without one in that text.
    """
    if not key:
        raise ValueError("surrogates need a key")
    t = F.col(f"`{text}`")
    pattern = F.lit(f"({ENTITY})")
    # most texts have no digit, @ or title: they don't meet the long pattern
    maybe = t.rlike("[0-9@]")
    for title in FEMALE + MALE + NEUTRAL:
        maybe = maybe | t.contains(title + " ")
    has = F.coalesce(F.when(maybe, t.rlike(ENTITY)), F.lit(False))
    found = F.when(has, F.regexp_extract_all(t, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    held = lambda c: F.array_distinct(F.flatten(F.transform(c, units)))
    seen = docs.filter(has).select(F.explode(held(F.regexp_extract_all(t, pattern, F.lit(0)))).alias("unit")).distinct()
    again = redraw(materialize(seen, "entities"), key)
    out, redrawn = docs.withColumn("__found", found), None
    if again is not None:  # each text with such an entity gets the map of its own
        hashed = F.sha2(t.cast("binary"), 256)
        pairs = docs.filter(has).select(hashed.alias("__text_key"), F.explode(held(F.regexp_extract_all(t, pattern, F.lit(0)))).alias("unit"))
        # one row a text and unit, so that many copies of a text don't meet in one task
        own = pairs.join(again, "unit").distinct().groupBy("__text_key").agg(F.map_from_entries(F.collect_list(F.struct("unit", "made"))).alias("__redrawn"))
        spread = F.col("doc_id") if "doc_id" in docs.columns else F.lit(0)
        out = join_small(out.withColumn("__text_key", F.when(has, hashed)), materialize(own, "redrawn"), "__text_key", spread)
        redrawn = F.col("__redrawn")
    kinds = F.transform(F.col("__found"), type_of)
    out = out.withColumn("__kinds", kinds)
    for kind in TYPES:
        out = out.withColumn(f"n_{kind}", F.size(F.filter("__kinds", _is(kind))))
    made = F.concat(F.transform(F.col("__found"), lambda e: surrogate(e, key, 0, redrawn)), F.array(F.lit("")))
    pieces = F.zip_with(F.split(t, ENTITY, -1), made, lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))
    out = out.withColumn(text, F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(t))
    # the same name without its title
    full = F.array_distinct(F.filter("__found", lambda e: (type_of(e) == "name") & (F.size(F.split(e, " ")) > 2)))
    bare = lambda e: F.substring(e, F.locate(" ", e) + 1, F.length(e))
    alone = lambda name: F.concat(F.lit(r"(?<!\p{L})\Q"), name, F.lit(r"\E(?!\p{L})"))
    again = F.aggregate(full, t, lambda done, e: F.regexp_replace(done, alone(bare(e)), bare(surrogate(e, key, 0, redrawn))))
    out = out.withColumn(text, F.when((F.col("n_name") > 0) & (F.size(full) > 0), again).otherwise(t))
    return out.drop("__found", "__kinds", "__text_key", "__redrawn")


def op6_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their entities, and counts by type.

    The key is the setting ``graincast.pii.key``. Without it each run draws one that is told to nobody, so surrogates of
    two runs can't be matched.
    """
    key = spark.conf.get(KEY_CONF, None) or secrets.token_hex(32)
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
