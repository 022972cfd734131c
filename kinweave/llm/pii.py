"""Operator 10, PII: surrogates of the same type and format, distinct and coreferent.

Entities are found by patterns over the whole text: e-mail addresses, phone
numbers with or without country code, card numbers and IBANs with valid check
digits, IPv4 and IPv6 addresses, social security numbers, access keys,
``password=``-like secrets, and persons after an honorific. Each has a normal form (digits
without separators, lower case, the secret without its head; a person is a given
and a family name), and each distinct normal form of the corpus gets one
surrogate, drawn from a keyed hash, which is then laid over every way the entity
is written: one entity reads the same everywhere (coreference) and nothing leads
back without the key. Digits become digits, letters letters of their case and
alphabet (hex stays hex); e-mail domains map by themselves, cards keep their
first digit, IBANs their country, and both get valid check digits; phones keep
their country code, persons their honorific, gender and script.

Collision checks: no two normal forms of a type may share a surrogate, and no
surrogate may be a normal form of the corpus; whoever fails draws again (rounds
over the failing ones alone, in a fixed order), until all are distinct. Names grow
by a syllable where short ones run out; a number format of which the corpus fills
nearly the whole space ends in an error, never in a shared surrogate.

The patterns run once over all texts; rows with their matches are written, and
only rows with an entity are joined with their surrogates. Null and empty texts
pass unchanged. Decisions are about entities, not rows: repeated rows and null
ids need no care. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.common import free_name, table
from kinweave.scratch import checkpoint, materialize

KEY = "surrogate-key-1"

# Titles with the gender that they tell.
HONORIFICS = {
    "f": ["Mrs", "Ms", "Miss", "Madame", "Mme", "Frau", "Señora", "Sra", "Госпожа"],
    "m": ["Mr", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Господин"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"],
    "cyrillic": ["ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"],
}
#: Ends of given names that tell the gender.
ENDS = {("latin", "f"): ["na", "ra", "la", "ia"], ("latin", "m"): ["n", "r", "k", "s"], ("cyrillic", "f"): ["на", "ра", "ла", "ия"], ("cyrillic", "m"): ["н", "р", "к", "с"]}

_TITLES = "|".join(sorted((t for ts in HONORIFICS.values() for t in ts), key=lambda t: (-len(t), t)))
_SECRET_HEAD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
#: (type, pattern); earlier ones win where two begin at one place.
PATTERNS: list[tuple[str, str]] = [
    ("secret", rf"\b{_SECRET_HEAD}[A-Za-z0-9+/_\-]{{6,}}"),
    ("email", r"(?<![\w.%+\-])[\w.%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv4", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)"),
    ("ipv6", r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("phone", r"(?<!\w)\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(.\-])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\w\-])"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<![\d.\-])\d{4}([ \-]?)(?:\d{4}\1\d{4}\1\d{1,7}|\d{6}\1\d{5})(?![\d\-])"),
    ("person", rf"\b(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?:[ \-]\p{{Lu}}\p{{Ll}}+){{0,2}}"),
]
_ANY = "|".join(f"(?:{p})" for _, p in PATTERNS).replace(r"([ \-]?)", r"(?<gap>[ \-]?)").replace(r"\1", r"\k<gap>")
_GIVEN_NAMES = r"((?:\p{Lu}\p{Ll}+[ \-])*)\p{Lu}\p{Ll}+$"
#: Values (strings) that are broadcast at most.
BROADCAST_ROWS = 200_000
_MAY = rf"[0-9@=:]|{_TITLES}"


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number's digits, the last of which counts."""

    def weigh(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 1, F.when(n > 4, n * 2 - 9).otherwise(n * 2)).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _mod97(iban: Column) -> Column:
    """What is left of an IBAN's number, its first four characters last, when divided by 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda s, c: F.when(c == "", s).otherwise((s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def type_of(entity: Column) -> Column:
    """The type of a found entity, by the first pattern that is all of it; null for numbers with wrong check digits."""
    digits, plain = F.regexp_replace(entity, "[^0-9]", ""), F.regexp_replace(entity, " ", "")
    wrong = {"card": _luhn(digits) % 10 != 0, "iban": _mod97(plain) != 1}
    kinds = [F.when(entity.rlike(f"^(?:{p})$"), F.when(wrong[t], "no").otherwise(t) if t in wrong else F.lit(t)) for t, p in PATTERNS]
    return F.nullif(F.coalesce(*kinds, F.lit("no")), F.lit("no"))


def found(text: Column) -> Column:
    """Entities of a text in their order; null where it can't have one."""
    return F.when(text.rlike(_MAY), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))


def _digest(name: str, attempt: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(KEY), F.lit(name), attempt.cast("string"), *parts), 256)


def _byte(digest: Column, i: Column) -> Column:
    """Number ``i`` of a stream of values below 4096; past the digest's end it is stepped by the round."""
    at = (i % F.lit(20)) * 3 + 1
    three = F.conv(F.substr(digest, at.cast("int"), F.lit(3)), 16, 10).cast("int")
    return three + F.floor(i / 20).cast("int") * 7


def _alike(text: Column, digest: Column, hexadecimal: Column, keep: Column) -> Column:
    """Characters replaced by others of their class; the first ``keep`` stay."""

    def one(c: Column, i: Column) -> Column:
        r = _byte(digest, i)
        pick = lambda letters: F.substr(F.lit(letters), (r % len(letters) + 1).cast("int"), F.lit(1))
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), pick("0123456789"))
            .when(hexadecimal & c.rlike("[a-f]"), pick("abcdef"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{Lu}"), pick("ÀÉÈÎÔÜÑÇ"))
            .when(c.rlike(r"\p{Ll}"), pick("àéèîôüñç"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _checked(card: Column) -> Column:
    """A card number with its last digit set so that the Luhn sum holds."""
    body = F.substr(card, F.lit(1), F.length(card) - 1)
    return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def _iban(value: Column) -> Column:
    """An IBAN (without blanks) with its check digits set."""
    bare = F.concat(F.substring(value, 1, 2), F.lit("00"), F.substring(value, 5, 64))
    return F.concat(F.substring(value, 1, 2), F.lpad((98 - _mod97(bare)).cast("string"), 2, "0"), F.substring(value, 5, 64))


def _name(digest: Column, attempt: Column, script: str, syllables: int, ends: list[str]) -> Column:
    """Syllables, one more of them after every third attempt, and an end."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (_byte(digest, i) % len(names) + 1).cast("int"))
    all_of = F.transform(F.sequence(F.lit(1), F.lit(syllables) + F.least(F.lit(12), F.floor(attempt / 3).cast("int"))), lambda i: pick(SYLLABLES[script], i))
    return F.concat(F.array_join(all_of, ""), pick(ends, F.lit(0)))


def _lay(value: Column, content: str, drawn: Column) -> Column:
    """``drawn`` in the places of the last characters of ``value`` that are content (a pattern); their case is kept."""
    chars = F.split(value, "")
    is_content = lambda c: (c != "") & c.rlike(content)
    skip = F.size(F.filter(chars, is_content)) - F.length(drawn)
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        new = F.substr(drawn, acc["k"] - skip + 1, F.lit(1))
        cased = F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        hit = is_content(c)
        out = F.when(hit & (acc["k"] >= skip), F.concat(acc["out"], cased)).otherwise(F.concat(acc["out"], c))
        return F.struct(out.alias("out"), (acc["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(chars, none, step)["out"]


_DIGITS = ("phone", "card", "ssn")


def _secret_body(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_SECRET_HEAD}", "")


def parts_of(kind: Column, value: Column) -> Column:
    """``(kind, normal)`` of the entities in a found value: one, but a given and a family name for persons."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = F.regexp_extract(value, r"^\+(\d{1,3}(?=[ .\-(])|\d)", 1)
    rest = F.substr(digits, F.length(code) + 1, F.length(digits))
    names = F.regexp_replace(value, rf"^(?:{_TITLES})\.? ", "")
    bare = F.regexp_replace(F.trim(F.regexp_extract(value, rf"^(?:{_TITLES})\.? ", 0)), r"\.$", "")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    given = F.regexp_replace(F.regexp_extract(names, _GIVEN_NAMES, 1), r"[ \-]$", "")
    family = F.regexp_extract(names, r"(\p{Lu}\p{Ll}+)$", 1)
    part = lambda k, n: F.struct(k.alias("kind"), n.alias("normal"))
    gender = F.when(bare.isin(HONORIFICS["f"]), "f").otherwise("m")
    person = F.array(part(F.concat(F.lit("family|"), script), F.lower(family)), part(F.concat(F.lit("given|"), script, F.lit("|"), gender), F.lower(given)))
    normal = (
        F.when(kind == "phone", F.concat(F.when(code == "", "1").otherwise(code), F.lit(":"), rest))
        .when(kind.isin(*_DIGITS), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "secret", _secret_body(value))
        .when(kind == "access_key", value)
        .otherwise(F.lower(value))
    )
    return F.when(kind == "person", F.filter(person, lambda p: p["normal"] != "")).otherwise(F.array(part(kind, normal)))


def surrogate(kind: Column, normal: Column, attempt: Column) -> Column:
    """The keyed replacement of one normal form; another for another ``attempt``."""
    digest = _digest("entity", attempt, kind, normal)
    none, zero = F.lit(False), F.lit(0)
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(_alike(local, digest, none, zero), F.lit("@"), _alike(host, _digest("domain", F.lit(0), domain), none, zero), F.lit("."), top)
    octets = [F.when(F.lit(i == 0), _byte(digest, F.lit(i)) % 223 + 1).otherwise(_byte(digest, F.lit(i)) % 254 + 1) for i in range(4)]
    out = (
        F.when(kind == "email", email)
        .when(kind == "ipv4", F.concat_ws(".", *(o.cast("string") for o in octets)))
        .when(kind == "card", _checked(_alike(normal, digest, none, F.lit(1))))
        .when(kind == "phone", _alike(normal, digest, none, F.locate(":", normal)))
        .when(kind == "access_key", _alike(normal, digest, none, F.lit(4)))
        .when(kind == "iban", _iban(_alike(normal, digest, none, F.lit(4))))
        .when(kind.isin("secret", "ipv6"), _alike(normal, digest, normal.rlike("^[0-9a-f:]+$"), zero))
    )
    for script in SYLLABLES:
        out = out.when(kind == f"family|{script}", _name(digest, attempt, script, 5, ["n", "s", "r", "k"] if script == "latin" else ENDS[script, "m"]))
        for gender in "fm":
            out = out.when(kind == f"given|{script}|{gender}", _name(digest, attempt, script, 3, ENDS[script, gender]))
    return out.otherwise(_alike(normal, digest, none, zero))


def written(kind: Column, value: Column, drawn: Column) -> Column:
    """A found value with the surrogates of its parts (``drawn``: by kind of part) in its own format."""
    one = F.try_element_at(F.map_values(drawn), F.lit(1))
    title = F.regexp_extract(value, rf"^(?:{_TITLES})\.? ", 0)
    named = lambda head: F.initcap(F.try_element_at(F.map_values(F.map_filter(drawn, lambda k, v: k.startswith(head))), F.lit(1)))
    person = F.concat(title, F.coalesce(F.concat(named("given"), F.lit(" ")), F.lit("")), named("family"))
    head = F.substr(value, F.lit(1), F.length(value) - F.length(_secret_body(value)))
    return (
        F.when(kind == "person", person)
        .when(kind == "phone", _lay(value, "[0-9]", F.substring_index(one, ":", -1)))
        .when(kind.isin(*_DIGITS), _lay(value, "[0-9]", one))
        .when(kind == "iban", _lay(value, "[A-Z0-9]", one))
        .when(kind == "secret", F.concat(head, one))
        .when(kind.isin("email", "ipv6"), _lay(value, ".", one))
        .otherwise(one)
    )


def assign_surrogates(entities: DataFrame, max_rounds: int = 25) -> DataFrame:
    """``kind, normal, surrogate`` for distinct entities (``kind, normal``), with no two of a kind alike and none an entity."""
    taken = entities.select("kind", F.col("normal").alias("surrogate"))
    drawn = entities.select("kind", "normal", F.lit(0).alias("attempt"))
    for _ in range(max_rounds):
        drawn = materialize(drawn.select("kind", "normal", "attempt", surrogate(F.col("kind"), F.col("normal"), F.col("attempt")).alias("surrogate")), "surrogates")
        # A surrogate's rows are few: two entities share one by chance alone.
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "normal")
        late = drawn.withColumn("place", F.row_number().over(order)).where("place > 1").select("kind", "normal")
        real = drawn.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "normal")
        failed = checkpoint(late.union(real).distinct())
        if failed.isEmpty():
            return drawn.select("kind", "normal", "surrogate")
        failed = failed.withColumn("again", F.lit(1))
        drawn = drawn.join(failed, ["kind", "normal"], "left").select("kind", "normal", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds: the format leaves too few of them")


def replace_entities(docs: DataFrame) -> DataFrame:
    """``docs`` with surrogates for entities in ``text`` and their count as ``n_entities`` (replaced if present)."""
    own = [c for c in docs.columns if c != "n_entities"]
    seen, key, swap = (free_name(docs, x) for x in ("found", "entity_key", "swap"))
    told = docs.select(*[F.col(f"`{c}`") for c in own], found(F.col("text")).alias(seen))
    told = materialize(told, "texts-and-matches")
    none = told.where(F.col(seen).isNull() | (F.size(seen) == 0)).select(*[F.col(f"`{c}`") for c in own], F.lit(0).cast("long").alias("n_entities"))
    some = told.where(F.size(seen) > 0).withColumn(key, F.xxhash64("text"))
    met = some.select(F.col(key).alias("key"), F.explode(F.array_distinct(seen)).alias("value")).distinct().withColumn("kind", type_of(F.col("value")))
    met = materialize(met.where("kind is not null"), "entities")
    values = met.select("kind", "value").distinct()
    parts = materialize(values.select("kind", "value", F.explode(parts_of(F.col("kind"), F.col("value"))).alias("p")).select(F.col("kind").alias("type"), "value", "p.*"), "parts")
    named = assign_surrogates(parts.select("kind", "normal").distinct())
    drawn = parts.join(named, ["kind", "normal"]).groupBy("type", "value").agg(F.map_from_entries(F.collect_list(F.struct("kind", "surrogate"))).alias("drawn"))
    laid = materialize(drawn.select("value", written(F.col("type"), F.col("value"), F.col("drawn")).alias("surrogate")), "written")
    laid = F.broadcast(laid) if laid.count() <= BROADCAST_ROWS else laid
    maps = met.join(laid, "value").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias(swap)).withColumnRenamed("key", key)
    between = F.split(F.col("text"), _ANY, -1)
    swapped = F.transform(seen, lambda e: F.coalesce(F.try_element_at(swap, e), e))
    text = F.when(F.col(swap).isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(between, swapped, lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), ""))
    count = F.coalesce(F.size(F.filter(seen, lambda e: F.try_element_at(swap, e).isNotNull())), F.lit(0)).cast("long")
    done = some.join(maps, key, "left").select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in own], F.when(F.col(swap).isNull(), 0).otherwise(count).cast("long").alias("n_entities"))
    return done.unionByName(none)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
