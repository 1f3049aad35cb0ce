"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one alternation of patterns; each consists of *units*
(the words of a name; the letters and digits of anything else, whatever its
punctuation), so spellings of one number share a unit.  Every distinct unit of
the corpus gets a surrogate of the same kind by a keyed hash: given names keep
gender and script, names keep their case, numbers and tokens keep length and
character kinds, phone numbers their country code, card numbers their first
digit and whether the Luhn check holds.  Surrogates are then checked over the
whole corpus: one that two units share, or that is itself a unit of the corpus,
stays with none but the smallest unit, the others draw again, until all are
distinct.  Where a format is crowded (``a@b.de`` has 676 of its shape) later draws
are longer: names and mail addresses from the second draw on, other kinds only
after ``_SAME_LENGTH`` draws, so units of any number get distinct surrogates.
Equal units get equal surrogates everywhere (coreference), different units
different ones.

On Spark: finding is narrow; distinct units are one aggregate (map-side
combine), each round of the check is one aggregate and one equi join on the
units still open; documents meet their surrogates by occurrence, in an equi
join that AQE splits on hot units.  Only documents with entities are shuffled.

Defined results: null texts stay null, texts without entities stay as they are;
rows that agree in id and text are one document and are replaced alike, rows
that share an id only are told apart by a hash of the text; a null id is an id
like any other; an empty table stays empty; other columns pass through, but
those named ``__sg_...`` may not exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftsmith.session import checkpoint_dir

# Titles that name a person's gender.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "г-жа")
NEUTRAL = ("Dr", "Prof", "Mx")

_ANY = "[\\p{L}\\p{N}]"
_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")\\.?"
_NAME = "\\p{Lu}(?:['’-]?[\\p{L}\\p{M}])++"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": f"(?<![\\p{{L}}\\p{{N}}._+-]){_ANY}[\\p{{L}}\\p{{N}}._+-]*+@{_ANY}++(?:-++{_ANY}++)*+(?:\\.{_ANY}++(?:-++{_ANY}++)*+)++",
    "person": f"(?<![\\p{{L}}\\p{{N}}]){_TITLE} {_NAME}(?: {_NAME})?",
    "ip": f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9]|\\.[0-9])",
    "iban": f"(?<!{_ANY})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}+(?: ?[A-Z0-9]{{1,3}})?(?!{_ANY})",
    "phone": (
        "(?<![\\p{L}\\p{N}+])(?:\\+[0-9]{1,3}[ .-]?)?\\([0-9]{2,4}\\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
        "|(?<![\\p{L}\\p{N}+])\\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}+(?![0-9])"
        "|(?<![\\p{L}\\p{N}.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
    ),
    "ssn": "(?<![\\p{L}\\p{N}.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|[.-][0-9])",
    "card": f"(?<![\\p{{L}}\\p{{N}}.+-])(?:[0-9]{{13,19}}(?!{_ANY})|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}(?!{_ANY}|[ -][0-9]{{4}}))",
    "secret": f"(?<!{_ANY})(?=[A-Za-z_-]{{0,200}}[0-9])(?=[0-9_-]{{0,200}}[A-Za-z])[A-Za-z0-9][A-Za-z0-9_-]{{30,}}+(?!{_ANY})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_CHEAP = f"[@0-9]|(?<![\\p{{L}}\\p{{N}}]){_TITLE} \\p{{Lu}}"  # no entity without one of these
KEY = "draftsmith-surrogates-1"
_SAME_LENGTH = 8  # draws that keep a format's length
_ROUNDS = 40


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def entities(text: Column) -> Column:
    """The entity strings of a text in order."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(_CHEAP), found).otherwise(F.array().cast("array<string>"))


def _title(e: Column) -> Column:
    return F.regexp_extract(e, f"^({_TITLE}) ", 1)


def kind(e: Column) -> Column:
    """Kind of an entity string, in the order of ``PATTERNS``."""
    out = F.when(F.contains(e, F.lit("@")), F.lit("email"))
    for name in list(PATTERNS)[1:]:
        out = out.when(e.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name))
    return out.otherwise(F.lit("secret"))


def _units(e: Column, what: Column) -> Column:
    """Array of ``struct<type, unit>``."""
    title = F.rtrim(F.regexp_replace(_title(e), "\\.", ""))
    gender = F.when(title.isin(*MALE), "given_m").when(title.isin(*FEMALE), "given_f").otherwise("given_n")
    words = F.slice(F.split(F.lower(e), " "), 2, 2)
    of = lambda t, u: F.struct(t.alias("type"), u.alias("unit"))
    person = F.transform(words, lambda w, i: of(F.when((i == 0) & (F.size(words) == 2), gender).otherwise(F.lit("surname")), w))
    other = F.array(of(what, F.when(what.isin("email", "ip"), F.lower(e)).otherwise(F.regexp_replace(e, "[^A-Za-z0-9]", ""))))
    return F.when(what == "person", person).otherwise(other)


def _byte(hex_text: Column, i: Column) -> Column:
    return F.conv(F.substr(hex_text, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(pool: str, n: Column) -> Column:
    return F.substr(F.lit(pool), F.pmod(n, F.lit(len(pool))) + 1, F.lit(1))


def _same_shape(unit: Column, h: Column, keep: Column) -> Column:
    """Letters for letters, digits for digits; the first ``keep`` characters stay."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        return (
            F.when(i < keep, c)
            .when(c.rlike("[0-9]"), _pick("0123456789", b))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(c.rlike("\\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(unit, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits before the check digit."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return a + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), add)


def _card(unit: Column, h: Column) -> Column:
    drawn = _same_shape(unit, h, F.lit(1))
    check = lambda d: F.pmod(F.lit(10) - F.pmod(_luhn(d), F.lit(10)), F.lit(10))
    own = F.substr(unit, F.length(unit), F.lit(1)).cast("int")
    off = F.pmod(_byte(h, F.lit(63)), F.lit(9)) + 1  # any digit but the right one
    last = F.when(own == check(unit), check(drawn)).otherwise(F.pmod(check(drawn) + off, F.lit(10)))
    return F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), last.cast("string"))


def _name(unit: Column, h: Column, what: Column, attempt: int) -> Column:
    """Consonant-vowel syllables in the script of the unit; given names end by gender."""
    pools = {"\\p{IsCyrillic}": ("бвгдзклмнпрстф", "аеиоу", "а", "нрслк"), "\\p{IsGreek}": ("βγδζκλμνπρστφχ", "αεηιοω", "α", "ςνρ"), "": ("bdfgklmnprstvz", "aeiou", "a", "nrslk")}
    words = {}
    for script, (cons, vows, female, male) in pools.items():

        def syllable(i: Column) -> Column:
            return F.concat(_pick(cons, _byte(h, i * 2)), _pick(vows, _byte(h, i * 2 + 1)))  # noqa: B023  used at once

        n = F.pmod(_byte(h, F.lit(62)), F.lit(2)) + (2 + attempt)
        stem = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), syllable), "")
        end = F.when(what == "given_f", F.concat(_pick(cons, _byte(h, F.lit(60))), F.lit(female))).when(what.isin("given_m", "surname"), _pick(male, _byte(h, F.lit(61)))).otherwise("")
        words[script] = F.concat(stem, end)
    return F.when(unit.rlike("\\p{IsCyrillic}"), words["\\p{IsCyrillic}"]).when(unit.rlike("\\p{IsGreek}"), words["\\p{IsGreek}"]).otherwise(words[""])


def _draw(attempt: int, key: str) -> Column:
    """Surrogate of (type, unit) at this attempt."""
    what, unit = F.col("type"), F.col("unit")
    h0 = F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(attempt)), what, unit), 512)

    def drawn(h: Column) -> Column:
        octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(h, i), F.lit(254)) + 1).cast("string"))
        tld = F.regexp_extract(unit, "\\.[^.]*$", 0)
        more = F.concat(*[_pick("abcdefghijklmnopqrstuvwxyz", _byte(h, F.lit(63 - i))) for i in range(max(1, 2 * attempt))]) if attempt else F.lit("")
        mail = F.concat(more, _same_shape(F.substr(unit, F.lit(1), F.length(unit) - F.length(tld)), h, F.lit(0)), tld)
        hexes = F.substr(F.repeat(h, 1 + 4), F.lit(1), F.length(unit))
        longer = max(0, attempt - _SAME_LENGTH + 1)
        extra = F.concat(*[_pick("0123456789", _byte(h, F.lit(40 + i))) for i in range(longer)]) if longer else F.lit("")
        same = (
            F.when(what == "ip", F.array_join(octets, "."))
            .when(what == "phone", _same_shape(unit, h, F.greatest(F.length(unit) - 10, F.lit(0))))
            .when(what == "card", _card(unit, h))
            .when(what == "iban", _same_shape(unit, h, F.lit(2)))
            .when((what == "secret") & unit.rlike("^[0-9a-f]{1,640}$"), hexes)
            .when((what == "secret") & unit.rlike("^[0-9A-F]{1,640}$"), F.upper(hexes))
            .otherwise(_same_shape(unit, h, F.lit(0)))
        )
        fixed = what.isin("ip", "phone", "card", "iban", "secret", "ssn")
        return F.when(what == "email", mail).when(fixed, F.concat(same, extra)).otherwise(_name(unit, h, what, attempt))

    return _let(h0, drawn)


def surrogate_table(units: DataFrame, *, key: str = KEY) -> DataFrame:
    """Distinct ``(type, unit)`` to ``(type, unit, surrogate)``, surrogates
    distinct within a type and none of them a unit of that type."""
    checkpoint_dir(units.sparkSession)
    units = units.select("type", "unit").distinct().checkpoint()
    left, done = units, None
    for attempt in range(_ROUNDS):
        drawn = left.withColumn("surrogate", _draw(attempt, key))
        taken = units.select("type", F.col("unit").alias("surrogate"))
        if done is not None:
            taken = taken.unionAll(done.select("type", "surrogate"))
        free = drawn.groupBy("type", "surrogate").agg(F.min("unit").alias("unit")).join(taken, ["type", "surrogate"], "left_anti")
        won = free.select("type", "unit", "surrogate")
        done = (won if done is None else done.unionAll(won)).checkpoint()
        left = units.join(done, ["type", "unit"], "left_anti").checkpoint()
        if left.isEmpty():
            return done
    raise ValueError(f"surrogates still collide after {_ROUNDS} draws, of which the last are longer than their units: the draws do not differ")


def _render(e: Column, what: Column, got: Column) -> Column:
    """Entity ``e`` with its units replaced by the surrogates ``got``."""

    def cased(w: Column, s: Column) -> Column:
        return F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(s)).otherwise(F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.substr(s, F.lit(2))))

    names = F.zip_with(F.slice(F.split(e, " "), 2, 2), got, cased)
    person = F.concat_ws(" ", _title(e), F.array_join(names, " "))
    nth = lambda i: F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
    chars = F.filter(F.split(e, ""), lambda c: c != "")
    spread = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(got[0], nth(i), F.lit(1))).otherwise(c)), "")
    rest = F.substr(got[0], nth(F.length(e) - 1) + 1)  # of a surrogate that had to be longer
    spread = F.concat(spread, rest)
    loud = (what == "email") & (F.upper(e) == e)
    return F.when(what == "person", person).when(loud, F.upper(got[0])).when(what.isin("email", "ip"), got[0]).otherwise(spread)


def replace_entities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with entities of ``text_col`` replaced, and ``n_entities``."""
    names = [c for c in docs.columns if c != "n_entities"]
    x = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(entities(F.col(text_col)), F.array().cast("array<string>")).alias("__sg_e"))
    clean = x.where(F.size("__sg_e") == 0).select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_entities"))
    touched = x.where(F.size("__sg_e") > 0).withColumn("__sg_k", F.xxhash64(F.col(id_col), F.col(text_col)))
    touched = touched.withColumn("__sg_i", F.col(id_col))

    each = touched.select("__sg_i", "__sg_k", F.posexplode("__sg_e").alias("p", "e")).distinct()
    each = each.withColumn("what", kind(F.col("e")))
    occurring = each.select("__sg_i", "__sg_k", "p", "e", "what", F.posexplode(_units(F.col("e"), F.col("what"))).alias("q", "u")).select("__sg_i", "__sg_k", "p", "e", "what", "q", "u.*")
    occurring = occurring.checkpoint()  # entities only; read for the units and for the replacements
    table = surrogate_table(occurring, key=key)
    got = occurring.join(table, ["type", "unit"])
    per_entity = got.groupBy("__sg_i", "__sg_k", "p", "e", "what").agg(F.sort_array(F.collect_list(F.struct("q", "surrogate"))).alias("s"))
    shown = per_entity.select("__sg_i", "__sg_k", "p", _render(F.col("e"), F.col("what"), F.transform("s", lambda v: v["surrogate"])).alias("r"))
    per_doc = shown.groupBy("__sg_i", "__sg_k").agg(F.sort_array(F.collect_list(F.struct("p", "r"))).alias("__sg_r"))
    per_doc = per_doc.withColumnsRenamed({"__sg_i": "__sg_i2", "__sg_k": "__sg_k2"})

    both = touched.join(per_doc, (F.col("__sg_k") == F.col("__sg_k2")) & F.col("__sg_i").eqNullSafe(F.col("__sg_i2")))
    put = F.array_append(F.transform("__sg_r", lambda v: v["r"]), "")
    text = F.array_join(F.flatten(F.zip_with(F.split(F.col(text_col), PATTERN, -1), put, lambda a, b: F.array(a, b))), "")
    changed = both.select(*[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in names], F.size("__sg_e").cast("long").alias("n_entities"))
    return clean.unionByName(changed)
