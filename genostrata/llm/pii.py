"""Surrogates for personal data in whole texts, with DataFrame functions only.

Entities are found by one pattern. Each is made of units that co-refer wherever they stand: an
address in lower case, the digits of a number whatever its format, a given name, a family name. A
unit's surrogate is a function of a key, its kind, itself and an attempt, so it is the same in all
texts; it keeps the kind's form: digits stay digits, letters stay letters, check digits stay valid,
reserved domains and country codes stay, given names keep their gender, names their script, and
every occurrence its own format and case.

All distinct units are checked for collisions: units of a kind whose surrogates are equal, or equal
to a unit that occurs, go to their next attempt, but for the first of them, until none collide. Only
units beyond their first attempt have to be looked up; all others are computed where they stand, so
no text is shuffled unless the looked-up ones were counted to be too many to broadcast.

Defined results: a null text stays null with no entity; texts without entities stay as they are;
of overlapping matches the leftmost counts, then the kind listed first; ties between units go by
their hash; repeated rows each keep their row; input columns stay, except those named as the output;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable

# Forms of address and given names by gender, and the pieces that names are made of.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "госпожа")
OPEN_TITLES = ("Dr", "Prof")
MALE_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Hans Klaus Jürgen Wolfgang Pierre Jean Jacques Luis Carlos Juan José Miguel Иван Пётр Сергей Алексей Дмитрий".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Ursula Monika Petra Sabine Marie Claire Sophie Camille María Carmen Ana Isabel Анна Мария Елена Ольга Наталья".split()
CONSONANTS = {"latin": list("bdfgklmnprstvz"), "cyrillic": list("бдгклмнпрствз"), "greek": list("βγδζκλμνπρστφ")}
VOWELS = {"latin": list("aeiou"), "cyrillic": list("аеиоу"), "greek": list("αεηιο")}
MALE_ENDS = {"latin": list("nrs"), "cyrillic": list("нрс"), "greek": list("νρς")}
FEMALE_ENDS = {"latin": ["a"], "cyrillic": ["а"], "greek": ["α"]}
#: Letters of scripts for the letters of an address; other scripts' become ASCII letters.
SCRIPTS = {
    "IsCyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "IsGreek": "αβγδεζηθικλμνξοπρστυφχψω",
    "IsHan": "".join(map(chr, range(0x4E00, 0x5600))),
    "IsHiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "IsKatakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "IsHangul": "".join(map(chr, range(0xAC00, 0xB400))),
    "IsArabic": "بتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "IsHebrew": "אבגדהוזחטיכלמנסעפצקרשת",
}

#: Attempts after which the space of a form counts as full. Addresses grow by a letter every four attempts.
MOST_ATTEMPTS = 100

#: How telephone country codes begin, and so how many digits they have.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"

NAME = r"\p{Lu}[\p{L}'’-]+"
#: What stands before any entity. Tried first, it fails at once within words.
EDGE, STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
NAMED = "|".join(n for x in MALE_NAMES + FEMALE_NAMES for n in (x, x.upper()))
#: (kind, pattern after EDGE), in order of precedence at one place.
PATTERNS = (
    ("email", r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}" + STOP),
    ("ip", r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])"),
    ("ip6", r"(?<!:)(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{2,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![\p{L}\p{N}:])"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + STOP),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9\p{L}])"),
    ("card", r"(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19})" + STOP),
    ("phone", r"(?<![+]|[0-9][.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\p{L}\p{N}]|[.-][0-9])"),
    ("phone", r"(?<![+])\+[0-9]{8,15}" + STOP),
    ("person", r"(?=[\p{Lu}г])(?:(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES) + rf")\.? (?:{NAME} ){{0,2}}{NAME}|(?:{NAMED}) {NAME})" + STOP),
)
ENTITY = EDGE + "(?:" + "|".join(p for _, p in PATTERNS) + ")"
TITLE = r"^(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES) + r")\.? "


def kind_of(value: Column) -> Column:
    whole = None
    for kind, p in PATTERNS:
        # the value was matched in its text: what stood around it is not looked at again
        c = value.rlike(f"^(?:{p})$")
        whole = F.when(c, F.lit(kind)) if whole is None else whole.when(c, F.lit(kind))
    return whole


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def digest(key: str, kind: Column, unit: Column, attempt: Column) -> Column:
    """256 hexadecimal digits."""
    base = F.concat_ws("\u0001", F.lit(key), kind, unit, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(base, F.lit(f"\u0001{i}")), 256) for i in range(4)))


def drawn(h: Column, i: Column, n: int) -> Column:
    """A number below n from place i of a digest."""
    return F.conv(F.substr(h, F.pmod(i * 3, F.lit(252)) + 1, F.lit(3)), 16, 10).cast("int") % n


def letters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def remade(x: Column, h: Column, scripts: bool = False) -> Column:
    """x with each ASCII digit and letter replaced by a drawn one of its class, and if asked for, those
    of all scripts: letters by letters of theirs, or else ASCII ones, and digits by ASCII ones."""

    def one(c: Column, i: Column) -> Column:
        made = (
            F.when(c.between("0", "9"), drawn(h, i, 10).cast("string"))
            .when(c.between("a", "z"), F.char(drawn(h, i, 26) + 97))
            .when(c.between("A", "Z"), F.char(drawn(h, i, 26) + 65))
        )
        if scripts:
            for script, own in SCRIPTS.items():
                made = made.when(c.rlike(rf"^(?=\p{{L}})\p{{{script}}}"), F.substr(F.lit(own), drawn(h, i, len(own)) + 1, F.lit(1)))
            made = made.when(c.rlike(r"\p{L}"), F.char(drawn(h, i, 26) + 97)).when(c.rlike(r"\p{N}"), drawn(h, i, 10).cast("string"))
        return made.otherwise(c)

    return F.array_join(F.transform(letters(x), one), "")


def hexed(x: Column, h: Column) -> Column:
    """x with each hexadecimal digit replaced by a drawn one, a group's first by one that isn't 0."""
    return F.array_join(F.transform(letters(x), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(drawn(h, i, 15) + 1)))), "")


def mod97(x: Column) -> Column:
    """Check sum of a bank account number whose first four places were moved to its end: 1 if valid."""

    def add(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(letters(x), F.lit(0), add)


def luhn(digits: Column) -> Column:
    """Check sum of a number: 0 if valid."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return s + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def word(h: Column, attempt: Column, kind: Column, unit: Column) -> Column:
    """A name in the script: three syllables and an end of its gender, or four for family names."""

    def made(script: str) -> Column:
        c, v = (F.array(*map(F.lit, x[script])) for x in (CONSONANTS, VOWELS))
        count = F.when(kind == "family", 4).otherwise(3) + F.least(attempt, F.lit(4))
        body = F.array_join(
            F.transform(
                F.sequence(F.lit(1), count),
                lambda i: F.concat(F.get(c, drawn(h, i * 2, len(CONSONANTS[script]))), F.get(v, drawn(h, i * 2 + 1, len(VOWELS[script])))),
            ),
            "",
        )
        male, female = (F.array(*map(F.lit, x[script])) for x in (MALE_ENDS, FEMALE_ENDS))
        ends = F.when(kind == "given_f", F.concat(F.get(c, drawn(h, F.lit(40), 13)), F.get(female, F.lit(0)))).when(kind == "given_m", F.get(male, drawn(h, F.lit(40), 3))).otherwise(F.lit(""))
        return F.concat(body, ends)

    return F.when(unit.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(unit.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def surrogate(key: str, kind: Column, unit: Column, attempt: Column) -> Column:
    return let(digest(key, kind, unit, attempt), lambda h: of_kind(h, kind, unit, attempt))


def of_kind(h: Column, kind: Column, unit: Column, attempt: Column) -> Column:
    tail = F.coalesce(
        F.nullif(F.regexp_extract(unit, r"(?<=[@.])example\.(?:com|net|org)$", 0), F.lit("")), F.regexp_extract(unit, r"\.[a-z]+$", 0)
    )

    def email(tail: Column) -> Column:
        head = F.substr(unit, F.lit(1), F.length(unit) - F.length(tail))
        return F.concat(remade(F.concat(F.repeat(F.lit("a"), F.floor(attempt / 4).cast("int")), head), h, scripts=True), tail)

    def card(body: Column) -> Column:
        check = let(F.concat(body, F.lit("0")), lambda x: F.pmod(10 - luhn(x), F.lit(10)).cast("string"))
        last = remade(F.substr(unit, F.length(unit), F.lit(1)), F.substr(h, F.lit(100), F.lit(150)))
        return F.concat(body, F.when(luhn(unit) == 0, check).otherwise(last))

    def iban(account: Column) -> Column:
        country = F.substr(unit, F.lit(1), F.lit(2))
        valid = mod97(F.concat(F.substr(unit, F.lit(5)), F.substr(unit, F.lit(1), F.lit(4)))) == 1
        check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, F.when(valid, check).otherwise(remade(F.substr(unit, F.lit(3), F.lit(2)), F.substr(h, F.lit(100), F.lit(150)))), account)

    body = F.concat(F.substr(unit, F.lit(1), F.lit(1)), remade(F.substr(unit, F.lit(2), F.length(unit) - 2), h))
    octet = [(drawn(h, F.lit(i), 254) + 1).cast("string") for i in range(4)]
    return (
        F.when(kind == "email", let(tail, email))
        .when(kind == "card", let(body, card))
        .when(kind == "phone", let(F.regexp_extract(unit, COUNTRY, 0), lambda code: F.concat(code, remade(F.substr(unit, F.length(code) + 1), h))))
        .when(kind == "ip6", hexed(unit, h))
        .when(kind == "iban", let(remade(F.substr(unit, F.lit(5)), h), iban))
        .when(kind == "ip", F.concat_ws(".", *octet))
        .when(kind == "ssn", remade(unit, h))
        .otherwise(word(h, attempt, kind, unit))
    )


def units(value: Column) -> Column:
    """The (kind, unit, shown) parts of an entity, in order; shown is the text that the unit stands for."""
    return let(kind_of(value), lambda kind: units_of(kind, value))


def units_of(kind: Column, value: Column) -> Column:
    number = F.regexp_replace(value, "[^0-9A-Z+]", "")
    title = F.regexp_extract(value, TITLE, 0)
    names = F.split(F.substr(value, F.length(title) + 1), " ")
    called = F.regexp_replace(title, r"\.? $", "")
    first = F.get(names, F.lit(0))
    gender = (
        F.when(called.isin(*MALE_TITLES) | F.initcap(first).isin(*MALE_NAMES), "given_m").when(called.isin(*FEMALE_TITLES) | F.initcap(first).isin(*FEMALE_NAMES), "given_f").otherwise("given")
    )

    def part(k: Column, u: Column, shown: Column) -> Column:
        return F.struct(k.alias("kind"), u.alias("unit"), shown.alias("shown"))

    person = F.transform(names, lambda x, i: part(F.when(i == F.size(names) - 1, "family").otherwise(gender), F.lower(x), x))
    unit = F.when(kind.isin("email", "ip6"), F.lower(value)).when(kind == "ip", value).otherwise(number)
    return F.when(kind == "person", person).otherwise(F.array(part(kind, unit, value)))


def spread(shown: Column, made: Column) -> Column:
    """The characters of `made` in the places of the digits and capitals of `shown`."""

    def step(acc: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Z+]")
        return F.struct(
            F.concat(acc["out"], F.when(own, F.substr(made, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (acc["i"] + F.when(own, 1).otherwise(0)).alias("i"),
        )

    return F.aggregate(letters(shown), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: acc["out"])


def rendered(key: str, value: Column, attempts: Column) -> Column:
    """An entity with surrogates for its units, in its own format and case."""

    def cased(p: Column, made: Column) -> Column:
        upper = (p["shown"] == F.upper(p["shown"])) & (p["shown"] != F.lower(p["shown"]))
        name = p["kind"].isin("family", "given", "given_m", "given_f")
        text = F.when(upper, F.upper(made)).when(name, F.initcap(made)).otherwise(made)
        return F.when(p["kind"].isin("card", "phone", "ssn", "iban"), spread(p["shown"], made)).otherwise(text)

    def one(p: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(attempts, F.concat_ws("\u0001", p["kind"], p["unit"])), F.lit(0))
        return let(attempt, lambda n: let(surrogate(key, p["kind"], p["unit"], n), lambda made: cased(p, made)))

    return F.concat(F.regexp_extract(value, TITLE, 0), F.array_join(F.transform(units(value), one), " "))


def found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def unit_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """All distinct (kind, unit) of the texts."""
    values = docs.select(F.explode(found(F.col(f"`{text}`"))).alias("value")).distinct()
    return values.select(F.explode(units(F.col("value"))).alias("p")).select("p.kind", "p.unit").distinct()


def attempts(known: DataFrame, key: str) -> DataFrame:
    """known with the attempt and the surrogate of each unit, none equal within a kind, and none
    equal to a unit that occurs."""
    now = durable(known.withColumn("attempt", F.lit(0)).withColumn("made", surrogate(key, F.col("kind"), F.col("unit"), F.lit(0))))
    while True:
        turn = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", F.xxhash64("unit"), "unit"))
        taken = known.select("kind", F.col("unit").alias("made"), F.lit(True).alias("occurs"))
        judged = now.withColumn("turn", turn).join(taken, ["kind", "made"], "left").withColumn("clash", (F.col("turn") > 1) | F.col("occurs").isNotNull())
        judged = durable(judged.select("kind", "unit", "attempt", "made", "clash"))
        most = judged.where("clash").agg(F.max("attempt")).first()[0]
        if most is None:
            return now
        if most >= MOST_ATTEMPTS:
            raise ValueError("the units of a kind leave no room for as many distinct surrogates of their form")
        # a column of its own: in one select, an alias could stand in for the column of its name within lambdas
        turned = judged.withColumn("next", F.col("attempt") + F.col("clash").cast("int"))
        made = F.when(F.col("clash"), surrogate(key, F.col("kind"), F.col("unit"), F.col("next"))).otherwise(F.col("made"))
        now = durable(turned.select("kind", "unit", F.col("next").alias("attempt"), made.alias("made")))


def replace(docs: DataFrame, key: str, text: str = "text", into: str = "text", count: str = "n_entities") -> DataFrame:
    """docs with surrogates in the place of all entities of each whole text, and their number."""
    names = [c for c in docs.columns if c not in (into, count)]
    known = durable(unit_table(docs, text))
    moved = durable(attempts(known, key).where("attempt > 0").select("kind", "unit", "attempt"))
    # the rows travel in one column, whatever their columns are named
    whole = F.col(f"`{text}`")
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), whole.alias("_text"), found(whole).alias("_found")) if names else docs.select(whole.alias("_text"), found(whole).alias("_found"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    n = moved.limit(BROADCAST_ROWS + 1).count()
    if n:
        few = n <= BROADCAST_ROWS
        texts = docs.select(F.xxhash64(whole).alias("_hash"), F.explode(found(whole)).alias("value")).select("_hash", F.explode(units(F.col("value"))).alias("p")).select("_hash", "p.kind", "p.unit").distinct()
        maps = texts.join(F.broadcast(moved) if few else moved, ["kind", "unit"]).groupBy("_hash").agg(
            F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\u0001", "kind", "unit"), "attempt"))).alias("_attempts")
        )
        source = source.withColumn("_hash", F.xxhash64("_text")).join(maps, "_hash", "left").withColumn("_attempts", F.coalesce("_attempts", none)).drop("_hash")
    else:
        source = source.withColumn("_attempts", none)
    pieces = F.split("_text", ENTITY, -1)
    made = F.transform("_found", lambda v: rendered(key, v, F.col("_attempts")))
    joined = F.array_join(F.zip_with(pieces, F.concat(made, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    row = [F.col("_row")] if names else []
    # two steps: in one select, an alias could stand in for the column of its name within lambdas
    out = source.select(*row, F.when(F.size("_found") > 0, joined).otherwise(F.col("_text")).alias("_made"), F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("_n"))
    return out.select(*(F.col(f"_row.`{c}`") for c in names), F.col("_made").alias(into), F.col("_n").alias(count))
