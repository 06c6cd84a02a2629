"""Keyed surrogates for personal data. Column expressions only.

Entities are found by one pattern: e-mail addresses, IBANs, secrets in hexadecimal, keys with a known prefix, payment
cards, social security and phone numbers, IPv4 and IPv6 addresses, and names of persons after a form of address or with a
known given name; in a text with persons, their names are found again wherever they stand alone. Each distinct entity (in
its plain form: lower case, without separators) gets a surrogate from a keyed hash: of its type and format, with valid
check digits where its own are valid, a given name of its gender and script, a family name of its script. A surrogate
that another entity took, or that is itself an entity of the corpus, is drawn again, so different entities stay different
and equal ones equal, however they are written. Texts without entities aren't shuffled, nor is a text before its entities
have their surrogates.

Names of persons without form of address or known given name are not found: that takes a model of names, not a pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, quoted

#: Forms of address by gender, given names by gender and script, syllables of family names by script.
MALE_TITLES = "Mr Mister Sir Herr Herrn Monsieur Señor Sr господин г-н κύριος"
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mademoiselle Mme Mlle Señora Señorita Sra госпожа г-жа κυρία"
NEUTRAL_TITLES = "Dr Prof Professor Doctor Doktor"
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Bruno Carlos Daniel David Edward Felix Frank George Henri Hugo Jacob James John Karl Louis Lucas Martin Michael Oscar Paul Peter Pierre Robert Simon Stefan Thomas Walter",
    ("latin", "f"): "Agnes Alice Amelia Anna Carla Carmen Clara Diana Elena Elisabeth Emma Eva Flora Helene Ida Irene Isabel Jane Johanna Julia Laura Lucia Margaret Maria Martha Mary Nina Olivia Sarah Sophie",
    ("cyrillic", "m"): "Александр Алексей Борис Виктор Дмитрий Иван Игорь Михаил Николай Павел Пётр Сергей",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Πέτρος Στέφανος",
    ("greek", "f"): "Άννα Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία",
}
SYLLABLES = {
    "latin": "bal ber bor cal dan dor fal fen gar gil hal har kel ken lam lor mar mel nor pal per ral ren sal sol tal tor val ver wen",
    "cyrillic": "бар бел вол гор дар зим кал кор лан лев мар мир нов пол рад род сав сол тар фед",
    "greek": "βα γα δα θε κα κο λα λι μα μι να νο πα πε ρα σα στα τα φα χα",
}
TYPES = ("email", "key", "iban", "secret", "card", "ssn", "phone", "ipv6", "ip", "person")
#: Draws for one entity before names, e-mail and IP addresses are made longer, and before any other surrogate is.
REDRAWS, LONGER = 8, 24


def _any(words: str) -> str:
    return "|".join(sorted(words.split(), key=lambda w: (-len(w), w)))


#: Holds the first letter of every form of address and given name: most places of a text are out at once. Few ranges, as each costs a test.
_STARTS = r"(?=[A-Z\u0370-\u04ff])"
_NAME = r"\p{Lu}[\p{L}'’]*\p{L}(?:-\p{Lu}\p{L}+)?"
_TITLE = rf"(?:{_any(MALE_TITLES)}|{_any(FEMALE_TITLES)}|{_any(NEUTRAL_TITLES)})\.?"
_KEY = "AKIA|ASIA|sk-(?:proj-|live-|test-)?|gh[pousr]_|xox[baprs]-"
_HEX4 = "[0-9A-Fa-f]{1,4}"
_ALL_GIVEN = _any(" ".join(GIVEN.values()))
#: In this order, so that an e-mail address or a card is not taken apart.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]++\.){1,127}\p{L}{2,24}+",  # a bounded group: each turn of an open one is a stack frame
    "key": rf"(?<![\p{{L}}\p{{N}}])(?:{_KEY})(?=[A-Za-z_\-]*[0-9])[0-9A-Za-z][0-9A-Za-z_\-]{{14,200}}[0-9A-Za-z](?![\p{{L}}\p{{N}}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{N}\-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?=(?:[0-9A-Fa-f]*:){{3}}|[Ff][Ee]80:|2[0-9A-Fa-f]{{3}}:)(?:{_HEX4}(?::{_HEX4}){{0,6}})?::(?:{_HEX4}(?::{_HEX4}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "ip": r"(?<![\p{N}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\p{N})",
    "person": rf"{_STARTS}(?<![\p{{L}}\p{{N}}\-])(?:{_TITLE} {_NAME}(?: {_NAME})?|(?:{_ALL_GIVEN}) {_NAME})(?![\p{{L}}\p{{N}}])",
}
ENTITY = "|".join(f"(?:{PATTERNS[t]})" for t in TYPES)
#: What a text with an entity has, in one class or word: only such texts are searched.
HINT = rf"[0-9@]|{_STARTS}(?<!\p{{L}})(?:{_any(MALE_TITLES)}|{_any(FEMALE_TITLES)}|{_any(NEUTRAL_TITLES)}|{_ALL_GIVEN})(?!\p{{L}})"
_LETTER_ONLY = r"[^\p{L}\p{N}]"


def mentions(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _type(mention: Column) -> Column:
    return F.coalesce(*(F.when(mention.rlike(f"^(?:{PATTERNS[t]})$"), F.lit(t)) for t in TYPES[:-1]), F.lit("person"))


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^(?:{_TITLE} )?", 0)


def _given_of(gender: str) -> str:
    return _any(" ".join(v for (_, g), v in GIVEN.items() if g == gender))


def _gender(mention: Column, title: Column) -> Column:
    """By the form of address, else by the given name; x if neither tells."""
    name = F.substr(mention, F.length(title) + 1)
    by_title = F.when(title.rlike(rf"^(?:{_any(FEMALE_TITLES)})\.? "), "f").when(title.rlike(rf"^(?:{_any(MALE_TITLES)})\.? "), "m")
    return by_title.when(name.rlike(rf"^(?:{_given_of('f')}) "), "f").when(name.rlike(rf"^(?:{_given_of('m')}) "), "m").otherwise("x")


def _names(mention: Column) -> Column:
    """(raw, type) of a person's names; a single one after a form of address is a family name."""

    def of(title: Column) -> Column:
        parts = F.split(F.substr(mention, F.length(title) + 1), " ")
        given = F.concat(F.lit("given-"), _gender(mention, title))
        return F.transform(parts, lambda x, i: F.struct(x.alias("raw"), F.when((F.size(parts) > 1) & (i == 0), given).otherwise(F.lit("family")).alias("type")))

    return let(_title(mention), of)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _again(names: Column) -> Column:
    """The pattern of a text: entities, and its persons' names where they stand alone."""
    alone = F.concat(F.lit(ENTITY + r"|(?:(?<![\p{L}\p{N}\-])(?:"), F.array_join(F.array_distinct(names), "|"), F.lit(r")(?![\p{L}\p{N}]))"))
    return F.when(F.size(names) > 0, alone).otherwise(F.lit(ENTITY))


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(c.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _units(found: DataFrame) -> DataFrame:
    """A row for each part that has a surrogate of its own: a name is a given and a family name, all else is one part.

    unit: its number in the mention; raw: as written; plain: what equal entities have in common.
    """
    rows = found.withColumn("kind", F.when(F.col("role").isNull(), _type(F.col("mention"))).otherwise(F.lit("alone")))
    rows = rows.withColumn("title", F.when(F.col("kind") == "person", _title(F.col("mention"))).otherwise(F.lit("")))
    parts = F.transform(_names(F.col("mention")), lambda x, i: F.struct(i.alias("unit"), x["type"].alias("type"), x["raw"].alias("raw")))
    whole = F.array(F.struct(F.lit(0).alias("unit"), F.coalesce("role", "kind").alias("type"), F.col("mention").alias("raw")))
    own = [c for c in found.columns if c != "role"]
    rows = rows.select(*own, "title", F.explode(F.when(F.col("kind") == "person", parts).otherwise(whole)).alias("u")).select(*own, "title", "u.*")
    bare = F.regexp_replace("raw", _LETTER_ONLY, "")
    plain = F.when(F.col("type").isin("email", "ip", "ipv6") | F.col("type").rlike("^(given|family)"), F.lower("raw")).when(F.col("type") == "key", bare).otherwise(F.lower(bare))
    return rows.withColumn("plain", plain).withColumn("script", _script(F.col("raw")))


def _digit_sum(digits: Column) -> Column:
    """Of a card number, each second digit from the right doubled and cast out of nines."""

    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(account: Column) -> Column:
    """Remainder of an account number, letters as 10 to 35."""

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 87
        return (F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + letter) % 97).cast("int")

    return F.aggregate(F.filter(F.split(account, ""), lambda c: c != ""), F.lit(0), step)


def _number(hex_digest: Column, at: int) -> Column:
    """A number below 2**28 from seven hexadecimal digits."""
    return F.conv(F.substring(hex_digest, at, 7), 16, 10).cast("long")


def _pick(words: str, number: Column) -> Column:
    values = words.split()
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def _digest(key: str) -> Column:
    """128 hexadecimal digits by key, entity and draw."""
    return F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), F.col("type"), F.col("script"), F.col("plain"), F.col("turn"), F.lit(k)), 256) for k in range(2)))


def _draw() -> Column:
    """The surrogate of `plain` at draw `turn`, in plain form; `digest` is a column, computed once for an entity."""
    digest = F.col("digest")

    def letters(script_first: str, n: int, number: Column) -> Column:
        return F.substring(F.lit(script_first), (number % n + 1).cast("int"), 1)

    # each character by one of its kind; the place in the digest is that of the character
    def replaced(c: Column, i: Column) -> Column:
        byte = F.conv(F.substr(digest, i * F.lit(2) % F.lit(126) + F.lit(1), F.lit(2)), 16, 10).cast("int")
        digit = F.when((i == 0) & (c != "0"), byte % 9 + 1).otherwise(byte % 10).cast("string")
        cyrillic, greek, latin = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz"
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), letters(cyrillic, len(cyrillic), byte)).when(c.rlike(r"\p{IsGreek}"), letters(greek, len(greek), byte)).otherwise(letters(latin, len(latin), byte))
        hexes = letters("abcdef", 6, byte)
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{L}"), F.when(F.col("type").isin("secret", "ipv6"), hexes).otherwise(letter)).otherwise(c)

    def filled(s: Column) -> Column:
        return F.array_join(F.transform(F.split(s, ""), replaced), "")

    local, top = F.regexp_extract("plain", "^[^@]*", 0), F.regexp_extract("plain", r"\.(com|org|net)$", 1)
    longer = F.when(F.col("turn") >= REDRAWS, F.substring(digest, 1, 8)).otherwise(F.lit(""))
    email = F.concat(filled(local), longer, F.lit("@"), _pick(SYLLABLES["latin"], _number(digest, 60)), _pick(SYLLABLES["latin"], _number(digest, 70)), F.lit(".example."), F.when(top == "", F.lit("com")).otherwise(top))

    def octet(x: Column, i: Column) -> Column:
        drawn = F.conv(F.substr(digest, i * F.lit(4) + F.lit(1), F.lit(4)), 16, 10).cast("int")
        return F.when((F.length(x) == 3) | (F.col("turn") >= REDRAWS), 100 + drawn % 156).when(F.length(x) == 2, 10 + drawn % 90).otherwise(1 + drawn % 9).cast("string")

    # a format of which all values are in use gets digits at its end
    more = F.when(F.col("turn") >= LONGER, F.lpad((_number(digest, 100) % 10**7).cast("string"), 7, "0")).otherwise(F.lit(""))
    ip = F.concat(F.array_join(F.transform(F.split("plain", r"\."), octet), "."), F.when(F.col("turn") >= LONGER, F.concat(F.lit(":"), more)).otherwise(F.lit("")))
    country = F.substring("plain", 1, 2)

    def account(made: Column) -> Column:
        rest = F.substr(made, F.lit(3))
        valid = _mod97(F.concat(F.substr("plain", F.lit(5)), F.substring("plain", 1, 4))) == 1
        return F.concat(country, F.when(valid, F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(made, 1, 2)), rest)

    def card(made: Column) -> Column:
        head = F.substr(made, F.lit(1), F.length(made) - 1)
        return F.when(_digit_sum(F.col("plain")) % 10 == 0, F.concat(head, ((10 - _digit_sum(F.concat(head, F.lit("0"))) % 10) % 10).cast("string"))).otherwise(made)

    prefix = F.regexp_extract("plain", "^(AKIA|ASIA|sk(?:proj|live|test)?|gh[pousr]|xox[baprs])", 0)
    key_like = F.concat(prefix, filled(F.substr("plain", F.length(prefix) + 1)))

    def given(gender: str) -> Column:
        lists = {s: " ".join(words for (t, g), words in GIVEN.items() if t == s and gender in (g, "x")) for s in SYLLABLES}
        by_script = [F.when(F.col("script") == s, F.concat(_pick(words, _number(digest, 1)), F.when(F.col("turn") > 0, F.concat(F.lit("-"), _pick(words, _number(digest, 9)))).otherwise(F.lit("")))) for s, words in lists.items()]
        more = [F.when(F.col("script") == s, F.concat(_pick(w, _number(digest, 17)), _pick(w, _number(digest, 25)), _pick(w, _number(digest, 33)))) for s, w in SYLLABLES.items()]
        return F.lower(F.when(F.col("turn") < REDRAWS, F.coalesce(*by_script)).otherwise(F.concat(F.coalesce(*by_script), F.coalesce(*more))))

    def family() -> Column:
        out = []
        for s, w in SYLLABLES.items():
            short = F.concat(*(_pick(w, _number(digest, 1 + 8 * k)) for k in range(3)))
            out.append(F.when(F.col("script") == s, F.when(F.col("turn") < REDRAWS, short).otherwise(F.concat(short, *(_pick(w, _number(digest, 41 + 8 * k)) for k in range(4))))))
        return F.coalesce(*out)

    t = F.col("type")
    names = F.when(t == "given-m", given("m")).when(t == "given-f", given("f")).when(t == "given-x", given("x")).when(t == "family", family())
    numbers = F.when(t == "iban", let(filled(F.substr("plain", F.lit(3))), account)).when(t == "card", let(filled(F.col("plain")), card)).when(t == "key", key_like)
    other = F.concat(F.when(t.isin("iban", "card", "key"), numbers).otherwise(filled(F.col("plain"))), more)
    return F.when(t == "email", email).when(t == "ip", ip).when(t.rlike("^(given|family)"), names).otherwise(other)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, script, plain, surrogate) for distinct (type, script, plain): distinct ones, none of which is an entity itself.

    Each round, of the entities that drew one surrogate the least keeps it and the others draw again. Surrogates of formats
    with few values grow: after `REDRAWS` draws addresses and names, after `LONGER` draws all others get more digits.
    So an entity draws from ever more values, and rounds end however many entities there are.
    """
    waiting = checkpoint(entities.select("type", "script", "plain").distinct().withColumn("turn", F.lit(0)))
    taken = waiting.select("type", F.col("plain").alias("surrogate"))
    done: list[DataFrame] = []
    turn = 0
    while not waiting.isEmpty():
        drawn = waiting.withColumn("digest", _digest(key)).withColumn("surrogate", _draw()).drop("digest")
        free = drawn.join(taken, ["type", "surrogate"], "left_anti")
        won = free.groupBy("type", "surrogate").agg(F.min(F.struct("script", "plain")).alias("by")).select("type", "surrogate", "by.script", "by.plain")
        won = checkpoint(won)
        done.append(won)
        taken = taken.unionByName(won.select("type", "surrogate"))  # of checkpoints, one for each round
        turn += 1
        waiting = checkpoint(waiting.join(won, ["type", "script", "plain"], "left_anti").withColumn("turn", F.lit(turn)))
    empty = entities.select("type", "script", "plain", F.col("plain").alias("surrogate")).limit(0)
    return reduce(DataFrame.unionByName, done, empty)


def _written() -> Column:
    """The surrogate as the raw part was written: separators and case kept."""
    raw, new = F.col("raw"), F.col("surrogate")
    before = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), _LETTER_ONLY, ""))

    def char(i: Column) -> Column:
        c, s = F.substr(raw, i, F.lit(1)), F.substr(new, before(i), F.lit(1))
        return F.when(c.rlike(_LETTER_ONLY), c).when(c.rlike(r"\p{Lu}"), F.upper(s)).otherwise(s)

    rest = F.substr(new, before(F.length(raw)) + 1)  # of a surrogate that had to be longer
    shaped = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), char), ""), rest)
    loud = (F.length(raw) > 1) & (raw == F.upper(raw)) & (raw != F.lower(raw))
    name = F.when(loud, F.upper(new)).otherwise(F.array_join(F.transform(F.split(new, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2), F.length(p)))), "-"))
    t = F.col("type")
    return F.when(t == "ip", new).when(t.isin("email", "ipv6"), F.when(loud, F.upper(new)).otherwise(new)).when(t.rlike("^(given|family)"), name).otherwise(shaped)


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with surrogates in the text, and a column n_entities (an own one of that name is replaced).

    A null text stays null, with no entities; empty and clean texts stay as they are. Equal texts get equal replacements,
    repeated rows stay repeated. All other columns stay as they are, whatever their names. A text of any length is read
    whole; nothing in the patterns recurses with it. No rows give no rows.
    """
    if not key:
        raise ValueError("a key is needed")
    names = [c for c in docs.columns if c != "n_entities"]
    packed = docs.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("row"), F.col(quoted(text)).alias("body"))
    packed = packed.withColumn("found", F.coalesce(mentions(F.col("body")), F.array().cast("array<string>")))
    # names of the text's persons, in order; what stands alone has the first one's role
    persons = F.filter("found", lambda m: m.rlike(r"^\p{Lu}|^\p{Ll}-") & (_type(m) == "person"))
    packed = packed.withColumn("parts", F.flatten(F.transform(persons, _names)))
    packed = packed.withColumn("pattern", _again(F.col("parts.raw")))
    packed = packed.withColumn("found", F.when(F.size("parts") > 0, F.regexp_extract_all("body", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    ident = [F.xxhash64("body").alias("id"), F.crc32(F.encode("body", "utf-8")).alias("crc"), F.length("body").alias("n")]
    dirty = packed.where(F.size("found") > 0)
    role = lambda m: F.get("parts.type", F.array_position("parts.raw", m).cast("int") - 1)
    told = F.transform("found", lambda m: F.struct(m.alias("mention"), role(m).alias("role")))
    found = dirty.select(*ident, told.alias("told")).dropDuplicates(["id", "crc", "n"]).select("id", "crc", "n", F.posexplode("told").alias("at", "m")).select("id", "crc", "n", "at", "m.*")
    units = checkpoint(_units(found))
    named = units.join(surrogates(units, key), ["type", "script", "plain"]).withColumn("new", _written())
    # the parts of one mention, then the mentions of one text
    whole = named.groupBy("id", "crc", "n", "at").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("unit", "new"))).alias("parts"))
    whole = whole.withColumn("new", F.concat("title", F.array_join("parts.new", " ")))
    lists = whole.groupBy("id", "crc", "n").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("news"))
    both = dirty.select("row", "body", "pattern", *ident).join(lists, ["id", "crc", "n"])
    gaps = F.split("body", F.col("pattern"), -1)
    made = F.array_join(F.zip_with(gaps, F.concat("news.new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = both.select("row", made.alias("body"), F.size("news").alias("n_entities"))
    clean = packed.where(F.size("found") == 0).select("row", "body", F.lit(0).alias("n_entities"))
    out = changed.unionByName(clean)
    return out.select(*((F.col("body") if c == text else F.col("row").getField(c)).alias(c) for c in names), "n_entities")
