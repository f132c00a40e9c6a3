"""Personal data replaced by keyed surrogates.

Entities are found by pattern. An entity's canonical form (case, separators and title apart)
names it: all its mentions get the same surrogate, in the format of each mention. Surrogates
are made from a keyed digest character by character: digits become digits, letters become
letters of the same script and case, or Latin ones; names keep their gender's ending, phone
numbers their country, card and account numbers get check digits that hold. A surrogate that
another entity has too, or that is itself an entity of the corpus, is made again with the
next attempt until all are distinct, and grows when its shape may have no value left.

Everything is column expressions; a lambda reads other columns only where these are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.names import by_place, without
from tallyfold.llm.scratch import Scratch

#: What each kind of entity looks like, in order of precedence. No capturing groups.
PATTERNS = (
    ("email", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("card", r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)"),
    ("phone", r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)|(?<!\d)\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("name", r"(?<!\p{L})(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Señor|Señora|Г-н|Г-жа)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?!\p{L})"),
)

#: Country codes of telephone numbers; those not named have three digits. None begins another.
_COUNTRY_CODE = r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Titles of women; the other titles are men's.
_FEMALE = ("Mrs", "Ms", "Frau", "Madame", "Señora", "Г-жа")
#: Syllables and endings of made-up names, by script and gender.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke ko la le lo ma me mo na ne no pa po ra re ro sa se ta te vo wa".split(),
    "cyrillic": "ба бе бо да де до ва ве га ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се та те во за".split(),
}
_ENDINGS = {("latin", True): "lia", ("latin", False): "ric", ("cyrillic", True): "рина", ("cyrillic", False): "рин"}

#: First and last letter of alphabets that a letter stays in.
_ALPHABETS = (("a", "z"), ("A", "Z"), ("α", "ω"), ("Α", "Ρ"), ("а", "я"), ("А", "Я"), ("א", "ת"), ("ぁ", "ん"), ("ァ", "ン"), ("一", "龥"), ("가", "힣"),
              ("ا", "غ"), ("अ", "ह"), ("ก", "ฮ"), ("ա", "ֆ"), ("Ա", "Ֆ"), ("ა", "ჰ"))

MENTION = "|".join(pattern for _, pattern in PATTERNS)
#: What every mention has one of: a digit, an at sign, the start of a secret, or a title. Cheap to look for first.
HINT = r"[0-9@]|[a-f]{32}|[A-F]{32}|AKIA|sk-|gh[pousr]_|[MHFSГ](?:rs?|s|err|rau|onsieur|adame|eñora?|-н|-жа)\.? "
#: Digests chained for one surrogate: hex digits that a value's characters draw from.
_BLOCKS = 4
#: Attempts after which a surrogate gets a character more for each further one, as its shape may have no free value:
#: an address has few values at a short domain, numbers have many.
_GROWN_EMAIL, _GROWN_NUMBER = 3, 8


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern is all of ``mention``; lookarounds see its ends."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity have in common."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    female = F.regexp_extract(mention, r"^(\S+?)\.? ", 1).isin(*_FEMALE)
    person = F.regexp_extract(mention, r"^\S+ (.*)$", 1)
    code = F.regexp_extract(digits, _COUNTRY_CODE, 1)
    phone = F.concat(F.lit("+"), code, F.lit(" "), F.substr(digits, F.char_length(code) + 1))
    return (
        F.when((kind == "phone") & F.startswith(mention, F.lit("+")), phone)
        .when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "name", F.concat(F.when(female, F.lit("f ")).otherwise(F.lit("m ")), person))
        .when(kind == "email", F.lower(mention))
        .otherwise(mention)
    )


def _stream(key: str, *parts: Column) -> Column:
    """Hex digits that depend on a key and the parts; 64 for each block."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{b}")), 256) for b in range(_BLOCKS)))


def _number(stream: Column, i: Column, digits: int = 4) -> Column:
    """A number of four hex digits for the character ``i``."""
    at = (i * digits) % (64 * _BLOCKS - digits) + 1
    return F.conv(F.substr(stream, at, F.lit(digits)), 16, 10).cast("int")


def _letter(c: Column, n: Column) -> Column:
    """A letter of the alphabet of ``c``, a plain Latin one if it is in none of them."""
    out = F.when(c == F.lower(c), F.char(F.lit(97) + n % 26)).otherwise(F.char(F.lit(65) + n % 26))
    for first, last in reversed(_ALPHABETS):
        size, start = ord(last) - ord(first) + 1, ord(first)
        # a character from its number, beyond ASCII too
        point = F.decode(F.unhex(F.lpad(F.hex((F.lit(start) + n % size).cast("long")), 8, "0")), "UTF-32")
        out = F.when(c.between(first, last), point).otherwise(out)
    return out


def _characters(value: Column, stream: Column) -> Column:
    """``value`` with each letter replaced by one of its kind, and each digit of any script by a plain one."""
    return F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(c.rlike(r"\p{N}"), (_number(stream, i) % 10).cast("string"))
            .when(c.rlike(r"\p{L}"), _letter(c, _number(stream, i)))
            .otherwise(c),
        ),
        "",
    )


def _hex_characters(value: Column, stream: Column) -> Column:
    """A secret's characters: hex digits as hex digits if it has no others."""
    hexed = F.substr(F.repeat(stream, 1), F.lit(1), F.char_length(value))
    lower, upper = value.rlike("^[0-9a-f]{32,}$"), value.rlike("^[0-9A-F]{32,}$")
    fits = F.char_length(value) <= 64 * _BLOCKS
    return F.when(lower & fits, hexed).when(upper & fits, F.upper(hexed)).otherwise(_characters(value, stream))


def _made_up(script: str, female: bool, stream: Column, surname: bool, attempt: Column) -> Column:
    """Three syllables, one more for each further attempt, and the gender's ending."""
    syllables = F.array(*(F.lit(s) for s in _SYLLABLES[script]))
    parts = F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.element_at(syllables, _number(stream, i) % len(_SYLLABLES[script]) + 1))
    return F.concat(F.initcap(F.array_join(parts, "")), F.lit("" if surname and script == "latin" else _ENDINGS[script, female]))


def _with_check_digit(digits: Column) -> Column:
    """Digits and the one that makes every other of them doubled, from the right, add up to tens."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + d)
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def _account(country: Column, number: Column) -> Column:
    """An account number of a country: its two check digits leave 1 when all is divided by 97, letters counting from 10."""
    turned = F.concat(number, country, F.lit("00"))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), number)


def _cased(value: Column, like: Column) -> Column:
    """``value`` with capitals where ``like`` has them."""
    letters = F.zip_with(F.split(value, ""), F.split(like, ""), lambda v, c: F.struct(v.alias("v"), c.alias("c")))
    return F.array_join(F.transform(letters, lambda p: F.when(p["c"] != F.lower(p["c"]), F.upper(p["v"])).otherwise(F.coalesce(p["v"], F.lit("")))), "")


def _person(value: Column, given: Column, surname: Column, attempt: Column) -> Column:
    """A name for ``f Given Surname`` or ``m Surname``; surnames are keyed alone, so they agree between forms."""
    names = F.split(F.substr(value, F.lit(3)), " ")
    out = F.lit(None).cast("string")
    for script, is_script in (("latin", F.lit(True)), ("cyrillic", value.rlike(r"\p{IsCyrillic}"))):
        for female in (True, False):
            last = _made_up(script, female, surname, True, attempt)
            whole = F.when(F.size(names) > 1, F.concat(_made_up(script, female, given, False, attempt), F.lit(" "), last)).otherwise(last)
            out = F.when(is_script & (F.substr(value, F.lit(1), F.lit(1)) == ("f" if female else "m")), whole).otherwise(out)
    return F.concat(F.substr(value, F.lit(1), F.lit(2)), out)


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, value, attempt) with ``surrogate``, in canonical form. Countries of phone and account numbers stay.

    The digests become columns first: inside the lambdas they would be made again for each character.
    """
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    tries = attempt.cast("string")
    domain = F.substring_index(value, "@", -1)
    # a domain's addresses stay together, unless its short ones run out; so do the forms of a surname
    group = F.when(kind == "email", domain).otherwise(F.substring_index(value, " ", -1))
    again = F.when((kind != "email") | (attempt > 3), tries).otherwise(F.lit(""))
    streams = entities.withColumns({"__own": _stream(key, kind, value, tries), "__group": _stream(key, F.lit("group"), kind, group, again)})
    # what it has grown by: hex digits as letters for addresses, as digits for numbers
    grown = F.substr("__own", F.lit(129), F.greatest(attempt - F.when(kind == "email", _GROWN_EMAIL).otherwise(_GROWN_NUMBER), F.lit(0)))
    letters, numbers = F.translate(grown, "0123456789", "ghijklmnop"), F.translate(grown, "abcdef", "012345")
    streams = streams.withColumn("__more", F.when(kind == "email", letters).otherwise(numbers))
    stream, of_group, more = F.col("__own"), F.col("__group"), F.col("__more")
    local, host = F.substring_index(value, "@", 1), F.regexp_replace(domain, r"\.[^.]+$", "")
    email = F.concat(_characters(local, stream), more, F.lit("@"), _characters(host, of_group), F.lit(".example"))
    octets = [(_number(stream, F.lit(i)) % (254 if i else 223) + 1).cast("string") for i in range(4)]
    surrogate = (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "secret", _hex_characters(value, stream))
        .when(kind == "name", _person(value, stream, of_group, attempt))
        .when(kind == "iban", _account(F.substr(value, F.lit(1), F.lit(2)), F.concat(_characters(F.substr(value, F.lit(5)), stream), more)))
        .when(kind == "card", _with_check_digit(F.concat(_characters(F.substr(value, F.lit(2)), stream), more)))
        .when(F.contains(value, F.lit(" ")), F.concat(F.substring_index(value, " ", 1), F.lit(" "), _characters(F.substring_index(value, " ", -1), stream), more))
        .otherwise(F.concat(_characters(value, stream), more))
    )
    return streams.withColumn("surrogate", surrogate).drop("__own", "__group", "__more")


def dressed(kind: Column, mention: Column, value: Column) -> Column:
    """A canonical surrogate ``value`` in the format of ``mention``: its separators, title and case. What it has grown by comes last."""
    mark = F.when(kind == "iban", F.lit("[0-9A-Z]")).otherwise(F.lit("[0-9]"))
    other = F.when(kind == "iban", F.lit("[^0-9A-Z]")).otherwise(F.lit("[^0-9]"))
    marks = F.regexp_replace(value, other, F.lit(""))
    # the character at i is the mark whose number is that of the marks up to there
    upto = lambda i: F.char_length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), other, F.lit("")))
    filled = F.array_join(
        F.transform(F.split(mention, ""), lambda c, i: F.when(F.regexp_like(c, mark), F.substr(marks, upto(i), F.lit(1))).otherwise(c)), ""
    )
    filled = F.concat(filled, F.substr(marks, F.char_length(F.regexp_replace(mention, other, F.lit(""))) + 1))
    loud = (mention == F.upper(mention)) & (mention != F.lower(mention))
    title = F.regexp_extract(mention, r"^(\S+ )", 1)
    host = F.regexp_replace(F.substring_index(mention, "@", -1), r"\.[^.]+$", "")
    local, domain = _cased(F.substring_index(value, "@", 1), F.substring_index(mention, "@", 1)), _cased(F.substring_index(value, "@", -1), host)
    mixed = (kind == "email") & (mention != F.lower(mention))
    return (
        F.when((kind == "email") & loud, F.upper(value))
        .when(mixed, F.concat(local, F.lit("@"), domain))
        .when(kind == "name", F.concat(title, F.substr(value, F.lit(3))))
        .when(kind.isin("card", "phone", "ssn", "iban"), filled)
        .otherwise(value)
    )


def entity_map(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, value, attempt, surrogate) for distinct ``entities`` (kind, value), the surrogates of a kind distinct.

    Also no surrogate is a value of its kind. Who came by a surrogate with fewer attempts, then
    the smaller value, keeps it; the others try again, few of them more than once.
    """
    n = entities.count()
    state = scratch.write(with_surrogates(entities.withColumn("attempt", F.lit(0)), key), n)
    known = entities.select("kind", F.col("value").alias("surrogate"))
    while True:
        holders = state.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("holder"))
        holders = holders.join(known, ["kind", "surrogate"], "left_anti").select("kind", F.col("holder.value").alias("value"))
        again = scratch.write(state.join(holders, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), n)
        if again.isEmpty():
            return state
        settled = state.join(again.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(with_surrogates(again, key))
        after = scratch.write(settled, n)
        scratch.drop(state)
        state = after


def replace_entities(
    docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", count: str = "n_entities"
) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced, and a column ``count``; all other columns as they are.

    Texts without an entity, and null ones, are untouched and leave the scan as they came; the
    others are rebuilt from the parts between mentions. Rows are told apart by id and text, so
    ids may be null or repeat. Other columns are named as they like; one of the name ``count``
    gives way to it.
    """
    docs = without(docs, count)
    names = docs.columns
    places = (f"c{names.index(c)}" for c in (doc_id, text))
    return _replaced(by_place(docs), key, *places).toDF(*names, count)


def _replaced(docs: DataFrame, key: str, doc_id: str, text: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    has = F.coalesce(F.regexp_like(text, F.lit(HINT)) & F.regexp_like(text, F.lit(MENTION)), F.lit(False))
    plain = docs.where(~has).withColumn("n_entities", F.lit(0).cast("long"))
    rows = docs.where(has).withColumn("__digest", F.xxhash64(doc_id, text))

    mentions = rows.select("__digest", F.posexplode(F.regexp_extract_all(text, F.lit(MENTION), 0)).alias("__i", "mention"))
    mentions = mentions.withColumn("kind", kind_of(F.col("mention")))
    mentions = scratch.write(mentions.withColumn("value", canonical(F.col("kind"), F.col("mention"))))
    entities = scratch.write(mentions.select("kind", "value").where("kind is not null").distinct(), mentions.count())
    known = entity_map(entities, key, scratch)
    worn = mentions.join(known, ["kind", "value"], "left").select(
        "__digest", "__i", F.coalesce(dressed(F.col("kind"), F.col("mention"), F.col("surrogate")), "mention").alias("worn")
    )
    worn = worn.groupBy("__digest").agg(F.array_sort(F.collect_set(F.struct("__i", "worn"))).alias("__worn"))
    joined = rows.join(worn, "__digest").withColumn("__parts", F.split(text, MENTION, -1))
    rebuilt = F.array_join(F.zip_with("__parts", "__worn", lambda p, w: F.concat(p, F.coalesce(w["worn"], F.lit("")))), "")
    replaced = joined.withColumn(text, rebuilt).withColumn("n_entities", F.size("__worn").cast("long"))
    return plain.unionByName(replaced.select(*docs.columns, "n_entities"))
