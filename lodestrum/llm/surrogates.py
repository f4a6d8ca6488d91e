"""Replace personal data by keyed surrogates; DataFrame expressions only.

An entity's canonical form (digits of a number, an address or a name in lower
case) is mapped by a keyed permutation of all forms of its format: the places
that may change are cut into two halves, and each half in turn is shifted by a
keyed hash of the other (a Feistel network over digits and letters). One such
encryption, a step on, and the decryption make a permutation that leaves no form
as it was. So every mention, in any document and spelling, gets the same
surrogate, two entities never share one, whatever the table holds, and nothing is
drawn or looked up. Check digits of cards and IBANs are made anew, wrong ones by
as much as they were wrong. Listed given names are permuted within their gender
and script, other names letter by letter, vowels to vowels, with their ending
kept. The surrogate is written in the mention's own format and case. A check over
the distinct entities of the table counts surrogates that two of them share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KEY = "replace-this-key"
#: Given names by gender and script.
NAMES = {
    "f-latin": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Emma", "Olivia", "Sophia", "Laura", "Julia", "Maria", "Anna", "Sophie", "Hannah", "Lucía", "Carmen", "Amélie", "Chloé", "Ingrid", "Petra", "Claudia", "Isabel", "Camille", "Katharina"],
    "m-latin": ["James", "Robert", "John", "Michael", "David", "William", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Paul", "George", "Oliver", "Henry", "Lukas", "Jürgen", "Stefan", "Carlos", "Javier", "François", "Olivier", "Andrés", "Hugo", "Klaus", "Miguel", "Pierre", "Wolfgang"],
    "f-cyrillic": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна"],
    "m-cyrillic": ["Иван", "Сергей", "Дмитрий", "Алексей", "Андрей", "Николай"],
    "f-greek": ["Μαρία", "Ελένη", "Αικατερίνη", "Βασιλική"],
    "m-greek": ["Γεώργιος", "Ιωάννης", "Κωνσταντίνος", "Δημήτριος"],
    "f-arabic": ["فاطمة", "عائشة", "مريم", "زينب"],
    "m-arabic": ["محمد", "أحمد", "يوسف", "إبراهيم"],
    "f-han": ["王芳", "李娜", "张敏", "刘静"],
    "m-han": ["王伟", "李强", "张磊", "刘洋"],
}
#: Words after which a capitalised word is a name.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mme"]
LABELS = ["name is", "Name is", "name:", "Name:", "Contact:", "contact:", "Dear", "Signed by", "signed by"]
#: Letters that stand for one another in names.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ"]
WORD = r"\p{Lu}\p{L}+"


def _listed() -> str:
    """Alternation of the listed names, in their own case or in capitals, tried by first letter."""
    by: dict[str, set[str]] = {}
    for n in (x for group in NAMES.values() for n in group for x in (n, n.upper())):
        by.setdefault(n[0], set()).add(n[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in sorted(by.items()))


#: A listed name, or a capitalised word after a title or label, and a capitalised word after it.
NAME = rf"(?<!\p{{L}})(?=[\p{{Lu}}\p{{Lo}}])(?:(?:{_listed()})(?!\p{{L}})|(?<=(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? ){WORD}|(?<=(?<!\p{{L}})(?:{'|'.join(LABELS)}) ){WORD})(?: {WORD})?"
#: Type and pattern, in the order they are tried; no two can begin at one place of a text otherwise.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    ("card", r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"),
    ("name", NAME),
]
#: What every match but a name holds, cheap to look for: an address's sign, or two digits with no letter between.
CHEAP = r"@|\d[^\p{L}\n]{0,3}\d"
NUMBERS = "|".join(f"(?:{p})" for k, p in PATTERNS if k != "name")
ANY = f"{NUMBERS}|(?:{NAME})"
#: Rounds of the network, each way.
ROUNDS = 3
#: Written around matches while a text is taken apart; the text's own first marks are written OWN meanwhile. No pattern holds them.
MARK, OWN, BORDER = "\x01", "\x01\x02", "\x01\x03"


def permuted_names(key: str) -> dict[str, str]:
    """Every listed name to another of its gender and script, no two to one."""
    out = {}
    for names in NAMES.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|name|{n}".encode()).hexdigest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def kind(surface: Column) -> Column:
    """Type of a matched entity; each is recognised from its own characters."""
    out = F.when(surface.contains("@"), "email").when(surface.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip").when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    out = out.when(surface.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(surface.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card").when(surface.rlike(r"^[+(\d]"), "phone")
    return out.otherwise("name")


def canonical(kind_: Column, surface: Column) -> Column:
    number = F.regexp_replace(surface, r"\D", "")
    octets = F.array_join(F.transform(F.split(surface, r"\."), lambda x: x.cast("int").cast("string")), ".")
    return F.when(kind_.isin("email", "name"), F.lower(surface)).when(kind_ == "iban", F.replace(surface, F.lit(" "))).when(kind_ == "ip", octets).otherwise(number)


def _at(s: Column, i: Column) -> Column:
    """Character i, from 0."""
    return F.substr(s, i + 1, F.lit(1))


def _alphabet(kind_: Column, canon: Column, i: Column) -> Column:
    """The characters that may stand at place i: that of canon alone, or those of its class. Places and classes are the same for every form they lead to."""
    c, size = _at(canon, i), F.length(canon)
    end = F.when(kind_ == "email", F.length(F.substring_index(canon, ".", -1)) + 1).when(kind_.isin("card", "name"), 1).otherwise(0)
    begin = F.when(kind_ == "iban", 4).when(kind_ == "card", 1).when(kind_ == "phone", F.greatest(size - 10, F.lit(0))).otherwise(0)
    out = F.when((i < begin) | (i >= size - end), c)
    lead = (kind_ == "phone") & (i == begin)
    out = out.when(lead & c.isin("0", "1"), "01").when(lead, "23456789")
    out = out.when((kind_ == "ssn") & (i == 0) & c.isin("0", "9"), "09").when((kind_ == "ssn") & (i == 0), "12345678")
    name = kind_ == "name"
    for group in LETTERS:
        out = out.when(name & F.lit(group).contains(c), group)
    out = out.when(c.between("0", "9"), "0123456789").when(~name & c.between("a", "z"), "abcdefghijklmnopqrstuvwxyz")
    return out.when(~name & c.between("A", "Z"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").otherwise(c)


#: First octets of networks of their own, which stay.
OWN_NETS = (10, 127)


def _octet(o: Column, first: Column) -> Column:
    """(v, r) of an octet: 0 to 255; the first of an address within 1 to 223 less OWN_NETS, or within the others."""
    v = o.cast("int")
    common = v - 1 - sum((v > n).cast("int") for n in OWN_NETS)
    cell = lambda x, r: F.struct(x.cast("int").alias("v"), F.lit(r).alias("r"))
    return F.when(~first, cell(v, 256)).when(v.isin(*OWN_NETS), cell(F.lit(0), 1)).when(v.between(1, 223), cell(common, 223 - len(OWN_NETS))).otherwise(cell(F.when(v == 0, 0).otherwise(v - 223), 33))


def _octet_back(v: Column, was: Column, first: Column) -> Column:
    was = was.cast("int")
    common = v + 1
    for n in OWN_NETS:
        common = F.when(common >= n, common + 1).otherwise(common)
    return F.when(~first, v).when(was.isin(*OWN_NETS), was).when(was.between(1, 223), common).when(v == 0, 0).otherwise(v + 223)


def _cells(kind_: Column, canon: Column) -> Column:
    """(v, r) of every place: number of the character among the r that may stand there."""
    places = F.sequence(F.lit(0), F.length(canon) - 1)
    letters = F.transform(F.transform(places, lambda i: F.struct(_alphabet(kind_, canon, i).alias("a"), _at(canon, i).alias("c"))), lambda x: F.struct((F.instr(x["a"], x["c"]) - 1).alias("v"), F.length(x["a"]).alias("r")))
    octets = F.transform(F.split(canon, r"\."), lambda o, i: _octet(o, i == 0))
    return F.when(kind_ == "ip", octets).otherwise(letters)


def _each(column: str, change: Callable[[Column], Column]) -> Column:
    """column, an array of arrays of entities, with every entity changed."""
    return F.transform(column, lambda match: F.transform(match, change))


def _stream(half: Column, other: Column, seed: Column, turn: int) -> Column:
    """Hash of the other half, four hexadecimal digits for every place of half."""
    base = F.concat_ws("|", seed, F.lit(str(turn)), F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ","))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(half) / 16).cast("int")), lambda k: F.sha2(F.concat(base, F.lit("#"), k.cast("string")), 256))
    return F.when(F.size(half) > 0, F.array_join(blocks, "")).otherwise("")


def _shifted(half: Column, stream: Column, sign: int) -> Column:
    return F.transform(half, lambda x, i: F.struct(F.pmod(x["v"] + sign * F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), x["r"]).alias("v"), x["r"].alias("r")))


def _permuted(d: DataFrame, column: str, key: str, also: Callable[[Column], Column]) -> DataFrame:
    """column's entities with field sur permuted, where also() holds, within its format.

    The network encrypts, goes a step on in every place that may change, and decrypts. The
    hash is seeded by the format, so forms of unlike formats do not meet.
    """
    put = lambda out, **fields: out.withColumn(column, _each(column, lambda e: _with(e, {k: f(e) for k, f in fields.items()})))
    empty = F.array().cast("array<struct<v:int,r:int>>")
    d = put(d, cells=lambda e: F.when(also(e), _cells(e["kind"], e["sur"])).otherwise(empty))
    free = lambda e: F.filter(e["cells"], lambda x: x["r"] > 1)

    def seed(e: Column) -> Column:
        # What stays and how many may stand where, the same for both forms; check digits, which follow from the rest, have no part in it.
        check = lambda i: ((e["kind"] == "card") & (i == F.size(e["cells"]) - 1)) | ((e["kind"] == "iban") & i.isin(2, 3))
        stay = F.array_join(F.transform(e["cells"], lambda x, i: F.when((x["r"] == 1) & ~check(i), _at(e["sur"], i)).otherwise(F.lit("?"))), "")
        return F.concat_ws("|", F.lit(key), e["kind"], F.when(e["kind"] == "ip", F.lit("")).otherwise(stay), F.array_join(F.transform(e["cells"], lambda x: x["r"].cast("string")), ","))

    half = lambda e: F.floor(F.size(free(e)) / 2).cast("int")
    d = put(d, seed=seed, a=lambda e: F.slice(free(e), F.lit(1), half(e)), b=lambda e: F.slice(free(e), half(e) + 1, F.size(free(e))))
    step = lambda part: F.transform(part, lambda x: F.struct(F.pmod(x["v"] + 1, x["r"]).alias("v"), x["r"].alias("r")))
    for n, sign in [*((n, 1) for n in range(ROUNDS)), (-1, 0), *((n, -1) for n in reversed(range(ROUNDS)))]:
        if not sign:
            d = put(d, a=lambda e: step(e["a"]), b=lambda e: step(e["b"]))
            continue
        this, other = ("b", "a") if n % 2 else ("a", "b")
        d = put(d, stream=lambda e, this=this, other=other, n=n: _stream(e[this], e[other], e["seed"], n))
        d = put(d, **{this: lambda e, this=this, sign=sign: _shifted(e[this], e["stream"], sign)})
    # The places that may change, in order, take the permuted values.
    places = lambda e: F.filter(F.transform(e["cells"], lambda x, i: F.when(x["r"] > 1, i).otherwise(-1)), lambda i: i >= 0)
    d = put(d, moved=lambda e: F.concat(e["a"], e["b"]), places=places)
    new = lambda e, x, i: F.when(x["r"] == 1, x["v"]).otherwise(F.get(e["moved"], F.array_position(e["places"], i).cast("int") - 1)["v"])
    d = put(d, values=lambda e: F.transform(e["cells"], lambda x, i: new(e, x, i)))
    letters = lambda e: F.array_join(F.transform(e["values"], lambda v, i: _at(_alphabet(e["kind"], e["sur"], i), v)), "")
    octets = lambda e: F.array_join(F.transform(e["values"], lambda v, i: _octet_back(v, F.get(F.split(e["sur"], r"\."), i), i == 0).cast("string")), ".")
    d = put(d, sur=lambda e: F.when(F.size(e["moved"]) == 0, e["sur"]).when(e["kind"] == "ip", octets(e)).otherwise(letters(e)))
    return d.withColumn(column, _each(column, lambda e: e.dropFields("cells", "seed", "a", "b", "stream", "moved", "places", "values")))


def _with(e: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        e = e.withField(name, value)
    return e


def _luhn(body: Column) -> Column:
    """Check digit of a card number's other digits."""
    size = F.length(body)

    def add(acc: Column, i: Column) -> Column:
        d = _at(body, i).cast("int")
        return acc + F.when((size - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.when(size > 0, F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add)).otherwise(0)
    return (10 - total % 10) % 10


def _iban_check(iban: Column) -> Column:
    """Check digits of an IBAN, whatever digits it bears."""
    s = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(2)), F.lit("00"))

    def add(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (F.when(v < 10, acc * 10).otherwise(acc * 100) + v) % 97

    return 98 - F.aggregate(F.transform(F.sequence(F.lit(0), F.length(s) - 1), lambda i: _at(s, i)), F.lit(0), add)


def _listed_in(key: str) -> Callable[[Column, str], Column]:
    table = permuted_names(key)
    return lambda e, field: (e["kind"] == "name") & e[field].isin([x.lower() for x in table])


def with_surrogates(d: DataFrame, column: str, key: str = KEY) -> DataFrame:
    """column, arrays of arrays of structs with kind and canon, with a field sur, itself canonical. A form with nothing that may change stays.

    Listed names have a permutation of their own, so another name that comes out as
    a listed one is permuted again, until it does not: what is left over by the
    list is permuted in itself. That is very rare, and seen in the table that was written.
    """
    listed = _listed_in(key)
    d = d.withColumn(column, _each(column, lambda e: e.withField("sur", e["canon"])))
    d = C.table(_permuted(d, column, key, lambda e: ~listed(e, "canon")), "with-entities")
    on_list = lambda e: ~listed(e, "canon") & listed(e, "sur")
    while not d.where(F.exists(F.flatten(column), on_list)).isEmpty():
        last, d = d, C.table(_permuted(d, column, key, on_list), "with-entities")
        C.drop(last)
    table = F.create_map(*[F.lit(x.lower()) for pair in permuted_names(key).items() for x in pair])
    number = lambda s: F.substr(s, F.lit(1), F.length(s) - 1)
    last = lambda s: _at(s, F.length(s) - 1).cast("int")

    def card(e: Column) -> Column:
        body = number(e["sur"])
        return F.concat(body, F.pmod(_luhn(body) + last(e["canon"]) - _luhn(number(e["canon"])), F.lit(10)).cast("string"))

    def iban(e: Column) -> Column:
        check = F.pmod(_iban_check(e["sur"]) + F.substr(e["canon"], F.lit(3), F.lit(2)).cast("int") - _iban_check(e["canon"]), F.lit(100))
        return F.concat(F.substr(e["sur"], F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), F.substr(e["sur"], F.lit(5), F.length(e["sur"])))

    final = lambda e: F.when(listed(e, "canon"), F.element_at(table, e["canon"])).when(e["kind"] == "card", card(e)).when(e["kind"] == "iban", iban(e)).otherwise(e["sur"])
    return d.withColumn(column, _each(column, lambda e: e.withField("sur", final(e))))


def written(kind_: Column, surface: Column, sur: Column) -> Column:
    """The surrogate in the mention's own format: separators and letter case as they were."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        drop = (kind_.isin("card", "ssn", "phone") & ~c.rlike(r"\d")) | ((kind_ == "iban") & (c == " "))
        s = F.substr(sur, acc["i"], F.lit(1))
        s = F.when(c.rlike(r"\p{Lu}"), F.upper(s)).otherwise(s)
        return F.struct(F.when(drop, acc["i"]).otherwise(acc["i"] + 1).alias("i"), F.concat(acc["out"], F.when(drop, c).otherwise(s)).alias("out"))

    chars = F.transform(F.sequence(F.lit(0), F.length(surface) - 1), lambda i: _at(surface, i))
    each = F.aggregate(chars, start, step, lambda a: a["out"])
    first = F.concat(F.upper(F.substr(sur, F.lit(1), F.lit(1))), F.substr(sur, F.lit(2), F.length(sur)))
    other = F.when((surface == F.upper(surface)) & (F.length(surface) > 1), F.upper(sur)).otherwise(first)
    return F.when(kind_ == "ip", sur).when((kind_ == "name") & (F.length(sur) != F.length(surface)), other).otherwise(each)


def collisions(found: DataFrame) -> int:
    """Number of surrogates that distinct entities (kind, canon, sur) share."""
    return found.distinct().groupBy("kind", "sur").count().where("count > 1").count()


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per row of docs: doc_id, n_entities, text with every entity replaced.

    A null text stays null with no entity. Rows that repeat get the same text each.
    Other columns are not looked at. The key and the entity alone decide a surrogate, so
    no row waits for another; a surrogate may be an entity elsewhere in the table, which has then
    been replaced itself. Addresses without a letter or digit before the last dot, and names
    in scripts without an alphabet here that are not listed, stay as they are.
    """
    docs = docs.select("doc_id", "text")
    has = F.coalesce((F.col("text").rlike(CHEAP) & F.col("text").rlike(NUMBERS)) | F.col("text").rlike(NAME), F.lit(False))
    # Matches are marked in one pass; the text's own marks are written otherwise meanwhile.
    marked = F.regexp_replace(F.replace("text", F.lit(MARK), F.lit(OWN)), F.lit(ANY), F.lit(f"{BORDER}$0{BORDER}"))
    d = docs.where(has).select("doc_id", F.split(marked, BORDER, -1).alias("parts"))
    plain = lambda x: F.replace(x, F.lit(OWN), F.lit(MARK))
    odd = F.transform(F.filter("parts", lambda x, i: i % 2 == 1), lambda x: F.struct(x.alias("surface"), kind(x).alias("kind")))
    d = d.select("doc_id", F.transform(F.filter("parts", lambda x, i: i % 2 == 0), plain).alias("gaps"), odd.alias("odd"))
    # A match is one entity; a name is one for each of its words.
    split = lambda x: F.when(x["kind"] == "name", F.split(x["surface"], " ")).otherwise(F.array(x["surface"]))
    found = F.transform("odd", lambda x: F.transform(split(x), lambda s: F.struct(x["kind"].alias("kind"), s.alias("surface"), canonical(x["kind"], s).alias("canon"))))
    d = with_surrogates(d.select("doc_id", "gaps", found.alias("found")), "found", key)
    d = d.withColumn("found", _each("found", lambda e: e.withField("new", written(e["kind"], e["surface"], e["sur"])).dropFields("surface")))
    shared = collisions(d.select(F.explode(F.flatten("found")).alias("e")).select("e.kind", "e.canon", "e.sur"))
    if shared:
        raise RuntimeError(f"{shared} surrogates stand for two entities each")
    # Gaps and matches in order of place, joined; words of one name by a space.
    pieces = F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.array_join(F.transform(F.get("found", i), lambda e: e["new"]), " "), F.lit(""))))
    texts = d.select("doc_id", F.size("found").cast("long").alias("n_entities"), F.array_join(pieces, "").alias("text"))
    return docs.where(~has).select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text").union(texts)
