"""Replacement of personal data by keyed surrogates, with DataFrame functions only.

Entities are found by one pattern; card numbers also need a right check digit. Each consists of one
or two components (a mailbox and a domain, a given name and a surname, a number), and every distinct
component of the corpus gets a surrogate by a keyed permutation of all values of its shape: digits
for digits, letters of the same case and script for letters, vowels for vowels in names, listed given
names of the same gender, card numbers with the same check-digit remainder. So surrogates drawn
together are distinct by construction. Those that are real values of the corpus, or taken, are drawn
again by another permutation; where a shape is so crowded that a few draws don't do, the surrogate
is longer than any value. Equal components get equal surrogates everywhere, whatever their case,
so "Mr. Smith", "Mr. SMITH" and "John Smith" keep their surname in common, and so does a bare "Smith"
in the same text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import written

# Titles and given names that mark a person, by gender.
TITLES = {"m": "Mr Herr Señor Monsieur Signor", "f": "Mrs Ms Miss Frau Señora Madame Mme Signora", "x": "Dr Prof Professor", "mc": "господин", "fc": "госпожа"}
GIVEN_M = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Edward Peter Henry Juan Carlos Luis Pierre Jean Hans Karl"
GIVEN_F = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Emma Olivia Anna Maria Laura Julia Alice Jane Carmen Sofia Marie Claire Greta Heidi"
GIVEN_MC = "Иван Пётр Сергей Андрей Дмитрий Николай Павел Олег"
GIVEN_FC = "Анна Мария Елена Ольга Наталья Ирина Татьяна Вера"
# The letters of each kind that stand for each other.
VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
CYRILLIC, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", CYRILLIC, CYRILLIC.upper(), GREEK, GREEK.upper())
HEXADECIMAL = ("0123456789", "abcdef", "ABCDEF")
NAMES = (VOWELS, CONSONANTS, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS, GREEK)
ROUNDS = 6
#: Draws before a surrogate becomes longer.
DRAWS = 8

#: A capitalised word, with hyphens and apostrophes inside but no possessive.
_CASED = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))(?=\p{L}))++"
_PERSON = (
    r"(?<![\p{L}\d])(?:(?:" + "|".join(x for v in TITLES.values() for x in v.split()) + r")\.? " + _CASED + "(?: " + _CASED + ")?"
    + "|(?:" + "|".join(f"{GIVEN_M} {GIVEN_F} {GIVEN_MC} {GIVEN_FC}".split()) + ") " + _CASED + ")"
)
#: Type, pattern; the first that matches an entity gives its type.
PATTERNS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("secret", r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?[\"']?)[^\s\"']{6,}+"),
    ("key", r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abp]-[A-Za-z0-9-]{10,}+)(?![\w])"),
    ("iban", r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"),
    ("mac", r"(?<![\w:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])"),
    ("ipv6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("ip", r"(?<![\d.])(?<!(?i:version|release) )(?<!(?i:v|ver)[. ])(?<!(?i:[ (]v))(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("number", r"(?<![\d.,])(?:\d{3}-\d{2}-\d{4}|\d(?:[ -]?\d){12,18})(?![\d]|-\d)"),
    ("phone", r"(?<![\d.,])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d]|[.-]\d)"),
    ("person", _PERSON),
)
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def _code(digest: Column, i) -> Column:
    """A number from 0 to 65,535 for place i, from a hex digest."""
    at = F.pmod(F.lit(4) * i + F.floor(i / 16).cast("int"), F.lit(61)).cast("int") + 1
    return F.conv(digest.substr(at, F.lit(4)), 16, 10).cast("int")


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda x: x != "")


def _permuted(value: Column, alphabets, *keyed: Column) -> Column:
    """A keyed permutation of the strings with letters of the same alphabets in the same places.

    A Feistel network: characters in even and in odd places are shifted in turn within their
    alphabets, by a digest of the others and of keyed. Other characters stay.
    """

    def shifted(c, by):
        out = None
        for letters in alphabets:
            at = F.instr(F.lit(letters), c)
            new = F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))
            out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
        return out.otherwise(c)

    def step(chars, r):
        others = F.array_join(F.filter(chars, lambda c, i: i % 2 != r % 2), "")
        digest = F.sha2(F.concat_ws("\u001f", *keyed, r.cast("string"), F.size(chars).cast("string"), others), 256)
        return _let(digest, lambda d: F.transform(chars, lambda c, i: F.when(i % 2 == r % 2, shifted(c, _code(d, i))).otherwise(c)))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _characters(value), step), "")


def _octets(value: Column, *keyed: Column) -> Column:
    """The same for four numbers under 256."""

    def step(parts, r):
        others = F.array_join(F.transform(F.filter(parts, lambda c, i: i % 2 != r % 2), lambda x: x.cast("string")), ".")
        digest = F.sha2(F.concat_ws("\u001f", *keyed, r.cast("string"), others), 256)
        return _let(digest, lambda d: F.transform(parts, lambda c, i: F.when(i % 2 == r % 2, F.pmod(c + _code(d, i), F.lit(256))).otherwise(c)))

    start = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda x: x.cast("string")), ".")


def _check_sum(digits: Column) -> Column:
    """The sum whose remainder by 10 is 0 for card numbers with a right check digit."""
    each = F.transform(
        _characters(F.reverse(digits)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _listed(names: str, key: str) -> dict[str, str]:
    """Each of some names -> the one after it in a keyed order, the last -> the first; in lower case."""
    order = sorted(names.lower().split(), key=lambda x: hashlib.sha256(f"{key}\u001f{x}".encode()).hexdigest())
    return dict(zip(order, [*order[1:], order[0]]))


def _next(key: str) -> Column:
    """What the keyed permutation of its type makes of a component (type, canon)."""
    kind, v = F.col("type"), F.col("canon")
    size = F.length(v)
    kept = lambda first, last, alphabets: F.concat(
        v.substr(F.lit(1), F.lit(first)),
        _permuted(v.substr(F.lit(first + 1), F.greatest(size - first - last, F.lit(0))), alphabets, F.lit(key), kind, v.substr(F.lit(1), F.lit(first)), v.substr(size - last + 1, F.lit(last)) if last else F.lit("")),
        v.substr(size - last + 1, F.lit(last)) if last else F.lit(""),
    )
    fresh = F.concat(v.substr(F.lit(1), F.lit(1)), _permuted(v.substr(F.lit(2), F.greatest(size - 2, F.lit(0))), PLAIN, F.lit(key), kind, v.substr(F.lit(1), F.lit(1)), F.pmod(_check_sum(v), F.lit(10)).cast("string")))
    number = _let(fresh, lambda x: F.concat(x, F.pmod(_check_sum(v) - _check_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
    tail = F.regexp_extract(v, r"(\.[^.]*)$", 1)
    head = F.regexp_extract(v, r"^(AKIA|gh\w_|sk-|xox\w-)", 1)
    around = lambda before, body, after, alphabets: F.concat(before, _permuted(body, alphabets, F.lit(key), kind, before, after), after)
    return (
        F.when(kind == "ip", _octets(v, F.lit(key)))
        .when(kind == "number", number)
        .when(kind == "phone", kept(1, 0, PLAIN))
        .when(kind == "domain", around(F.lit(""), v.substr(F.lit(1), size - F.length(tail)), tail, PLAIN))
        .when(kind == "iban", kept(2, 0, PLAIN))
        .when(kind == "key", around(head, v.substr(F.length(head) + 1, size - F.length(head)), F.lit(""), PLAIN))
        .when(kind.isin("mac", "ipv6"), _permuted(v, HEXADECIMAL, F.lit(key), kind))
        .when(kind == "secret", F.when(v.rlike("^[0-9a-f]+$"), _permuted(v, HEXADECIMAL, F.lit(key), kind)).otherwise(_permuted(v, PLAIN, F.lit(key), kind)))
        .when(kind == "surname", _permuted(v, NAMES, F.lit(key), kind))
        .when(kind.isin("given_m", "given_f"), kept(0, 1, NAMES))
        .otherwise(_permuted(v, PLAIN, F.lit(key), kind))
    )


def _typed(hits: DataFrame) -> DataFrame:
    """(hit) -> hit, kind, head (kept as it is), first and second component (type, canon), null where there is none."""
    kind = None
    digits = F.regexp_replace("hit", r"\D", "")
    wrong = F.col("hit").rlike(r"^\d(?:[ -]?\d){12,18}$") & (F.pmod(_check_sum(digits), F.lit(10)) != 0)
    for name, pattern in PATTERNS:
        test = F.col("hit").rlike(f"^(?:{pattern})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    d = hits.withColumn("kind", F.when(wrong, F.lit("none")).otherwise(kind.otherwise("secret"))).where("kind != 'none'")
    titles = "|".join(x for v in TITLES.values() for x in v.split())
    title = F.regexp_extract("hit", rf"^((?:{titles})\.? )", 1)
    names = F.split(F.regexp_replace("hit", rf"^(?:{titles})\.? ", ""), " ")
    given = F.when(F.size(names) > 1, names[0])
    word = F.regexp_replace(title, r"[. ]", "")
    female = word.isin(*TITLES["f"].split(), *TITLES["fc"].split()) | given.isin(*GIVEN_F.split(), *GIVEN_FC.split())
    male = word.isin(*TITLES["m"].split(), *TITLES["mc"].split()) | given.isin(*GIVEN_M.split(), *GIVEN_MC.split())
    gender = F.when(female, "given_f").when(male, "given_m").otherwise(F.when(given.rlike("[aeа]$"), "given_f").otherwise("given_m"))
    prefix = r"^((?i:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?[\"']?)"
    part = lambda t, c: F.struct(t.alias("type") if isinstance(t, Column) else F.lit(t).alias("type"), c.alias("canon"))
    is_ = lambda k: F.col("kind") == k
    country = F.regexp_extract("hit", r"^(\+\d{1,3}[ .-]?)", 1)
    return d.select(
        "hit",
        "kind",
        F.when(is_("secret"), F.regexp_extract("hit", prefix, 1)).when(is_("person"), title).when(is_("phone"), country).otherwise("").alias("head"),
        F.when(is_("email"), part("mailbox", F.lower(F.substring_index("hit", "@", 1))))
        .when(is_("secret"), part("secret", F.regexp_replace("hit", prefix, "")))
        .when(is_("number"), part("number", digits))
        .when(is_("phone"), part("phone", F.regexp_replace(F.regexp_replace("hit", r"^\+\d{1,3}[ .-]?", ""), r"\D", "")))
        .when(is_("iban"), part("iban", F.regexp_replace("hit", " ", "")))
        .when(is_("person"), part("surname", F.lower(F.element_at(names, -1))))
        .otherwise(part(F.col("kind"), F.col("hit")))
        .alias("one"),
        F.when(is_("email"), part("domain", F.lower(F.substring_index("hit", "@", -1)))).when(is_("person") & given.isNotNull(), part(gender, F.lower(given))).alias("two"),
    )


def _filled(shape: Column, characters: Column) -> Column:
    """The letters and digits of shape replaced in order by characters."""
    step = lambda a, c: F.when(
        c.rlike(r"^[\p{L}\d]$"), F.struct(F.concat(a["s"], characters.substr(a["k"] + 1, F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step, lambda a: a["s"])


def _cased(new: Column, like: Column) -> Column:
    """A name in lower case, with capitals where like has them."""
    capital = lambda i: F.substr(like, i + 1, F.lit(1)).rlike(r"^\p{Lu}$")
    return F.array_join(F.transform(_characters(new), lambda c, i: F.when(capital(i), F.upper(c)).otherwise(c)), "")


def assigned(components: DataFrame, key: str, draws: int = DRAWS) -> DataFrame:
    """Distinct (type, canon) -> type, canon, surrogate: one to one within a type, and never a real value.

    Given names of the lists stand for each other. All others draw by a keyed permutation of their
    shape, and again by another one where the value is real or taken. What is open after some draws,
    as most values of its shape are real, gets a longer surrogate than any value of its type has.
    """
    given = {"given_m": _listed(GIVEN_M, key) | _listed(GIVEN_MC, key), "given_f": _listed(GIVEN_F, key) | _listed(GIVEN_FC, key)}
    listed = None
    for kind, pairs in given.items():
        table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
        listed = F.when(F.col("type") == kind, table[F.col("canon")]) if listed is None else listed.when(F.col("type") == kind, table[F.col("canon")])
    parts = written(components.withColumn("listed", listed), "components")
    known = parts.where("listed is not null").select("type", "canon", F.col("listed").alias("surrogate"))
    todo = parts.where("listed is null").select("type", "canon")
    # names of the lists are taken, whether or not the corpus has them
    extra = components.sparkSession.createDataFrame([(k, x) for k, pairs in given.items() for x in pairs], "type string, canon string")
    gone = todo.unionByName(extra).select(F.col("type").alias("t"), F.col("canon").alias("c")).distinct()
    numeric = F.col("type").isin("number", "phone", "ip")
    most = todo.groupBy("type").agg(F.max(F.length("canon")).alias("most"))
    done = known
    for draw in range(draws):
        drawn = todo.withColumn("surrogate", _next(f"{key}/{draw}")).join(gone.withColumn("no", F.lit(True)), (F.col("type") == F.col("t")) & (F.col("surrogate") == F.col("c")), "left")
        drawn = written(drawn.select("type", "canon", "surrogate", F.col("no").isNotNull().alias("open")), "drawn")
        fair = drawn.where("not open").select("type", "canon", "surrogate")
        done, todo = done.unionByName(fair), drawn.where("open").select("type", "canon")
        if todo.isEmpty():
            return done
        gone = gone.unionByName(fair.select(F.col("type").alias("t"), F.col("surrogate").alias("c")))
    longer = F.concat("at", F.when(numeric, "1").otherwise("x"), F.repeat(F.when(numeric, "0").otherwise("a"), F.greatest(F.col("most") - F.length("at"), F.lit(0)).cast("int")))
    return done.unionByName(todo.withColumn("at", _next(f"{key}/{draws}")).join(most, "type").select("type", "canon", longer.alias("surrogate")))


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: id, text with surrogates, n_entities.

    Texts without entities, empty texts and null (no entities) stay as they are. Repeated rows get
    equal texts; a corpus and a key determine all surrogates. A surname that stands alone elsewhere
    in a text that names the person is replaced too, and not counted. Texts are read whole, however
    long. An empty table gives an empty table. Only id and text are read, so other columns can't
    clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    hits = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    found = written(rows.select("id", "key", hits.alias("hits")).where(F.size("hits") > 0), "entities").distinct()
    typed = written(_typed(found.select(F.explode("hits").alias("hit")).distinct()), "typed")
    parts = typed.select(F.explode(F.array("one", "two")).alias("p")).where("p is not null").select("p.*").distinct()
    given = written(assigned(parts, key), "surrogates")
    one = given.select(F.col("type").alias("t1"), F.col("canon").alias("c1"), F.col("surrogate").alias("s1"))
    two = given.select(F.col("type").alias("t2"), F.col("canon").alias("c2"), F.col("surrogate").alias("s2"))
    full = typed.join(one, (F.col("one.type") == F.col("t1")) & (F.col("one.canon") == F.col("c1"))).join(two, (F.col("two.type") == F.col("t2")) & (F.col("two.canon") == F.col("c2")), "left")
    kind = F.col("kind")
    tail = F.expr("substring(hit, length(head) + 1)")
    surname = F.element_at(F.split(tail, " "), -1)
    named = _cased(F.col("s1"), surname)
    new = (
        F.when(kind == "email", F.concat("s1", F.lit("@"), "s2"))
        .when(kind == "person", F.concat("head", F.when(F.col("s2").isNull(), named).otherwise(F.concat(_cased(F.col("s2"), F.split(tail, " ")[0]), F.lit(" "), named))))
        .when(kind.isin("number", "phone", "iban"), F.concat("head", _filled(tail, F.col("s1"))))
        .otherwise(F.concat("head", "s1"))
    )
    alone = F.when(kind == "person", F.struct(surname.alias("was"), named.alias("is")))
    swaps = written(full.select("hit", new.alias("new"), alone.alias("alone")), "swaps")
    each = found.select("id", "key", F.posexplode("hits").alias("pos", "hit")).join(swaps, "hit", "left")
    lists = each.groupBy("id", "key").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("new", "hit").alias("new")))).alias("news"), F.count("new").alias("n"), F.array_sort(F.collect_set("alone")).alias("alone")
    )
    lists = lists.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("news.new").alias("news"), "n", "alone").where("n > 0")
    out = rows.join(lists.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    between = F.when(F.col("news").isNotNull(), F.split("text", ENTITY, -1))
    out = out.select("id", "text", "news", "n", "alone", between.alias("between"))
    bare = lambda x: F.concat(F.lit(r"(?<![\p{L}\d'’-])\Q"), x["was"], F.lit(r"\E(?![\p{L}\d]|['’-]\p{L}(?<!['’]s))"))
    rest = F.when(F.size("alone") == 0, F.col("between")).otherwise(
        F.transform("between", lambda part: F.aggregate("alone", part, lambda text, x: F.regexp_replace(text, bare(x), x["is"])))
    )
    text = F.array_join(F.flatten(F.transform(rest, lambda x, i: F.array(x, F.coalesce(F.get("news", i), F.lit(""))))), "")
    return out.select("id", F.when(F.col("news").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"))


def report(docs: DataFrame, key: str = "replace this key") -> DataFrame:
    return replace_private(docs, key).withColumnRenamed("id", "doc_id")
