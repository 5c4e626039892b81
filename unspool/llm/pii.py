"""Surrogates for personal data and secrets, in DataFrame operations only.

One pattern finds the entities of a text. Each gets a keyed replacement of its own type and form:
addresses keep their shape and script under a reserved domain, numbers their length, separators and
check digit, network addresses stay dotted quads (in the reserved range 240/4), secrets keep length
and alphabet. A name after a title is replaced by its parts, a given name of the same gender and
script and a last name of the same script, so Mrs Mary Jones, Mr Jones and Mrs JONES keep one last
name; the same full name without a title goes too where the text has it with one. The replacement
is a function of the key and of the entity's normal form, so mentions of one entity agree everywhere
(coreference): in any letter case, with other separators, a number with or without the country
code +1. Other country codes are part of the number. All distinct entities of the table are checked: where two would
share a replacement, or a replacement is itself an entity of the table, all but one take the next of
their candidates, until none collide (distinctness). The first few candidates of an entity have its
own form; later ones grow with the attempt (a label before example.<tld>, syllables, letters, digits,
an IPv6 address of the range for documentation), so no number of entities uses them up.

The pattern runs once over each text, which is written with its parts; entities and new texts are
made from that table, without a shuffle of texts. The few entities that needed a later candidate
travel in the expression up to INLINE_RETRIES, beyond that by a join on the row.

Defined results: a null text stays null, an empty one empty, both without entities; a text of any
length is searched whole; repeated rows are rewritten alike; ties between colliding entities go to
the smaller by code point; an empty table gives an empty result. Columns beside text pass through,
whatever their names; n_entities is replaced.
"""

from __future__ import annotations

import secrets
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unspool.llm.common import LOWER, UPPER, delete, materialize, written

INLINE_RETRIES = 2_000
#: Random keys by application.
_own_keys: dict[str, str] = {}
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
#: Titles by gender; the script of the name decides the list that it is drawn from.
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа|Κυρία|Κα"
_MALE = "Mr|Herr|Monsieur|Señor|Sr|Г-н|Господин|Κύριος|Κος"
_NAME = "\\p{Lu}\\p{L}+(?:['-]\\p{Lu}\\p{L}+)?"
#: Kind and pattern; at one place the first that matches counts.
PATTERNS = (
    ("secret", "\\b(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth[_-]?token)\\b[\"']?\\s{0,4}[:=]\\s{0,4}[\"']?(?=[^\\s\"'<>,;]*\\d)[^\\s\"'<>,;]{6,}"),
    ("access_key", "\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b"),
    ("email", "(?<![._%+-])[\\p{L}\\p{N}._%+-]++@[\\p{L}\\p{N}-]++(?:\\.[\\p{L}\\p{N}-]++)+"),
    ("iban", "\\b[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\\b"),
    ("ip", f"(?<![\\w.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![\\w]|\\.\\d)"),
    ("phone", "(?<![\\w+])(?:\\+\\d{1,3}[ .-]?)?\\(\\d{2,4}\\)[ .-]?\\d{3,4}[ .-]?\\d{3,4}(?!\\d)|(?<![\\w+])\\+\\d{1,3}(?:[ .-]?\\d{2,4}){2,4}(?!\\d)|(?<![\\w.+-])\\d{3}[.-]\\d{3}[.-]\\d{4}(?![\\w-])"),
    ("national_id", "(?<![\\w-])\\d{3}-\\d{2}-\\d{4}(?![\\w-])"),
    ("card", "(?<![\\w.+-])(?:\\d{13,19}|\\d{4}[ -]\\d{4}[ -]\\d{4}[ -]\\d{1,7})(?![\\w])"),
    ("female", f"\\b(?:{_FEMALE})\\.? {_NAME}(?: {_NAME})?"),
    ("male", f"\\b(?:{_MALE})\\.? {_NAME}(?: {_NAME})?"),
)
#: An entity begins where no letter, digit or underscore stands before.
ANY = "(?<![\\p{L}\\p{N}_])(?:" + "|".join(f"(?:{p})" for _, p in PATTERNS) + ")"
_TITLE = f"^(?:{_FEMALE}|{_MALE})\\.? "
#: What a secret's mention has before its value.
_BEFORE_VALUE = "^[A-Za-z_-]+[\"']?\\s{0,4}[:=]\\s{0,4}[\"']?"
#: First names by gender and script; last names are put together from syllables.
FIRST = {
    ("female", "latin"): ("Anna", "Clara", "Elena", "Greta", "Ines", "Julia", "Laura", "Marta", "Nora", "Paula", "Rosa", "Sofia", "Teresa", "Vera", "Alice", "Emma"),
    ("male", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Leo", "Marco", "Oscar", "Paul", "Robert", "Simon", "Tomas", "Victor"),
    ("female", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("male", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Олег", "Павел", "Роман", "Юрий"),
    ("female", "greek"): ("Άννα", "Ελένη", "Ζωή", "Θεοδώρα", "Ιωάννα", "Μαρία", "Σοφία", "Χριστίνα"),
    ("male", "greek"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος", "Χρήστος"),
}
SYLLABLES = {
    "latin": ("bar", "cal", "den", "fel", "gar", "hol", "kel", "lan", "mar", "nor", "pel", "ran", "sel", "tor", "ver", "wil"),
    "greek": ("βαρ", "γαλ", "δελ", "ζαν", "θεμ", "καλ", "λαμ", "μαρ", "νικ", "παλ", "ρον", "σαλ", "τιν", "φιλ", "χαρ", "ψαλ"),
    "cyrillic": ("бар", "вел", "гор", "дан", "зор", "кал", "лад", "мир", "нов", "пол", "рад", "сол", "тар", "фед", "хол", "чер"),
}

#: Candidates in an entity's own form before they grow: more for forms that have millions of them.
OWN_FORM, OWN_FORM_NUMBERS = 3, 16
_NUMBERS = ("ip", "phone", "card", "national_id", "iban", "access_key")
#: First and last code point of letters beyond the Latin script, or of digits, that are replaced by one another.
_RANGES = (
    (0x386, 0x3AB), (0x3AC, 0x3CE), (0x400, 0x42F), (0x430, 0x45F), (0x531, 0x556), (0x561, 0x586), (0x10D0, 0x10F0),
    (0x5D0, 0x5EA), (0x620, 0x65F), (0x660, 0x669), (0x66E, 0x6D5), (0x6F0, 0x6F9), (0x904, 0x939), (0x966, 0x96F), (0x985, 0x9B9), (0x9E6, 0x9EF), (0xA05, 0xA39), (0xA85, 0xAB9), (0xB05, 0xB39),
    (0xB83, 0xBB9), (0xC05, 0xC39), (0xC85, 0xCB9), (0xD05, 0xD39), (0xD85, 0xDC6), (0xE01, 0xE2E), (0xE50, 0xE59), (0xE81, 0xEAE), (0xF40, 0xF6C), (0x1000, 0x1021), (0x1200, 0x135A),
    (0x1780, 0x17B3), (0x1820, 0x1878), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3105, 0x312F), (0x3400, 0x4DB5), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF10, 0xFF19), (0xFF66, 0xFF9D),
)
#: Each range with the letters or digits of its last one's kind that are drawn for it, 1,024 at most.
_DRAWN = [(a, b, "".join(c for c in map(chr, range(a, b + 1)) if unicodedata.category(c) in ("Lo", "Nd", unicodedata.category(chr(b))))[:1024]) for a, b in _RANGES]
#: Stands around each mention where the pattern marks it; a text that has it itself is cut in two steps.
_MARK = "\x1e"


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mentions(text: Column) -> Column:
    """The entities of a text as they are written, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(mention: Column) -> Column:
    out = F.lit(PATTERNS[-1][0])
    for kind, pattern in reversed(PATTERNS[:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def normal(kind: Column, mention: Column) -> Column:
    """The form in which mentions of one entity agree; that of a name is its lower-cased words."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.regexp_replace(digits, "^1(?=[0-9]{10}$)", ""))
        .when(kind.isin("card", "national_id"), digits)
        .when(kind == "email", F.translate(mention, UPPER, LOWER))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", F.regexp_replace(mention, _BEFORE_VALUE, ""))
        .when(kind.isin("female", "male"), F.lower(F.regexp_replace(mention, _TITLE, "")))
        .otherwise(mention)
    )


def pieces(kind: Column, norm: Column) -> Column:
    """What is replaced by itself, as array of struct(kind, norm): a name's given name (of its gender) and last name, else the entity."""
    one = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    given, last = F.substring_index(norm, " ", 1), F.substring_index(norm, " ", -1)
    names = F.when(norm.contains(" "), F.array(one(kind, given), one(F.lit("last"), last))).otherwise(F.array(one(F.lit("last"), last)))
    return F.when(kind.isin("female", "male"), names).otherwise(F.array(one(kind, norm)))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 keyed hexadecimal digits for an entity's candidate."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f2")), 256))


def _number(stream: Column, place: Column | int, below: Column | int) -> Column:
    """The place-th keyed number under `below` (at most 1,024 choices, nearly even)."""
    at = (F.lit(place) if isinstance(place, int) else place) % 31
    return (F.conv(F.substring(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _shape(text: Column, stream: Column, digits: str = "0123456789", lower: str = LOWER, upper: str = UPPER) -> Column:
    """text with each Latin letter and each ASCII digit replaced by a keyed one of its class."""
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        pick = lambda alphabet: F.substring(F.lit(alphabet), _number(stream, i, len(alphabet)) + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), pick(digits)).when(c.rlike("^[\\p{IsLatin}&&\\p{Lu}]$"), pick(upper)).when(c.rlike("^\\p{IsLatin}$"), pick(lower)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _own_script(text: Column, stream: Column) -> Column:
    """text with each letter and digit that is neither Latin nor ASCII replaced by a keyed one of its script, by an ASCII one where the script is not known."""
    ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("x"), F.lit(len(x)).alias("n")) for a, b, x in _DRAWN])

    def one(c: Column, i: Column) -> Column:
        own = F.transform(F.filter(ranges, lambda r: F.ascii(c).between(r["a"], r["b"])), lambda r: F.substring(r["x"], _number(stream, i, r["n"]) + 1, F.lit(1)))
        other = F.coalesce(F.try_element_at(own, F.lit(1)), F.when(c.rlike("^\\p{N}$"), F.lit("0")).otherwise(F.lit("a")))
        return F.when(c.rlike("^[\\p{L}\\p{N}&&[^0-9\\p{IsLatin}]]$"), other).otherwise(c)

    return F.when(text.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for numbers with a right check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0))), F.lit(0), lambda t, i: add(t, i))


def surrogate(key: str, kind: Column, norm: Column, attempt: Column, names: bool = True) -> Column:
    """The replacement's normal form: the attempt-th candidate of an entity. names: whether it may be a part of a name."""
    # What later candidates have more than the entity's own form: keyed characters, 16 choices each.
    more = F.least(F.greatest(attempt - F.when(kind.isin(*_NUMBERS), OWN_FORM_NUMBERS).otherwise(OWN_FORM), F.lit(0)), F.lit(60))

    def of(stream: Column, norm: Column) -> Column:
        grown = F.substring(F.reverse(stream), F.lit(1), more)
        letters, numbers = F.translate(grown, "0123456789abcdef", "bcdfghjklmnprstv"), F.translate(grown, "abcdef", "012345")
        labels = F.split(F.substring_index(norm, "@", -1), "\\.")
        inner = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))
        email = F.concat(_shape(F.substring_index(norm, "@", 1), stream), F.lit("@"), F.concat_ws(".", F.when(F.size(inner) > 0, _shape(F.array_join(inner, "."), F.reverse(stream))), F.when(more > 0, letters), F.lit("example"), F.element_at(labels, -1)))
        ip = F.concat_ws(".", F.lit(240) + _number(stream, 0, 16), _number(stream, 1, 256), _number(stream, 2, 256), F.lit(1) + _number(stream, 3, 254))
        ip = F.when(more > 0, F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(stream, 4 * k + 1, 4)) for k in range(6)])).otherwise(ip)
        # A phone keeps its country code where it has more than ten digits; no group starts with 0 or 1.
        code = F.greatest(F.length(norm) - 10, F.lit(0))
        phone = F.concat(F.substring(norm, F.lit(1), code), _shape(F.substring(norm, code + 1, F.lit(1)), stream, "23456789"), _shape(F.substring(norm, code + 2, F.lit(2)), F.substring(stream, 5, 120)), _shape(F.substring(norm, code + 4, F.lit(1)), F.substring(stream, 17, 110), "23456789"), _shape(F.substring(norm, code + 5, F.lit(30)), F.substring(stream, 21, 107)), numbers)
        body = F.concat(F.substring(norm, 1, 1), _shape(F.substring(norm, F.lit(2), F.length(norm) - 2), stream), numbers)
        check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
        last = F.when(_luhn(norm) % 10 == 0, check).otherwise(((F.lit(10 + 1) + check.cast("int") + _number(stream, 30, 9)) % 10).cast("string"))
        card = F.concat(body, last)
        hexes = F.substring(F.concat(stream, F.reverse(stream)), F.lit(1), F.length(norm))
        hexes = F.when(F.length(norm) <= 256, hexes).otherwise(_shape(norm, stream, lower="abcdef"))
        secret = F.when(norm.rlike("^[0-9a-f]+$"), F.concat(hexes, grown)).otherwise(F.concat(_shape(norm, stream), grown))
        access = F.concat(F.substring(norm, 1, 4), _shape(F.substring(norm, F.lit(5), F.length(norm)), stream, digits="234567"), F.upper(letters))
        iban = F.concat(F.substring(norm, 1, 2), _shape(F.substring(norm, F.lit(3), F.length(norm)), stream), numbers)
        out = (
            F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
            .when(kind == "secret", secret).when(kind == "access_key", access).when(kind == "iban", iban)
            .when(kind == "national_id", F.concat(_shape(norm, stream), numbers))
        )
        return out.when(kind.isin("female", "male", "last"), _name(kind, norm, stream, attempt)) if names else out

    def own_script(stream: Column) -> Column:
        # The last label of an address stays.
        mail = F.concat(_own_script(F.regexp_extract(norm, "^(.*)\\.[^.]*$", 1), stream), F.lit("."), F.substring_index(norm, ".", -1))
        return F.when(kind == "email", mail).when(kind == "secret", _own_script(norm, stream)).otherwise(norm)

    return _let(_stream(key, kind, norm, attempt), lambda stream: _let(own_script(stream), lambda own: of(stream, own)))


def _name(kind: Column, norm: Column, stream: Column, attempt: Column) -> Column:
    """A given name of the gender asked for, or a last name, of the script of norm; later candidates have more syllables."""
    by_script = lambda cyrillic, greek, latin: F.when(norm.rlike("\\p{IsCyrillic}"), cyrillic).when(norm.rlike("\\p{IsGreek}"), greek).when(norm.rlike("\\p{IsLatin}"), latin)
    stock = lambda words: by_script(*[F.array(*map(F.lit, words(script))) for script in ("cyrillic", "greek", "latin")])
    first = F.when(kind == "female", stock(lambda x: FIRST["female", x])).when(kind == "male", stock(lambda x: FIRST["male", x]))
    pick = lambda words, k: F.get(words, _number(stream, k, F.size(words)))
    # Four syllables make a last name. Few given names have no other form, so theirs grow from the second candidate on.
    count = F.when(kind == "last", F.greatest(attempt - OWN_FORM, F.lit(0)) + 4).otherwise(F.least(attempt, F.lit(60)))
    grown = lambda words: F.array_join(F.transform(F.sequence(F.lit(0), count), lambda k: F.when(k > 0, pick(words, k)).otherwise("")), "")
    name = lambda own, words: F.initcap(F.concat(F.coalesce(pick(own, F.lit(0)), F.lit("")), grown(words)))
    other = F.initcap(_own_script(F.concat(norm, F.repeat(F.substring(norm, -1, 1), attempt)), stream))
    return _let(F.struct(first.alias("own"), stock(lambda x: SYLLABLES[x]).alias("words")), lambda x: F.when(x["words"].isNull(), other).otherwise(name(x["own"], x["words"])))


def _pour(mention: Column, digits: Column) -> Column:
    """The mention with its digits replaced by others in order, separators kept; digits beyond the mention's follow it."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["used"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["used"] + digit.cast("int")).alias("used"))

    return F.aggregate(F.split(mention, ""), state, step, lambda s: F.concat(s["out"], F.substring(digits, s["used"] + 1, F.length(digits))))


def _new_name(key: str, kind: Column, norm: Column, attempt_of) -> Column:
    def one(kind: Column, norm: Column) -> Column:
        return _let(attempt_of(kind, norm), lambda attempt: _let(_stream(key, kind, norm, attempt), lambda stream: _name(kind, norm, stream, attempt)))

    return F.array_join(F.transform(pieces(kind, norm), lambda p: one(p["kind"], p["norm"])), " ")


def replacement(key: str, mention: Column, attempt_of) -> Column:
    """What stands in for a mention. attempt_of: from kind and normal form to the candidate in use."""

    def with_norm(kind: Column, norm: Column) -> Column:
        name = kind.isin("female", "male")
        new = F.when(name, _new_name(key, kind, norm, attempt_of)).otherwise(_let(attempt_of(kind, norm), lambda attempt: surrogate(key, kind, norm, attempt, names=False)))
        digits = F.regexp_replace(mention, "[^0-9]", "")

        def written(new: Column) -> Column:
            upper = mention == F.upper(mention)
            said = F.regexp_replace(mention, _TITLE, "")
            return (
                # What the normal form leaves out of a number stays before it.
                F.when(kind.isin("phone", "card", "national_id"), _pour(mention, F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(norm)), new)))
                .when(kind == "secret", F.concat(F.regexp_extract(mention, _BEFORE_VALUE, 0), new))
                .when(name, F.concat(F.regexp_extract(mention, _TITLE, 0), F.when(said == F.upper(said), F.upper(new)).otherwise(new)))
                .when((kind == "email") & upper, F.upper(new))
                .otherwise(new)
            )

        return _let(new, written)

    return _let(kind_of(mention), lambda kind: _let(normal(kind, mention), lambda norm: with_norm(kind, norm)))


def parts_of(text: Column) -> Column:
    """A text cut into what is no entity (even places) and mentions (odd places); null where nothing is found."""
    marked = F.regexp_replace(text, ANY, f"{_MARK}$0{_MARK}")
    gaps, found = F.split(text, ANY, -1), mentions(text)
    slow = F.slice(F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, m))), F.lit(1), 2 * F.size(found) + 1)
    quick = _let(marked, lambda m: F.when(m.contains(_MARK), F.split(m, _MARK, -1)))
    return F.when(text.contains(_MARK), F.when(F.size(found) > 0, slow)).otherwise(quick)


def _said(parts: Column) -> Column:
    return F.filter(parts, lambda p, i: i % 2 == 1)


def entities(marked: DataFrame) -> DataFrame:
    """The distinct entities of a table with __parts: kind, norm."""
    found = marked.where("__parts is not null").select(F.explode(F.array_distinct(_said(F.col("__parts")))).alias("mention")).distinct()
    found = found.withColumn("kind", kind_of(F.col("mention")))
    return found.select(F.explode(pieces(F.col("kind"), normal(F.col("kind"), F.col("mention")))).alias("p")).select("p.kind", "p.norm").distinct()


def later_candidates(found: DataFrame, key: str) -> DataFrame:
    """The entities of found (kind, norm) whose first candidate collides, with the one that doesn't: kind, norm, attempt.

    Each round compares all entities' candidates with each other and with the entities themselves.
    """
    def made(rows: DataFrame) -> DataFrame:
        # Names are compared as their normal forms are, whatever their case.
        new = surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))
        return rows.select("kind", "norm", "attempt", F.when(F.col("kind").isin("female", "male", "last"), F.lower(new)).otherwise(new).alias("new"))

    current = materialize(made(found.withColumn("attempt", F.lit(0))), "candidates")
    while True:
        # Of those that share a candidate the one with the fewest attempts, then the smaller, keeps it.
        kept = current.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm"))["norm"].alias("first")).where("n > 1")
        shared = current.join(kept, ["kind", "new"]).where(F.col("norm") != F.col("first")).select("kind", "norm")
        real = current.join(current.select("kind", F.col("norm").alias("new")), ["kind", "new"], "left_semi").select("kind", "norm")
        losers = materialize(shared.union(real).distinct(), "collisions")
        if losers.isEmpty():
            return current.where("attempt > 0").select("kind", "norm", "attempt")
        moved = current.join(losers, ["kind", "norm"], "left_semi").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        current = materialize(current.join(losers, ["kind", "norm"], "left_anti").unionByName(made(moved)), "candidates")


def _rewritten(key: str, parts: Column, attempt_of) -> Column:
    """The text of parts with every mention replaced, and full names that it has with a title also where they stand without."""
    names = F.array_distinct(F.filter(F.transform(_said(parts), lambda m: F.struct(kind_of(m).alias("kind"), F.regexp_replace(m, _TITLE, "").alias("name"))), lambda n: n["kind"].isin("female", "male") & n["name"].contains(" ")))
    known = F.transform(names, lambda n: F.struct(F.concat(F.lit("(?<![\\p{L}\\p{N}])"), n["name"], F.lit("(?![\\p{L}\\p{N}])")).alias("pattern"), _new_name(key, n["kind"], F.lower(n["name"]), attempt_of).alias("new")))

    def with_names(known: Column) -> Column:
        plain = lambda gap: F.when(F.size(known) > 0, F.aggregate(known, gap, lambda t, n: F.regexp_replace(t, n["pattern"], n["new"]))).otherwise(gap)
        return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, replacement(key, p, attempt_of)).otherwise(plain(p))), "")

    return _let(known, with_names)


def session_key(spark: SparkSession) -> str:
    """The key in spark.unspool.pii.key; where none is set a random one, which nobody keeps, for this application."""
    app = spark.sparkContext.applicationId
    return spark.conf.get("spark.unspool.pii.key", None) or _own_keys.setdefault(app, secrets.token_hex(32))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with every entity in `text` replaced, and n_entities, the number of mentions.

    key: the secret of the replacements; without it they can't be traced back or made again.
    """
    spark, before = docs.sparkSession, len(written(docs.sparkSession))
    kept = [c for c in docs.columns if c not in ("text", "n_entities")]
    parts = parts_of(F.col("text"))
    # Rows get a number as they are written, so they have the same one wherever they are read.
    marked = docs.select(F.struct(*(kept or [F.lit(0).alias("none")])).alias("__kept"), F.col("text").alias("__text"), parts.alias("__parts"))
    marked = marked.select("__kept", F.when(F.col("__parts").isNull(), F.col("__text")).alias("__text"), "__parts", F.monotonically_increasing_id().alias("__row"))
    marked = materialize(marked, "pii-parts")
    retries = materialize(later_candidates(entities(marked), key), "retries")
    # What the search for candidates wrote on its way goes; the parts and the candidates stay.
    delete(spark, written(spark)[before + 1 : -1])
    count = retries.count()
    name = lambda kind, norm: F.concat(kind, F.lit(":"), norm)
    if not count:
        attempt_of = lambda kind, norm: F.lit(0)
    elif count <= INLINE_RETRIES:
        known = [x for r in retries.collect() for x in (F.lit(f"{r['kind']}:{r['norm']}"), F.lit(r["attempt"]))]
        later = F.create_map(*known)
        attempt_of = lambda kind, norm: F.coalesce(F.try_element_at(later, name(kind, norm)), F.lit(0))
    else:
        own = marked.where("__parts is not null").select("__row", F.explode(F.array_distinct(_said(F.col("__parts")))).alias("mention")).withColumn("kind", kind_of(F.col("mention")))
        own = own.select("__row", F.explode(pieces(F.col("kind"), normal(F.col("kind"), F.col("mention")))).alias("p")).select("__row", "p.kind", "p.norm").distinct().join(retries, ["kind", "norm"])
        own = own.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("norm")), "attempt"))).alias("__later"))
        marked = marked.join(own, "__row", "left")
        attempt_of = lambda kind, norm: F.coalesce(F.try_element_at(F.col("__later"), name(kind, norm)), F.lit(0))
    text = F.when(F.col("__parts").isNull(), F.col("__text")).otherwise(_rewritten(key, F.col("__parts"), attempt_of))
    count = F.when(F.col("__parts").isNull(), 0).otherwise(F.floor(F.size("__parts") / 2)).cast("int")
    columns = [text.alias(c) if c == "text" else F.col(f"__kept.`{c}`").alias(c) for c in docs.columns if c != "n_entities"]
    return marked.select(*columns, count.alias("n_entities"))
