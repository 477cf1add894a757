"""Format-preserving pseudonyms for personal identifiers, in SQL expressions only.

Numbers and dates that pass their validation are replaced by another value of the same format, through a keyed Feistel
network. The map is a bijection of each format, and it depends on key and value alone: equal values get equal pseudonyms in
every document, different values stay different, and the holder of the key can turn it back.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import fresh

ROUNDS = 8
#: The days of 1900-01-01 .. 2099-12-31 lie in a product, 260 x 281, that has 11 more.
DATE_FROM, DAYS, DATE_A, DATE_B = "1900-01-01", 73049, 260, 281

# The formats.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"(?<![\p{L}\p{N}])(?:19|20)\d\d-\d\d-\d\d(?![\p{L}\p{N}])"
IPV4 = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d\d-\d{4}(?![\p{L}\p{N}]|-\d)"
PHONE = r"(?<![\p{L}\p{N}])\+1[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{4}(?![\p{L}\p{N}])"
#: Numbers of other countries: 8 to 15 digits with the country code, in groups that end where what has another format's shape begins.
PHONE_ABROAD = rf"(?<![\p{{L}}\p{{N}}])\+[2-9]\d(?:(?:[ -](?!{EMAIL}|\d{{4}}-\d\d-\d\d(?![\p{{L}}\p{{N}}])|{IPV4}|{SSN}))?\d){{6,13}}(?![\p{{L}}\p{{N}}])"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
GROUP = r"\d++(?![\p{L}\p{N}])"
#: Groups of digits with single blanks or hyphens between, 13 digits at least, that end where another format begins. Which of
#: the groups are a card is for `cards` to say.
CARD = rf"(?<![\p{{L}}\p{{N}}])(?=\d(?:[ -]?\d){{12}}){GROUP}(?:[ -](?!{EMAIL}|{DATE}|{IPV4}|{SSN}){GROUP})*+"
#: The written forms of a card: unbroken, or 4-4-4-4, 4-6-5 and 4-6-4 with one kind of separator.
CARD_FORM = r"^(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}|\d{4}([ -])\d{6}\3\d{4,5})$"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, DATE, IPV4, SSN, PHONE, PHONE_ABROAD, CARD))
#: Runs of code points, all letters or all digits of one script, as first and number: 0-9, A-Z, a-z, Latin, Greek, Cyrillic, Hebrew, Arabic,
#: Devanagari, Thai, kana, Han, Hangul.
RUNS = [(0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25),
        (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16), (0x5D0, 27), (0x620, 43), (0x905, 53), (0xE01, 48), (0x3041, 86), (0x30A1, 90),
        (0x4E00, 20902), (0xAC00, 11172)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _hash(key: str, *parts: Column) -> Column:
    """60 bits of an HMAC (SHA-256) over the parts, each with its length before it."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    texts = [p.cast("string") for p in parts]
    message = F.concat(*[x for t in texts for x in (F.octet_length(t).cast("string"), F.lit(":"), t)]).cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, kind: str, key: str, back: bool = False) -> Column:
    """Permutes the pairs (a, b) of mod_a x mod_b: eight rounds add a keyed hash of one half to the other.
    `back` undoes it. Returns a struct with fields a and b."""
    def step(acc: Column, i: Column) -> Column:
        # even rounds change a, odd rounds change b
        add = _hash(key, F.lit(kind), i, mod_a, mod_b, F.when(i % 2 == 0, acc["b"]).otherwise(acc["a"]))
        sign = -1 if back else 1
        new_a = F.when(i % 2 == 0, F.pmod(acc["a"] + sign * (add % mod_a), mod_a)).otherwise(acc["a"])
        new_b = F.when(i % 2 == 0, acc["b"]).otherwise(F.pmod(acc["b"] + sign * (add % mod_b), mod_b))
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _refill(form: Column, digits: Column) -> Column:
    """The digits put one by one where the form has digits."""
    def fill(d: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            is_digit = c.rlike("^[0-9]$")
            return F.struct(
                F.concat(acc["out"], F.when(is_digit, F.substring(d, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"),
                (acc["n"] + F.when(is_digit, 1).otherwise(0)).alias("n"),
            )

        return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"]

    return _let(digits, fill)


def _decimal(digits: Column, n: Column, kind: str, key: str, back: bool) -> Column:
    """Permutes strings of n decimal digits, n from 2 to 36."""
    left = F.floor(n / 2).cast("int")
    right = n - left
    out = feistel(F.substring(digits, F.lit(1), left), F.substring(digits, left + 1, right), _ten(left), _ten(right), kind, key, back)
    return _let(out, lambda o: F.concat(F.lpad(o["a"].cast("string"), left, F.lit("0")), F.lpad(o["b"].cast("string"), right, F.lit("0"))))


def luhn_check(body: Column) -> Column:
    """The check digit that makes body + digit pass the Luhn test."""
    def add(acc: Column, x: Column) -> Column:
        d = F.substring(body, F.length(body) - x, F.lit(1)).cast("int")
        return acc + F.when(x % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add)
    return (10 - total % 10) % 10


def is_card(text: Column) -> Column:
    def valid(d: Column) -> Column:
        check = _let(F.substring(d, F.lit(1), F.length(d) - 1), luhn_check)
        return F.length(d).between(13, 19) & (check == F.substring(d, -1, 1).cast("int")) & ~d.rlike("^0+$")

    return _let(_digits(text), valid)


def card_pseudonym(text: Column, key: str, back: bool = False) -> Column:
    """First digit (the industry) and separators stay, the check digit is right again."""
    def new(d: Column) -> Column:
        n = F.length(d)
        return F.concat(F.substring(d, 1, 1), _decimal(F.substring(d, F.lit(2), n - 2), n - 2, "card", key, back))

    body = _let(_digits(text), new)
    return _refill(text, _let(body, lambda b: F.concat(b, luhn_check(b).cast("string"))))


def cards(run: Column, key: str, back: bool = False) -> Column:
    """A struct of the run of digit groups with its cards replaced, and how many were.

    A card is some groups in a row, 13-19 digits that pass the Luhn test. From left to right: at every group the written forms
    come first, then the longest; what has no written form gives way to one that begins inside it.
    """
    def parts(g: Column) -> Column:
        def text(i: Column, n: Column) -> Column:
            return F.regexp_replace(F.array_join(F.slice(g, i + 1, n), ""), "[ -]$", "")

        def at(i: Column) -> Column:
            sizes = F.sequence(F.least(F.lit(19), F.size(g) - i), F.lit(1), F.lit(-1))
            valid = F.filter(sizes, lambda n: is_card(text(i, n)))
            return _let(valid, lambda v: F.struct(F.filter(v, lambda n: text(i, n).rlike(CARD_FORM)).alias("form"), v.alias("any")))

        def walk(found: Column) -> Column:
            def size_at(i: Column) -> Column:
                own = found[i]
                free = F.filter(own["any"], lambda n: ~F.exists(F.slice(found, i + 2, n - 1), lambda x: F.size(x["form"]) > 0))
                return F.coalesce(F.get(own["form"], F.lit(0)), F.get(free, F.lit(0)), F.lit(0))

            def step(acc: Column, i: Column) -> Column:
                def taken(n: Column) -> Column:
                    old = text(i, n)
                    tail = F.regexp_extract(g[i + n - 1], "[ -]$", 0)
                    some = F.struct((i + n).alias("end"), F.concat(acc["text"], card_pseudonym(old, key, back), tail).alias("text"), (acc["n"] + 1).alias("n"))
                    one = F.struct((i + 1).alias("end"), F.concat(acc["text"], g[i]).alias("text"), acc["n"].alias("n"))
                    return F.when(n > 0, some).otherwise(one)

                return F.when(i < acc["end"], acc).otherwise(_let(size_at(i), taken))

            start = F.struct(F.lit(0).alias("end"), F.lit("").alias("text"), F.lit(0).alias("n"))
            return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step)

        return _let(F.transform(F.sequence(F.lit(0), F.size(g) - 1), at), walk)

    done = _let(F.regexp_extract_all(run, F.lit(r"\d+[ -]?"), F.lit(0)), parts)
    return _let(done, lambda d: F.struct(d["text"].alias("v"), d["n"].alias("n")))


def phone_pseudonym(text: Column, key: str, back: bool = False) -> Column:
    """The digits after the country code are permuted."""
    def new(d: Column) -> Column:
        code = F.regexp_extract(d, COUNTRY, 1)
        n = F.length(d) - F.length(code)
        return F.concat(code, _decimal(F.substring(d, F.length(code) + 1, n), n, "phone", key, back))

    return _refill(text, _let(_digits(text), new))


def is_ssn(text: Column) -> Column:
    return ~text.rlike("^(000|666|9)|^...-00|0000$")


def ssn_pseudonym(text: Column, key: str, back: bool = False) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999: 898 x 99 pairs by 9999."""
    area = F.substring(text, 1, 3).cast("int")
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(rank * 99 + F.substring(text, 5, 2).cast("int") - 1, F.substring(text, 8, 4).cast("int") - 1, F.lit(898 * 99), F.lit(9999), "ssn", key, back)
    new = lambda o: F.floor(o["a"] / 99).cast("int")
    return _let(out, lambda o: F.format_string("%03d-%02d-%04d", F.when(new(o) >= 665, new(o) + 2).otherwise(new(o) + 1), o["a"] % 99 + 1, o["b"] + 1))


def is_ipv4(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: (p.cast("int") <= 255) & ~p.rlike("^0."))


def ipv4_pseudonym(text: Column, key: str, back: bool = False) -> Column:
    p = F.split(text, r"\.")
    out = feistel(p[0].cast("int") * 256 + p[1].cast("int"), p[2].cast("int") * 256 + p[3].cast("int"), F.lit(65536), F.lit(65536), "ipv4", key, back)
    halves = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return _let(out, lambda o: F.concat_ws(".", *halves(o["a"]), *halves(o["b"])))


def _day(text: Column) -> Column:
    return F.date_diff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(DATE_FROM).cast("date"))


def is_date(text: Column) -> Column:
    return F.coalesce(_day(text).between(0, DAYS - 1), F.lit(False))


def date_pseudonym(text: Column, key: str, back: bool = False) -> Column:
    """Permuted until the result is a day of the range again. Eleven places of the product are none, so twelve steps are always enough,
    and the map stays a bijection of the range."""
    def once(day: Column) -> Column:
        out = feistel(F.floor(day / DATE_B), day % DATE_B, F.lit(DATE_A), F.lit(DATE_B), "date", key, back)
        return _let(out, lambda o: o["a"] * DATE_B + o["b"])

    more = F.sequence(F.lit(1), F.lit(DATE_A * DATE_B - DAYS))
    day = F.aggregate(more, once(_day(text).cast("long")), lambda acc, _: F.when(acc < DAYS, acc).otherwise(once(acc)))
    return F.date_format(F.date_add(F.lit(DATE_FROM).cast("date"), day.cast("int")), "yyyy-MM-dd")


def _in_run(code: Column, new: Callable[[Column, Column], Column], same: Column) -> Column:
    """The character of code point new(first, number) of the run that `code` lies in, `same` where it lies in none."""
    run = F.lit(None).cast("struct<base:int,n:int>")
    for base, n in reversed(RUNS):
        run = F.when(code.between(base, base + n - 1), F.struct(F.lit(base).alias("base"), F.lit(n).alias("n"))).otherwise(run)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, F.lit("0"))), "UTF-16BE")
    return _let(run, lambda r: F.when(r.isNull(), same).otherwise(char(new(r["base"], r["n"]))))


def email_pseudonym(text: Column, key: str, back: bool = False) -> Column:
    """Letters and digits of the local part are shifted within their run of RUNS by a keyed hash of the other half, in alternating
    rounds; letters of no run, other signs and the domain stay."""
    local = F.substring_index(text, "@", 1)
    cut = F.floor(F.length(local) / 2).cast("int")

    def shifted(half: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            add = _hash(key, F.lit("email"), i, F.length(local), at, other)
            return _let(F.ascii(c), lambda code: _in_run(code, lambda base, n: base + F.pmod(code - base + (-1 if back else 1) * (add % n), n), c))

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))

    def round_(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(acc["a"], acc["b"], i)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(shifted(acc["b"], acc["a"], i)).alias("b"))

    rounds = F.sequence(F.lit(3), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(3))
    start = F.struct(F.substring(local, F.lit(1), cut).alias("a"), F.substring(local, cut + 1, F.length(local)).alias("b"))
    tail = F.substring(text, F.length(local) + 1, F.length(text))
    return _let(F.aggregate(rounds, start, round_), lambda o: F.concat(o["a"], o["b"], tail))


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """A struct of the pseudonym of one match of ANY, and how many values in it were replaced. A match that its validation
    rejects stays as it is: a card number needs its check digit, an address its octets, a date a calendar day in range, a social
    security number possible parts."""
    one = lambda new: _let(new, lambda v: F.struct(v.alias("v"), (v != value).cast("int").alias("n")))
    return (
        F.when(F.contains(value, F.lit("@")), one(email_pseudonym(value, key, back)))
        .when(F.startswith(value, F.lit("+")), one(phone_pseudonym(value, key, back)))
        .when(value.rlike(r"^\d{4}-\d\d-\d\d$"), one(F.when(is_date(value), date_pseudonym(value, key, back)).otherwise(value)))
        .when(F.contains(value, F.lit(".")), one(F.when(is_ipv4(value), ipv4_pseudonym(value, key, back)).otherwise(value)))
        .when(value.rlike(r"^\d{3}-\d\d-\d{4}$"), one(F.when(is_ssn(value), ssn_pseudonym(value, key, back)).otherwise(value)))
        .otherwise(cards(value, key, back))
    )


def pseudonymised(text: Column, key: str, back: bool = False) -> Column:
    """A struct of the text with its identifiers replaced, and how many were. Null stays null with 0."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    none = F.array().cast("array<string>")
    gaps = F.split(text, ANY)

    def build(old: Column) -> Column:
        def joined(new: Column) -> Column:
            pieces = F.transform(F.arrays_zip(gaps.alias("g"), new.alias("v")), lambda x: F.concat(x["g"], F.coalesce(x["v"]["v"], F.lit(""))))
            changed = F.aggregate(new, F.lit(0), lambda acc, x: acc + x["n"])
            return F.struct(F.array_join(pieces, "").alias("text"), changed.cast("long").alias("n_replaced"))

        return _let(F.transform(old, lambda v: pseudonym(v, key, back)), joined)

    # nothing but texts with a digit or an @ can hold a match
    possible = F.when(text.rlike(r"\d[\d .()-]{4}|@"), found).otherwise(none)
    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_replaced"))
    return _let(possible, lambda f: F.when(F.size(f) > 0, build(f)).otherwise(same))


def pseudonymise(documents: DataFrame, key: str, text: str = "text", count: str | None = None, back: bool = False) -> DataFrame:
    """The documents with identifiers in `text` replaced, all other columns untouched; `count` names a column for the number
    of replaced values. One narrow stage in the JVM: no exchange, no Python.

    Null and empty texts stay. Repeated rows are treated alike. Texts are searched whole. n_chars and the like are not
    recomputed: pseudonyms have the length of the original, except that addresses (IPv4) may change theirs.
    """
    name = fresh(documents, "p")
    order = [F.col(f"`{name}`.text").alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns]
    extra = [F.col(f"`{name}`.n_replaced").alias(count)] if count else []
    return documents.withColumn(name, pseudonymised(F.col(text), key, back)).select(*order, *extra)
