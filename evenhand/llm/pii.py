"""Format-preserving Feistel pseudonyms, in SQL expressions only.

Every value that looks personal is found by one pattern, validated by kind
(Luhn, calendar, octets, ...), and permuted within its format by a keyed
Feistel network on Z_a x Z_b, a bijection for any a and b.  Equal values get
equal pseudonyms in every document, and no two numbers, dates or account
numbers share one.  Emails and secret keys have no fixed format to permute:
they become keyed digests of 80 bits or more, which could collide in theory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh

ROUNDS = 8

#: Lengths of account numbers by country.  In groups of four only these tell where one ends and a word begins.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped_iban(n: int, countries: str) -> str:
    rest = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}"


GROUPED_IBAN = "|".join(_grouped_iban(n, c) for n, c in IBAN_LENGTHS.items())

#: Patterns by kind, tried in this order (fixed values).  A host has at most 127 labels; the last dot may
#: end a sentence, so labels are given back.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|A[KS]IA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36,251}|xox[abprs]-[A-Za-z0-9\-]{10,250}|sk-[A-Za-z0-9_\-]{20,250}+)(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{GROUPED_IBAN})(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9\-])",
    "date": r"(?<![A-Za-z0-9\-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:?[0-9]{2})|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![A-Za-z0-9\-/]|\.[0-9]))",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Beginnings of secret keys that stay (fixed values).
KEY_STARTS = r"^(A[KS]IA|gh[opsur]_|xox[abprs]-|sk-)?"
#: Nothing matches in a text without any.
HINT = "[@0-9]|A[KS]IA|gh[opsur]_|xox[abprs]-|sk-"

#: Days of 400 Gregorian years are 189 x 773, so dates permute without a rest.
DATE_A, DATE_B, DATE_FROM = 189, 773, "1800-01-01"


def _round(key: str, kind: str, i: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """struct(l, r): the keyed permutation of (left, right) on Z_a x Z_b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + _round(key, kind, i, s["r"]) % a) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + _round(key, kind, i, s["l"]) % b) % b).alias("r"),
        )

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 34 digits, permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
    power = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")
    # A fresh name for the pair, so that the network stands in the plan once.
    pair = F.array(feistel(left.cast("long"), right.cast("long"), power(half), power(rest), key, kind))
    return F.element_at(
        F.transform(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0"))), 1
    )


def permute_letters(letters: Column, key: str, kind: str) -> Column:
    """A string of up to 26 letters A-Z, permuted among those of its length (halves of 13 fit a long)."""
    half = F.floor(F.length(letters) / 2).cast("int")
    rest = F.length(letters) - half
    size = lambda n: F.aggregate(F.sequence(F.lit(0), n), F.lit(1).cast("long"), lambda s, i: F.when(i > 0, s * 26).otherwise(s))
    number = lambda x: F.aggregate(F.split(x, ""), F.lit(0).cast("long"), lambda s, c: F.when(c == "", s).otherwise(s * 26 + F.ascii(c) - 65))

    def spelt(x: Column, n: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), x.alias("left"))
        one = lambda s, i: F.when(i > 0, F.struct(F.concat(F.char(65 + s["left"] % 26), s["out"]).alias("out"), F.floor(s["left"] / F.lit(26).cast("decimal(2,0)")).cast("long").alias("left"))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(0), n), start, one, lambda s: s["out"])

    left, right = F.substring(letters, F.lit(1), half), F.substring(letters, half + 1, rest)
    pair = F.array(feistel(number(left), number(right), size(half), size(rest), key, f"{kind} letters"))
    return F.element_at(F.transform(pair, lambda p: F.concat(spelt(p["l"], half), spelt(p["r"], rest))), 1)


def refill(template: Column, new: Column, what: str = "[0-9]") -> Column:
    """``template`` with its digits (or what else ``what`` matches) replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        F.split(template, ""),
        start,
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike(f"^{what}$"), F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(c.rlike(f"^{what}$"), 1).otherwise(0)).alias("at"),
        ),
        lambda s: s["out"],
    )


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; counted from the right, digits at positions of the parity ``doubled`` are doubled."""
    back = F.reverse(digits)
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, i: s
        + F.when(i % 2 == doubled, F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(back, i, F.lit(1)).cast("int") + 1)).otherwise(
            F.substring(back, i, F.lit(1)).cast("int")
        ),
    )


def iban_rest(moved: Column) -> Column:
    """An account number with its country and check digits moved to the end, modulo 97."""
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + F.ascii(c) - 48) % 97).when(c == "", s).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _card(m: Column, key: str) -> Column:
    def payload(d: Column) -> Column:
        return F.when(
            luhn_sum(d, 0) % 10 == 0,
            _let(
                permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"),
                lambda p: refill(m, F.concat(p, ((10 - luhn_sum(p, 1) % 10) % 10).cast("string"))),
            ),
        )

    return _let(F.regexp_replace(m, "[^0-9]", ""), payload)


def _ip(m: Column, key: str) -> Column:
    def octets(o: Column) -> Column:
        valid = F.forall(o, lambda x: x.cast("int") <= 255)
        pair = F.array(
            feistel(o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long"), F.lit(65536), F.lit(65536), key, "ip")
        )
        shown = F.element_at(
            F.transform(
                pair,
                lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string")),
            ),
            1,
        )
        return F.when(valid, shown)

    return _let(F.split(m, r"\."), octets)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    pair = F.array(
        feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    )

    def shown(p: Column) -> Column:
        a = p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
        g = F.floor(p["r"] / 9999) + 1
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, F.element_at(F.transform(pair, shown), 1))


def _date(m: Column, key: str) -> Column:
    formats = (("-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), (".", "dd.MM.yyyy"))
    out = F.lit(None).cast("string")
    for mark, form in reversed(formats):
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(DATE_FROM).cast("date")).cast("long")
        inside = (day >= 0) & (day < DATE_A * DATE_B)
        pair = F.array(feistel(F.floor(day / DATE_B), day % DATE_B, F.lit(DATE_A), F.lit(DATE_B), key, "date"))
        moved = F.element_at(F.transform(pair, lambda p: F.date_add(F.lit(DATE_FROM).cast("date"), (p["l"] * DATE_B + p["r"]).cast("int"))), 1)
        out = F.when(F.instr(m, mark) > 0, F.when(inside, F.date_format(moved, form))).otherwise(out)
    return out


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .\-(])|\+[0-9])?", 1)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    return F.when(F.length(digits).between(7, 15), F.concat(head, refill(rest, permute_digits(digits, key, "phone"))))


def _iban(m: Column, key: str) -> Column:
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    valid = iban_rest(bare(F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4)))) == 1
    body = F.substring(m, F.lit(5), F.length(m))
    digits = F.regexp_replace(body, "[^0-9]", "")

    def checked(b: Column) -> Column:
        country = F.substring(m, 1, 2)
        return F.concat(country, F.lpad((98 - iban_rest(bare(F.concat(b, country, F.lit("00"))))).cast("string"), 2, "0"), b)

    def renewed(b: Column) -> Column:
        letters = F.regexp_replace(b, "[^A-Z]", "")
        return F.when(F.length(letters).between(1, 26), refill(b, permute_letters(letters, key, "iban"), "[A-Z]")).otherwise(b)

    numbered = F.when(F.length(digits) >= 2, refill(body, permute_digits(digits, key, "iban"))).otherwise(body)
    return F.when(valid, _let(_let(numbered, renewed), checked))


def _keyed(m: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(m)), 256)


def _email(m: Column, key: str) -> Column:
    """Not a number: a keyed digest for the name and the host, of the same shape."""
    d = _keyed(m, key, "email")
    return F.concat(F.lit("user"), F.substring(d, 1, 20), F.lit("@mail"), F.substring(_keyed(F.substring_index(m, "@", -1), key, "host"), 1, 20), F.lit(".example.com"))


def _token(m: Column, key: str) -> Column:
    """Not a number either: its beginning and a keyed digest, of the same length."""
    start = F.regexp_extract(m, KEY_STARTS, 1)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("token"), m), 256)
    digest = F.when(F.substring(start, 1, 1) == "A", F.upper(digest)).otherwise(digest)
    return F.concat(start, F.substring(F.repeat(digest, 4), F.lit(1), F.length(m) - F.length(start)))


MAKERS = {"email": _email, "token": _token, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone}


def pseudonym(match: Column, key: str) -> Column:
    """struct(kind, value) of a match; null where it does not validate as any kind it looks like."""
    out = F.lit(None)
    for kind in reversed(KINDS):
        out = _first_valid(kind, F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), MAKERS[kind](match, key)), out)
    return out


def _first_valid(kind: str, value: Column, rest: Column) -> Column:
    return _let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))).otherwise(rest))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and ``found``: array of (kind, value), the new values in order.

    Values that fail their kind's validation stay.  A null text stays null with
    an empty array, an empty one stays empty, a long one is searched whole;
    every other column passes through, an existing ``found`` column is
    replaced; an empty table stays empty.  Narrow: no shuffle, no Python;
    repeated rows and ties are each rewritten alike.
    """
    body = F.col(text)
    has = body.rlike(HINT)
    hits = F.when(has, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    new = F.transform(hits, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    # One materialised column: the planner must not repeat the network in each use.
    name = fresh(docs, "_new")
    staged = docs.drop(found).withColumn(name, new)
    gaps = F.split(body, ANY, -1)
    joined = F.array_join(
        F.zip_with(gaps, F.col(name), lambda g, m: F.concat(g, F.coalesce(m["new"]["value"], m["old"], F.lit("")))), ""
    )
    replaced = F.when(F.exists(name, lambda m: m["new"].isNotNull()), joined).otherwise(body)
    only = F.transform(F.filter(name, lambda m: m["new"].isNotNull()), lambda m: m["new"])
    # An absent array is an empty one.
    only = F.coalesce(only, F.array().cast("array<struct<kind:string,value:string>>"))
    return staged.withColumns({text: replaced, found: only}).drop(name)


def count_of(found: str, kind: str) -> Column:
    """Number of values of a kind in the column ``found``."""
    return F.size(F.filter(found, lambda m: m["kind"] == kind)).cast("long")
