"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Every validated value is replaced by a keyed permutation of its own format:
card and account numbers keep their length and whether their check digit is
right (a run of 13 to 19 digits is taken for one with a wrong check digit too:
rewriting an order number is preferred to leaving a mistyped card), phone
numbers their country code and punctuation, identity numbers their
punctuation, IP addresses four octets, dates their notation and calendar
validity, and mail addresses the lengths and kinds of characters before the
``@``.  A phone number has one pseudonym in all its notations.  The same value gets the
same pseudonym in every document, so links between documents stay.

The permutation is an alternating Feistel network over a product of two
ranges ``a x b``: ``left += F(right) mod a``, ``right += F(left) mod b``.  It is
a bijection for any ``a`` and ``b``, so no value needs a second try.  The
round function is SHA-256 of key, kind, round and the other half.

All of it is built-in SQL functions: one regular expression finds the values,
the text between them is kept as it is, and each value is rewritten in an
array transform.  It is a single map pass without a shuffle.

Defined cases: a null text stays null, with no values.  A candidate that
fails validation (an octet above 255, a day that does not exist, an account
number whose digits go on, a domain name of more than 127 labels) is left as
it is.  A permutation may map a value to itself with a chance of one in the
size of its format.  Rows that repeat are rewritten alike; empty tables are
fine.  Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY = "0001-01-01"
# All days of the years 1 to 9999 as blocks of a x b days, one after the other; a date stays in its
# block.  The middle one runs from 1900-01-01 to August 2099.
DAY_BLOCKS = [(17, 35), (825, 840), (270, 270), (1698, 1698), (40, 59)]
# Telephone country codes of one and two digits; all others have three.
SHORT_CODES = ["1", "7"]
PAIR_CODES = ["20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
              "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84",
              "86", "90", "91", "92", "93", "94", "95", "98"]

# Repeated groups have a bound: a Java regular expression takes stack for every repetition.  A domain
# name has 127 labels at most.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}"
# the ten-digit form of country 1 first: a number that follows must not be taken for a part of it
PHONE = (r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
         r"|\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9]|\.[0-9])"
         r"|(?<![0-9+])(?<![0-9][ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-]|\.[0-9])")
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ACCOUNT = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9])"
KINDS = {"mail": MAIL, "phone": PHONE, "identity": IDENTITY, "iso_date": ISO_DATE, "day_date": DAY_DATE,
         "address": ADDRESS, "account": ACCOUNT}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _noise(key: str, kind: str, round_no: Column, half: Column) -> Column:
    """Keyed 60-bit number for a round."""
    text = F.concat_ws(":", F.lit(key), F.lit(kind), round_no.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Struct (l, r): the keyed permutation of (left, right) over ``a x b``."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(pair: Column, i: Column) -> Column:
        odd = (i % 2) == 1
        new_l = F.when(odd, (pair["l"] + F.pmod(_noise(key, kind, i, pair["r"]), a)) % a).otherwise(pair["l"])
        new_r = F.when(odd, pair["r"]).otherwise((pair["r"] + F.pmod(_noise(key, kind, i, pair["l"]), b)) % b)
        return F.struct(new_l.cast("bigint").alias("l"), new_r.cast("bigint").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _bind(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once (an array transform stands for the missing let)."""
    return F.transform(F.array(value), body)[0]


def _pow10(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("bigint")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 1 to 36 characters to another of the same length."""
    def run(d: Column) -> Column:
        n = F.length(d)
        u = (n / 2).cast("int")
        v = n - u
        left = F.when(u > 0, F.substring(d, F.lit(1), u).cast("bigint")).otherwise(F.lit(0))
        right = F.substring(d, u + 1, v).cast("bigint")
        return _bind(feistel(left, right, _pow10(u), _pow10(v), key, kind),
                     lambda p: F.concat(F.when(u > 0, F.lpad(p["l"].cast("string"), u, "0")).otherwise(F.lit("")),
                                        F.lpad(p["r"].cast("string"), v, "0")))

    return _bind(digits, run)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    characters = F.filter(F.split(shape, ""), lambda c: F.length(c) > 0)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["used"] + 1, F.lit(1))).otherwise(c)).alias("out"),
                        (acc["used"] + is_digit.cast("int")).alias("used"))

    return F.aggregate(characters, start, step, lambda acc: acc["out"])


def _check_digit(body: Column) -> Column:
    """The check digit that the Luhn rule gives for ``body``."""
    numbers = F.transform(F.filter(F.split(F.reverse(body), ""), lambda c: F.length(c) > 0), lambda c: c.cast("int"))
    weighed = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return (10 - F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10) % 10


def _account(value: Column, key: str) -> Column:
    """Digits but the last are permuted; the last keeps its distance to the right check digit."""
    def run(d: Column) -> Column:
        body, last = F.substring(d, F.lit(1), F.length(d) - 1), F.substring(d, F.length(d), F.lit(1)).cast("int")
        off = F.pmod(last - _check_digit(body), F.lit(10))
        return _bind(permute_digits(body, key, "account"),
                     lambda new: F.concat(new, ((_check_digit(new) + off) % 10).cast("string")))

    return _refill(value, _bind(_digits(value), run))


def _phone(value: Column, key: str) -> Column:
    """The country code stays, the digits after it are permuted, whatever the punctuation.

    A national number of ten digits is one of country 1.
    """
    def run(digits: Column) -> Column:
        code = (F.when(~value.startswith("+"), F.lit(""))
                .when(F.substring(digits, 1, 1).isin(SHORT_CODES), F.substring(digits, 1, 1))
                .when(F.substring(digits, 1, 2).isin(PAIR_CODES), F.substring(digits, 1, 2))
                .otherwise(F.substring(digits, 1, 3)))
        return _bind(code, lambda c: F.concat(c, permute_digits(
            F.substring(digits, F.length(c) + 1, F.length(digits)), key, "phone")))

    return _refill(value, _bind(_digits(value), run))


def _identity(value: Column, key: str) -> Column:
    return _refill(value, permute_digits(_digits(value), key, "identity"))


def _address(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("bigint"))

    def run(o: Column) -> Column:
        side = F.lit(65536)
        new = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], side, side, key, "address")
        text = _bind(new, lambda p: F.concat_ws(
            ".", *[(F.shiftright(p[h], s) % 256).cast("string") for h, s in (("l", 8), ("l", 0), ("r", 8), ("r", 0))]))
        return F.when(F.forall(o, lambda x: x <= 255), text).otherwise(value)

    return _bind(octets, run)


def _date(value: Column, notation: str, key: str) -> Column:
    def run(day: Column) -> Column:
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        first, a, b, low = F.lit(None), F.lit(None), F.lit(None), 0
        for x, y in DAY_BLOCKS:
            inside = (n >= low) & (n < low + x * y)
            first, a, b = (F.when(inside, F.lit(v)).otherwise(old) for v, old in ((low, first), (x, a), (y, b)))
            low += x * y

        def move(block: Column) -> Column:
            place = n - block["first"]
            new = feistel(F.floor(place / block["b"]), place % block["b"], block["a"], block["b"], key, "date")
            return _bind(new, lambda p: F.date_format(F.date_add(
                F.lit(FIRST_DAY).cast("date"), (block["first"] + p["l"] * block["b"] + p["r"]).cast("int")), notation))

        found = F.struct(first.cast("bigint").alias("first"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
        return _bind(found, lambda block: F.when(block["a"].isNull(), value).otherwise(move(block)))

    iso = value if notation == "yyyy-MM-dd" else F.concat_ws(
        "-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))
    return _bind(iso.try_cast("date"), lambda day: F.when(day.isNull(), value).otherwise(run(day)))


def _mail(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    local, domain = F.substring(value, F.lit(1), at - 1), F.substring(value, at, F.length(value))
    parts = F.regexp_extract_all(local, F.lit("[a-z]{1,12}|[A-Z]{1,12}|[0-9]{1,12}|[^a-zA-Z0-9]+"), F.lit(0))
    new = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), permute_digits(p, key, "mail"))
                      .when(p.rlike("^[a-z]"), permute_letters(p, key))
                      .when(p.rlike("^[A-Z]"), F.upper(permute_letters(F.lower(p), key))).otherwise(p))
    return F.concat(F.array_join(new, ""), domain)


def permute_letters(letters: Column, key: str) -> Column:
    """A run of 1 to 12 letters a-z to another of the same length (base-26 halves)."""
    a = ord("a")

    def number(text: Column) -> Column:
        return F.aggregate(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), F.lit(0).cast("bigint"),
                           lambda acc, c: acc * 26 + (F.ascii(c) - a))

    def text_of(n: Column, size: Column) -> Column:
        places = F.when(size > 0, F.sequence(size - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, lambda k: F.char(
            (F.pmod(F.floor(n / F.pow(F.lit(26.0), k)), F.lit(26)) + a).cast("int"))), "")

    def run(t: Column) -> Column:
        n = F.length(t)
        u = (n / 2).cast("int")
        v = n - u
        side = lambda k: F.pow(F.lit(26.0), k).cast("bigint")
        new = feistel(number(F.substring(t, F.lit(1), u)), number(F.substring(t, u + 1, v)), side(u), side(v), key, "letters")
        return _bind(new, lambda p: F.concat(text_of(p["l"], u), text_of(p["r"], v)))

    return _bind(letters, run)


def pseudonym(value: Column, key: str) -> Column:
    """The replacement of one found value."""
    def whole(kind: str) -> Column:
        return value.rlike(f"^(?:{KINDS[kind]})$")

    return (F.when(whole("mail"), _mail(value, key))
            .when(whole("phone"), _phone(value, key))
            .when(whole("identity"), _identity(value, key))
            .when(whole("iso_date"), _date(value, "yyyy-MM-dd", key))
            .when(whole("day_date"), _date(value, "dd/MM/yyyy", key))
            .when(whole("address"), _address(value, key))
            .otherwise(_account(value, key)))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text`` with every value replaced, ``n_values`` replaced."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # every kind of value has a digit or an @: texts without them are not searched
    rows = rows.withColumn("found", F.when(F.col("text").rlike("[0-9@]"),
                                           F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("fresh", F.transform("found", lambda v: pseudonym(v, key)))
    between = F.split("text", ANY, -1)
    joined = F.array_join(F.transform(between, lambda g, i: F.concat(g, F.coalesce(F.get("fresh", i), F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip("found", "fresh"), lambda z: z["found"] != z["fresh"]))
    return rows.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"),
                       F.when(F.size("found") > 0, changed).otherwise(F.lit(0)).cast("bigint").alias("n_values"))
