"""Personal data under format-preserving pseudonyms, in Spark expressions.

Numbers and dates are found by pattern, validated (Luhn digit, octets, calendar, mod 97, number ranges) and
permuted within their format by a keyed Feistel network with modular addition.  What falls out of the
format is permuted again until it is within (cycle walking), so each kind is a permutation of its own valid
values: equal values stay equal in all documents, and different values of a kind stay different.

* Phone numbers keep separators, length and country code; with and without it a number is the same.
* Card numbers keep length, separators and a valid check digit; bank account numbers country, length,
  letters, groups and valid check digits.  Addresses stay addresses.
* Dates stay dates, within their cycle of 400 years.  yyyy-MM-dd and dd/MM/yyyy have one permutation;
  MM/dd/yyyy, read so only where the day is over 12, has another among such dates.
* Social security numbers stay within the ranges that are given out.
* E-mail addresses, which have no fixed format, become keyed digests of 128 bits.

Defined cases: a null text stays null with zero counts; empty texts stay empty; repeated rows are
treated alike; a number that fails its validation stays, as do dates outside of the years 200 to 9799; an
empty table gives no rows; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import table

EMAIL = r"(?<![\w.%+-])[A-Za-z0-9_.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w/-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
#: A phone number ends where an address begins, so no group of it is an address's first octet.
_OCTET = r"(?:[01]?\d?\d|2[0-4]\d|25[0-5])"
_NO_ADDRESS = rf"(?!(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d))"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?" + _NO_ADDRESS + r"\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
CARD = r"(?<![\w])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
#: In this order at each place; each kind is told by its own pattern afterwards.
KINDS = {"email": EMAIL, "address": ADDRESS, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE, "iban": IBAN}
ANY = "|".join([EMAIL, ADDRESS, DATE, SSN, CARD, PHONE, IBAN])
ROUNDS = 8
#: Dates are permuted within their cycle of the calendar, counted from here: 146097 days = 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
YEARS = (200, 9799)  # whole cycles, written with four digits
#: Telephone country codes of one and of two digits; all others have three.
ONE_DIGIT = "^[17]"
TWO_DIGITS = "^(?:20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Steps of cycle walking, at most: each leaves the format with a chance under 0.4, so all of them never do.
WALK = 64


def _round_value(key: str, kind: str, i: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """Struct (l, r): the pair permuted within left_size * right_size values."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda s, i: F.struct(
            F.when(i % 2 == 0, (s["l"] + _round_value(key, kind, i, s["r"])) % left_size).otherwise(s["l"]).cast("long").alias("l"),
            F.when(i % 2 == 1, (s["r"] + _round_value(key, kind, i, s["l"])) % right_size).otherwise(s["r"]).cast("long").alias("r"),
        ),
    )


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _walk(value: Column, step, valid) -> Column:
    """``step`` of ``value``, and again until ``valid``: a permutation of the valid values."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(value), lambda v, i: F.when(valid(v), v).otherwise(step(v)))


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among the strings of its length."""
    cut = (F.length(digits) / 2).cast("int")
    a, b = F.substring(digits, F.lit(1), cut), F.substring(digits, cut + 1, F.length(digits))
    done = feistel(a, b, _ten_to(F.length(a)), _ten_to(F.length(b)), key, kind)
    return _let(done, lambda s: F.concat(F.lpad(s["l"].cast("string"), F.length(a), F.lit("0")), F.lpad(s["r"].cast("string"), F.length(b), F.lit("0"))))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string without its check digit is that of the string with 0 behind it."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i))


def _in_format(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    at = lambda i: F.substring(shape, i, F.lit(1))
    seen = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(at(i).rlike("[0-9]"), F.substring(digits, seen(i), F.lit(1))).otherwise(at(i))), "")


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(body, lambda b: _in_format(m, F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    return _let(_digits(m), new)


def _phone(m: Column, key: str) -> Column:
    """All digits but those of the country code change."""
    def new(d: Column) -> Column:
        code = F.when(~m.startswith("+"), 0).when(d.rlike(ONE_DIGIT), 1).when(d.rlike(TWO_DIGITS), 2).otherwise(3)
        return _in_format(m, F.concat(F.substring(d, F.lit(1), code), permute_digits(F.substring(d, code + 1, F.length(d)), key, "phone")))

    return _let(_digits(m), new)


def _ssn_ok(d: Column) -> Column:
    """Numbers that are given out: area, group and serial are not zero, and the area is under 900 and not 666."""
    return ~d.rlike("^(?:000|666|9)|^...00|0000$")


def _address(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    done = _let(o, lambda o: feistel(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), F.lit(65536), F.lit(65536), key, "address"))
    part = lambda v: F.concat_ws(".", (v / 256).cast("int").cast("string"), (v % 256).cast("string"))
    return _let(done, lambda s: F.concat_ws(".", part(s["l"]), part(s["r"])))


def _day(m: Column) -> Column:
    iso = m.contains("-")
    return F.coalesce(F.try_to_date(F.when(iso, m), "yyyy-MM-dd"), F.try_to_date(F.when(~iso, m), "dd/MM/yyyy"), F.try_to_date(F.when(~iso, m), "MM/dd/yyyy"))


def _permuted_day(day: Column, key: str, kind: str) -> Column:
    size = DAYS[0] * DAYS[1]
    first = F.lit(FIRST_DAY).cast("date")
    done = _let(F.date_diff(day, first), lambda n: F.struct(F.floor(n / size).alias("cycle"), feistel((F.pmod(n, F.lit(size)) / DAYS[1]).cast("int"), F.pmod(n, F.lit(size)) % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, kind).alias("s")))
    return _let(done, lambda x: F.date_add(first, (x["cycle"] * size + x["s"]["l"] * DAYS[1] + x["s"]["r"]).cast("int")))


def _date(m: Column, key: str) -> Column:
    american = F.try_to_date(F.when(~m.contains("-"), m), "dd/MM/yyyy").isNull()
    usual = _let(_permuted_day(_day(m), key, "date"), lambda day: F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy")))
    walked = _walk(_day(m), lambda day: _permuted_day(day, key, "date-month-first"), lambda day: F.day(day) > 12)
    return F.when(~m.contains("-") & american, F.date_format(walked, "MM/dd/yyyy")).otherwise(usual)


def _iban_rest(m: Column) -> Column:
    """Mod 97 of country and check digits moved behind, letters as 10 to 35; ``m`` without spaces."""
    turned = F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda s, i: F.when(code(i) < 65, (s * 10 + code(i) - 48) % 97).otherwise((s * 100 + code(i) - 55) % 97))


def _closed(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _iban(m: Column, key: str) -> Column:
    """The digits behind the check digits change, then the check digits follow."""
    def new(d: Column) -> Column:
        half = permute_digits(d, key, "iban")
        whole = F.concat(F.substring(m, F.lit(1), F.lit(2)), F.lit("00"), _in_format(F.substring(m, F.lit(5), F.length(m)), half))
        return _let(whole, lambda z: F.concat(F.substring(m, F.lit(1), F.lit(2)), F.lpad((98 - _iban_rest(_closed(z))).cast("string"), F.lit(2), F.lit("0")), F.substring(z, F.lit(5), F.length(z))))

    return _let(_digits(F.substring(m, F.lit(5), F.length(m))), new)


def _behind(m: Column) -> Column:
    """What looks like an account number in groups, without its first group."""
    return F.substring(m, F.lit(6), F.length(m))


def _is(kind: str, m: Column) -> Column:
    return m.rlike(f"^(?:{KINDS[kind]})$")


def kind_of(m: Column) -> Column:
    """The kind of a match, or null if it fails its validation."""
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(_is("address", m), F.when(octets, F.lit("address")))
        .when(_is("date", m), F.when(F.year(_day(m)).between(*YEARS), F.lit("date")))
        .when(_is("ssn", m), F.when(_ssn_ok(_digits(m)), F.lit("ssn")))
        .when(_is("card", m), F.when(_luhn_sum(_digits(m)) % 10 == 0, F.lit("card")))
        .when(_is("phone", m), F.lit("phone"))
        .when(_is("iban", m) & (_iban_rest(_closed(m)) == 1) & (F.length(_digits(m)) >= 4), F.lit("iban"))
        .when(_is("card", _behind(m)), F.when(_luhn_sum(_digits(_behind(m))) % 10 == 0, F.lit("card")))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    email = F.concat(F.lit("user."), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 32), F.lit("@mail.invalid"))
    return (
        F.when(kind == "email", email)
        .when(kind == "address", _address(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "ssn", _in_format(m, _walk(_digits(m), lambda d: permute_digits(d, key, "ssn"), _ssn_ok)))
        .when((kind == "card") & m.rlike("^[A-Z]"), F.concat(F.substring(m, F.lit(1), F.lit(5)), _card(_behind(m), key)))
        .when(kind == "card", _card(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "iban", _iban(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and a count for each kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Texts without a digit or an at sign hold none of the kinds.
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    marked = rows.withColumn("found", F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    new = F.transform("found", lambda x: pseudonym(x["m"], x["kind"], key))
    gaps = F.split("text", ANY, -1)
    text = F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("new", i), F.lit("")))), ""))
    of = lambda k: F.filter("found", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return marked.withColumn("new", new).select("doc_id", *counts, text.alias("text"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key="marlstone-demo-key")
