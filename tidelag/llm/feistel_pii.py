"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations.

All work is done by built-in expressions.  A text is cut at its candidates; each candidate is validated, permuted
within its own format and put back:

=========  =============================================  ==========================================================
kind       validated                                      pseudonym
=========  =============================================  ==========================================================
card       13 to 19 digits, or groups of 4-4-4-4 or 4-6-5  digits but the last are permuted, the last is the new check
           parted by blanks or hyphens; Luhn check digit  digit; separators stay
phone      +, country code, three or five groups of digits  digits after the country code are permuted, alike in
                                                          every grouping
ip         four numbers of 0 to 255                       the 32-bit address is permuted
date       a day of 1900-01-01 to 2099-11-13 that exists  the day is permuted within those 73,000 days; layout stays,
                                                          and so does the order of day and month
email      local part, @, domain                          letters and digits of the local part are permuted, class
                                                          by class; the domain stays
account    other runs of 13 to 19 digits                  all digits are permuted, never to a valid card number
=========  =============================================  ==========================================================

Equal values get equal pseudonyms in every document, and different ones stay different, since every step is a
permutation.  Rounds use SHA-256 of the key, the kind, the length, the round and the other half.

Not covered, and left as they are: phone numbers without a country code, dates with one-digit days or months or in words,
identity numbers such as 123-45-6789, and IBANs.

Defined results: a NULL text stays NULL with no finding; empty and repeated rows are handled one by one; what fails
validation stays unchanged; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
_A, _B = 250, 292  # a day number is (x, y) with x below 250 and y below 292: 73,000 days
_FIRST_DAY = "1900-01-01"

# One expression that finds every candidate; longer formats stand first.
# A host name has at most 127 labels; the bound also keeps the matcher, which nests a level per label, shallow.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,127}[A-Za-z]{2,24}"
PHONE = (
    r"\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
    r"|[ .-][0-9](?:[ .-][0-9]{2}){4})"
)
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DAY_DATE = r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
NUMBER = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
# A candidate starts at a digit, a plus, or an e-mail's first character, and touches no digit or letter.
CANDIDATE = (
    rf"(?<![A-Za-z0-9])(?:(?<![._%+-]){EMAIL}(?![A-Za-z0-9])"
    rf"|{PHONE}(?![A-Za-z0-9])"
    rf"|(?<![.-])(?:{ISO_DATE}|{DAY_DATE})(?![A-Za-z0-9])"
    rf"|(?<![.]){IP}(?![A-Za-z0-9])(?!\.[0-9])"
    rf"|{NUMBER}(?![A-Za-z0-9]))"
)
# Country calling codes.  No code begins with another one.
COUNTRY = "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
WALK = 64  # steps of a cycle walk; each ends it with a probability of about a half or more
# Every candidate has two digits at most one character apart, or an @: texts without pass by at once.
QUICK = "[0-9][ .-]?[0-9]|@"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _feistel(left: Column, right: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """ROUNDS rounds over (left, right): the halves swap, and ``step(round, moved, other)`` changes the moved one.

    An even number of rounds brings either half back to its side, so halves may differ in kind and length.
    """
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(left.alias("left"), right.alias("right")),
        lambda s, i: F.struct(s["right"].alias("left"), step(i, s["left"], s["right"]).alias("right")),
    )


def _keyed(key: Column, label: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat(key, F.lit(f"|{label}|"), i.cast("string"), F.lit("|"), other), 256)


def _number(digest: Column, at: int, width: int) -> Column:
    return F.conv(F.substring(digest, at, width), 16, 10).cast("long")


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i`` (from 1) of a digest in hexadecimal; after 32 bytes they repeat."""
    return F.conv(digest.substr((F.pmod(i - 1, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _each(value: Column, change: Callable[[Column, Column], Column]) -> Column:
    """``value`` with each character ``c`` at place ``i`` (from 1) replaced by ``change(c, i)``."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == "", c).otherwise(change(c, i + 1))), "")


def _add_digits(digits: Column, digest: Column) -> Column:
    """Add to each decimal digit its own byte of the digest, modulo 10."""
    return bound(
        digest, lambda d: _each(digits, lambda c, i: F.pmod(c.cast("int") + _byte(d, i), F.lit(10)).cast("string"))
    )


def permute_digits(digits: Column, key: Column, label: str) -> Column:
    """A permutation of the digit strings of one length (at least 2)."""

    def permuted(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        size = F.length(d).cast("string")
        halves = _feistel(
            d.substr(F.lit(1), half),
            d.substr(half + 1, F.length(d)),
            lambda i, moved, other: _add_digits(moved, _keyed(key, label, i, F.concat(size, F.lit("|"), other))),
        )
        return bound(halves, lambda h: F.concat(h["left"], h["right"]))

    return bound(digits, permuted)


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn values; the last digit counts once, the one before it twice, and so on."""

    def add(total: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        place = total["place"]
        worth = F.when(c == "", 0).when(place % 2 == 1, twice).otherwise(d)
        return F.struct((total["sum"] + worth).alias("sum"), (place + F.when(c == "", 0).otherwise(1)).alias("place"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("place"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda total: total["sum"])


def _pour(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced by ``digits``, in order; everything else stays in place."""

    def next_character(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["text"], F.when(digit, s["left"].substr(F.lit(1), F.lit(1))).otherwise(c)).alias("text"),
            F.when(digit, s["left"].substr(F.lit(2), F.length(s["left"]))).otherwise(s["left"]).alias("left"),
        )

    start = F.struct(F.lit("").alias("text"), digits.alias("left"))
    return F.aggregate(F.split(layout, ""), start, next_character, lambda s: s["text"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _walked(value: Column, step: Callable[[Column], Column], outside: Callable[[Column], Column]) -> Column:
    """``step`` applied to ``value`` until the result is not ``outside``: still a permutation of the values inside."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), step(value), lambda v, _: F.when(outside(v), step(v)).otherwise(v)
    )


def pseudonym_card(value: Column, key: Column) -> Column:
    def checked(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(body, check.cast("string"))

    digits = _digits(value)
    return _pour(value, bound(permute_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card"), checked))


def pseudonym_account(value: Column, key: Column) -> Column:
    """All digits permuted, again until the check digit of a card is not met."""
    return _walked(value, lambda v: permute_digits(v, key, "account"), lambda v: luhn_sum(v) % 10 == 0)


def pseudonym_phone(value: Column, key: Column) -> Column:
    """The number behind the country code is permuted, however the whole is grouped."""

    def made(digits: Column) -> Column:
        country = F.regexp_extract(digits, f"^{COUNTRY}", 0)
        rest = digits.substr(F.length(country) + 1, F.length(digits))
        return _pour(value, F.concat(country, permute_digits(rest, key, "phone")))

    return bound(_digits(value), made)


def pseudonym_ip(value: Column, key: Column) -> Column:
    part = [F.split(value, r"\.").getItem(i).cast("long") for i in range(4)]
    halves = _feistel(
        part[0] * 256 + part[1],
        part[2] * 256 + part[3],
        lambda i, moved, other: F.pmod(moved + _number(_keyed(key, "ip", i, other.cast("string")), 1, 4), F.lit(65536)),
    )

    def dotted(h: Column) -> Column:
        numbers = [n for half in (h["left"], h["right"]) for n in (F.floor(half / 256), half % 256)]
        return F.concat_ws(".", *[n.cast("string") for n in numbers])

    return bound(halves, dotted)


def day_of(value: Column) -> Column:
    """The date of a candidate, NULL unless it exists; 13/02/2020 is read day first, 02/13/2020 month first."""
    iso = F.when(value.rlike(f"^{ISO_DATE}$"), F.try_to_date(value, "yyyy-MM-dd"))
    plain = F.when(value.rlike(f"^{DAY_DATE}$"), F.regexp_replace(value, "[.]", "/"))
    return F.coalesce(iso, F.try_to_date(plain, "dd/MM/yyyy"), F.try_to_date(plain, "MM/dd/yyyy"))


def pseudonym_date(value: Column, key: Column) -> Column:
    def permuted(day: Column) -> Column:
        def step(i: Column, moved: Column, other: Column) -> Column:
            size = F.when(i % 2 == 0, F.lit(_A)).otherwise(F.lit(_B)).cast("long")
            return F.pmod(moved + _number(_keyed(key, "date", i, other.cast("string")), 1, 8), size)

        halves = _feistel(F.floor(day / _B), F.pmod(day, F.lit(_B)).cast("long"), step)
        return bound(halves, lambda h: (h["left"] * _B + h["right"]).cast("int"))

    def as_date(day: Column) -> Column:
        return F.date_add(F.lit(_FIRST_DAY).cast("date"), day)

    month_first = ~value.rlike("^[0-9]{4}-") & F.try_to_date(F.regexp_replace(value, "[.]", "/"), "dd/MM/yyyy").isNull()

    def walked(day: Column) -> Column:
        # What is read month first must be read so again, that is have a day beyond 12.
        return as_date(_walked(day.cast("int"), permuted, lambda d: month_first & (F.dayofmonth(as_date(d)) <= 12)))

    def written(made: Column) -> Column:
        slashed = F.when(month_first, F.date_format(made, "MM/dd/yyyy")).otherwise(F.date_format(made, "dd/MM/yyyy"))
        dotted = F.when(value.contains("."), F.regexp_replace(slashed, "/", ".")).otherwise(slashed)
        return F.when(value.rlike("^[0-9]{4}-"), F.date_format(made, "yyyy-MM-dd")).otherwise(dotted)

    return bound(bound(F.datediff(day_of(value), F.lit(_FIRST_DAY).cast("date")), walked), written)


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _add_letters(value: Column, digest: Column) -> Column:
    """Shift each letter or digit within its class by its byte of the digest; other characters stay."""

    def shifted(c: Column, by: Column) -> Column:
        made = c
        for alphabet in (_SMALL, _SMALL.upper(), "0123456789"):
            at = F.instr(F.lit(alphabet), c)
            moved = F.lit(alphabet).substr(F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))
            made = F.when(at > 0, moved).otherwise(made)
        return made

    return bound(digest, lambda d: _each(value, lambda c, i: shifted(c, _byte(d, i))))


def pseudonym_email(value: Column, key: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    half = F.ceil(F.length(local) / 2).cast("int")
    halves = _feistel(
        local.substr(F.lit(1), half),
        local.substr(half + 1, F.length(local)),
        lambda i, moved, other: _add_letters(moved, _keyed(key, "email", i, F.concat(domain, F.lit("|"), other))),
    )
    return bound(halves, lambda h: F.concat(h["left"], h["right"], F.lit("@"), domain))


def kind_of(value: Column) -> Column:
    """What a candidate is, NULL if it fails validation."""
    digits = _digits(value)
    valid_ip = F.forall(F.split(value, r"\."), lambda p: p.cast("int") <= 255)
    in_range = day_of(value).between(F.lit(_FIRST_DAY).cast("date"), F.date_add(F.lit(_FIRST_DAY).cast("date"), _A * _B - 1))
    number = value.rlike(f"^{NUMBER}$")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.startswith("+"), F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .when(value.rlike(f"^{IP}$"), F.when(valid_ip, F.lit("ip")))
        .when(value.rlike(f"^(?:{ISO_DATE}|{DAY_DATE})$"), F.when(in_range, F.lit("date")))
        .when(number & (luhn_sum(digits) % 10 == 0), F.lit("card"))
        .when(value.rlike("^[0-9]{13,19}$"), F.lit("account"))
    )


def pseudonym(value: Column, kind: Column, key: Column) -> Column:
    return (
        F.when(kind == "email", pseudonym_email(value, key))
        .when(kind == "phone", pseudonym_phone(value, key))
        .when(kind == "ip", pseudonym_ip(value, key))
        .when(kind == "date", pseudonym_date(value, key))
        .when(kind == "card", pseudonym_card(value, key))
        .when(kind == "account", pseudonym_account(value, key))
        .otherwise(value)
    )


KINDS = ["card", "phone", "ip", "date", "email", "account"]


def pseudonymised(documents: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_<kind> for every kind, and the findings (kind, pseudonym) in text order."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    cut = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        "doc_id", "text", F.when(text.rlike(QUICK), found).alias("found")
    )
    secret = F.lit(key)

    def handled(value: Column) -> Column:
        return bound(
            kind_of(value), lambda kind: F.struct(kind.alias("kind"), pseudonym(value, kind, secret).alias("value"))
        )

    made = cut.select("doc_id", "text", F.transform("found", handled).alias("made"))
    gaps = F.split(text, CANDIDATE, -1)
    pieces = F.zip_with(gaps, "made", lambda g, m: F.concat(g, F.coalesce(m["value"], F.lit(""))))
    kinds = F.filter("made", lambda m: m["kind"].isNotNull())

    def times(kind: str) -> Column:
        of_kind = F.size(F.filter("made", lambda m: m["kind"] == F.lit(kind)))
        return F.when(F.col("made").isNull(), F.lit(0)).otherwise(of_kind).cast("long").alias(f"n_{kind}")

    return made.select(
        "doc_id",
        F.when(F.col("made").isNull(), text).otherwise(F.array_join(pieces, "")).alias("text"),
        *map(times, KINDS),
        F.coalesce(kinds, F.array().cast("array<struct<kind:string,value:string>>")).alias("findings"),
    )
