"""Format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions only.

Card numbers (checked by their check digit), phone numbers, IPv4 addresses, e-mail names, calendar dates and secrets (access key
ids, and values with a digit that are assigned to the name of a secret, of any length) are found by pattern, validated, written as digits of mixed radix, permuted by an alternating Feistel network whose round function is a
keyed SHA-256, and written back in the format they had. The permutation of a format is a bijection: equal values
get equal pseudonyms in every document, different values different ones, and ``restore`` with the key undoes it.
A pseudonym depends on its value and the key alone, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.columns import whole_row, with_columns

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
#: 4-4-4-4, 4-6-5 and 4-6-4, 4-3-3-3, or 13 to 19 digits in one.
CARD = (
    r"(?<![0-9A-Za-z])(?:(?:[0-9]{4}[ .-]){3}[0-9]{4}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{4,5}|[0-9]{4}(?:[ .-][0-9]{3}){3}|[0-9]{13,19})(?![0-9A-Za-z])"
)
#: Three, three and four digits, apart.
LOCAL = r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
#: After a trunk 0: 3-4-4, 4-3-4, 4-3-3, 5-6, 5-3-3, pairs, or an area and 6 to 8 digits.
TRUNK = (
    r"(?:(?:\(0[0-9]{2}\) ?|0[0-9]{2}[ -])[0-9]{4}[ -][0-9]{4}|(?:\(0[0-9]{3}\) ?|0[0-9]{3}[ -])[0-9]{3}[ -][0-9]{3,4}"
    r"|(?:\(0[0-9]{4}\) ?|0[0-9]{4}[ -])(?:[0-9]{6}|[0-9]{3}[ -][0-9]{3})|0[0-9](?:[ .-][0-9]{2}){4}|(?:\(0[0-9]{2,4}\) ?|0[0-9]{2,4}[ /-])[0-9]{6,8})"
)
#: International numbers have 8 to 15 digits, of which the ones in brackets are a bonus, and 11 where the country is 1.
PHONE = (
    r"(?:(?<![0-9A-Za-z])\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\+[0-9]{1,3}[ .-]?\([0-9]{1,5}\)(?:[ ./-]?[0-9]){5,9}|\+[0-9]{1,3}(?:[ ./-]?[0-9]){7,12}"
    rf"|{LOCAL}|{TRUNK})(?![0-9A-Za-z]|[.-][0-9]))"
)
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z])(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2[0-9]{4})(?![0-9A-Za-z])"
SECRET = r"[A-Za-z0-9_/=+.~-]"
#: The whole run that stands there, but for full stops at its end. A run that begins with an e-mail name, or with a card or phone number that
#: it ends with or that goes on behind it, is left to their patterns. A cheap test of what stands before comes first, since the second one is tried at every place that passes it.
ASSIGNED = (
    r"(?<=[=:\"']|[=:] )(?<=(?i:token|secret|api_?key|access_?key|password|passwd|pwd)[\"']? ?[=:] ?[\"']?)"
    rf"(?!{EMAIL})(?!(?:{PHONE}|{CARD})(?!{SECRET}))(?=[A-Za-z_/=+.~-]*+[0-9]){SECRET}{{8,}}(?<=[^.])"
)
KEY_ID = r"(?<=(?<![0-9A-Za-z])AKIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
#: The groups in DATE are its only ones: the other patterns must have none.
ANY = "|".join((ASSIGNED, DATE, EMAIL, PHONE, IPV4, CARD, KEY_ID))

KINDS = ("date", "email", "phone", "ipv4", "card", "secret")
ROUNDS = 10
#: Dates are days 0 to SIDE * SIDE - 1 after DAY_0; others are not taken for dates.
DAY_0 = "1900-01-01"
SIDE = 270


def _chars(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "", -1))


def luhn(digits: Column) -> Column:
    """The Luhn sum of an array of digit strings, the last counting once."""
    n = F.size(digits)
    worth = F.transform(
        digits, lambda d, i: F.when((n - i) % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))
    )
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _as_date(text: Column) -> Column:
    iso = lambda day: F.when(day.rlike("^[0-9]{4}"), day).otherwise(
        F.concat(F.substring(day, 7, 4), F.lit("-"), F.substring(day, 4, 2), F.lit("-"), F.substring(day, 1, 2))
    )
    return F.try_to_timestamp(let(F.regexp_replace(text, "[./]", "-"), iso), F.lit("yyyy-MM-dd")).cast("date")


def _days(text: Column) -> Column:
    return F.date_diff(_as_date(text), F.lit(DAY_0).cast("date"))


def kind_of(text: Column) -> Column:
    """The kind of a found value, or null where it is none after all."""
    return (
        F.when(F.contains(text, F.lit("@")), "email")
        .when(text.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ipv4"))
        .when(text.rlike(r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$|^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), F.when(_days(text).between(0, SIDE * SIDE - 1), "date"))
        .when(text.rlike(f"^{CARD}$"), F.when(let(_chars(_only_digits(text)), luhn) % 10 == 0, "card"))
        .when(text.rlike(f"^{PHONE}$"), "phone")
        .otherwise("secret")
    )


def _low(c: Column, kind: Column) -> Column:
    """The first code of the class that a code is in, or itself: digits, small and capital letters.

    In secrets the letters that may be hexadecimal digits are classes of their own, so that such numbers stay what they are.
    """
    plain = F.when(c.between(48, 57), 48).when(c.between(97, 122), 97).when(c.between(65, 90), 65).otherwise(c)
    return F.when((kind == "secret") & (c.between(103, 122) | c.between(71, 90)), F.when(c > 90, 103).otherwise(71)).otherwise(plain)


def _radix(c: Column, kind: Column) -> Column:
    """How many codes the class of a code has."""
    letter = F.when(kind != "secret", 26).when(c.between(97, 102) | c.between(65, 70), 6).otherwise(20)
    return F.when(c.between(48, 57), 10).when(c.between(97, 122) | c.between(65, 90), letter).otherwise(1)


def _closed(phone: Column) -> Column:
    """What stays of a phone number, by digits that stay themselves: the country's code and the sign behind it, or the trunk 0."""
    return F.when(
        F.startswith(phone, F.lit("+")),
        F.regexp_extract(phone, r"^\+(?:[0-9]{1,3}(?![0-9])|1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})[ .-]?", 0),
    ).when(phone.rlike(f"^{LOCAL}$"), "").otherwise(F.regexp_extract(phone, r"^\(?0", 0))


def _open_part(h: Column) -> Column:
    """The characters of a value that may change."""
    return (
        F.when(h["kind"] == "email", F.substring_index(h["value"], "@", 1))
        .when(h["kind"] == "phone", F.substring(h["value"], F.length(_closed(h["value"])) + 1, F.length(h["value"])))
        .when(h["kind"] == "secret", h["value"])
        .otherwise(let(_only_digits(h["value"]), lambda d: F.substring(d, F.lit(1), F.length(d) - 1)))
    )


def _coded(h: Column) -> Column:
    """A found value with its digits ``v`` and their radix ``m``; ``o`` are the characters that digits stand for."""
    two = lambda days: F.array(F.struct(F.floor(days / SIDE).cast("int").alias("v"), F.lit(SIDE).alias("m")), F.struct((days % SIDE).cast("int").alias("v"), F.lit(SIDE).alias("m")))
    octets = F.transform(F.split(h["value"], r"\."), lambda o: F.struct(o.cast("int").alias("v"), F.lit(256).alias("m")))
    signs = F.transform(
        F.transform(_chars(_open_part(h)), lambda c: F.ascii(c)),
        lambda c: F.struct((c - _low(c, h["kind"])).alias("v"), _radix(c, h["kind"]).alias("m")),
    )
    digits = F.when(h["kind"] == "date", let(_days(h["value"]), two)).when(h["kind"] == "ipv4", octets).when(h["kind"].isNotNull(), signs)
    return let(digits, lambda d: F.struct(h["value"].alias("value"), h["kind"].alias("kind"), F.floor(F.size(d) / 2).cast("int").alias("h"), d.alias("d")))


def _halves(h: Column) -> Column:
    return F.struct(h["value"].alias("value"), h["kind"].alias("kind"), F.slice(h["d"], F.lit(1), h["h"]).alias("l"), F.slice(h["d"], h["h"] + 1, F.size(h["d"]) - h["h"]).alias("r"))


def _turned(mine: Column, other: Column, kind: Column, turn: int, key: str, back: bool) -> Column:
    """One half of the digits, each shifted by a keyed hash of the other half and its place."""

    # Each digit hashes the seed, so that of a long value is hashed first.
    short = lambda seed: F.when(F.size(mine) + F.size(other) > 128, F.sha2(seed, 256)).otherwise(seed)

    def shifted(seed: Column) -> Column:
        def one(x: Column, place: Column) -> Column:
            hashed = F.conv(F.substring(F.sha2(F.concat(seed, place.cast("string")), 256), 1, 12), 16, 10).cast("long")
            return F.struct(F.pmod(x["v"] - hashed if back else x["v"] + hashed, x["m"]).cast("int").alias("v"), x["m"].alias("m"))

        return F.transform(mine, one)

    seed = F.concat(F.lit(f"{key}/{turn}/"), kind, F.lit("/"), F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ","), F.lit("/"))
    return let(let(seed, short), shifted)


def _round(turn: int, key: str, back: bool):
    def run(h: Column) -> Column:
        left = _turned(h["l"], h["r"], h["kind"], turn, key, back) if turn % 2 else h["l"]
        right = h["r"] if turn % 2 else _turned(h["r"], h["l"], h["kind"], turn, key, back)
        return F.struct(h["value"].alias("value"), h["kind"].alias("kind"), left.alias("l"), right.alias("r"))

    return run


def _spelt(h: Column) -> Column:
    """A value's new digits in the old format."""
    value, kind = h["value"], h["kind"]
    new = F.transform(F.concat(h["l"], h["r"]), lambda x: x["v"])
    signs = lambda old: F.array_join(F.zip_with(new, F.transform(_chars(old), lambda c: F.ascii(c)), lambda v, c: F.char(v + _low(c, kind))), "")

    def card(body: Column) -> Column:
        check = F.pmod(-luhn(F.concat(body, F.array(F.lit("0")))), F.lit(10)).cast("string")
        place = lambda i: F.length(_only_digits(F.substring(value, F.lit(1), i + 1)))
        apart = lambda d: F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.between("0", "9"), F.substring(d, place(i), F.lit(1))).otherwise(c)), "")
        cut = lambda d: F.when(F.length(value) == F.length(d), d).otherwise(apart(d))
        return let(F.concat(F.array_join(body, ""), check), cut)

    def date(iso: Column) -> Column:
        y, m, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
        return F.when(value.rlike("^[0-9]{4}"), F.concat(y, F.substring(value, 5, 1), m, F.substring(value, 8, 1), d)).otherwise(
            F.concat(d, F.substring(value, 3, 1), m, F.substring(value, 6, 1), y)
        )

    day = let(new, lambda v: F.date_add(F.lit(DAY_0).cast("date"), F.get(v, F.lit(0)) * SIDE + F.get(v, F.lit(1))).cast("string"))
    made = (
        F.when(kind == "card", let(F.transform(new, lambda v: v.cast("string")), card))
        .when(kind == "date", let(day, date))
        .when(kind == "ipv4", F.array_join(F.transform(new, lambda v: v.cast("string")), "."))
        .when(kind == "secret", signs(value))
        .when(kind == "phone", F.concat(_closed(value), signs(_open_part(h))))
        .when(kind == "email", F.concat(signs(_open_part(h)), F.lit("@"), F.substring_index(value, "@", -1)))
        .otherwise(value)
    )
    return F.struct(kind.alias("kind"), made.alias("text"))


def pseudonymise(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs`` with the validated values in ``text`` replaced by pseudonyms, ``n_values`` and ``n_<kind>`` (long).

    ``key`` is the secret. A null text stays null and an empty one empty, with no values; a text without values is unchanged.
    Values that only look valid (a wrong check digit, the 30th of February, an octet of 300) stay, as do the names of secrets. Other columns pass;
    the counts replace columns of their names. Repeated rows get the same result each; an empty table stays empty.
    ``back=True`` undoes the permutation in texts that it made.
    """
    base = docs.select(whole_row(docs).alias("row"), F.col("text").cast("string").alias("text"))
    some = F.when(F.col("text").rlike("[0-9@]|AKIA"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # Each step reads the one before it once, so that the steps can be fused without being computed twice.
    found = base.withColumn("hits", F.transform(some, lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind"))))
    found = found.withColumn("hits", F.transform("hits", _coded)).withColumn("hits", F.transform("hits", _halves))
    for turn in range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1):
        found = found.withColumn("hits", F.transform("hits", _round(turn, key, back)))
    found = found.withColumn("hits", F.transform("hits", _spelt))
    new = F.transform("hits", lambda h: h["text"])
    gaps = F.split("text", ANY, -1)
    text = F.when(F.exists("hits", lambda h: h["kind"].isNotNull()), F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")).otherwise(F.col("text"))
    count = lambda k: F.coalesce(F.size(F.filter("hits", lambda h: h["kind"] == k)), F.lit(0)).cast("long")
    counts = {f"n_{k}": count(k) for k in KINDS}
    return with_columns(found, "row", {"text": text, "n_values": sum(counts.values(), F.lit(0)).cast("long"), **counts})


def restore(docs: DataFrame, key: str) -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, back=True)
