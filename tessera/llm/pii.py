"""Operator 1, personal data replaced by format-preserving Feistel pseudonyms.

Found by one pattern: card numbers (13 to 19 digits, at once or in groups of two or more, Luhn-valid), IBANs (mod 97), US social security numbers, dates
(2024-01-31, 31.01.2024, 01/31/2024, with or without zeros), IPv4 addresses, phone numbers (with a plus, in brackets, or in groups of 3, 3 and 4) and
e-mail addresses. Each goes through a keyed Feistel permutation of the valid numbers of its format, and back into its
places: cards and IBANs of all numbers with as many digits, check digits computed anew; social security numbers of the valid
ones (area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999); a phone number after its country code, which stays, ten
digits whose third groups may begin a North American number of those, so that a number has one pseudonym with and without +1;
an address of 32 bits; a date of the days 1900-01-01 to 2099-11-12 (73,000; other dates are left), whatever its format. A
permutation maps different values to different ones and equal ones to equal ones, so documents stay linked; who has the key
can undo it. An address's local part, which isn't a number, becomes a keyed hash. Other digits are left.

Null and empty texts stay as they are; rows are independent of each other, so ties and repeated rows are alike; a table without
rows gives none. Other columns stay, but for text; where they have the names of the two counts, the counts get an underscore
before theirs. A long text is rewritten as one row. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
SSN = r"\d{3}-\d{2}-\d{4}"
DATE = r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .]?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}"
# the usual groupings first, so that a number after them isn't taken in
CARD = (
    r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5}|\d{13,19}"
    r"|(?=(?:\d ?){13,19}(?! ?\d))\d{2,}(?: \d{2,})+|(?=(?:\d-?){13,19}(?!-?\d))\d{2,}(?:-\d{2,})+"
)
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?\d[A-Z0-9]{0,2})?"
# possessive and apart from other word characters, so that a match is never part of a longer number or name
FOUND = rf"(?<![\w.@%+-])(?:{EMAIL}|(?:{IBAN}|{IPV4}|{SSN}|{DATE}|{PHONE}|{CARD})(?![\w@]|[.-]\d))"
# Country codes of one and two digits; all others have three.
CODES = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\\d{3}"
ROUNDS = 8
FIRST_DAY, DAYS, HALVES = "1900-01-01", 73_000, (250, 292)


def secret(key: str, round_: Column, about: Column, value: Column) -> Column:
    """A keyed pseudo-random number under 2^52."""
    text = F.concat_ws("|", F.lit(key), about, round_.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, about: Column, key: str) -> Column:
    """A permutation of the pairs of a number under m and one under n: in turn, each half is moved by a secret of the other."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(now, r):
        left = F.pmod(now["a"] + secret(key, r, about, now["b"]), m.cast("long"))
        right = F.pmod(now["b"] + secret(key, r + 100, about, left), n.cast("long"))
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(13)]), n + 1)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def permuted(number: Column, about: str, key: str) -> Column:
    """Another string of as many digits (2 to 24)."""
    size = F.length(number)
    u, v = F.floor(size / 2).cast("int"), (size - F.floor(size / 2)).cast("int")
    out = feistel(F.substr(number, F.lit(1), u), F.substr(number, u + 1), ten(u), ten(v), F.concat(F.lit(about), size.cast("string")), key)
    return F.transform(F.array(out), lambda x: F.concat(F.lpad(x["a"].cast("string"), u, F.lit("0")), F.lpad(x["b"].cast("string"), v, F.lit("0"))))[0]


def luhn(number: Column) -> Column:
    """Sum of the digits, every second from the right doubled, modulo 10."""
    each = F.split(F.reverse(number), "")
    one = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(2 * d.cast("int") - 1, F.lit(9)) + F.when(d == "0", -8).otherwise(1))
    return F.pmod(F.aggregate(F.transform(F.filter(each, lambda d: d != ""), one), F.lit(0), lambda s, x: s + x.cast("int")), F.lit(10))


def mod97(x: Column) -> Column:
    """x, digits and capitals (10 to 35), as a number modulo 97."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.filter(F.split(x, "(?!^)"), lambda c: c != ""), F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def iban(x: Column, key: str) -> Column:
    """x with the digits after its check digits permuted (the first 24 of them), and check digits for these."""
    tail = F.substr(x, F.lit(5))
    own = digits(tail)
    body = F.transform(F.array(F.concat(permuted(F.substr(own, F.lit(1), F.least(F.length(own), F.lit(24))), "iban", key), F.substr(own, F.lit(25)))), lambda n: placed(tail, n))
    check = lambda b: F.lpad((98 - mod97(F.concat(F.replace(b, F.lit(" "), F.lit("")), F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    return F.transform(body, lambda b: F.concat(F.substring(x, 1, 2), check(b), b))[0]


def numbers(x: Column, at: int, size: int) -> Column:
    return F.substring(x, at, size).cast("long")


def padded(n: Column, size: int) -> Column:
    return F.lpad(n.cast("string"), size, "0")


def social(own: Column, key: str) -> Column:
    """The digits of another valid social security number."""
    area = numbers(own, 1, 3) - 1
    area = area - F.when(area > 665, 1).otherwise(0)
    out = feistel(area, (numbers(own, 4, 2) - 1) * 9999 + numbers(own, 6, 4) - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
    first = lambda v: v["a"] + 1 + F.when(v["a"] >= 665, 1).otherwise(0)
    return F.transform(F.array(out), lambda v: F.concat(padded(first(v), 3), padded(F.floor(v["b"] / 9999) + 1, 2), padded(F.pmod(v["b"], F.lit(9999)) + 1, 4)))[0]


def national(own: Column, key: str) -> Column:
    """The digits of a phone number without its country code, permuted; of North American form, to others of that form."""
    out = feistel(numbers(own, 1, 3) - 200, numbers(own, 4, 7) - 2_000_000, F.lit(800), F.lit(8_000_000), F.lit("phone-3-7"), key)
    ten_ = F.transform(F.array(out), lambda v: F.concat(padded(v["a"] + 200, 3), padded(v["b"] + 2_000_000, 7)))[0]
    return F.when(own.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"), ten_).otherwise(permuted(own, "phone", key))


def phone(x: Column, own: Column, key: str) -> Column:
    code = F.when(F.startswith(x, F.lit("+")), F.regexp_extract(own, f"^(?:{CODES})", 0)).otherwise("")
    return placed(x, F.concat(code, national(F.substr(own, F.length(code) + 1), key)))


def placed(shape: Column, number: Column) -> Column:
    """shape with its digits replaced, one after the other, by number's."""
    before = lambda i: F.length(digits(F.substr(shape, F.lit(1), i + 1)))
    put = lambda c, i: F.when(c.rlike(r"^\d$"), F.substr(number, before(i), F.lit(1))).otherwise(c)
    return F.concat_ws("", F.transform(F.split(shape, "(?!^)"), put))


def pseudonym(x: Column, key: str) -> Column:
    own = digits(x)
    body = permuted(F.substr(own, F.lit(1), F.length(own) - 1), "card", key)
    card = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))[0]
    octets = F.split(x, r"\.")
    octet = lambda i: octets[i].cast("int")
    ip = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    part = lambda v: [F.floor(v / 256).cast("string"), F.pmod(v, F.lit(256)).cast("string")]
    address = F.transform(F.array(ip), lambda v: F.concat_ws(".", *part(v["a"]), *part(v["b"])))[0]
    pattern = F.when(x.contains("/"), "M/d/yyyy").when(x.contains("."), "d.M.yyyy").otherwise("yyyy-M-d")
    short = x.rlike(r"(?:^|[-./])\d(?:[-./]|$)")  # written without zeros
    day = F.datediff(F.try_to_timestamp(x, pattern).cast("date"), F.lit(FIRST_DAY).cast("date"))
    moved = feistel(F.floor(day / HALVES[1]), F.pmod(day, F.lit(HALVES[1])), F.lit(HALVES[0]), F.lit(HALVES[1]), F.lit("date"), key)
    date = F.transform(F.array(moved), lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), (v["a"] * HALVES[1] + v["b"]).cast("int")))[0]
    plain = F.when(x.contains("/"), F.date_format(date, "M/d/yyyy")).when(x.contains("."), F.date_format(date, "d.M.yyyy")).otherwise(F.date_format(date, "yyyy-M-d"))
    date = F.when(short, plain).when(x.contains("/"), F.date_format(date, "MM/dd/yyyy")).when(x.contains("."), F.date_format(date, "dd.MM.yyyy")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    name = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|mail|"), F.lower(x)).cast("binary"), 256), 1, 12), F.regexp_extract(x, "@.*$", 0))
    is_card = x.rlike(f"^(?:{CARD})$") & F.length(own).between(13, 19) & (luhn(own) == 0)
    bare = F.replace(x, F.lit(" "), F.lit(""))
    is_iban = x.rlike(f"^{IBAN}$") & F.length(bare).between(15, 34) & (mod97(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))) == 1)
    is_ssn = x.rlike(f"^{SSN}$") & ~x.rlike(r"^(?:000|666|9\d\d)-|-00-|-0000$")
    is_ip = x.rlike(f"^{IPV4}$") & F.forall(octets, lambda o: o.cast("int") < 256)
    is_date = x.rlike(f"^(?:{DATE})$") & day.between(0, DAYS - 1)
    is_phone = x.rlike(f"^(?:{PHONE})$") & F.length(own).between(8, 15)
    return (
        F.when(x.contains("@"), name).when(is_iban, iban(x, key)).when(is_ip, address).when(is_ssn, placed(x, social(own, key))).when(is_date, date)
        .when(is_phone, phone(x, own, key)).when(is_card, placed(x, card)).otherwise(x)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text rewritten, and n_found (matches) and n_changed."""
    found, new, n_found, n_changed = (common.free(docs, x) for x in ("found", "new", "n_found", "n_changed"))
    matches = F.regexp_extract_all("text", F.lit(f"({FOUND})"), F.lit(1))
    done = docs.withColumn(found, matches).withColumn(new, F.transform(found, lambda x: pseudonym(x, key)))
    between = F.split("text", FOUND, -1)
    text = F.concat_ws("", F.flatten(F.zip_with(between, F.col(new), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    changed = F.size(F.filter(F.zip_with(F.col(found), F.col(new), lambda a, b: a != b), lambda x: x)).cast("long")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(F.size(found).cast("long"), zero).alias(n_found), F.coalesce(changed, zero).alias(n_changed)]
    text = F.when(F.size(found) > 0, text).otherwise(F.col("text")).alias("text")
    return done.select(*[text if x.lower() == "text" else F.col(f"`{x}`") for x in docs.columns], *counts)


def op1_pii(spark, sf_dir: str, key: str = "not a secret: give your own") -> DataFrame:
    return pseudonymise(common.documents(spark, sf_dir).select("doc_id", "text"), key)
