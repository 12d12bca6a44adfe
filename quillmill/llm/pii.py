"""Personal data: format-preserving Feistel pseudonyms, with DataFrame operations only.

E-mail addresses, telephone numbers, IPv4 addresses, payment card numbers, IBANs, US social security
numbers and dates are found by one pattern, validated (Luhn, mod 97, number ranges, the calendar),
and replaced by a keyed permutation of their own format, so that equal values stay equal in all documents and
different ones stay different; whoever has the key can reverse it. What fails validation is left alone.

Strings run through a Feistel network over their characters: in each round, every letter or digit of
one half moves within its class (a-z, A-Z, 0-9) by a stream hashed from key, round and the other half.
Check digits are computed anew. Dates, addresses and social security numbers are permuted as numbers: their
valid values are counted, and a Feistel network over two factors of that count moves them among each other. A date with
slashes is read day first where that is a day of the calendar, else month first; the former and the latter
are permuted each among themselves, so that a pseudonym is read as its value was.

Defined cases: null text stays null; an empty text stays empty; repeated values and rows get equal
pseudonyms; texts without digits or @ are passed on unread; a column named as the count is replaced, other
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import let
from quillmill.llm.common import fresh

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: The length of an IBAN, by country.
# fixed values: the IBAN registry
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, lands: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{lands.replace(' ', '|')})\d\d(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: One of its country's length, which ends there whatever follows.
_KNOWN = rf"(?:{'|'.join(_iban_of(n, lands) for n, lands in IBANS.items())})(?!\w)"
#: In this order; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}+",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "date": r"(?<![\w.\-/])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\w\-/]|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d\d-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\) ?\d{3,4}[ .\-]\d{3,4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w\-])|(?<![\w+(])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?![\w\-])",
    "iban": rf"(?<!\w)(?=[A-Z]{{2}}\d\d)(?:{_KNOWN}|[A-Z]{{2}}\d\d(?:(?! {_KNOWN}) ?[A-Z0-9]{{4}}){{2,7}}(?:(?! {_KNOWN}) ?[A-Z0-9]{{1,3}})?(?!\w))",
    "card": r"(?<![\w\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4})(?![\w\-])",
}
ANY = "|".join(PATTERNS.values())
#: The calendar days that count as dates: how many from the first one on, in two factors.
FIRST_DAY, DAYS = "1900-01-01", (229, 319)
#: Of these the days after the 12th of a month (one less than the product), and the months.
LATE_DAYS, MONTHS = (177, 250), 2400
#: Social security numbers: areas 001 to 899 but 666; groups 01 to 99 times serials 0001 to 9999.
AREAS, SERIALS = 898, 9999


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 512)


def _number(key: str, r: Column, x: Column, of: int) -> Column:
    return F.pmod(F.conv(F.substring(_hash(F.lit(key), r, x), 1, 12), 16, 10).cast("long"), F.lit(of))


def _moved(half: Column, stream: Column, sign: int) -> Column:
    """Each letter or digit moved on within its class by the stream's number at its place."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(stream.substr(F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int") * sign
        out = c
        for first, n, pattern in (("0", 10, "^[0-9]$"), ("a", 26, "^[a-z]$"), ("A", 26, "^[A-Z]$")):
            out = F.when(c.rlike(pattern), F.char(F.pmod(F.ascii(c) - ord(first) + by, F.lit(n)) + ord(first))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(half), one), "")


def _rounds(reverse: bool) -> Column:
    return F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if reverse else range(ROUNDS))])


def permute(s: Column, key: str, reverse: bool = False) -> Column:
    """The string, permuted among all strings of its pattern of classes."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(s.substr(F.lit(1), half).alias("a"), s.substr(half + 1, F.length(s)).alias("b"))
    if reverse:
        step = lambda x, r: F.struct(_moved(x["b"], _hash(F.lit(key), r, x["a"]), -1).alias("a"), x["a"].alias("b"))
    else:
        step = lambda x, r: F.struct(x["b"].alias("a"), _moved(x["a"], _hash(F.lit(key), r, x["b"]), 1).alias("b"))
    return F.aggregate(_rounds(reverse), start, step, lambda x: F.concat(x["a"], x["b"]))


def permute_pair(a: Column, b: Column, of_a: int, of_b: int, key: str, reverse: bool = False) -> Column:
    """(a, b) with a < of_a and b < of_b, permuted among all such pairs; a struct."""

    def step(x: Column, r: Column) -> Column:
        if reverse:
            a0 = F.pmod(x["a"] - _number(key + "a", r, F.pmod(x["b"] - _number(key + "b", r, x["a"], of_b), F.lit(of_b)), of_a), F.lit(of_a))
            return F.struct(a0.alias("a"), F.pmod(x["b"] - _number(key + "b", r, x["a"], of_b), F.lit(of_b)).alias("b"))
        a1 = F.pmod(x["a"] + _number(key + "a", r, x["b"], of_a), F.lit(of_a))
        return F.struct(a1.alias("a"), F.pmod(x["b"] + _number(key + "b", r, a1, of_b), F.lit(of_b)).alias("b"))

    return F.aggregate(_rounds(reverse), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _permuted(v: Column, of: tuple[int, int], key: str, reverse: bool) -> Column:
    """A number below of[0] * of[1], permuted among these."""
    pair = permute_pair(F.floor(v / of[1]), F.pmod(v, F.lit(of[1])), *of, key, reverse)
    return let(pair, lambda p: p["a"] * of[1] + p["b"])


def _refilled(form: Column, fill: Column) -> Column:
    """`form` with its letters and digits replaced, in turn, by the characters of `fill`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(x: Column, c: Column) -> Column:
        slot = c.rlike("^[0-9A-Za-z]$")
        return F.struct(F.concat(x["out"], F.when(slot, fill.substr(x["at"], F.lit(1))).otherwise(c)).alias("out"), (x["at"] + F.when(slot, 1).otherwise(0)).alias("at"))

    return F.aggregate(_chars(form), start, step, lambda x: x["out"])


def _plain(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9A-Za-z]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum; `doubled`: 0 if every second digit from the last on is doubled, 1 from the one before it."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(_chars(digits)), worth), F.lit(0), lambda t, x: t + x)


def _mod97(s: Column) -> Column:
    """Of the number that letters (A is 10) and digits spell."""

    def step(t: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.pmod(F.when(letter, t * 100 + F.ascii(c) - 55).otherwise(t * 10 + F.ascii(c) - 48), F.lit(97))

    return F.aggregate(_chars(s), F.lit(0), step)


def _card(m: Column, key: str, reverse: bool) -> Column:
    d = _plain(m)
    body = permute(d.substr(F.lit(1), F.length(d) - 1), key + "card", reverse)
    check = F.pmod(10 - F.pmod(_luhn(body, 0), F.lit(10)), F.lit(10)).cast("string")
    return F.when(_luhn(d, 1) % 10 == 0, _refilled(m, F.concat(body, check)))


def _iban(m: Column, key: str, reverse: bool) -> Column:
    s = _plain(m)
    ok = _mod97(F.concat(s.substr(F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1
    body, land = permute(s.substr(F.lit(5), F.length(s)), key + "iban", reverse), F.substring(s, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0")
    return F.when(ok, _refilled(m, F.concat(land, check, body)))


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    d = _plain(m)
    area, group, serial = (F.substring(d, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    a = area - F.when(area > 666, 2).otherwise(1)
    to = permute_pair(a, (group - 1) * SERIALS + serial - 1, AREAS, 99 * SERIALS, key + "ssn", reverse)

    def written(p: Column) -> Column:
        parts = ((p["a"] + F.when(p["a"] >= 665, 2).otherwise(1), 3), (F.floor(p["b"] / SERIALS) + 1, 2), (F.pmod(p["b"], F.lit(SERIALS)) + 1, 4))
        return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    valid = ~d.rlike("^(?:000|666|9)") & ~d.rlike("^...00") & ~d.rlike("0000$")
    return F.when(valid, _refilled(m, let(to, written)))


def _phone(m: Column, key: str, reverse: bool) -> Column:
    """The country code stays; in all, numbers have 7 to 15 digits."""
    land = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(\-])|^\+\d\d?", 0)
    rest = m.substr(F.length(land) + 1, F.length(m))
    return F.when(F.length(_plain(m)).between(7, 15), F.concat(land, _refilled(rest, permute(_plain(rest), key + "phone", reverse))))


def _ip(m: Column, key: str, reverse: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    p = permute_pair(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 65536, 65536, key + "ip", reverse)
    parts = F.transform(F.array(p), lambda x: F.concat_ws(".", F.shiftright(x["a"], 8), F.pmod(x["a"], F.lit(256)), F.shiftright(x["b"], 8), F.pmod(x["b"], F.lit(256))))
    return F.get(parts, F.lit(0))


def _late_before(month: Column) -> Column:
    """How many late days (after the 12th of a month) lie before a month, counted from the first one."""
    zero = F.to_date(F.lit(FIRST_DAY))
    return F.datediff(F.add_months(zero, month.cast("int")), zero) - 12 * month


def late_day(n: Column) -> Column:
    """The n-th late day. Its month is within one of n * MONTHS / (number of late days)."""
    near = F.floor(n * MONTHS / F.lit(float(LATE_DAYS[0] * LATE_DAYS[1] - 1)))
    months = F.filter(F.array(*[near + k for k in (2, 1, 0, -1, -2)]), lambda m: (m >= 0) & (_late_before(m) <= n))
    return let(F.get(months, F.lit(0)), lambda m: F.date_add(F.add_months(F.to_date(F.lit(FIRST_DAY)), m.cast("int")), (12 + n - _late_before(m)).cast("int")))


def late_number(day: Column) -> Column:
    return F.dayofmonth(day) - 13 + _late_before((F.year(day) - 1900) * 12 + F.month(day) - 1)


def _moved_day(day: Column, key: str, reverse: bool) -> Column:
    zero = F.to_date(F.lit(FIRST_DAY))
    return F.date_add(zero, _permuted(F.datediff(day, zero), DAYS, key + "date", reverse).cast("int"))


def _moved_late_day(day: Column, key: str, reverse: bool) -> Column:
    # one number of the product is no late day: what moves there moves on, and that once, as only one number moves there
    void = LATE_DAYS[0] * LATE_DAYS[1] - 1
    step = lambda n: _permuted(n, LATE_DAYS, key + "late", reverse)
    return let(let(step(late_number(day)), lambda n: F.when(n == void, step(n)).otherwise(n)), late_day)


def _date(m: Column, key: str, reverse: bool) -> Column:
    read = lambda form: F.try_to_timestamp(m, F.lit(form)).cast("date")
    out = F.lit(None).cast("string")
    for form, fits, to in (("MM/dd/yyyy", "/", _moved_late_day), ("dd/MM/yyyy", "/", _moved_day), ("dd.MM.yyyy", ".", _moved_day), ("yyyy-MM-dd", "-", _moved_day)):
        out = F.when(m.contains(fits) & read(form).isNotNull(), F.date_format(to(read(form), key, reverse), form)).otherwise(out)
    return out


def _email(m: Column, key: str, reverse: bool) -> Column:
    """All but the top-level domain, which begins with two letters."""
    tail = F.regexp_extract(m, r"\.[^.]*$", 0)
    head = m.substr(F.lit(1), F.length(m) - F.length(tail))
    return F.when(tail.rlike(r"^\.[A-Za-z]{2}"), F.concat(permute(head, key + "email", reverse), tail))


_OF = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}


def pseudonym(match: Column, key: str, reverse: bool = False) -> Column:
    """Of one match (null if it is no valid value)."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), _OF[kind](match, key, reverse)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_replaced", reverse: bool = False) -> DataFrame:
    """The rows of `docs` with pseudonyms in their texts, and the column n_replaced. Whoever has the key can turn them
    back, with `reverse`: keep it out of code and logs."""
    text, found, to, out = F.col(text_col), fresh(docs, "__pii_found"), fresh(docs, "__pii_to"), docs
    some = text.rlike("[0-9@]")
    out = out.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(to, F.when(F.size(found) > 0, F.transform(F.col(found), lambda m: pseudonym(m, key, reverse))).otherwise(F.array().cast("array<string>")))
    parts = F.split(text, ANY, -1)
    woven = F.zip_with(parts, F.zip_with(F.col(to), F.col(found), lambda t, m: F.coalesce(t, m)), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return out.withColumn(text_col, F.when(F.size(found) > 0, F.array_join(woven, "")).otherwise(text)).withColumn(count_col, F.size(F.filter(F.col(to), lambda t: t.isNotNull()))).drop(found, to)
