"""Pseudonyms: one-to-one, reversible, and equal to a plain Python version over whole tables."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillmill.llm import pii

DATE_FORMS = {"yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "dd/MM/yyyy": "%d/%m/%Y", "MM/dd/yyyy": "%m/%d/%Y"}


def _digest(*parts):
    return hashlib.sha512("|".join(map(str, parts)).encode()).hexdigest()


def _word(s, key):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(8):
        stream, moved = _digest(key, r, b), ""
        for i, c in enumerate(a):
            by = int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if 0 <= ord(c) - ord(first) < n:
                    c = chr((ord(c) - ord(first) + by) % n + ord(first))
                    break
            moved += c
        a, b = b, moved
    return a + b


def _pair(a, b, of_a, of_b, key):
    number = lambda k, r, x, of: int(_digest(key + k, r, x)[:12], 16) % of
    for r in range(8):
        a = (a + number("a", r, b, of_a)) % of_a
        b = (b + number("b", r, a, of_b)) % of_b
    return a, b


def _fill(form, chars):
    it = iter(chars)
    return "".join(next(it) if re.match("[0-9A-Za-z]", c) else c for c in form)


def _plain(s):
    return re.sub("[^0-9A-Za-z]", "", s)


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


FIRST = datetime.date(1900, 1, 1)
DAYS = [FIRST + datetime.timedelta(i) for i in range(73049)]
LATE = [d for d in DAYS if d.day > 12]


def _date(m, key):
    forms = [f for f, at in (("%Y-%m-%d", "-"), ("%d.%m.%Y", "."), ("%d/%m/%Y", "/"), ("%m/%d/%Y", "/")) if at in m]
    for form in forms:
        try:
            day = datetime.datetime.strptime(m, form).date()
        except ValueError:
            continue
        if form != "%m/%d/%Y":
            a, b = _pair(*divmod(DAYS.index(day), 319), 229, 319, key + "date")
            return DAYS[a * 319 + b].strftime(form)
        n = LATE.index(day)
        while True:
            a, b = _pair(*divmod(n, 250), 177, 250, key + "late")
            n = a * 250 + b
            if n < len(LATE):
                return LATE[n].strftime(form)
    return None


def _brute(kind, m, key):
    d = _plain(m)
    if kind == "email":
        head, _, tail = m.rpartition(".")
        return _word(head, key + "email") + "." + tail if re.match("[A-Za-z]{2}", tail) else None
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        a, b = _pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key + "ip")
        return ".".join(map(str, (*divmod(a, 256), *divmod(b, 256))))
    if kind == "date":
        return _date(m, key)
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [x for x in range(1, 900) if x != 666]
        a, b = _pair(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key + "ssn")
        return _fill(m, f"{areas[a]:03d}{b // 9999 + 1:02d}{b % 9999 + 1:04d}")
    if kind == "phone":
        land = re.match(r"\+\d{1,3}(?=[ .(\-])|\+\d\d?|", m)[0]
        return land + _fill(m[len(land) :], _word(_plain(m[len(land) :]), key + "phone")) if 7 <= len(d) <= 15 else None
    if kind == "iban":
        body = _word(d[4:], key + "iban")
        return _fill(m, d[:2] + f"{98 - _mod97(body + d[:2] + '00'):02d}" + body) if _mod97(d[4:] + d[:4]) == 1 else None
    body = _word(d[:-1], key + "card")
    return _fill(m, body + str(-_luhn(body + "0") % 10)) if _luhn(d) == 0 else None


def brute(text, key):
    n = 0

    def one(m):
        nonlocal n
        for kind, pattern in pii.PATTERNS.items():
            if re.fullmatch(pattern, m[0], re.ASCII):
                to = _brute(kind, m[0], key)
                n += to is not None
                return m[0] if to is None else to
        raise AssertionError(m[0])

    return (text if text is None else re.sub(pii.ANY, one, text, flags=re.ASCII)), n


@pytest.mark.parametrize("form", DATE_FORMS)
def test_dates_are_one_to_one_and_turn_back(spark, form):
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), form).alias("d"))
    to = days.select("d", pii._date(F.col("d"), "k", False).alias("p"))
    out = to.select("d", "p", pii._date(F.col("p"), "k", True).alias("back")).agg(F.count("*"), F.countDistinct("d"), F.countDistinct("p"), F.count_if(F.col("back") == F.col("d")), F.count_if(F.col("d") == F.col("p"))).first()
    assert out[:4] == (73049,) * 4 and out[4] < 20


def test_slashed_dates_together(spark):
    """Both readings in one text: no two strings share a pseudonym."""
    days = spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    texts = days.select(F.date_format("d", "dd/MM/yyyy").alias("s")).union(days.select(F.date_format("d", "MM/dd/yyyy").alias("s"))).distinct()
    n = texts.count()
    assert n == 73049 + 44249
    assert texts.select(pii._date(F.col("s"), "k", False).alias("p")).distinct().count() == n


def test_late_days(spark):
    got = spark.range(len(LATE)).select("id", pii.late_day(F.col("id")).alias("d")).select("id", "d", pii.late_number(F.col("d")).alias("n")).orderBy("id").collect()
    assert [r.d for r in got] == LATE and all(r.n == r.id for r in got)


def test_social_security_numbers(spark):
    own = spark.range(20_000).select(F.format_string("%03d-%02d-%04d", F.pmod(F.col("id") * 7919, F.lit(1000)).cast("int"), F.pmod(F.col("id") * 31, F.lit(100)).cast("int"), F.pmod(F.col("id") * 104729, F.lit(10000)).cast("int")).alias("s")).distinct()
    to = own.select("s", pii._ssn(F.col("s"), "k", False).alias("p")).where("p is not null")
    out = to.select("s", "p", pii._ssn(F.col("p"), "k", True).alias("back")).agg(F.count("*"), F.countDistinct("p"), F.count_if(F.col("back") == F.col("s"))).first()
    assert out[0] > 8_000 and out[0] == out[1] == out[2]


def test_feistel_is_one_to_one(spark):
    digits = spark.range(1000).select(pii.permute(F.lpad(F.col("id").cast("string"), 3, "0"), "k").alias("d"))
    assert {r.d for r in digits.collect()} == {f"{i:03d}" for i in range(1000)}


def test_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(-1, "31/12/1999 12/31/1999 02/30/2000 078-05-1120 900-12-3456 +49 30 12345678 (030) 555-1234 a@b.c0m a.b@c.de-x 1.2.3.4 4041894974608795 BE68 5390 0754 7034"), (-2, None), (-3, "")]
    rows = {r.doc_id: r.text for r in docs.collect()} | dict(more)
    out = pii.pseudonymise(docs.union(spark.createDataFrame(more, docs.schema)), "op6").collect()
    assert len(out) == len(rows) and sum(r.n_replaced for r in out) > 20
    for r in out:
        assert (r.text, r.n_replaced) == brute(rows[r.doc_id], "op6")


def test_pii_round_trip(spark):
    texts = [
        "call +1 (988) 555-2485 or 555-123-4567", "a.b+c@mail8.example.com, x@y.de.", "42.144.35.254 and 4041894974608795, 4041 8949 7460 8795", "born 1990-02-29 1988-02-29 31/12/1999 12/31/1999 01.02.2003", "078-05-1120 000-12-3456",
        "DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "version 1.2.3 and 1234567890123456, 300.1.1.1", "", None, "no data at all", "4041894974608795 again 4041894974608795", "@" * 50 + "9" * 60, "a" * 70_000 + "@example.com",
    ]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, __pii_found int")
    out = pii.pseudonymise(df, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].n_replaced for i in range(9)] == [2, 2, 3, 4, 1, 2, 0, 0, 0] and got[10].n_replaced == 2
    for i in (6, 7, 8, 9, 11):
        assert got[i].text == texts[i]
    for secret in ("988", "2485", "mail8", "42.144", "4041894974608795", "1988-02-29", "078-05-1120", "370400440532013000"):
        assert all(secret not in (r.text or "") for r in got.values())
    card = got[10].text.split(" ")
    assert card[0] == card[2] and card[0] == got[2].text.split(" ")[2].rstrip(",")  # equal values stay linked
    assert sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(card[0])) % 10 == 0
    assert "1990-02-29" in got[3].text  # no day of the calendar
    back = {r.doc_id: r.text for r in pii.pseudonymise(out.drop("n_replaced"), "k", reverse=True).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "another key").collect()}
    assert other[2] != got[2].text
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def test_pii_ibans_before_words(spark):
    tails = ["BE68 5390 0754 7034", "AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32", "MT84MALT011000012345MTLCAST001S"]
    cases = [(f"paid {iban}{after}", iban) for iban in tails for after in ("", " EUR 10", " I paid", " 12 euros", " NOW", " 1234 5678", " BIC ABCD", ".")]
    cases += [("CODE AB12 CD34 WXYZ DE89 3704 0044 0532 0130 00 EUR", "DE89 3704 0044 0532 0130 00"), ("BE68 5390 0754 7034 AT611904300234573201 EUR", "AT611904300234573201"), ("BE68 5390 0754 7034 4041 8949 7460 8795", "4041 8949 7460 8795")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    out = pii.pseudonymise(df, "k")
    got = {r.doc_id: r for r in out.collect()}
    n = len(cases) - 2
    for i, (t, iban) in enumerate(cases):
        assert iban not in got[i].text and got[i].n_replaced == (1 if i < n else 2), t
        assert len(got[i].text) == len(t) and (i >= n or got[i].text.split(" ")[0] == t.split(" ")[0])
        assert i >= n or got[i].text.endswith(t.partition(iban)[2]), t
    back = {r.doc_id: r.text for r in pii.pseudonymise(out.drop("n_replaced"), "k", reverse=True).collect()}
    assert [back[i] for i in range(len(cases))] == [t for t, _ in cases]
    wrong = spark.createDataFrame([(1, "BE68 5390 0754 7035 EUR 10")], "doc_id long, text string")
    assert pii.pseudonymise(wrong, "k").first().text == "BE68 5390 0754 7035 EUR 10"
