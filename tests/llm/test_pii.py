"""Pseudonyms of every kind against a plain-Python twin, and the patterns on their worst cases."""

import calendar
import datetime
import hashlib
import re
import time

import pytest

from voxloom.llm import pseudonyms

KEY = "k"
LOWER, UPPER, TEN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def hashed(kind, *parts):
    return hashlib.sha256("|".join([KEY, kind, *map(str, parts)]).encode()).hexdigest()


SPANS = ((0xE0, 0xF6), (0xF8, 0xFF), (0xC0, 0xD6), (0xD8, 0xDE), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x430, 0x44F), (0x410, 0x42F))
NAMES = (LOWER, UPPER, TEN, *("".join(map(chr, range(a, b + 1))) for a, b in SPANS))


def feistel(left, right, a, b, kind):
    for i in range(1, pseudonyms.ROUNDS + 1):
        if i % 2:
            left = (left + int(hashed(kind, i, right)[:15], 16) % a) % a
        else:
            right = (right + int(hashed(kind, i, left)[:15], 16) % b) % b
    return left, right


def digits(d, kind):
    u = len(d) // 2
    left, right = feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), kind)
    return f"{left:0{u}d}{right:0{len(d) - u}d}"


def shape(text, kind, alphabets):
    u = len(text) // 2
    sides = [text[:u], text[u:]]
    for i in range(1, 7):
        at = 0 if i % 2 else 1
        told, out = hashed(kind, i, sides[1 - at]), ""
        for k, c in enumerate(sides[at]):
            step = int(hashed(kind, k // 32, told)[2 * (k % 32) : 2 * (k % 32) + 2], 16)
            letters = next((a for a in alphabets if c in a), None)
            out += letters[(letters.index(c) + step) % len(letters)] if letters else c
        sides[at] = out
    return "".join(sides)


def laid_out(value, new):
    rest = iter(new)
    return "".join(next(rest) if c.isdigit() else c for c in value)


def email(v):
    local, domain = v.split("@")
    host, last = domain.rsplit(".", 1)
    return shape(local, "email", NAMES) + "@" + shape(host, "domain", NAMES) + "." + last


def secret(v):
    value = re.search(r"[0-9A-Za-z+/_-]+$", v)[0]
    new = shape(value, "hex", (TEN + "abcdef",)) if re.fullmatch("[0-9a-f]+", value) else shape(value, "secret", (LOWER, UPPER, TEN))
    return v[: len(v) - len(value)] + new


def ssn(v):
    sep = v[3]
    a, g, s = map(int, v.split(sep))
    left, right = feistel((a - 2 if a > 666 else a - 1) * 99 + g - 1, s - 1, 898 * 99, 9999, "ssn")
    a = left // 99 + 1
    return f"{a + (a >= 666):03d}{sep}{left % 99 + 1:02d}{sep}{right + 1:04d}"


def phone(v):
    d = re.sub("[^0-9]", "", v)
    local = re.fullmatch(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}", v)
    if v[0] == "+" and not local and not (d[0] == "1" and len(d) == 11):
        size = 1 if d[0] in "17" else 2 if d[:2] in pseudonyms.CODES2.split() else 3
        return laid_out(v, d[:size] + digits(d[size:], "phone_abroad"))
    code, n = d[:-10], d[-10:]
    if n[0] < "2":
        return laid_out(v, code + n[0] + digits(n[1:], "phone_low"))
    left, right = feistel(int(n[:5]) - 20_000, int(n[5:]), 80_000, 100_000, "phone")
    return laid_out(v, code + f"{left + 20_000}{right:05d}")


def token(v):
    before = re.match("(?i:bearer) +|[spr]k-(?:[a-z]+-)*|gh[pousr]_", v)[0]
    return before + shape(v[len(before) :], "token", (LOWER, UPPER, TEN))


def iban(v):
    if v.islower():
        return iban(v.upper()).lower()
    plain = v.replace(" ", "")
    bban = plain[4:]
    moved = laid_out(bban, digits(re.sub("[^0-9]", "", bban), "iban"))
    number = int("".join(str(int(c, 36)) for c in moved + plain[:2] + "00"))
    new = iter(plain[:2] + f"{98 - number % 97:02d}" + moved)
    return "".join(c if c == " " else next(new) for c in v)


def date(v):
    year_first = v[:4].isdigit()
    sep = re.search("[-./]", v)[0]
    one, two, three = v.split(sep)
    day_first = not year_first and int(two) <= 12
    y, m, d = (one, two, three) if year_first else (three, two, one) if day_first else (three, one, two)
    at = datetime.date(int(y), int(m), int(d))
    if year_first or (day_first and len(one) == len(two) == 2):
        start = datetime.date(1800, 1, 1)
        left, right = feistel((at - start).days // 773, (at - start).days % 773, 189, 773, "date")
        to = start + datetime.timedelta(left * 773 + right)
        return sep.join([f"{to.year}", f"{to.month:02d}", f"{to.day:02d}"] if year_first else [f"{to.day:02d}", f"{to.month:02d}", f"{to.year}"])
    low, high, months = (1, 9 if len(one) == 1 else 31, 9 if len(two) == 1 else 12) if day_first else (13, 31, 9 if len(one) == 1 else 12)
    days = [(m, d) for m in range(1, months + 1) for d in range(low, high + 1) if d <= calendar.monthrange(2000, m)[1]]
    left, right = at.year - 1800, days.index((at.month, at.day))
    while True:
        left, right = feistel(left, right, 400, len(days), f"date {low} {high} {months}")
        m, d = days[right]
        if d <= calendar.monthrange(1800 + left, m)[1]:
            break
    fields = (d, m) if day_first else (m, d)
    return sep.join([str(x).zfill(len(w)) for x, w in zip(fields, (one, two), strict=True)] + [str(1800 + left)])


CASES = {
    email: ["a.b-c_d%42@mail8.Example-Host.com", "x@y.zz", "Long." + "q7" * 40 + "@a.b.c.d.org", "me@10.0.0.1.example", "user@münchen.de", "jöe@ex.com", "иван.п@пример.рф"],
    token: ["Bearer eyJhbGciOi.J9_x-Y0=.abcDEF12345", "sk-proj-Abc123DEF456ghi789", "ghp_0123456789abcdefghijABCDEFGHIJ012345"],
    secret: ["token=0123456789abcdef0123456789abcdef01234567", 'password: "Abc_DEF-123/x+9', "api_key = " + "zZ9" * 50],
    ssn: ["001-01-0001", "665-99-9999", "667-45-1234", "899-10-0500", "123 45 6789"],
    phone: ["415 555 0123", "(212) 555-0199", "+1 415-555-0123", "+49 30 1234567", "+33 6 12 34 56 78", "+14155550123", "+7 (495) 123-45-67", "+353 1 234 5678", "012 345 6789"],
    iban: ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "de89370400440532013000"],
    date: ["2024-02-29", "29/02/2024", "02/29/2024", "1.3.1999", "31.12.2199", "1800-01-01", "2020/01/31", "07/14/1847", "7/14/1847", "2/29/2024", "1.2.2020", "9/9/1800", "5.12.2199", "27/9/1865", "29/2/2096", "12/31/1999"],
}


def pseudonym(spark, texts, domains=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = pseudonyms.pseudonymize(df, KEY, out_col="out", kinds_col="kinds", domains=domains).orderBy("i").collect()
    return [r["out"] for r in rows], [r["kinds"] for r in rows]


@pytest.mark.parametrize("twin", list(CASES), ids=lambda f: f.__name__)
def test_kind_against_brute_force(spark, twin):
    out, kinds = pseudonym(spark, [f"see {v}, ok" for v in CASES[twin]])
    assert out == [f"see {twin(v)}, ok" for v in CASES[twin]] and kinds == [[twin.__name__]] * len(out)


def test_numbers_stay_linked_across_formats(spark):
    out, _ = pseudonym(spark, ["+14155550123", "+1 415-555-0123"])
    assert re.sub("[^0-9]", "", out[0]) == re.sub("[^0-9]", "", out[1]) != "14155550123"


def test_domains_are_optional(spark):
    (kept,), _ = pseudonym(spark, ["a.b@mail.example.com"], domains=False)
    assert kept.endswith("@mail.example.com") and not kept.startswith("a.b@")


M = 1 << 20
WORST = {
    "email, long domain": "a@b" + ".c" * (M // 2), "email, long name": "a." * (M // 2) + "@", "email, whole": "a" * (M // 4) + "@" + "b" * (M // 4) + ".com", "secret": "token=" + "aB3" * (M // 3),
    "access key": "AKIA" + "Q" * M, "ipv4": "1." * (M // 2), "iban": "GB82 " + "WEST " * (M // 5), "date": "2024-" * (M // 5), "ssn": "123-45-" * (M // 7), "phone": "+1" + " 234" * (M // 4),
    "phone, signs": "+1" + "( " * (M // 2), "card": "4" * M, "card, groups": "4111 " * (M // 5), "at signs": "@" * M, "dots": "." * M + "1",
}


@pytest.mark.parametrize("name", list(WORST))
def test_long_texts(spark, name):
    start = time.time()
    (out,), _ = pseudonym(spark, [WORST[name]])
    assert len(out) == len(WORST[name]) and time.time() - start < 30


def test_column_names(spark):
    df = spark.createDataFrame([("1.2.3.4", ["mine"], "p", "q")], "text string, kinds array<string>, pseudonyms string, PSEUDONYMS_ string")
    r = pseudonyms.pseudonymize(df, KEY).first()
    assert r["text"] != "1.2.3.4" and r["kinds"] == ["mine"] and (r["pseudonyms"], r["PSEUDONYMS_"]) == ("p", "q")
    assert pseudonyms.pseudonymize(df, KEY, kinds_col="kinds").first()["kinds"] == ["ipv4"]


def test_key_is_the_sessions_own(spark):
    other = spark.newSession()
    a = pseudonyms.session_key(other)
    assert len(a) == 64 and pseudonyms.session_key(other) == a != pseudonyms.session_key(spark.newSession())
    other.conf.set(pseudonyms.KEY_SETTING, "mine")
    assert pseudonyms.session_key(other) == "mine"


def written_dates(keep):
    first = datetime.date(1800, 1, 1)
    days = [first + datetime.timedelta(k) for k in range(146_097)]
    return [text for d in days for text in keep(d)]


FORMS = {
    "month first": lambda d: [f"{d.month:02d}/{d.day}/{d.year}"] * (d.day > 12),
    "month first, one digit": lambda d: [f"{d.month}.{d.day}.{d.year}"] * (d.day > 12 and d.month < 10),
    "day first": lambda d: [f"{d.day:02d}/{d.month:02d}/{d.year}"],
    "one digit each": lambda d: [f"{d.day}.{d.month}.{d.year}"] * (d.day < 10 and d.month < 10),
    "one digit day": lambda d: [f"{d.day}/{d.month:02d}/{d.year}"] * (d.day < 10),
    "one digit month": lambda d: [f"{d.day:02d}.{d.month}.{d.year}"] * (d.month < 10),
}


def test_different_dates_stay_different(spark):
    """All dates of 400 years in every form: as many pseudonyms as values, each of its value's form."""
    values = [(name, v) for name, keep in FORMS.items() for v in written_dates(keep)]
    df = spark.createDataFrame(values, "form string, text string").repartition(8)
    out = pseudonyms.pseudonymize(df, KEY, out_col="out", kinds_col="kinds").selectExpr("form", "text", "out", "kinds").toPandas()
    assert out["kinds"].map(lambda k: list(k) == ["date"]).all()
    sep = lambda c: c.str.replace(".", "/", regex=False)
    own, new = out.assign(t=sep(out["text"])), out.assign(t=sep(out["out"]))
    for name, part in own.groupby("form"):
        made = new[new["form"] == name]["t"]
        assert made.nunique() == len(part) and set(made) == set(part["t"]), name


def test_key_stands_in_no_plan(spark, capsys):
    key = "7f" * 32
    df = spark.createDataFrame([("see 1.2.3.4", 1), (None, 2), ("nothing", 3)], "text string, pseudonym_key int")
    out = pseudonyms.pseudonymize(df, key)
    out.explain("extended")
    assert key not in capsys.readouterr().out and key not in out._jdf.queryExecution().toString()
    assert out.columns == df.columns and sorted(r["pseudonym_key"] for r in out.collect()) == [1, 2, 3]
    assert out.filter("text IS NULL").count() == 1 and not out.filter("text = 'nothing'").isEmpty()
