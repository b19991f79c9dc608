"""Format-preserving Feistel pseudonyms of personal data, in DataFrame functions alone.

Candidates are found by one pattern and validated by kind: card numbers by the Luhn digit, IBANs by
the remainder 97, dates by the calendar, social security numbers by their excluded ranges, IPv4
octets by their range in the pattern. A valid value is permuted by a keyed Feistel network over exactly its format's
domain, and check digits are computed anew, so the pseudonym is valid too, equal values stay
linked across documents and different values stay different. What fails validation stays as it is.

A network alternates additions modulo the two sides' sizes, which is a permutation of the product
domain for any sizes, so only some forms of dates need cycle walking:

    digits          10**u x 10**(n - u)
    phone number    8 * 10**4 x 10**5 for national numbers of ten digits (first digit 2 to 9)
    SSN             898 * 99 x 9999
    date            189 x 773, the 146,097 days of 1800 to 2199; 400 years x the days of a written form
    IPv4            2**16 x 2**16
    other strings   character shifts within each character's class, side by side

The round function is SHA-256 over the key, the kind, the round and the other side. Strings cost
time in proportion to their length: the other side is hashed once a round, and the shifts come from
hashes of that digest. Repeated groups of the patterns are bounded or possessive, so that the JVM's
matcher neither recurses nor backtracks over a long text.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.base import table

ROUNDS = 8
#: Setting of the session that holds the key. Its name falls under Spark's redaction of secrets.
KEY_SETTING = "spark.voxloom.pseudonym.secret"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FREE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9][\p{L}0-9._%+-]*+@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)++",
    # what stands after "Bearer", and keys that name their issuer in front
    "token": _FREE + r"(?:(?i:bearer) {1,3}[0-9A-Za-z._~+/=-]{16,}+|(?:[spr]k-|gh[pousr]_)[0-9A-Za-z_-]{16,}+)",
    "secret": r"(?i:(?<![0-9A-Za-z])(?:token|password|passwd|secret|api[_-]?key)) ?[=:] ?\"?[0-9A-Za-z+/_-]{8,}" + _END,
    "access_key": _FREE + r"AKIA[0-9A-Z]{16}" + _END,
    "ipv4": r"(?<![0-9A-Za-z.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9A-Za-z]|\.[0-9])",
    "iban": _FREE + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _END + "|" + _FREE + r"[a-z]{2}[0-9]{2}[0-9a-z]{11,30}" + _END,
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9A-Za-z]|[- ][0-9])",
    # national numbers of three, three and four digits, or a plus sign and 8 to 15 digits in any groups
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|(?<![0-9])[0-9]{3}(?=[ .-]))[ .-]?[0-9]{3}[ .-][0-9]{4}|\+[1-9](?:[ .()/-]{0,2}[0-9]){7,14})(?![0-9A-Za-z]|[.-][0-9])",
    "card": _FREE + r"(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _END,
}
#: Kinds of equal reach are told apart by which pattern matches the whole value, in this order.
_ORDER = ("email", "secret", "token", "access_key", "ipv4", "iban", "date", "ssn", "card", "phone")
ANY = "|".join(PATTERNS[k].replace(r"\1", "(?:[./])").replace("([./])", "[./]") for k in _ORDER)
_HINT = "[0-9@]|[=:]|AKIA|(?i:bearer)|[spr]k-|gh[pousr]_"
#: Calling codes of two digits; 1 and 7 have one digit, all others three. Fixed values of the numbering plan.
CODES2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _hash(key: Column, kind: str | Column, *parts) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind) if isinstance(kind, str) else kind, *[p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, a, b, key: Column, kind: str | Column, rounds: int = ROUNDS) -> Column:
    """struct(l, r): a keyed permutation of 0..a-1 x 0..b-1 (sizes below 2**60). Odd rounds add
    to the left side, even rounds to the right one."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def turn(s: Column, i: Column) -> Column:
        number = F.conv(F.substring(_hash(key, kind, i, F.when(i % 2 == 1, s["r"]).otherwise(s["l"])), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 1, (s["l"] + number % a) % a).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, (s["r"] + number % b) % b).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(1, rounds + 1)]), start, turn)


def permute_digits(digits: Column, key: Column, kind: str) -> Column:
    """Digits of one length (2 to 30) onto digits of that length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")

    def done(s: Column) -> Column:
        return F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), n - u, "0"))

    both = feistel(F.substr(digits, F.lit(1), u), F.substr(digits, u + 1), size(u), size(n - u), key, kind)
    return F.when(n < 2, digits).otherwise(_let(both, done))


def permute_text(text: Column, key: Column, kind: str, alphabets: tuple[str, ...], rounds: int = 6) -> Column:
    """A string onto one of the same shape: characters of an alphabet move within it, by amounts
    that hash the other half; others stay."""

    def shifted(half: Column, other: Column, i: Column) -> Column:
        def with_steps(steps: Column) -> Column:
            def at(c: Column, k: Column) -> Column:
                # two hash digits for each character, from a hash for each run of 32
                step = F.conv(F.substr(F.try_element_at(steps, F.floor(k / 32).cast("int") + 1), 2 * (k % 32) + 1, F.lit(2)), 16, 10).cast("int")

                def within(sets: list[str]) -> Column:
                    out = c
                    for letters in reversed(sets):
                        p = F.instr(F.lit(letters), c)
                        out = F.when((p > 0) & (c != ""), F.substr(F.lit(letters), (p - 1 + step) % len(letters) + 1, F.lit(1))).otherwise(out)
                    return out

                plain, wide = [a for a in alphabets if a.isascii()], [a for a in alphabets if not a.isascii()]
                return F.when(c < "\x80", within(plain)).otherwise(_let(F.instr(F.lit("".join(wide)), c), lambda p: F.when(p > 0, beyond(wide, p, step)).otherwise(c))) if wide else within(plain)

            def beyond(sets: list[str], p: Column, step: Column) -> Column:
                """Many alphabets at once: laid end to end, the one that position p lies in by its start."""
                starts = [1]
                for a in sets:
                    starts.append(starts[-1] + len(a))
                k = F.size(F.filter(F.lit(starts), lambda x: x <= p))
                first, size = F.element_at(F.lit(starts), k), F.element_at(F.lit([len(a) for a in sets]), k)
                return F.substr(F.lit("".join(sets)), (p - first + step) % size + first, F.lit(1))

            return F.concat_ws("", F.transform(F.split(half, ""), at))

        runs = F.sequence(F.lit(0), F.floor(F.length(half) / 32).cast("int"))
        return _let(_hash(key, kind, i, other), lambda told: _let(F.transform(runs, lambda run: _hash(key, kind, run, told)), with_steps))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 1, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
        )

    u = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), u).alias("l"), F.substr(text, u + 1).alias("r"))
    # a text of one character is all right side, which even rounds move
    return F.aggregate(F.array(*[F.lit(i) for i in range(1, rounds + 1)]), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(
            F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"),
            F.concat(s["out"], F.when(is_digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
        )

    return F.aggregate(F.split(value, ""), F.struct(F.lit(1).alias("k"), F.lit("").alias("out")), put, lambda s: s["out"])


def luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Sum of the Luhn check over a digit string, from the right; ``first_doubled`` for a string
    without its check digit."""
    odd = F.lit(1 if first_doubled else 0)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when(i % 2 == odd, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod97(text: Column) -> Column:
    """Remainder 97 of a string of digits and upper-case letters, letters as 10 to 35."""

    def add(s: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v < 10, (s * 10 + v) % 97).otherwise((s * 100 + v) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(m: Column, key: Column) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
        return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, True) % 10) % 10).cast("string")))

    return _let(_digits(m), lambda d: F.when(luhn_sum(d, False) % 10 == 0, _laid_out(m, made(d))))


def _iban(m: Column, key: Column) -> Column:
    def made(v: Column) -> Column:
        bban = F.substr(v, F.lit(5))
        moved = _laid_out(bban, permute_digits(_digits(bban), key, "iban"))

        def checked(b: Column) -> Column:
            country = F.substr(v, F.lit(1), F.lit(2))
            check = F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, b)

        return _let(moved, checked)

    def valid(v: Column) -> Column:
        return mod97(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))) == 1

    # a small one is taken as its capitals and written small again
    plain = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    # spaces go back to their places: the digits and letters are laid out one by one
    spaced = lambda v: F.aggregate(
        F.split(m, ""),
        F.struct(F.lit(1).alias("k"), F.lit("").alias("out")),
        lambda s, c: F.struct((s["k"] + F.when(c == " ", 0).otherwise(1)).alias("k"), F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(v, s["k"], F.lit(1)))).alias("out")),
        lambda s: s["out"],
    )
    cased = lambda v: F.when(m.rlike("^[a-z]"), F.lower(v)).otherwise(v)
    return _let(plain, lambda v: F.when(valid(v), cased(_let(made(v), spaced))))


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substr(m, F.lit(p), F.lit(n)).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    areas = F.when(area > 666, area - 2).otherwise(area - 1)  # 0..897

    def done(s: Column) -> Column:
        a = F.floor(s["l"] / 99) + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        sep = F.substr(m, F.lit(4), F.lit(1))
        return F.concat(F.lpad(a.cast("string"), 3, "0"), sep, F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), sep, F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(feistel(areas * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), done))


def _phone(m: Column, key: Column) -> Column:
    """National numbers of ten digits; what stands before them, as a country code, stays. Behind a
    plus sign and another calling code than 1, the national digits are permuted among those of
    their length."""

    def abroad(d: Column) -> Column:
        two = F.substr(d, F.lit(1), F.lit(2))
        size = F.when(F.substr(d, F.lit(1), F.lit(1)).isin("1", "7"), 1).when(F.instr(F.lit(f" {CODES2} "), F.concat(F.lit(" "), two, F.lit(" "))) > 0, 2).otherwise(3)
        code = F.substr(d, F.lit(1), size)
        return F.concat(code, permute_digits(F.substr(d, size + 1), key, "phone_abroad"))

    def made(d: Column) -> Column:
        n = F.length(d)
        code, national = F.substr(d, F.lit(1), n - 10), F.substr(d, n - 9, F.lit(10))
        whole = feistel(F.substr(national, F.lit(1), F.lit(5)).cast("long") - 20_000, F.substr(national, F.lit(6)), 80_000, 100_000, key, "phone")
        joined = _let(whole, lambda s: F.concat((s["l"] + 20_000).cast("string"), F.lpad(s["r"].cast("string"), 5, "0")))
        plain = permute_digits(national, key, "phone_low")  # numbers that begin with 0 or 1 stay among each other
        low = F.concat(F.substr(national, F.lit(1), F.lit(1)), permute_digits(F.substr(national, F.lit(2)), key, "phone_low"))
        return F.concat(code, F.when(F.substr(national, F.lit(1), F.lit(1)) >= "2", joined).otherwise(F.coalesce(low, plain)))

    national = ~m.startswith("+") | m.rlike(r"^\+1[^0-9]*+(?:[0-9][^0-9]*+){10}$") | m.rlike(r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}$")
    return _let(_digits(m), lambda d: F.when(national & (F.length(d) >= 10), _laid_out(m, made(d))).when(~national, _laid_out(m, abroad(d))))


def _ipv4(m: Column, key: Column) -> Column:
    def made(o: Column) -> Column:
        n = [o[i].cast("int") for i in range(4)]
        both = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ipv4")
        return _let(both, lambda s: F.concat_ws(".", *[F.floor(x).cast("string") for x in (s["l"] / 256, s["l"] % 256, s["r"] / 256, s["r"] % 256)]))

    return _let(F.split(m, r"\."), made)


#: Days of the months of a leap year.
_MONTHS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
#: Steps after which a permuted year and day is a date: only February 29 of 303 years of 400 is none, so that
#: a chain of this length has a chance below 1e-37.
_WALK = 16


def _calendar(low: int, high: int, months: int) -> list[int]:
    """Days from ``low`` to ``high`` in a leap year before each of the first months, and in all of them."""
    out = [0]
    for n in _MONTHS[:months]:
        out.append(out[-1] + min(high, n) - low + 1)
    return out


#: Written forms whose fields tell more than the calendar does, as (lowest day, highest day, months): a day above
#: 12 tells that the month comes first, a field of one digit that it is below 10.
_FORMS = ((1, 9, 9), (1, 9, 12), (1, 31, 9), (13, 31, 9), (13, 31, 12))


def _date(m: Column, key: Column) -> Column:
    """ISO dates, and day and month in the order that the calendar allows, day first if both.

    A date goes to a date that is written in the same form: ISO and two-digit dates with the day first
    are permuted among all days of 1800 to 2199, and are equal where the date is. Dates with the month
    first have a day above 12 and get one; fields of one digit get one digit. Those are permuted among
    the years and days of their form, and again while the day is no date of the year.
    """
    start = F.lit("1800-01-01").cast("date")

    def read(p: Column) -> Column:
        year_first, one, two = F.length(p[0]) == 4, p[0].cast("int"), p[1].cast("int")
        day_first = ~year_first & (two <= 12)
        month_short = F.when(day_first, F.length(p[1])).otherwise(F.length(p[0])) == 1
        return F.struct(
            year_first.alias("year_first"), day_first.alias("day_first"), F.regexp_extract(m, "[-./]", 0).alias("sep"), F.length(p[0]).alias("one"), F.length(p[1]).alias("two"),
            F.when(year_first, one).otherwise(p[2].cast("int")).alias("year"), F.when(year_first | day_first, two).otherwise(one).alias("month"), F.when(year_first, p[2].cast("int")).when(day_first, one).otherwise(two).alias("day"),
            F.when(day_first, 1).otherwise(13).alias("low"), F.when(day_first & (F.length(p[0]) == 1), 9).otherwise(31).alias("high"), F.when(month_short, 9).otherwise(12).alias("months"),
            (year_first | day_first & (F.length(p[0]) == 2) & (F.length(p[1]) == 2)).alias("plain"),
        )

    def any_day(v: Column) -> Column:
        def written(s: Column) -> Column:
            to = F.date_add(start, (s["l"] * 773 + s["r"]).cast("int"))
            d, mo, y = F.date_format(to, "dd"), F.date_format(to, "MM"), F.lpad(F.year(to).cast("string"), 4, "0")
            return F.when(v["year_first"], F.concat(y, v["sep"], mo, v["sep"], d)).otherwise(F.concat(d, v["sep"], mo, v["sep"], y))

        at = F.datediff(F.make_date(v["year"], v["month"], v["day"]), start)
        return _let(feistel(F.floor(at / 773), at % 773, 189, 773, key, "date"), written)

    def of_form(v: Column) -> Column:
        kind = F.concat_ws(" ", F.lit("date"), v["low"].cast("string"), v["high"].cast("string"), v["months"].cast("string"))
        upto = reduce(lambda rest, f: F.when((v["low"] == f[0]) & (v["high"] == f[1]) & (v["months"] == f[2]), F.lit(_calendar(*f))).otherwise(rest), _FORMS, F.lit(_calendar(1, 31, 12)))

        def permuted(before: Column) -> Column:
            size = F.element_at(before, -1).cast("long")

            def again(s: Column, _: Column) -> Column:
                y = s["l"] + 1800
                leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
                gap = (v["high"] > 28) & (s["r"] == before[1] + 29 - v["low"]) & ~leap
                return F.when(gap, feistel(s["l"], s["r"], 400, size, key, kind)).otherwise(s)

            def written(s: Column) -> Column:
                def fields(mo: Column) -> Column:
                    day, month = (s["r"] - F.element_at(before, mo) + v["low"]).cast("string"), mo.cast("string")
                    first, second = F.when(v["day_first"], day).otherwise(month), F.when(v["day_first"], month).otherwise(day)
                    return F.concat(F.lpad(first, v["one"], "0"), v["sep"], F.lpad(second, v["two"], "0"), v["sep"], (s["l"] + 1800).cast("string"))

                return _let(F.size(F.filter(before, lambda x: x <= s["r"])), fields)

            once = feistel(v["year"] - 1800, F.element_at(before, v["month"]) + v["day"] - v["low"], 400, size, key, kind)
            return _let(F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), once, again), written)

        return _let(upto, permuted)

    def moved(v: Column) -> Column:
        real = F.try_to_date(F.format_string("%04d-%02d-%02d", v["year"], v["month"], v["day"]), "yyyy-MM-dd")
        fit = real.isNotNull() & v["year"].between(1800, 2199)
        return F.when(fit & v["plain"], any_day(v)).when(fit, of_form(v))

    return _let(_let(F.split(m, "[-./]"), read), moved)


_LOWER, _UPPER, _TEN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Letters of e-mail addresses: besides ASCII the letters of Latin-1, Greek and Cyrillic, small and capital.
_SPANS = ((0xE0, 0xF6), (0xF8, 0xFF), (0xC0, 0xD6), (0xD8, 0xDE), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x430, 0x44F), (0x410, 0x42F))
_NAMES = (_LOWER, _UPPER, _TEN, *("".join(map(chr, range(a, b + 1))) for a, b in _SPANS))


def _email(m: Column, key: Column) -> Column:
    """The local part is permuted; the domain stays."""
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_text(local, key, "email", _NAMES), F.lit("@"), F.substring_index(m, "@", -1))


def _email_and_domain(m: Column, key: Column) -> Column:
    """The local part and the domain are permuted on their own, so that addresses of one domain
    stay linked; the domain's last label stays."""
    domain, last = F.substring_index(m, "@", -1), F.substring_index(m, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    return F.concat(F.substring_index(_email(m, key), "@", 1), F.lit("@"), permute_text(host, key, "domain", _NAMES), F.lit("."), last)


def _secret(m: Column, key: Column) -> Column:
    value = F.regexp_extract(m, r"[0-9A-Za-z+/_-]+$", 0)
    before = F.substr(m, F.lit(1), F.length(m) - F.length(value))
    low = permute_text(value, key, "hex", (_TEN + "abcdef",))
    return F.concat(before, F.when(value.rlike("^[0-9a-f]+$"), low).otherwise(permute_text(value, key, "secret", (_LOWER, _UPPER, _TEN))))


def _token(m: Column, key: Column) -> Column:
    before = F.regexp_extract(m, "^(?:(?i:bearer) +|[spr]k-(?:[a-z]+-)*|gh[pousr]_)", 0)
    return F.concat(before, permute_text(F.substr(m, F.length(before) + 1), key, "token", (_LOWER, _UPPER, _TEN)))


def _access_key(m: Column, key: Column) -> Column:
    return F.concat(F.lit("AKIA"), permute_text(F.substr(m, F.lit(5)), key, "access_key", (_UPPER + _TEN,)))


_MAKERS = {"email": _email, "secret": _secret, "token": _token, "access_key": _access_key, "ipv4": _ipv4, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(m: Column) -> Column:
    tests = [(k, m.rlike("^(?:" + PATTERNS[k] + ")$")) for k in _ORDER]
    return reduce(lambda rest, kt: F.when(kt[1], F.lit(kt[0])).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def pseudonymized(text: Column, key: Column, domains: bool = False) -> Column:
    """struct(text, kinds): the text with pseudonyms, and the kind of each replaced value in
    order; ``domains`` includes the domains of e-mail addresses. Null for a null text."""
    makers = _MAKERS | ({"email": _email_and_domain} if domains else {})

    def one(m: Column) -> Column:
        def as_kind(k: Column) -> Column:
            made = reduce(lambda rest, name: F.when(k == name, makers[name](m, key)).otherwise(rest), reversed(_ORDER), F.lit(None).cast("string"))
            return _let(made, lambda v: F.struct(F.coalesce(v, m).alias("value"), F.when(v.isNotNull(), k).alias("kind")))

        return _let(_kind(m), as_kind)

    def spliced(found: Column) -> Column:
        between = F.split(text, ANY, -1)
        values = F.array_append(F.transform(found, lambda x: x["value"]), F.lit(""))
        whole = F.concat_ws("", F.flatten(F.zip_with(between, values, lambda a, b: F.array(a, b))))
        return F.struct(whole.alias("text"), F.filter(F.transform(found, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), one)
    nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.isNull(), F.lit(None)).when(key.isNull() | ~text.rlike(_HINT), nothing).otherwise(_let(found, spliced))


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", out_col: str = "text", kinds_col: str | None = None, domains: bool = False) -> DataFrame:
    """``df`` with the texts pseudonymised in ``out_col`` and, with ``kinds_col``, the kinds of
    the replaced values. ``domains`` includes the domains of e-mail addresses.

    The key comes from a table of one row that is broadcast to the texts that may hold values, so it
    stands in no plan, explain or event log. No shuffle, no Python. Null texts stay null and
    empty ones empty; values that fail validation stay; all other columns and rows are as they were,
    whatever their names; an existing column named ``out_col`` or ``kinds_col`` is replaced.
    """
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    held, known, hint = free("pseudonyms"), free("pseudonym_key"), free("pseudonym_hint")
    keys = df.sparkSession.createDataFrame([(True, key)], f"{hint} boolean, {known} string")
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.withColumn(hint, F.coalesce(text.rlike(_HINT), F.lit(False))).join(F.broadcast(keys), hint, "left")
    rows = rows.withColumn(held, pseudonymized(text, F.col(known), domains))
    out = rows.withColumn(out_col, F.col(held)["text"])
    if kinds_col:
        out = out.withColumn(kinds_col, F.coalesce(F.col(held)["kinds"], F.array().cast("array<string>")))
    return out.drop(held, known, hint)


def session_key(spark: SparkSession) -> str:
    """The key of ``spark.voxloom.pseudonym.secret``. Where it is unset, a random one is set for this
    session: values are then linked within the session and nobody can invert them later."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, session_key(spark), kinds_col="kinds", domains=True).withColumn("n_replaced", F.size("kinds").cast("long"))
