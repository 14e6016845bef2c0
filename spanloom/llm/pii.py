"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates, each is validated, and what is valid is permuted within its format by a
keyed Feistel network, so equal values stay equal across documents and nothing is looked up:

- card numbers (13 to 19 digits, Luhn): digits between the first and the last, then a new check digit;
- telephone numbers of the North American plan (area and exchange from 200): the ten digits, within that range;
- other telephone numbers with a country code: the digits after the code;
- IPv4 addresses: four numbers below 256;
- US social security numbers: area, group and serial number within what is assigned;
- IBANs (remainder 1 modulo 97): digits and letters after the country, then new check digits;
- dates of 1800 to 2199 (``yyyy-mm-dd``, ``dd.mm.yyyy``, ``mm/dd/yyyy`` or else ``dd/mm/yyyy``): year, month and
  day within an era (1800-1899, 1900-2039, 2040-2199) and a kind of day (to the 12th, to the 28th, later,
  29 February), so dates stay dates and a date keeps the one reading that its order of day and month allows;
- e-mail addresses: letters and digits before the last domain label;
- access keys (``AKIA...``) and values assigned to names such as ``password`` or ``token``.

Separators, case and lengths stay.  The network adds, modulo each position's own base, a keyed SHA-512
of the other half of the value to one half after the other, which is a permutation for any bases.

A candidate that fails its check as a whole may hold a valid value beside a short neighbour: of a card
number the whole groups of 13 to 19 digits are tried, of an IBAN what ends at a blank, the longest first.  Still open: in longer runs of one separator, as
in ``2024 4111 1111 1111 1111`` (20 digits), the candidate ends at 19 digits and may miss the card.

Every value has one form before it is permuted (the digits of a number without separators and, in the
North American plan, without the code; year, month and day of a date), so the same value written in other
ways gets the same pseudonym, and different values get different ones.  The key is the caller's: who has
it can undo the permutation.

Defined cases: null texts stay null; texts without candidates stay as they are; candidates that fail
their validation stay.  Texts are read whole, rows are independent (no shuffle), and other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: First and last years of the eras that dates stay in.
ERAS = ((1800, 1899), (1900, 2039), (2040, 2199))
#: Length of the country codes that don't have three digits (fixed values of the international numbering plan).
CODES_1 = "[17]"
CODES_2 = "2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
AREAS = 898  # 001-665 and 667-899

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:(?<![a-z])(?:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_+/-]{12,128}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NANP = r"(?<![A-Za-z0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])"
PHONE = r"\+[0-9]{1,3}(?:[ .-]\(?[0-9]{2,4}\)?){2,5}(?![A-Za-z0-9])"
PLUS = r"\+[0-9]{8,15}(?![A-Za-z0-9])"
# A number before a blank and a hyphened card is left out where both are more than 19 digits.
CARD = r"(?<![A-Za-z0-9])(?![0-9]{4,6} (?=[0-9]+-)[0-9](?:-?[0-9]){15,18}(?![A-Za-z0-9]))[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
IPV4 = r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])"
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
DATE = r"(?<![A-Za-z0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-SU-Za-z/-]|T(?![0-9]))"
CANDIDATE = "|".join((EMAIL, ACCESS_KEY, SECRET, DATE, SSN, NANP, PHONE, PLUS, CARD, IBAN, IPV4))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _int(value: Column) -> Column:
    return value.cast("int")


def feistel(values: Column, bases: Column, kind: str, key: str) -> Column:
    """The keyed permutation of an array of numbers, each below the base at its place."""

    def step(state: Column, turn: Column) -> Column:
        half = F.floor(F.size(state.v) / 2).cast("int")
        left = turn % 2 == 0
        other = F.when(left, F.slice(state.v, half + 1, F.size(state.v))).otherwise(F.slice(state.v, F.lit(1), half))
        seed = F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), F.size(state.v).cast("string"), F.lit("|"), F.array_join(other.cast("array<string>"), ","), F.lit("|"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(state.v) - 1) / 16).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda j: F.sha2(F.concat(seed, j.cast("string")), 512)), "")
        added = lambda s: F.transform(
            s.v,
            lambda x, i: F.when((i < half) != left, x).otherwise(
                F.pmod(x + F.conv(F.substr(s.k, (i * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long"), F.get(s.b, i).cast("long")).cast("int")
            ),
        )
        return _let(
            F.struct(state.v.alias("v"), state.b.alias("b"), stream.alias("k")),
            lambda s: F.struct(added(s).alias("v"), s.b.alias("b")),
        )

    start = F.struct(values.cast("array<int>").alias("v"), bases.cast("array<int>").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s.v)


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda d: _int(d))


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in order."""
    return _let(
        F.struct(F.split(text, "").alias("c"), digits.alias("d")),
        lambda s: F.aggregate(
            s.c,
            F.struct(F.lit("").alias("o"), F.lit(0).alias("k")),
            lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a.o, F.get(s.d, a.k).cast("string")).alias("o"), (a.k + 1).alias("k"))).otherwise(F.struct(F.concat(a.o, c).alias("o"), a.k.alias("k"))),
            lambda a: a.o,
        ),
    )


def luhn(digits: Column) -> Column:
    """The Luhn sum of an array of digits modulo 10."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    weighed = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10


def mod97(text: Column) -> Column:
    """The remainder that ends an IBAN's check, of its text without blanks."""
    moved = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: _let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _within(c: Column, spans: Column, valid: Callable[[Column], Column], body: Callable[[Column], Column]) -> Column:
    """``c`` with ``body`` of the first valid one of ``spans`` (``at`` from 1, ``n`` letters), and what is on its sides."""
    cut = lambda s: F.substr(c, s.at, s.n)
    found = F.filter(spans, lambda s: valid(cut(s)))
    put = lambda s: F.concat(F.substr(c, F.lit(1), s.at - 1), body(cut(s)), F.substr(c, s.at + s.n, F.length(c)))
    return _let(found, lambda f: F.when(F.size(f) > 0, put(f[0])).otherwise(c))


def _groups(c: Column) -> Column:
    """Spans of whole groups between blanks and hyphens that hold 13 to 19 digits, the longest first."""
    # Where a group starts, and one past where a group ends.
    starts = F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: (i == 1) | F.substr(c, i - 1, F.lit(1)).isin(" ", "-"))
    ends = F.filter(F.sequence(F.lit(2), F.length(c) + 1), lambda i: (i == F.length(c) + 1) | F.substr(c, i, F.lit(1)).isin(" ", "-"))
    spans = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(ends, lambda e: e > a), lambda e: F.struct((a - e).alias("order"), a.alias("at"), (e - a).alias("n")))))
    return F.array_sort(F.filter(spans, lambda s: F.length(F.regexp_replace(F.substr(c, s.at, s.n), "[ -]", "")).between(13, 19)))


def _card(c: Column, key: str) -> Column:
    def make(d: Column) -> Column:
        inner = F.slice(d, F.lit(2), F.size(d) - 2)
        body = F.concat(F.slice(d, 1, 1), feistel(inner, F.array_repeat(F.lit(10), F.size(d) - 2), "card", key))
        return _let(body, lambda b: F.concat(b, F.array((10 - luhn(F.concat(b, F.array(F.lit(0))))) % 10)))

    fine = lambda x: luhn(_digits(x)) == 0
    new = lambda x: _let(_digits(x), lambda d: _refill(x, make(d)))
    return F.when(fine(c), new(c)).otherwise(_within(c, _groups(c), fine, new))


def _nanp(c: Column, key: str) -> Column:
    """Ten digits of which the first and the fourth are from 2 to 9."""
    first = lambda i: (i == 0) | (i == 3)

    def make(d: Column) -> Column:
        own = F.slice(d, F.size(d) - 9, F.lit(10))
        low = F.transform(own, lambda x, i: F.when(first(i), x - 2).otherwise(x))
        new = F.transform(feistel(low, F.transform(own, lambda x, i: F.when(first(i), 8).otherwise(10)), "phone", key), lambda x, i: F.when(first(i), x + 2).otherwise(x))
        return F.concat(F.slice(d, F.lit(1), F.size(d) - 10), new)

    fine = lambda d: (F.get(d, F.size(d) - 10) > 1) & (F.get(d, F.size(d) - 7) > 1)
    return _let(_digits(c), lambda d: F.when((F.size(d) >= 10) & fine(d), _refill(c, make(d))).otherwise(c))


def _phone(c: Column, key: str) -> Column:
    """Numbers with a country code, which stays; those of the North American plan as without it."""
    code = F.when(c.rlike(rf"^\+(?:{CODES_1})"), 1).when(c.rlike(rf"^\+(?:[ .()-]*)(?:{CODES_2})"), 2).otherwise(3)
    make = lambda d, n: F.concat(F.slice(d, F.lit(1), n), feistel(F.slice(d, n + 1, F.size(d)), F.array_repeat(F.lit(10), F.size(d) - n), "phone+", key))
    other = lambda d: F.when(F.size(d).between(8, 15), _let(code, lambda n: _refill(c, make(d, n)))).otherwise(c)
    return _let(_digits(c), lambda d: F.when((F.size(d) == 11) & (d[0] == 1), _nanp(c, key)).otherwise(other(d)))


def _ipv4(c: Column, key: str) -> Column:
    make = lambda p: F.array_join(feistel(p, F.array_repeat(F.lit(256), 4), "ipv4", key).cast("array<string>"), ".")
    parts = F.transform(F.split(c, r"\."), lambda x: _int(x))
    return _let(parts, lambda p: F.when(F.forall(p, lambda x: x < 256), make(p)).otherwise(c))


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _ssn(c: Column, key: str) -> Column:
    parts = F.transform(F.split(c, "-"), lambda x: _int(x))
    fine = lambda p: (p[0] > 0) & (p[0] != 666) & (p[0] < 900) & (p[1] > 0) & (p[2] > 0)
    area = lambda p: F.when(p[0] > 666, p[0] - 2).otherwise(p[0] - 1)
    new = lambda p: feistel(F.array(area(p), p[1] - 1, p[2] - 1), F.array(F.lit(AREAS), F.lit(99), F.lit(9999)), "ssn", key)
    text = lambda v: F.concat_ws("-", _pad(F.when(v[0] > 664, v[0] + 2).otherwise(v[0] + 1), 3), _pad(v[1] + 1, 2), _pad(v[2] + 1, 4))
    return _let(parts, lambda p: F.when(fine(p), _let(new(p), text)).otherwise(c))


#: Months and days after the 28th, without 29 February.
LATE = [(m, d) for m in range(1, 13) for d in (29, 30, 31) if not (m == 2 or (d == 31 and m in (4, 6, 9, 11)))]


def _new_day(p: Column, low: int, high: int, key: str) -> Column:
    """The pseudonym of a day ``y, m, d`` of one era, as ``y, m, d``."""
    years, kind = F.lit(high - low + 1), f"date{low}"
    part = lambda y, m, d: F.struct(_int(y).alias("y"), _int(m).alias("m"), _int(d).alias("d"))

    def spread(days: int, first: int, name: str) -> Column:
        new = feistel(F.array(p.y - low, p.m - 1, p.d - first), F.array(years, F.lit(12), F.lit(days)), f"{kind}{name}", key)
        return _let(new, lambda v: part(v[0] + low, v[1] + 1, v[2] + first))

    late = F.array(*[F.lit(m * 100 + d) for m, d in LATE])
    new_late = feistel(F.array(p.y - low, _int(F.array_position(late, p.m * 100 + p.d)) - 1), F.array(years, F.lit(len(LATE))), f"{kind}late", key)
    leap = [y for y in range(low, high + 1) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
    leaps = F.array(*map(F.lit, leap))
    new_leap = feistel(F.array(_int(F.array_position(leaps, p.y)) - 1), F.array(F.lit(len(leap))), f"{kind}leap", key)
    return (
        F.when(p.d <= 12, spread(12, 1, "early"))
        .when(p.d <= 28, spread(16, 13, "middle"))
        .when(p.m == 2, _let(new_leap, lambda v: part(F.get(leaps, v[0]), F.lit(2), F.lit(29))))
        .otherwise(_let(new_late, lambda v: part(v[0] + low, F.floor(F.get(late, v[1]) / 100), F.get(late, v[1]) % 100)))
    )


def _date(c: Column, key: str) -> Column:
    iso, dots = c.rlike("^[0-9]{4}-"), c.rlike(r"\.")
    n = lambda at, size: _int(F.substring(c, at, size))
    year = F.when(iso, n(1, 4)).otherwise(n(7, 4))
    fits = lambda p: p.y.between(ERAS[0][0], ERAS[-1][1]) & p.m.between(1, 12) & F.coalesce(p.d.between(1, F.day(F.last_day(F.make_date(p.y, F.when(p.m.between(1, 12), p.m), F.lit(1))))), F.lit(False))
    part = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    month_first = part(year, n(1, 2), n(4, 2))
    day_first = part(year, n(4, 2), n(1, 2))

    def make(p: Column, text: Callable[[Column], Column]) -> Column:
        new = F.lit(None)
        for low, high in ERAS:
            new = F.when(p.y.between(low, high), _new_day(p, low, high, key)).otherwise(new)
        return _let(new, text)

    two = lambda x: _pad(x, 2)
    ymd = lambda t: F.concat_ws("-", _pad(t.y, 4), two(t.m), two(t.d))
    dmy = lambda sep: lambda t: F.concat_ws(sep, two(t.d), two(t.m), _pad(t.y, 4))
    mdy = lambda t: F.concat_ws("/", two(t.m), two(t.d), _pad(t.y, 4))
    # The order of the parts first, then one permutation and one text, so that the plan holds it once.
    read = F.when(iso, F.struct(F.lit(0).alias("order"), part(year, n(6, 2), n(9, 2)).alias("p"))).when(dots, F.struct(F.lit(1).alias("order"), day_first.alias("p")))
    read = read.otherwise(_let(month_first, lambda p: F.when(fits(p), F.struct(F.lit(2).alias("order"), p.alias("p"))).otherwise(F.struct(F.lit(3).alias("order"), day_first.alias("p")))))
    write = lambda order: lambda t: F.when(order == 0, ymd(t)).when(order == 1, dmy(".")(t)).when(order == 2, mdy(t)).otherwise(dmy("/")(t))
    return _let(read, lambda r: F.when(fits(r.p), make(r.p, write(r.order))).otherwise(c))


def _chars(text: Column, kind: str, key: str) -> Column:
    """``text`` with letters and digits permuted within their classes; hexadecimal stays hexadecimal."""
    hexa = text.rlike("^[0-9a-f]+$")

    def kinds(s: Column) -> Column:
        one = lambda c: (
            F.when(c.rlike("[0-9]"), F.struct(c.alias("c"), F.lit(48).alias("low"), F.lit(10).alias("base")))
            .when(c.rlike("[a-z]"), F.struct(c.alias("c"), F.lit(97).alias("low"), F.when(s.h, 6).otherwise(26).alias("base")))
            .when(c.rlike("[A-Z]"), F.struct(c.alias("c"), F.lit(65).alias("low"), F.lit(26).alias("base")))
            .otherwise(F.struct(c.alias("c"), F.ascii(c).alias("low"), F.lit(1).alias("base")))
        )
        return F.transform(s.c, one)

    def make(k: Column) -> Column:
        new = feistel(F.transform(k, lambda x: F.ascii(x.c) - x.low), F.transform(k, lambda x: x.base), kind, key)
        return F.array_join(F.zip_with(k, new, lambda x, v: F.chr(x.low + v)), "")

    return _let(_let(F.struct(F.split(text, "").alias("c"), hexa.alias("h")), kinds), make)


def _email(c: Column, key: str) -> Column:
    cut = F.length(c) - F.length(F.substring_index(c, ".", -1)) - 1
    return F.concat(_chars(F.substr(c, F.lit(1), cut), "email", key), F.substr(c, cut + 1, F.length(c)))


def _iban(c: Column, key: str) -> Column:
    def make(t: Column) -> Column:
        body = _chars(F.substring(t, 5, 64), "iban", key)
        country = F.substring(t, 1, 2)
        whole = lambda b: F.concat(country, _pad(98 - mod97(F.concat(country, F.lit("00"), b)), 2), b)
        return _let(body, whole)

    blanks = lambda x, new: _let(
        F.struct(F.split(x, "").alias("c"), new.alias("n")),
        lambda s: F.aggregate(
            s.c,
            F.struct(F.lit("").alias("o"), F.lit(1).alias("k")),
            lambda a, x: F.when(x == " ", F.struct(F.concat(a.o, x).alias("o"), a.k.alias("k"))).otherwise(F.struct(F.concat(a.o, F.substr(s.n, a.k, F.lit(1))).alias("o"), (a.k + 1).alias("k"))),
            lambda a: a.o,
        ),
    )
    bare = lambda x: F.regexp_replace(x, " ", "")
    fine = lambda x: _let(bare(x), lambda t: F.length(t).between(15, 34) & (mod97(t) == 1))
    new = lambda x: blanks(x, _let(bare(x), make))
    # What is left of a candidate whose end is cut off at a blank, the longest first.
    ends = F.filter(F.sequence(F.length(c) - 1, F.lit(1), F.lit(-1)), lambda n: F.substr(c, n + 1, F.lit(1)) == " ")
    spans = F.transform(ends, lambda n: F.struct(F.lit(1).alias("at"), n.alias("n")))
    return F.when(fine(c), new(c)).otherwise(_within(c, spans, fine, new))


def _secret(c: Column, key: str) -> Column:
    value = F.regexp_extract(c, r"[A-Za-z0-9_+/-]{12,128}$", 0)
    return _let(value, lambda v: F.concat(F.substr(c, F.lit(1), F.length(c) - F.length(v)), _chars(v, "secret", key)))


def _is(pattern: str, c: Column) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def pseudonym(c: Column, key: str) -> Column:
    """What stands for one candidate."""
    return (
        F.when(_is(EMAIL, c), _email(c, key))
        .when(_is(ACCESS_KEY, c), F.concat(F.lit("AKIA"), _chars(F.substring(c, 5, 16), "key", key)))
        .when(_is(DATE, c), _date(c, key))
        .when(_is(SSN, c), _ssn(c, key))
        .when(_is(NANP, c), _nanp(c, key))
        .when(_is(IPV4, c), _ipv4(c, key))
        .when(c.startswith("+"), _phone(c, key))
        .when(_is(CARD, c), _card(c, key))
        .when(_is(IBAN, c), _iban(c, key))
        .when(_is(SECRET, c), _secret(c, key))
        .otherwise(c)
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with the personal data in ``text`` replaced, columns unchanged."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    new = F.concat(F.transform(found, lambda c: pseudonym(c, key)), F.array(F.lit("")))
    between = F.split(text, CANDIDATE, -1)
    whole = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")
    return df.withColumn(text, F.when(F.col(text).rlike("[0-9@]|[=:]"), whole).otherwise(F.col(text)))
