"""Format-preserving pseudonyms for personal numbers and dates, as column expressions only.

Values are found by pattern, validated, and replaced by a keyed Feistel permutation of their
own format: cards keep their length and a right check digit, dates are dates in the same
notation, addresses are addresses, and what separates the characters stays.  Under one key
equal values get equal pseudonyms in every document and different ones different pseudonyms,
so they stay linked; the text keeps its length unless a date is written without zeros.

| Kind | Validated by | Permuted |
|-|-|-|
| card | 13 to 19 digits, Luhn | all digits but the last, which is the new check digit |
| phone | + and 8 to 15 digits, or ten digits as 3-3-4 | all but the country code |
| social security number | number ranges in use | area, group and serial within those ranges |
| date | the calendar, 1901 to 2096 | the day's number among the first twelve days of all months, or among the others, so that every notation of a date shows one pseudonym |
| IPv4 address | four numbers up to 255 | the four numbers |
| mail address | host with a dot | letters and digits before the @ |
| secret | 32 to 64 hex digits in either case, letters among them | the hex digits, which keep their case |

The key is the caller's: whoever knows it can undo the pseudonyms.  It reaches the expressions as the
one value of a table, by a scalar subquery, so that no plan, and with it no event log, shows it.

Hex digits that differ only by case are one value, so their pseudonyms differ at most by case.
What isn't valid stays as it is.  Null texts stay null, empty ones empty; texts of any length
are searched whole, and every pattern starts at a boundary and is of bounded length.  Other
columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, YEARS = "1901-01-01", 196  # seven cycles of 28 years
LATE = (105, 413)  # the 43,365 days of that span after the 12th of their month

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[/.-]\d)"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
SECRET = r"(?<!\w)[0-9A-Fa-f]{32,64}+(?!\w)"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
    r"|(?<![\w+-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w|-\d)"
)
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\w|[.-]\d)"
ANY = "|".join((MAIL, DATE, IPV4, SECRET, PHONE, SSN, CARD))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(digits: Column, radices: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the numbers ``digits``, each below its radix.

    The left half of the numbers gets the keyed hash of the right one added, each modulo its
    radix, then the right half that of the left; so every round can be undone.
    """
    half = F.floor(F.size(digits) / 2).cast("int")
    rest = F.size(digits) - half
    left_radix, right_radix = F.slice(radices, F.lit(1), half), F.slice(radices, half + 1, rest)

    def add(to: Column, radix: Column, by: Column, turn: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), F.array_join(by.cast("array<string>"), ",")).cast("binary"), 512)
        number = lambda h, j: F.conv(F.substring(h, j * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return _let(stream, lambda h: F.transform(to, lambda x, j: (x + number(h, j)) % F.get(radix, j)))

    def turn(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        even = F.struct(add(a, left_radix, b, i).alias("a"), b.alias("b"))
        odd = F.struct(a.alias("a"), add(b, right_radix, a, i).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.slice(digits, F.lit(1), half).alias("a"), F.slice(digits, half + 1, rest).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _characters(text: Column) -> Column:
    return F.split(text, "")


def _at(alphabet: str, i: Column) -> Column:
    return F.substring(F.lit(alphabet), i + 1, F.lit(1))


def _refill(shape: Column, fresh: Column, moves: str) -> Column:
    """The characters of ``shape``, those matching ``moves`` replaced in turn by those of ``fresh``."""
    step = lambda s, c: F.when(
        c.rlike(moves), F.struct(F.concat(s["t"], F.get(fresh, s["i"])).alias("t"), (s["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i")))
    return F.aggregate(_characters(shape), F.struct(F.lit("").alias("t"), F.lit(0).alias("i")), step, lambda s: s["t"])


def _strings(numbers: Column) -> Column:
    return numbers.cast("array<string>")


def _digits(text: Column) -> Column:
    return _characters(F.regexp_replace(text, r"\D", "")).cast("array<int>")


def _permuted(text: Column, key: Column, kind: str) -> Column:
    """The digits of a text, permuted."""
    return _let(_digits(text), lambda d: feistel(d, F.array_repeat(F.lit(10), F.size(d)), key, kind))


def _luhn(digits: Column) -> Column:
    """Sum of digits in which every second one from the right, the last first, counts double."""
    n = F.size(digits)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + _let(F.get(digits, i) * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))


def _card(text: Column, key: Column) -> Column:
    def valid(d: Column) -> Column:
        body = F.slice(d, F.lit(1), F.size(d) - 1)
        check = (10 - _luhn(body) % 10) % 10
        fresh = _let(feistel(body, F.array_repeat(F.lit(10), F.size(body)), key, "card"), lambda p: F.concat(p, F.array((10 - _luhn(p) % 10) % 10)))
        return F.when(check == F.element_at(d, -1), _refill(text, _strings(fresh), r"\d")).otherwise(text)

    return _let(_digits(text), valid)


def _phone(text: Column, key: Column) -> Column:
    code = F.regexp_extract(text, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    rest = F.substring(text, F.length(code) + 1, F.length(text))
    count = F.length(F.regexp_replace(text, r"\D", ""))
    return F.when(count.between(8, 15), F.concat(code, _refill(rest, _strings(_permuted(rest, key, "phone")), r"\d"))).otherwise(text)


def _ssn(text: Column, key: Column) -> Column:
    part = F.split(text, "-").cast("array<int>")
    area, group, serial = part[0], part[1], part[2]
    valid = (area.between(1, 899)) & (area != 666) & (group > 0) & (serial > 0)
    ranks = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    fresh = _let(feistel(ranks, F.array(*map(F.lit, (898, 99, 9999))), key, "ssn"), lambda p: F.format_string("%03d-%02d-%04d", F.when(p[0] > 664, p[0] + 2).otherwise(p[0] + 1), p[1] + 1, p[2] + 1))
    return F.when(valid, fresh).otherwise(text)


def _date(text: Column, key: Column) -> Column:
    """Day first where a dot divides; with a slash month first unless only day first is a date."""
    part = F.split(text, r"[-/.]")
    ymd = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    iso, dot, month_first = ymd(part[0], part[1], part[2]), ymd(part[2], part[1], part[0]), ymd(part[2], part[0], part[1])
    slash, hyphen = F.contains(text, F.lit("/")), F.contains(text, F.lit("-"))
    day = F.when(hyphen, iso).when(slash, F.coalesce(month_first, dot)).otherwise(dot)
    first = F.to_date(F.lit(FIRST_DAY))
    month_of = lambda d: (F.year(d) - 1901) * 12 + F.month(d) - 1

    def two(i: Column, radix: int, by: int, part: str) -> Column:
        ranks = F.array(F.floor(i / by).cast("int"), (i % by).cast("int"))
        return _let(feistel(ranks, F.array(F.lit(radix), F.lit(by)), key, part), lambda p: p[0] * by + p[1])

    def early(d: Column) -> Column:
        """One of the first twelve days of a month for another."""
        return _let(two(month_of(d) * 12 + F.dayofmonth(d) - 1, YEARS, 144, "early date"), lambda x: F.date_add(F.add_months(first, F.floor(x / 12).cast("int")), (x % 12).cast("int")))

    def late(d: Column) -> Column:
        """One of the days after the 12th for another; these alone read day first with a slash.  Before month m
        lie its first day's number less 12 m of them, which is never a month's worth off 18.4375 m."""
        before = lambda m: F.datediff(F.add_months(first, m), first) - m * 12
        rank = F.datediff(d, first) - (month_of(d) + 1) * 12
        month = lambda x: F.array_max(F.filter(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.greatest(F.lit(0), F.floor(x / 18.4375).cast("int") + k)), lambda m: before(m) <= x))
        return _let(two(rank, *LATE, "late date"), lambda x: _let(month(x), lambda m: F.date_add(F.add_months(first, m), (x - before(m) + 12).cast("int"))))

    def shown(d: Column) -> Column:
        as_ = lambda fresh, form: F.date_format(fresh, form)
        fresh = F.when(F.dayofmonth(d) > 12, late(d)).otherwise(early(d))
        return _let(fresh, lambda x: F.when(hyphen, as_(x, "yyyy-MM-dd")).when(~slash, as_(x, "dd.MM.yyyy")).when(month_first.isNotNull(), as_(x, "MM/dd/yyyy")).otherwise(as_(x, "dd/MM/yyyy")))

    return F.coalesce(_let(day, lambda d: F.when(F.year(d).between(1901, 1900 + YEARS), shown(d)).otherwise(text)), text)


def _ipv4(text: Column, key: Column) -> Column:
    part = F.split(text, r"\.").cast("array<int>")
    fresh = F.array_join(_strings(feistel(part, F.array_repeat(F.lit(256), 4), key, "ipv4")), ".")
    return F.when(F.forall(part, lambda x: x <= 255), fresh).otherwise(text)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _mail(text: Column, key: Column) -> Column:
    local, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    moving = _characters(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
    shift = F.transform(moving, lambda c: F.ascii(c) - base(c))
    radix = F.transform(moving, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))
    fresh = F.zip_with(feistel(shift, radix, key, "mail"), moving, lambda x, c: F.chr(x + base(c)))
    return F.when(local.rlike("[A-Za-z0-9]"), F.concat(_let(fresh, lambda f: _refill(local, f, "[A-Za-z0-9]")), F.lit("@"), host)).otherwise(text)


def _secret(text: Column, key: Column) -> Column:
    numbers = F.transform(_characters(text), lambda c: F.conv(c, 16, 10).cast("int"))
    lower = text.rlike("[a-f]")  # without any, new letters are upper-case too
    shown = lambda x, c: F.when(lower & ~c.rlike("[A-F]"), _at("0123456789abcdef", x)).otherwise(_at("0123456789ABCDEF", x))
    fresh = F.array_join(F.zip_with(feistel(numbers, F.array_repeat(F.lit(16), F.length(text)), key, "secret"), _characters(text), shown), "")
    return F.when(text.rlike("[A-Fa-f]"), fresh).otherwise(text)


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of one found value."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(value, F.lit("@")), _mail(value, key)).when(whole(DATE), _date(value, key)).when(whole(IPV4), _ipv4(value, key))
        .when(whole(SECRET), _secret(value, key)).when(whole(SSN), _ssn(value, key)).when(whole(PHONE), _phone(value, key)).otherwise(_card(value, key))
    )


def pseudonymised(text: Column, key: Column) -> Column:
    """A text with its values replaced: the parts between the finds, and the pseudonyms, in turn."""
    # a cheap test first: without a mark of any kind there is nothing to find
    candidate = text.rlike(r"@|\d[\d .()/-]{6}|[0-9A-Fa-f]{32}")
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key))
    pieces = F.zip_with(F.split(text, ANY), found, lambda t, m: F.concat(t, F.coalesce(m, F.lit(""))))
    return F.when(candidate, F.array_join(pieces, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its text column; rows and the other columns stay as they are."""
    held = "key"
    while held in docs.columns:
        held += "_"
    keyed = docs.withColumn(held, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    new = pseudonymised(F.col(f"`{text_col}`"), F.col(held))
    return keyed.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
