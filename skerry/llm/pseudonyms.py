"""Format-preserving pseudonyms for personal data (native).

Numbers and dates that look like personal data are validated (Luhn digits of cards, octets of
addresses, days of dates, number ranges) and permuted by a keyed Feistel network within the values
that are valid in their notation.  So equal values get equal pseudonyms in all documents, different
values of a notation different ones, and a pseudonym is as valid as what it stands for.

* card: issuer digits and separators stay, the account digits are permuted, the check digit is new;
* phone: separators and the country code stay, the digits are permuted;
* social security number: permuted among the 898 x 99 x 9999 numbers that can be issued;
* IPv4: permuted among all addresses; an octet with leading zeros keeps its width and stays below 100;
* date: permuted by its day, whatever its notation, among the days of the years 1901 to 2095, those before,
  or those after; so one day has one pseudonym in every notation, and the notation stays.  Days up to the
  12th and later ones are permuted apart: where a slashed date can only be read one way, so can its
  pseudonym.  Slashed dates are month first where that is a date, in every text, so that equal values
  stay linked; a day first is recognised from the 13th on;
* e-mail: letters and digits of the local part are permuted in blocks (capitals don't count), domain
  and other characters stay.

The network has two halves below ``a`` and ``b``; a round adds a keyed hash of one half to the other
modulo its bound, which permutes all ``a * b`` values, so no value has to be tried twice.

No shuffle: everything happens within a document's row.  One pass of the pattern puts marks around
its matches; the marks cut the text into what lies between and the matches.  The key comes in as a
scalar subquery, so it isn't part of the plan's text.

Defined results: a null or empty text has no findings; values that fail validation stay; a null
identifier is kept; repeated rows give equal rows; an empty table gives an empty result; further
columns are ignored by :func:`findings`; a text of any length is worked on as a whole.
"""

from __future__ import annotations

from datetime import date, timedelta
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm._columns import computed_once, let

ROUNDS = 8
#: Dates are permuted among days of the years from one of these to the next; both numbers of days of
#: every span have factors that are near each other.
YEARS = (1, 1901, 2096, 10_000)
#: Days of a month that can't be months; the last ones of a leap year, in order.
EARLY = 12
LATE_DAYS = [d.isoformat()[5:] for d in (date(2000, 1, 1) + timedelta(k) for k in range(366)) if d.day > EARLY]
BLOCK = 16
#: Put around matches; texts that have it themselves take a second pass instead.
MARK = "\x01"

# The notations, tried in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, DATE, SSN, PHONE, CARD, IPV4))
#: The same for texts without an at sign, tried only where a number can begin.
NUMBERS = f"(?=[0-9+(])(?:{'|'.join(f'(?:{p})' for p in (DATE, SSN, PHONE, CARD, IPV4))})"


def _keyed(key: str | Column, kind: str, round_: Column, half: Column) -> Column:
    """48 bits of a keyed hash."""
    text = F.concat_ws("/", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 12), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str | Column, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the numbers below a * b."""

    def run(value: Column, a: Column, b: Column) -> Column:
        first = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, _step(a, b, key, kind), lambda s: s["l"] * b + s["r"])

    return let(run, value=value, a=a, b=b)


def _step(a: Column, b: Column, key: str | Column, kind: str):
    """A round over a pair of halves: odd ones change the left half, even ones the right."""

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (s["l"] + _keyed(key, kind, i, s["r"])) % a).otherwise(s["l"]).cast("long").alias("l"),
            F.when(odd, s["r"]).otherwise((s["r"] + _keyed(key, kind, i, s["l"])) % b).cast("long").alias("r"),
        )

    return step


def _power(base: int, n: Column) -> Column:
    """base ** n as an exact whole number, for small n."""
    return F.element_at(F.expr(f"array({', '.join(f'{base**k}L' for k in range(11 if base == 10 else 9))})"), n.cast("int") + 1)


def permuted_digits(digits: Column, key: str | Column, kind: str) -> Column:
    """A permutation of the strings of as many digits (18 at most)."""

    def run(digits: Column, n: Column, low: Column, a: Column, b: Column) -> Column:
        left = F.coalesce(F.substring(digits, F.lit(1), n - low).try_cast("long"), F.lit(0))
        start = F.struct(left.cast("long").alias("l"), F.substring(digits, n - low + 1, low).cast("long").alias("r"))

        def joined(s: Column) -> Column:
            head = F.when(n - low > 0, F.lpad(s["l"].cast("string"), n - low, F.lit("0"))).otherwise("")
            return F.concat(head, F.lpad(s["r"].cast("string"), low, F.lit("0")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, _step(a, b, key, kind), joined)

    n = F.length(digits)
    low = F.ceil(n / 2).cast("int")
    return let(run, digits=digits, n=n, low=low, a=_power(10, n - low), b=_power(10, low))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, characters: Column, kind: str = "[0-9]") -> Column:
    """``value`` with its characters of a kind replaced in order by ``characters``."""

    def run(value: Column, characters: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

        def step(s: Column, c: Column) -> Column:
            hit = c.rlike(kind)
            return F.struct(
                F.concat(s["out"], F.when(hit, F.substring(characters, s["k"], F.lit(1))).otherwise(c)).alias("out"),
                F.when(hit, s["k"] + 1).otherwise(s["k"]).alias("k"),
            )

        return F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])

    return let(run, value=value, characters=characters)


def luhn_sum(digits: Column, doubled: int = 0) -> Column:
    """Luhn sum; from the right, every second digit counts double (``doubled`` 1: the first does)."""

    def run(digits: Column, n: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return total + F.when(i % 2 == doubled, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return let(run, digits=digits, n=F.length(digits))


def _card(value: Column, key: str | Column) -> Column:
    def account(digits: Column, n: Column) -> Column:
        return F.concat(F.substring(digits, 1, 6), permuted_digits(F.substring(digits, F.lit(7), n - 7), key, "card"))

    def closed(body: Column) -> Column:
        return F.concat(body, ((10 - luhn_sum(body, 1) % 10) % 10).cast("string"))

    return _refilled(value, let(closed, body=let(account, digits=_digits(value), n=F.length(_digits(value)))))


def _phone(value: Column, key: str | Column) -> Column:
    head = F.regexp_extract(value, r"^(\+[0-9]{1,3}[ .-]?(?=[(0-9]))?", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, _refilled(rest, permuted_digits(_digits(rest), key, "phone")))


def _ssn(value: Column, key: str | Column) -> Column:
    """Numbers of the areas 001 to 899 without 666, the groups 01 to 99 and the serials 0001 to 9999, in order."""
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(k)).cast("long") for k in (1, 2, 3))
    place = (area - 1 - F.when(area > 666, 1).otherwise(0)) * (99 * 9999) + (group - 1) * 9999 + serial - 1

    def written(n: Column) -> Column:
        number, rest = F.floor(n / (99 * 9999)).cast("long"), n % (99 * 9999)
        parts = (number + 1 + F.when(number > 664, 1).otherwise(0), F.floor(rest / 9999).cast("long") + 1, rest % 9999 + 1)
        return F.concat_ws("-", *[F.lpad(p.cast("string"), width, "0") for p, width in zip(parts, (3, 2, 4))])

    return let(written, n=feistel(place, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "ssn"))


def _octet(value: Column, k: int) -> Column:
    return F.split_part(value, F.lit("."), F.lit(k))


def _ipv4(value: Column, key: str | Column) -> Column:
    octets = {f"o{k}": _octet(value, k) for k in (1, 2, 3, 4)}
    widths = {f"w{k}": F.when(_octet(value, k).rlike("^0[0-9]+$"), F.length(_octet(value, k))).otherwise(0) for k in (1, 2, 3, 4)}

    def size(width: Column) -> Column:
        return F.when(width == 3, 100).when(width == 2, 10).otherwise(256).cast("long")

    def run(o1, o2, o3, o4, w1, w2, w3, w4) -> Column:
        number = [o.cast("long") for o in (o1, o2, o3, o4)]
        b = size(w3) * size(w4)
        moved = feistel((number[0] * size(w2) + number[1]) * b + number[2] * size(w4) + number[3], size(w1) * size(w2), b, key, "ipv4")

        def written(left: Column, right: Column) -> Column:
            parts = (F.floor(left / size(w2)), left % size(w2), F.floor(right / size(w4)), right % size(w4))
            texts = [p.cast("long").cast("string") for p in parts]
            return F.concat_ws(".", *[F.lpad(t, F.greatest(w, F.length(t)), F.lit("0")) for t, w in zip(texts, (w1, w2, w3, w4))])

        return let(lambda n: let(written, left=F.floor(n / b).cast("long"), right=n % b), n=moved)

    return let(run, **octets, **widths)


def _day(value: Column) -> Column:
    """The date of a value, or null."""
    iso, dotted = F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "dd.MM.yyyy")
    slashed = F.coalesce(F.try_to_date(value, "MM/dd/yyyy"), F.try_to_date(value, "dd/MM/yyyy"))
    day = F.when(value.contains("."), dotted).when(value.contains("/"), slashed).otherwise(iso)
    return F.when(F.year(day).between(YEARS[0], YEARS[-1] - 1), day)


def _sides(n: int) -> tuple[int, int]:
    """Two factors of ``n``, as close as they can be."""
    a = next(k for k in range(isqrt(n), 0, -1) if n % k == 0)
    return a, n // a


def _early_before(year):
    """Days up to the 12th in the years 1 to ``year`` - 1, of a number or a column."""
    return 12 * EARLY * (year - 1)


def _late_before(year):
    """Days from the 13th on in those years."""
    past = year - 1
    if isinstance(year, Column):
        leaps = F.floor(past / 4) - F.floor(past / 100) + F.floor(past / 400)
    else:
        leaps = past // 4 - past // 100 + past // 400
    return (len(LATE_DAYS) - 1) * past + leaps


def _early_day(n: Column) -> Column:
    """The ``n``-th day (from 0) up to the 12th, from year 1 on."""
    rest = n % (12 * EARLY)
    return F.make_date((F.floor(n / (12 * EARLY)) + 1).cast("int"), (F.floor(rest / EARLY) + 1).cast("int"), (rest % EARLY + 1).cast("int"))


def _late_day(n: Column) -> Column:
    """The ``n``-th day (from 0) from the 13th on, from year 1 on."""
    mean = (400 * (len(LATE_DAYS) - 1) + 97) / 400

    def of_year(year: Column, n: Column) -> Column:
        place = n - _late_before(year)
        common = _late_before(year + 1) - _late_before(year) < len(LATE_DAYS)
        place = place + F.when(common & (place >= LATE_DAYS.index("02-29")), 1).otherwise(0)
        month_day = F.element_at(F.split(F.lit(",".join(LATE_DAYS)), ","), (place + 1).cast("int"))
        return F.make_date(year.cast("int"), F.substring(month_day, 1, 2).cast("int"), F.substring(month_day, 4, 2).cast("int"))

    def near(guess: Column, n: Column) -> Column:
        year = F.when(_late_before(guess + 1) <= n, guess + 1).when(_late_before(guess) <= n, guess).otherwise(guess - 1)
        return let(of_year, year=year, n=n)

    return let(near, guess=F.floor(n / mean).cast("long") + 1, n=n)


def _moved_day(day: Column, key: str | Column) -> Column:
    """The day that stands for another."""

    def of_class(before, number: Column, make, year: Column) -> Column:
        def of_span(numbers: list[int]) -> Column:
            return F.when(year < YEARS[1], numbers[0]).when(year < YEARS[2], numbers[1]).otherwise(numbers[2]).cast("long")

        first = [before(y) for y in YEARS]
        sides = [_sides(n - m) for m, n in zip(first, first[1:])]

        def run(number: Column, base: Column) -> Column:
            return let(make, n=base + feistel(number - base, of_span([x for x, _ in sides]), of_span([x for _, x in sides]), key, "date"))

        return let(run, number=number.cast("long"), base=of_span(first))

    def run(year: Column, month: Column, day: Column, of_year: Column) -> Column:
        early = of_class(_early_before, _early_before(year) + (month - 1) * EARLY + day - 1, _early_day, year)
        late = of_class(_late_before, _late_before(year) + of_year - EARLY * month - 1, _late_day, year)
        return F.when(day > EARLY, late).otherwise(early)

    return let(run, year=F.year(day), month=F.month(day), day=F.day(day), of_year=F.dayofyear(day))


def _date(value: Column, key: str | Column) -> Column:
    def written(day: Column) -> Column:
        slashed = F.when(F.substring(value, 1, 2) > str(EARLY), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
        return F.when(value.contains("."), F.date_format(day, "dd.MM.yyyy")).when(value.contains("/"), slashed).otherwise(F.date_format(day, "yyyy-MM-dd"))

    return let(written, day=let(lambda day: _moved_day(day, key), day=_day(value)))


def _permuted_block(block: Column, key: str | Column) -> Column:
    """A permutation of the strings of as many lower-case letters and digits (BLOCK at most)."""

    def number(text: Column) -> Column:
        return F.coalesce(F.conv(text, 36, 10).cast("long"), F.lit(0))

    def text(half: Column, width: Column) -> Column:
        return F.when(width > 0, F.lpad(F.lower(F.conv(half.cast("string"), 10, 36)), width, F.lit("0"))).otherwise("")

    def run(block: Column, n: Column, low: Column, a: Column, b: Column) -> Column:
        start = F.struct(number(F.substring(block, F.lit(1), n - low)).alias("l"), number(F.substring(block, n - low + 1, low)).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, _step(a, b, key, "email"), lambda s: F.concat(text(s["l"], n - low), text(s["r"], low)))

    n = F.length(block)
    low = F.ceil(n / 2).cast("int")
    return let(run, block=block, n=n, low=low, a=_power(36, n - low), b=_power(36, low))


def _email(value: Column, key: str | Column) -> Column:
    def run(local: Column, plain: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(plain), F.lit(BLOCK))
        blocks = F.transform(starts, lambda s: _permuted_block(F.substring(plain, s, F.lit(BLOCK)), key))
        return F.concat(_refilled(local, F.array_join(blocks, ""), "[0-9A-Za-z]"), F.lit("@"), F.substring_index(value, "@", -1))

    local = F.substring_index(value, "@", 1)
    return let(run, local=local, plain=F.regexp_replace(F.lower(local), "[^0-9a-z]", ""))


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def kind_of(value: Column) -> Column:
    """The kind of a match, or null where validation fails."""
    digits = _digits(value)
    card = F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0) & (F.substring(digits, 1, 6) != "000000")
    octets = [_octet(value, k).cast("long") <= 255 for k in (1, 2, 3, 4)]
    ssn = ~F.substring(value, 1, 3).isin("000", "666") & (F.substring(value, 1, 1) != "9") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(_whole(value, DATE), F.when(_day(value).isNotNull(), F.lit("date")))
        .when(_whole(value, SSN), F.when(ssn, F.lit("ssn")))
        .when(_whole(value, PHONE), F.lit("phone"))
        .when(_whole(value, CARD), F.when(card, F.lit("card")))
        .when(_whole(value, IPV4), F.when(octets[0] & octets[1] & octets[2] & octets[3], F.lit("ipv4")))
    )


def pseudonym(value: Column, kind: Column, key: str | Column) -> Column:
    return (
        F.when(kind == "email", _email(value, key)).when(kind == "date", _date(value, key)).when(kind == "ssn", _ssn(value, key))
        .when(kind == "phone", _phone(value, key)).when(kind == "card", _card(value, key)).when(kind == "ipv4", _ipv4(value, key))
        .otherwise(value)
    )


def cut(text: Column) -> Column:
    """What lies before the first match, the first match, what lies between, the second match, and so on."""

    def once(pattern: str) -> Column:
        return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    between, values = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    twice = F.flatten(F.zip_with(between, values, lambda b, v: F.array(b, v)))
    return F.when(text.contains(MARK), F.slice(twice, 1, F.size(twice) - 1)).when(text.contains("@"), once(PATTERN)).otherwise(once(NUMBERS))


def findings(docs: DataFrame, key: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text, found (array of kind and pseudonym, in order): the documents in which something was found."""
    text = F.col("original")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("original")).filter(text.rlike("[0-9@]"))
    rows = computed_once(rows, parts=cut(text)).filter(F.size("parts") > 1).select("doc_id", "parts")
    seen = F.transform("parts", lambda p, i: F.struct(p.alias("value"), F.when(i % 2 == 1, kind_of(p)).alias("kind")))
    rows = computed_once(rows, seen=seen).filter(F.exists("seen", lambda s: s["kind"].isNotNull())).select("doc_id", "seen")
    rows = rows.withColumn("key", docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    new = F.transform("seen", lambda s: F.struct(s["kind"].alias("kind"), F.when(s["kind"].isNull(), s["value"]).otherwise(pseudonym(s["value"], s["kind"], F.col("key"))).alias("pseudonym")))
    rows = computed_once(rows, new=new)
    return rows.select("doc_id", F.array_join("new.pseudonym", "").alias("text"), F.filter("new", lambda n: n["kind"].isNotNull()).alias("found"))
