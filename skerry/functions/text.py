"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, and what ends a line.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def filled(text: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text)


def optional_id(text: Column) -> Column:
    return F.nullif(without_prefix(strip(text), "PMC"), F.lit(""))


def author_name(surname: Column, given: Column) -> Column:
    """"Surname, Given", or whichever is there."""
    return F.concat_ws(", ", filled(surname), filled(given))


def abstract_text(sections: Column) -> Column:
    return strip(F.array_join(F.transform(sections, lambda s: s["text"]), "\n"))


def question_lines(text: Column, k: int) -> Column:
    """The first ``k`` lines that are left after numbering is taken off."""
    lines = F.transform(F.split(text, LINE_BREAK), lambda x: strip(F.regexp_replace(strip(x), r"^[0-9.) -]+", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, k)


def enriched_text(content: Column, questions: Column) -> Column:
    return F.when(F.size(questions) <= 0, content).otherwise(F.concat_ws("\n", content, F.array_join(questions, "\n")))


def first_question(text: Column) -> Column:
    """The first line with text, without quotes around it."""
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")
    return F.coalesce(F.regexp_replace(F.get(lines, F.lit(0)), r'^"+|"+$', ""), F.lit(""))


def normalised_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(strip(title)), r"^\d+(\.\d+)*\.?\s*", "")


def rendered(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced; ``{{`` and ``}}`` are braces."""
    parts, rest = [], template
    while rest:
        cut = min((rest.find(c) for c in "{}" if c in rest), default=-1)
        if cut < 0:
            parts.append(F.lit(rest))
            break
        parts.append(F.lit(rest[:cut]))
        if rest[cut : cut + 2] in ("{{", "}}"):
            parts.append(F.lit(rest[cut]))
            rest = rest[cut + 2 :]
            continue
        end = rest.index("}", cut)
        parts.append(values[rest[cut + 1 : end]])
        rest = rest[end + 1 :]
    return F.concat(*parts) if parts else F.lit("")


def length_ratio(rewritten: Column, original: Column) -> Column:
    return F.length(rewritten) / F.greatest(F.length(original), F.lit(1))


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 9562 version 5: SHA-1 of the namespace and the name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    nibble = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(nibble, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts with a zero character between them."""
    zero = F.unhex(F.lit("00"))
    joined = [F.encode(p, "UTF-8") for p in parts]
    return F.sha2(F.concat(*[x for p in joined for x in (zero, p)][1:]), 256)


def partial_date(year: Column, month: Column, day: Column, free: Column) -> Column:
    """A date from what a citation gives.

    Free text counts first: its first word is a year, or there is no date.  A month may be a number
    or an English name; a month or day that makes no sense is 1, a day that the month lacks makes
    it the first of January.
    """
    names = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    table = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n[:3], i + 1)], *[F.lit(x) for i, n in enumerate(names) if len(n) > 3 for x in (n, i + 1)])

    def number(text: Column) -> Column:
        return F.when(strip(text).rlike(r"^[0-9]{1,9}$"), strip(text).try_cast("int"))

    def day_of(y: Column, m: Column, d: Column) -> Column:
        text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return F.when(y.between(1, 9999), F.try_to_date(text, "yyyy-MM-dd"))

    one = F.lit(1)
    m = F.coalesce(number(month), F.try_element_at(table, F.lower(strip(month))), one)
    m = F.when(m.between(1, 12), m).otherwise(one)
    d = F.coalesce(number(day), one)
    d = F.when(d.between(1, 31), d).otherwise(one)
    y = number(year)
    first = number(F.get(F.split(strip(free), r"[\s-]+"), F.lit(0)))
    plain = F.coalesce(day_of(y, m, d), day_of(y, one, one))
    return F.when(filled(free).isNotNull(), day_of(first, one, one)).otherwise(plain)
