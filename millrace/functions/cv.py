"""Entries of a CV out of the text of its sections, as arrays of structs, and the CV as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of entries. An entry runs from a star to the next line that begins with one.
ENTRY = r"(?s)\* (.*?)(?=\n\*|\z)"
DEGREE = r"^([^,]+), ([^,]+), (\d{4})([^\n]*)"
GRADE = r"GPA: ([\d.]+)"
POSITION = r"^([^\n]*?), ([^\n]*?)(?:, |$)"
YEARS = r"(?i)(\d{4})\s*-\s*(\d{4}|present)"
SKILL = r"(?s)(?:^|\n)(\w+.*?):\s*(.*?)(?=\n\w+.*?:|\z)"


def _entries(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTRY), F.lit(1)), F.trim)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def education(text: Column) -> Column:
    """Array of (area, institution, end, grade) of lines "* degree, place, year"; others are left out, an entry without a grade has null."""

    def one(e: Column) -> Column:
        part = lambda k: _stripped(F.regexp_extract(e, DEGREE, k))
        grade = F.regexp_extract(part(4), GRADE, 1)
        return F.struct(part(1).alias("area"), part(2).alias("institution"), part(3).alias("end"), F.when(grade != "", grade).alias("grade"))

    return F.transform(F.filter(F.transform(_entries(text), _stripped), lambda e: e.rlike(DEGREE)), one)


def work(text: Column) -> Column:
    """Array of (position, company, start, end, highlights) of entries "* position, company, ..." and the lines with a dash or star below; without years start and end are empty."""

    def one(e: Column) -> Column:
        first = _stripped(F.split_part(e, F.lit("\n"), F.lit(1)))
        lines = F.transform(F.slice(F.split(e, "\n"), 2, 1 << 20), _stripped)
        points = F.transform(F.filter(lines, lambda x: x.rlike(r"^[*-]")), lambda x: _stripped(F.substring(x, 2, 1 << 20)))
        part = lambda k: _stripped(F.regexp_extract(first, POSITION, k))
        return F.struct(part(1).alias("position"), part(2).alias("company"), F.regexp_extract(e, YEARS, 1).alias("start"), F.regexp_extract(e, YEARS, 2).alias("end"), points.alias("highlights"))

    kept = F.filter(F.transform(_entries(text), _stripped), lambda e: _stripped(F.split_part(e, F.lit("\n"), F.lit(1))).rlike(POSITION))
    return F.transform(kept, one)


def skills(text: Column) -> Column:
    """Array of (name, keywords) of lines "name: keyword, keyword"; keywords may go on over lines."""
    all_ = lambda k: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SKILL), F.lit(k))
    words = lambda s: F.filter(F.transform(F.split(s, r",|\n"), _stripped), lambda w: w != "")
    return F.zip_with(all_(1), all_(2), lambda n, s: F.struct(_stripped(n).alias("name"), words(s).alias("keywords")))


def cv_json(**sections: Column) -> Column:
    """A CV document: its sections by name, dates as ISO text, fields without a value as null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sections.items()]), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"})


def profiles(links: dict[str, tuple[Column, str, bool]]) -> Column:
    """Array of (network, username, url) of the networks that have a non-empty value, in the order given.

    Each network has its value, a start of its address and whether the value is a name there: if so it
    is shown and put behind the start; otherwise it is the address itself.
    """

    def one(network: str, value: Column, start: str, is_name: bool) -> Column:
        filled = F.when(value != "", value)
        shown = (filled, F.concat(F.lit(start), filled)) if is_name else (F.lit(""), filled)
        return F.when(filled.isNotNull(), F.struct(F.lit(network).alias("network"), shown[0].alias("username"), shown[1].alias("url")))

    return F.array_compact(F.array(*[one(n, *rest) for n, rest in links.items()]))


def summary(employer: Column, bio: Column) -> Column:
    """Where somebody works, then what they say of themselves; either may be missing."""
    parts = (F.when(employer != "", F.concat(F.lit("Currently employed at "), employer)), F.when(bio != "", bio))
    return F.concat_ws(". ", *parts)
