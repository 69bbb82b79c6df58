"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trimmed, null as empty."""
    return F.trim(F.coalesce(c, F.lit("")))


def opaque_id(first: Column, last: Column, size: int = 16) -> Column:
    """A stable id of a name that does not show the name."""
    return F.substring(F.sha1(F.concat(F.lower(clean(first)), F.lit("|"), F.lower(clean(last)))), 1, size)


def display_name(first: Column, last: Column) -> Column:
    """First name in title case and the last name's initial with a stop."""
    given = F.initcap(F.array_join(F.filter(F.split(clean(first), r"\s+"), lambda w: w != ""), " "))
    initial = F.when(clean(last) != "", F.concat(F.lit(" "), F.upper(F.substring(clean(last), 1, 1)), F.lit("."))).otherwise("")
    return F.trim(F.concat(given, initial))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_quotes(c: Column) -> Column:
    """Ampersands and both quotes as entities, for attribute values; null gives null."""
    return _replaced(c, [("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;")])


def escape_html(c: Column) -> Column:
    """The five characters that mean something in HTML as entities."""
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def slug(title: Column) -> Column:
    """A title for a URL: no braces or backslashes, blanks as hyphens, no bracketed parts, one pass over double hyphens."""
    bare = F.replace(F.translate(title, "{}\\", ""), F.lit(" "), F.lit("-"))
    return F.replace(F.regexp_replace(bare, r"\[.*\]|[^a-zA-Z0-9_-]", ""), F.lit("--"), F.lit("-"))


def slugify(c: Column) -> Column:
    """Lower case, everything but letters and digits as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def citation(authors: Column, title: Column, venue: Column, year: Column) -> Column:
    """authors (array of struct first, last), quoted title, venue and year in one line."""
    names = F.array_join(F.transform(authors, lambda a: F.concat(F.lit(" "), a["first"], F.lit(" "), a["last"], F.lit(", "))), "")
    return F.concat(names, F.lit('"'), escape_quotes(F.translate(title, "{}\\", "")), F.lit('." '), escape_quotes(venue), F.lit(", "), year, F.lit("."))


def strip_prefix(c: Column, prefix: str) -> Column:
    """c without a literal prefix, case ignored, blanks around it gone; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)^\s*\Q{prefix}\E\s*", ""))


def strip_html(c: Column) -> Column:
    """Without scripts, comments, styles and tags."""
    return F.regexp_replace(c, r"(?is)<script.*?</script>|<!--.*?-->|<style.*?</style>|<[^>]*>", "")


def word_count(c: Column) -> Column:
    """Runs of non-blanks."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def read_time(words: Column, per_minute: int = 160) -> Column:
    """'less than 1', '1', or whole minutes, as text."""
    return F.when(words < 180, "less than 1").when(words < 360, "1").otherwise(F.floor(words / per_minute).cast("string"))


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def with_model_suffix(label: Column, model: Column, known: tuple[str, ...]) -> Column:
    """label with _model appended where it ends in none of the known suffixes."""
    has = F.lit(False)
    for k in known:
        has = has | label.endswith(f"_{k}")
    return F.when(has | model.isNull() | (model == ""), label).otherwise(F.concat(label, F.lit("_"), model))


def marked_authors(authors: Column, own: str) -> Column:
    """Authors split at '; ', one's own (by last name) in strong tags, comma-joined."""
    return F.array_join(F.transform(F.split(authors, "; "), lambda a: F.when(a.contains(own), F.concat(F.lit("<strong>"), a, F.lit("</strong>"))).otherwise(a)), ", ")


def place_line(title: Column, venue: Column, location: Column) -> Column:
    return F.concat(F.trim(title), F.lit("<br />"), F.trim(venue), F.lit("; "), F.trim(location))


def padded_date(name: Column) -> Column:
    """The Y-M-D of a file name, zero-padded; null where there is none."""
    part = lambda n: F.regexp_extract(name, r"(\d{4})-(\d{1,2})-(\d{1,2})", n)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def grouped_number(c: Column, decimals: int = 0) -> Column:
    """With thousands separators and a fixed number of decimals."""
    return F.format_number(F.round(c, decimals), decimals)


def pace(seconds_per_mile: Column) -> Column:
    """m:ss/mi, sixty seconds carried; a dash for nothing or zero."""
    s = F.round(F.pmod(seconds_per_mile, F.lit(60.0))).cast("int")
    minutes = F.floor(seconds_per_mile / 60).cast("int") + F.when(s == 60, 1).otherwise(0)
    shown = F.concat(minutes.cast("string"), F.lit(":"), F.lpad(F.when(s == 60, 0).otherwise(s).cast("string"), 2, "0"), F.lit("/mi"))
    return F.when(F.coalesce(seconds_per_mile, F.lit(0)) == 0, "—").otherwise(shown)


def duration(seconds: Column) -> Column:
    """h:mm, sixty minutes carried."""
    m = F.round(F.pmod(seconds, F.lit(3600)) / 60).cast("int")
    h = F.floor(seconds / 3600).cast("int") + F.when(m == 60, 1).otherwise(0)
    return F.concat(h.cast("string"), F.lit(":"), F.lpad(F.when(m == 60, 0).otherwise(m).cast("string"), 2, "0"))


def level_label(pressure: Column, meters: Column, model: Column, imperial: bool = False) -> Column:
    """Pressure level with its height to two figures (feet) or whole metres."""
    from millrace.functions.numeric import significant

    height = F.concat(significant(meters * 3.28084, 2).cast("long").cast("string"), F.lit("ft")) if imperial else F.concat(F.round(meters).cast("long").cast("string"), F.lit("m"))
    return F.concat(pressure.cast("string"), F.lit("mb (~"), height, F.lit(")<br>("), model, F.lit(")"))
