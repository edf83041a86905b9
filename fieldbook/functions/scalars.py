"""Column functions: cleaning, dates, codes, coordinates, rates and bands. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_cat(x: str | Column) -> Column:
    """Trimmed, runs of white space (any Unicode) as one space, null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " ")), F.lit(""))


def normalize_status(x: str | Column, prefix: str = "transfer", into: str = "Transferred") -> Column:
    """Blank as Unknown; anything that starts with the prefix as one status; the rest cleaned."""
    c = clean_cat(x)
    return F.when(c == "", "Unknown").when(F.lower(c).startswith(prefix), into).otherwise(c)


def normalize_flag(x: str | Column, negative: str, positive: str, negative_into: str, positive_into: str) -> Column:
    """Two values: what starts with `negative`, else what contains `positive`; others cleaned, blanks Unknown."""
    c = clean_cat(x)
    return F.when(F.lower(c).startswith(negative), negative_into).when(F.lower(c).contains(positive), positive_into).when(c == "", "Unknown").otherwise(c)


def to_count(x: str | Column) -> Column:
    """A number of at least 0; what doesn't parse is 0."""
    return F.greatest(F.coalesce(_c(x).try_cast("double"), F.lit(0.0)), F.lit(0.0)).cast("bigint")


def row_total(columns: Sequence[str | Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(_c(x), F.lit(0)) for x in columns))


def date_of(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """A date, null if there is none of that name."""
    text = F.format_string("%04d-%02d-%02d", _c(year).cast("int"), _c(month).cast("int"), _c(day).cast("int"))
    return F.when(_c(year).isNotNull() & _c(month).isNotNull() & _c(day).isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def day_of_week(date: str | Column) -> Column:
    """Monday is 0; -1 without a date."""
    return F.coalesce(F.weekday(_c(date)), F.lit(-1))


#: Months of the four seasons, in order.
SEASONS = (("Winter", (12, 1, 2)), ("Summer", (3, 4, 5)), ("Monsoon", (6, 7, 8, 9)), ("Post-Monsoon", (10, 11)))


def season(month: str | Column) -> Column:
    found = F.lit(None).cast("string")
    for name, months in reversed(SEASONS):
        found = F.when(_c(month).isin(*months), name).otherwise(found)
    return F.coalesce(found, F.lit("Unknown"))


def partial_flag(year: str | Column, partial_year: int) -> Column:
    return F.coalesce((_c(year) == partial_year).cast("int"), F.lit(0))


def first_match(x: str | Column, rules: Sequence[tuple[str, str, str]], default: tuple[str, str]) -> Column:
    """struct(bucket, method) of the first rule (keyword, bucket, method) whose keyword the text holds."""
    text = F.lower(F.coalesce(_c(x), F.lit("")))
    pair = lambda b, m: F.struct(F.lit(b).alias("bucket"), F.lit(m).alias("method"))
    found = pair(*default)
    for keyword, bucket, method in reversed(rules):
        found = F.when(text.contains(keyword.lower()), pair(bucket, method)).otherwise(found)
    return found


def observed_bucket(x: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Bucket of the first keyword that records an observation, else null."""
    text = F.lower(F.coalesce(_c(x), F.lit("")))
    found = F.lit(None).cast("string")
    for keyword, bucket in reversed(rules):
        found = F.when(text.contains(keyword.lower()), bucket).otherwise(found)
    return found


#: A segment's list of sections: numbers with a letter or a part in brackets, and commas and blanks after each.
_SECTIONS = r"(?U)^\s*(?:\d+[A-Za-z]?(?:\([^)]*\))?[,\s]*)++"


def parse_citations(x: str | Column) -> Column:
    """struct(acts, pairs, first_act, first_section) of `<ACT> U/s: s1,s2 <ACT2> U/s: s3`.

    Every segment after a delimiter starts with a list of sections, parted by commas or blanks; what follows the list names the next act,
    but for the last segment, whose rest names none. Acts lose commas at their end. Act i goes with segment i + 1, before repeats are
    dropped from acts; surplus segments go with the last act, and with an empty one if there is none; a middle segment without a name
    adds no act and so shifts the pairs after it. A text without delimiter is one act, as it stands, without sections. Nulls and blanks
    have neither; first_act and first_section are empty texts where there is none.
    """
    named = lambda part: F.rtrim(clean_cat(part), F.lit(","))

    def segment(part: Column) -> Column:
        return _let(F.regexp_extract(part, _SECTIONS, 0), lambda head: F.struct(F.filter(F.split(head, r"[,\s]+"), lambda s: s != "").alias("sections"), named(F.substring(part, F.length(head) + 1, F.length(part))).alias("act")))

    def from_parts(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), segment)
        return F.when(F.size(parts) == 1, whole(F.filter(parts, lambda a: a != ""), F.array().cast("array<struct<act:string,section:string>>"))).otherwise(_let(rest, lambda r: with_segments(named(F.element_at(parts, 1)), r)))

    def with_segments(first: Column, rest: Column) -> Column:
        names = F.transform(F.slice(rest, 1, F.size(rest) - 1), lambda r: r["act"])
        return _let(F.filter(F.concat(F.array(first), names), lambda a: a != ""), lambda acts: whole(acts, pairs_of(acts, rest)))

    def pairs_of(acts: Column, rest: Column) -> Column:
        act_of = lambda i: F.when(F.size(acts) > 0, F.element_at(acts, F.least(i + 1, F.size(acts)))).otherwise("")
        return F.flatten(F.transform(rest, lambda r, i: F.transform(r["sections"], lambda s: F.struct(act_of(i).alias("act"), s.alias("section")))))

    def whole(acts: Column, pairs: Column) -> Column:
        first = lambda a: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))
        return _let(pairs, lambda p: F.struct(F.array_distinct(acts).alias("acts"), p.alias("pairs"), first(acts).alias("first_act"), first(F.transform(p, lambda y: y["section"])).alias("first_section")))

    return _let(F.split(clean_cat(x), r"(?U)U/[sS]\s*:"), from_parts)


def extract_suffix_code(x: str | Column) -> Column:
    """struct(name, code): a trailing (XX), upper case without dots and spaces, and what is before it."""
    c = clean_cat(x)
    code = F.upper(F.translate(F.regexp_extract(c, r"\(([^)]+)\)\s*$", 1), ". ", ""))
    return F.struct(F.trim(F.regexp_replace(c, r"\(([^)]+)\)\s*$", "")).alias("name"), code.alias("code"))


#: Latin letters with marks, and the letters without.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def norm_name(x: str | Column, suffixes: Sequence[str] = ()) -> Column:
    """Upper case ASCII letters and digits with single spaces; trailing or inner suffix words go."""
    c = F.upper(F.translate(F.coalesce(_c(x), F.lit("")), ACCENTED, PLAIN))
    c = F.regexp_replace(c, "[^A-Z0-9]+", " ")
    if suffixes:
        c = F.regexp_replace(c, r"\b(?:" + "|".join(suffixes) + r")\b", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def valid_coord(lat: str | Column, lon: str | Column, box: tuple[float, float, float, float]) -> Column:
    """struct(lat, lon) inside the box (south, north, west, east), unswapped if that helps; nulls otherwise. (0, 0) is none."""
    a, b = _c(lat).try_cast("double"), _c(lon).try_cast("double")
    south, north, west, east = box
    inside = lambda y, x: y.between(south, north) & x.between(west, east)
    known = ~((a == 0) & (b == 0))
    pair = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    none = F.lit(None).cast("double")
    return F.when(known & inside(a, b), pair(a, b)).when(known & inside(b, a), pair(b, a)).otherwise(pair(none, none))


def rounded(x: Column, places: int = 4) -> Column:
    """Half up, by way of a decimal, so that engines agree."""
    return F.round(x.cast("decimal(38,10)"), places).cast("double")


def safe_rate(a: str | Column, b: str | Column, places: int = 4) -> Column:
    """a / b, 0 if b is 0."""
    return F.coalesce(rounded(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), places), F.lit(0.0))


def haversine(lat1: str | Column, lon1: str | Column, lat2: str | Column, lon2: str | Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def salted_token(x: str | Column, salt: str, prefix: str = "PT-", digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), _c(x)), 256), 1, digits))


def log_intensity(x: str | Column, top: str | Column, floor: float = 0.03) -> Column:
    """log1p of a value by log1p of the largest, at least `floor`."""
    return F.greatest(F.lit(floor), F.coalesce(F.try_divide(F.log1p(_c(x).cast("double")), F.log1p(_c(top).cast("double"))), F.lit(0.0)))


def sentence(template: str, *columns: str | Column) -> Column:
    return F.format_string(template, *(_c(x) for x in columns))
