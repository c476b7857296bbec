"""Column functions the operators share; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-9


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def last_n(items: Column, n: int | Column) -> Column:
    """The last n items of an array, all if there are fewer; null stays null."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))


def nonempty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def tokens(packed: Column) -> Column:
    """Space-separated ids; null and empty give an empty array, not one empty id."""
    return nonempty(F.split(F.coalesce(packed, F.lit("")), " "))


def packed_pairs(packed: Column) -> tuple[Column, Column]:
    """Candidates, and those marked 1, of "id-0 id-1 ..."."""
    pairs = tokens(packed)
    ident = lambda p: F.substring_index(p, "-", 1)
    return F.transform(pairs, ident), F.transform(F.filter(pairs, lambda p: F.substring_index(p, "-", -1) == "1"), ident)


def entity_labels(json_text: Column) -> Column:
    """Labels of a JSON array of objects; null, malformed and unlabelled count for nothing."""
    parsed = F.from_json(F.coalesce(json_text, F.lit("[]")), "array<struct<Label:string>>")
    return F.filter(F.coalesce(F.transform(parsed, lambda e: e.Label), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def union_keep_order(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def clock_12h(text: Column) -> Column:
    """Parses "1/31/2024 5:04:03 PM"."""
    return F.to_timestamp_ntz(text, F.lit("M/d/yyyy h:mm:ss a"))


def number_or_zero(x: Column) -> Column:
    """Null and NaN count as 0."""
    return F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is null or empty."""
    known = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(known, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length, EPS added so that zero stays zero; the length is computed once a vector."""
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / (n + F.lit(EPS)))), F.lit(0))


def decay(age_hours: Column, half_life: float | Column = 24.0) -> Column:
    """0.5 ** (age / half-life); unknown age gives 0, negative age counts as 0."""
    half = F.lit(half_life) if isinstance(half_life, float) else half_life
    return F.when(age_hours.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / half))
