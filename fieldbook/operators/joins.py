"""Lookups, conformed dimensions, tiered resolution, rankings side by side, contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded, safe_rate
from fieldbook.operators.ranking import running_total


def conform_dimension(df: DataFrame, key: str, dim: DataFrame, dim_key: str, attributes: Mapping[str, str]) -> DataFrame:
    """Adds the dimension's attributes by trimmed key, with a default for each where the key is unknown.

    Whether the dimension is broadcast is left to the planner, which knows its size.
    """
    own = dim.select(F.trim(dim_key).alias("_key"), *(F.col(a).alias(f"_{a}") for a in attributes)).dropDuplicates(["_key"])
    joined = df.join(own, F.trim(F.col(key)) == F.col("_key"), "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(f"_{a}"), F.lit(default)).alias(a) for a, default in attributes.items()))


def unmatched_keys(df: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Keys that the dimension lacks, with their rows; keys are counted before they are joined."""
    return df.groupBy(F.trim(F.col(key)).alias(key)).agg(F.count("*").alias("n")).join(dim.select(F.trim(dim_key).alias(key)), key, "left_anti")


def parent_rollup(dim: DataFrame, member: str, parent: str, code: str, counted: Column) -> DataFrame:
    """(parent, members, n_members, code): members sorted, first code in member order; only rows that count."""
    kept = dim.where(counted)
    return kept.groupBy(parent).agg(F.array_join(F.array_sort(F.collect_set(member)), "; ").alias("members"), F.countDistinct(member).alias("n_members"), F.min_by(code, member).alias(code))


def code_override(column: str, overrides: Mapping[str, str]) -> Column:
    """The code with some replaced, such as a child's by that of the parent it folds into."""
    c = F.col(column)
    for old, new in overrides.items():
        c = F.when(F.col(column) == old, new).otherwise(c)
    return c


def token_sort(x: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.upper(F.trim(x)), " +")), " ")


def token_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / longer length) of the token-sorted texts."""
    x, y = token_sort(a), token_sort(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(x, y) / longest))


def crosscheck(dim: DataFrame, key: str, code: str, name: str, references: Mapping[str, DataFrame], cut: float) -> DataFrame:
    """(reference, key, issue) for each reference table (key, code, name): missing key, other code, or a name less alike than `cut`."""
    found = []
    for title, ref in references.items():
        r = ref.select(F.col("key").alias("_k"), F.col("code").alias("_c"), F.col("name").alias("_n"))
        j = dim.join(r, dim[key] == r["_k"], "left")
        issue = F.when(F.col("_k").isNull(), "error: missing").when(F.col(code) != F.col("_c"), "error: code").when(token_ratio(F.col(name), F.col("_n")) < cut, "warn: name")
        found.append(j.select(F.lit(title).alias("reference"), key, issue.alias("issue")).where("issue is not null"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def nearest_candidate(df: DataFrame, key: Sequence[str], lat: str, lon: str, ref_lat: str, ref_lon: str, order: str) -> DataFrame:
    """The candidate of each key with the smallest squared-degree distance to its reference point; without one, the first by `order`."""
    d2 = F.coalesce(F.pow(F.col(lat) - F.col(ref_lat), F.lit(2.0)) + F.pow(F.col(lon) - F.col(ref_lon), F.lit(2.0)), F.lit(0.0))
    return df.groupBy(*key).agg(F.min(F.struct(d2.alias("d"), F.col(order).alias("o"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))).alias("m")).select(*key, F.col("m.o").alias(order), F.col("m.lat").alias(lat), F.col("m.lon").alias(lon))


def fuzzy_best_match(queries: DataFrame, query: str, candidates: DataFrame, candidate: str, block: str, cut: float) -> DataFrame:
    """(query, candidate, score): the most alike candidate in the same block, at least `cut`; ties to the smaller candidate.

    Distinct names meet within their block only, never all with all.
    """
    q, c = queries.select(block, query).distinct(), candidates.select(block, candidate).distinct()
    scored = q.join(c, block).withColumn("score", rounded(token_ratio(F.col(query), F.col(candidate)), 2)).where(F.col("score") >= cut)
    return scored.groupBy(block, query).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(candidate).alias("c"))).alias("m")).select(block, query, F.col("m.c").alias(candidate), (-F.col("m.s")).alias("score"))


def tiered_resolve(df: DataFrame, keys: Sequence[str], own_lat: str, own_lon: str, tiers: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Adds (lat, lon, precision): the row's own point, else the first tier that has one, else nulls and `none`.

    A tier is (tag, table with lat and lon, join columns, a part of `keys`). Distinct keys are resolved once and joined back.
    """
    distinct = df.select(*keys).distinct()
    lat, lon, tag = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("none")
    for i, (name, places, on) in reversed(list(enumerate(tiers))):
        lat, lon = F.coalesce(F.col(f"_lat{i}"), lat), F.coalesce(F.col(f"_lon{i}"), lon)
        tag = F.when(F.col(f"_lat{i}").isNotNull(), name).otherwise(tag)
    for i, (_, places, on) in enumerate(tiers):
        one = places.groupBy(*on).agg(F.min(F.struct("lat", "lon")).alias("_p")).select(*on, F.col("_p.lat").alias(f"_lat{i}"), F.col("_p.lon").alias(f"_lon{i}"))
        distinct = distinct.join(one, list(on), "left")
    resolved = distinct.select(*keys, lat.alias("_lat"), lon.alias("_lon"), tag.alias("_tag"))
    own = F.col(own_lat).isNotNull() & F.col(own_lon).isNotNull()
    joined = df.join(resolved, list(keys), "left")
    return joined.withColumns({"lat": F.when(own, F.col(own_lat)).otherwise(F.col("_lat")), "lon": F.when(own, F.col(own_lon)).otherwise(F.col("_lon")), "precision": F.when(own, "own").otherwise(F.coalesce("_tag", F.lit("none")))}).drop("_lat", "_lon", "_tag")


def per_capita(facts: DataFrame, key: str, n: str, population: DataFrame, people: str, part: str) -> DataFrame:
    """Rate for 100,000, share of a part of the people, and its ratio for 1,000."""
    j = facts.join(population.select(key, people, part), key, "left")
    return j.withColumns({"rate_100k": safe_rate(F.col(n) * 100_000, people, 2), "part_share": safe_rate(part, people), "part_ratio": safe_rate(F.col(part) * 1000, people, 2)})


def anti_split(df: DataFrame, key: str, holdout: DataFrame) -> DataFrame:
    """Rows that aren't held out; that the two share no key follows from the anti join."""
    return df.join(holdout.select(key).distinct(), key, "left_anti")


def align(key: str, **series: DataFrame) -> DataFrame:
    """Several keyed series side by side, incomplete keys dropped. Each has the columns key and value."""
    out = None
    for name, df in series.items():
        own = df.select(key, F.col("value").alias(name))
        out = own if out is None else out.join(own, key)
    return out


def contract_conformance(contract: DataFrame, present: DataFrame) -> DataFrame:
    """(entity, field, status, blocker) of every contract row against (entity, field, n_values) of what is there."""
    p = present.select(F.col("entity").alias("_e"), F.col("field").alias("_f"), "n_values")
    tables = present.select(F.col("entity").alias("_t")).distinct()
    j = contract.join(p, (F.col("entity") == F.col("_e")) & (F.col("field") == F.col("_f")), "left").join(tables, F.col("entity") == F.col("_t"), "left")
    status = F.when(F.col("_t").isNull(), "absent").when(F.col("_f").isNull(), "missing").when(F.col("n_values") == 0, "empty").otherwise("populated")
    blocker = F.when(F.col("_t").isNull(), "no source table").when(F.col("_f").isNull(), "no source column").when(F.col("n_values") == 0, "no values").otherwise("")
    return j.select("entity", "field", status.alias("status"), blocker.alias("blocker"))


def value_counts_of_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, field, n_values): non-null values of every column, one pass over each table."""
    out = None
    for name, df in tables.items():
        counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values")) for c in df.columns)))
        own = counts.select(F.lit(name).alias("entity"), pairs.alias("x")).select("entity", "x.*")
        out = own if out is None else out.unionByName(own)
    return out


def relationship_check(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One row: orphan rows, distinct orphan keys, most children of a key, and parents without any."""
    c = child.groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    p = parent.select(F.col(parent_key).alias("pk")).distinct()
    j = c.join(p, F.col("k") == F.col("pk"), "full")
    orphan = F.col("pk").isNull() & F.col("k").isNotNull()
    return j.agg(F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_rows"), F.count_if(orphan).alias("orphan_keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most_children"), F.count_if(F.col("k").isNull()).alias("childless")).select(F.lit(name).alias("relation"), "*")


def rank_window(df: DataFrame, by: str, into: str) -> DataFrame:
    """Average ranks (1 is the smallest value): equal values are counted first, and a running total over them gives the ranks."""
    sizes = df.groupBy(F.col(by).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = running_total(sizes, ["_v"], "_n", "_before").select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias("_r"))
    return df.join(ranks, F.col(by) == F.col("_v")).withColumn(into, F.col("_r")).drop("_v", "_r")
