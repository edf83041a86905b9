"""Grouped counts, sums and rates; citations; co-occurrence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import parse_citations, rounded, safe_rate
from fieldbook.session import written


def count_by(df: DataFrame, by: Sequence[str], into: str = "n", where: Column | None = None) -> DataFrame:
    """Rows of each group; partial sums are made before the shuffle, so hot groups cost little."""
    kept = df if where is None else df.where(where)
    return kept.groupBy(*by).agg(F.count("*").alias(into))


def grid(df: DataFrame, lat: str, lon: str, by: Sequence[str] = (), places: int = 2, where: Column | None = None) -> DataFrame:
    """Counts of located rows by cell (coordinates rounded) and `by`."""
    kept = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    kept = kept if where is None else kept.where(where)
    return kept.groupBy(rounded(F.col(lat), places).alias("cell_lat"), rounded(F.col(lon), places).alias("cell_lon"), *by).agg(F.count("*").alias("n"))


def unit_summary(df: DataFrame, unit: Sequence[str], lat: str, lon: str) -> DataFrame:
    """Rows, located rows and mean coordinates (6 places) of each unit."""
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    mean = lambda c: rounded(F.avg(F.when(located, F.col(c)).cast("decimal(20,10)")), 6)
    return df.groupBy(*unit).agg(F.count("*").alias("n"), F.count_if(located).alias("n_located"), mean(lat).alias("mean_lat"), mean(lon).alias("mean_lon"))


def funnel(df: DataFrame, by: Sequence[str], measures: Sequence[str], flag: Column, rates: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rows, flagged rows, sums of the measures, and rates of any two of them (name: numerator, denominator)."""
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"), *(F.sum(F.col(m).cast("bigint")).alias(m) for m in measures))
    return got.select("*", *(safe_rate(a, b).alias(name) for name, (a, b) in rates.items()))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, value, n) for several columns in one pass."""
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns)))
    return df.select(pair.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def explode_citations(df: DataFrame, case: str, text: str) -> DataFrame:
    """One row for each (case, act, section): acts numbered by first place, sections within their act. Each row by itself, so nothing is sorted or joined."""
    parsed = df.select(case, parse_citations(text)["pairs"].alias("_p"))
    sections = lambda a: F.array_distinct(F.transform(F.filter("_p", lambda x: x["act"] == a), lambda x: x["section"]))
    acts = F.transform(F.array_distinct(F.transform("_p", lambda x: x["act"])), lambda a: F.struct(a.alias("act"), sections(a).alias("sections")))
    by_act = parsed.select(case, F.posexplode(acts).alias("_a", "_x")).select(case, F.col("_x.act").alias("act"), "_a", F.posexplode("_x.sections").alias("_s", "section"))
    return by_act.select(case, "act", "section", (F.col("_a") + 1).alias("act_order"), (F.col("_s") + 1).alias("section_order"))


def citation_counts(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Cases of each act, and of each (act, section) pair with repeats; equal texts are parsed once, weighted, and both are counted in one pass."""
    weighted = df.groupBy(text).agg(F.count("*").alias("w")).select(parse_citations(text).alias("p"), "w")
    acts = F.transform("p.acts", lambda a: F.struct(a.alias("act"), F.lit(None).cast("string").alias("section")))
    counts = written(weighted.select(F.explode(F.concat(acts, "p.pairs")).alias("x"), "w").groupBy("x.act", "x.section").agg(F.sum("w").alias("n")))
    return counts.where("section is null").select("act", "n"), counts.where("section is not null")


def case_items(df: DataFrame, case: str, item: str) -> DataFrame:
    """(case, items): the distinct items of each case, sorted. A case's items are few; rows are dealt once, by case."""
    return df.select(case, item).where(F.col(item).isNotNull()).groupBy(case).agg(F.sort_array(F.collect_set(item)).alias("items"))


def item_pairs(items: DataFrame, least: int) -> DataFrame:
    """(src, dst, weight): pairs of items in a case, each once in sorted order, in at least `least` cases.

    Equal item lists are counted before pairs are made.
    """
    lists = items.where(F.size("items") > 1).groupBy("items").agg(F.count("*").alias("w"))
    pairs = F.flatten(F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return lists.select(F.explode(pairs).alias("x"), "w").groupBy("x.src", "x.dst").agg(F.sum("w").alias("weight")).where(F.col("weight") >= least)


def typed_edges(left: DataFrame, src: str, src_type: str, dst: str, dst_type: str, least: int = 1) -> DataFrame:
    """(src_type, src, dst_type, dst, weight) of two columns of a table with one row for each case and pair."""
    got = left.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    return got.select(F.lit(src_type).alias("src_type"), "src", F.lit(dst_type).alias("dst_type"), "dst", "weight")


def cooccurrence(cases: DataFrame, items: DataFrame, case: str, category: str, group: str, least_category: int, least_pair: int) -> DataFrame:
    """Edges category-item, item-item and category-group; weights are cases."""
    own = cases.select(case, category, group)
    lists = own.join(items, case).groupBy(category, "items").agg(F.count("*").alias("w"))  # equal lists of a category are counted before they are taken apart
    sums = lists.select(F.col(category).alias("src"), F.explode("items").alias("dst"), "w").groupBy("src", "dst").agg(F.sum("w").alias("weight")).where(F.col("weight") >= least_category)
    one = sums.select(F.lit("category").alias("src_type"), "src", F.lit("item").alias("dst_type"), "dst", "weight")
    two = item_pairs(items, least_pair).select(F.lit("item").alias("src_type"), "src", F.lit("item").alias("dst_type"), "dst", "weight")
    three = typed_edges(own, category, "category", group, "group")
    return one.unionByName(two).unionByName(three)


def multi_item(items: DataFrame) -> DataFrame:
    """Cases, cases with more than one item, and items per case."""
    return items.agg(F.count("*").alias("n_cases"), F.count_if(F.size("items") > 1).alias("n_multi"), rounded(F.avg(F.size("items").cast("decimal(20,4)"))).alias("items_per_case"))


def outcome_rates(df: DataFrame, by: Sequence[str], label: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """Positive, negative and excluded labels of each group; the rate leaves out the excluded."""
    got = df.groupBy(*by).agg(F.count_if(F.col(label).isin(*positive)).alias("n_positive"), F.count_if(F.col(label).isin(*negative)).alias("n_negative"), F.count("*").alias("n"))
    got = got.withColumn("n_excluded", F.col("n") - F.col("n_positive") - F.col("n_negative"))
    return got.withColumn("rate", safe_rate("n_positive", F.col("n_positive") + F.col("n_negative")))


def series_levels(df: DataFrame, period: str, group: str, category: str, top_categories: int, top_in_group: int) -> DataFrame:
    """(level, key, category, period, n): total, by group, by top category, and by group and its top categories, from one count."""
    base = df.groupBy(period, group, category).agg(F.count("*").alias("n"))
    total = base.groupBy(F.lit("total").alias("level"), F.lit("ALL").alias("key"), F.lit("ALL").alias("category"), period).agg(F.sum("n").alias("n"))
    by_group = base.groupBy(F.lit("group").alias("level"), F.col(group).alias("key"), F.lit("ALL").alias("category"), period).agg(F.sum("n").alias("n"))
    top = base.groupBy(category).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), category).limit(top_categories).select(category)
    by_category = base.join(F.broadcast(top), category, "left_semi").groupBy(F.lit("category").alias("level"), F.lit("ALL").alias("key"), F.col(category).alias("category"), period).agg(F.sum("n").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("t"), category)
    own = base.groupBy(group, category).agg(F.sum("n").alias("t")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_in_group).select(group, category)
    both = base.join(own, [group, category], "left_semi").select(F.lit("group_category").alias("level"), F.col(group).alias("key"), F.col(category).alias("category"), period, "n")
    return total.unionByName(by_group).unionByName(by_category).unionByName(both)


def weighted_centroid(df: DataFrame, by: Sequence[str], lat: str, lon: str, weight: str) -> DataFrame:
    """Weighted mean coordinates (6 places) of each group."""
    w, kept = F.col(weight).cast("decimal(18,0)"), df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    mean = lambda c: rounded(F.sum(F.col(c).cast("decimal(20,8)") * w).cast("double") / F.sum(w).cast("double"), 6)
    return kept.groupBy(*by).agg(F.sum(weight).alias("weight"), mean(lat).alias("lat"), mean(lon).alias("lon"))


def entity_profiles(df: DataFrame, entity: str, case: str, group: str, category: str, year: str, least: int = 2) -> DataFrame:
    """Entities with at least `least` cases: cases, groups, `category xN` mix, case list and years.

    Lists are per entity and hold its distinct categories and cases; an entity is meant to be a person-sized thing.
    """
    mix = df.groupBy(entity, category).agg(F.count("*").alias("k")).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.col(category).alias("c")))).alias("m"))
    mix = mix.select(entity, F.array_join(F.transform("m", lambda x: F.concat(x["c"], F.lit(" x"), (-x["o"]).cast("string"))), "; ").alias("mix"))
    base = df.groupBy(entity).agg(F.count("*").alias("n"), F.countDistinct(group).alias("n_groups"), F.array_join(F.transform(F.array_sort(F.collect_set(case)), lambda x: x.cast("string")), ";").alias("case_ids"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return base.where(F.col("n") >= least).join(mix, entity)


def role_pairs(df: DataFrame, case: str, member: str, role: str) -> DataFrame:
    """Typed edges within a case: same-role pairs once each, and pairs across roles."""
    own = df.select(case, member, role).distinct()
    a, b = own.select(case, F.col(member).alias("a"), F.col(role).alias("ra")), own.select(case, F.col(member).alias("b"), F.col(role).alias("rb"))
    joined = a.join(b, case).where(((F.col("ra") == F.col("rb")) & (F.col("a") < F.col("b"))) | (F.col("ra") < F.col("rb")))
    return joined.groupBy("a", "b", F.when(F.col("ra") == F.col("rb"), "same").otherwise("cross").alias("edge")).agg(F.count("*").alias("n"))


def class_shares(df: DataFrame, by: Sequence[str], value: str, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Share of the rows of each group whose value is in each class."""
    return df.groupBy(*by).agg(*(rounded(F.count_if(F.col(value).isin(*members)).cast("double") / F.count("*")).alias(f"share_{name}") for name, members in classes.items()))
