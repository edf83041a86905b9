"""What a reader of the results asks for: small filters, roll-ups and orders over result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded, safe_rate
from fieldbook.operators.ranking import clamp


def overview(groups: DataFrame, key: str, geographic: DataFrame, n: str, flagged: str, k: int = 10) -> DataFrame:
    """One row: totals over the geographic groups, the share of flagged rows, and the k largest groups."""
    kept = groups.join(geographic.select(key), key, "left_semi")
    total = kept.agg(F.count("*").alias("n_groups"), F.sum(n).alias("total"), F.sum(flagged).alias("flagged"))
    top = kept.orderBy(F.desc(n), key).limit(k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("o"), F.col(key).alias("g")))), lambda x: x["g"]), "; ").alias("top"))
    return total.withColumn("flag_share", safe_rate("flagged", "total")).crossJoin(top)


def only(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal all the values asked for; None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def with_total(df: DataFrame, order: Sequence[Column | str], limit: object, most: int, default: int = 50) -> DataFrame:
    """The first rows in an order, each with the number of all rows."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*order).limit(clamp(limit, most, default)).crossJoin(F.broadcast(total))


def counted(df: DataFrame, by: str) -> DataFrame:
    """Each row with the number of rows of its kind."""
    return df.join(df.groupBy(by).agg(F.count("*").alias(f"{by}_count")), by)


def ordered_values(column: str, order: Sequence[str]) -> Column:
    """Place of a value in a fixed order, unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(place == 0, len(order) + 1).otherwise(place)


def drilldown(cases: DataFrame, group: str, wanted: str, parent: str, partial_year: int, top: int = 12) -> DataFrame:
    """(section, label, n): a group's (or its parent's) years, months, categories, statuses and units in one table; one scan of the filtered rows."""
    kept = cases.where((F.col(group) == wanted) | (F.col(parent) == wanted))
    label = F.explode(
        F.array(
            F.struct(F.lit("year").alias("section"), F.concat(F.col("year").cast("string"), F.when(F.col("year") == partial_year, " (partial)").otherwise("")).alias("label")),
            F.struct(F.lit("month").alias("section"), F.format_string("%04d-%02d", "year", "month").alias("label")),
            F.struct(F.lit("category").alias("section"), F.col("category").alias("label")),
            F.struct(F.lit("status").alias("section"), F.col("status").alias("label")),
            F.struct(F.lit("unit").alias("section"), F.col("unit_id").cast("string").alias("label")),
        )
    )
    counts = kept.select(label.alias("x")).groupBy("x.section", "x.label").agg(F.count("*").alias("n"))
    order = Window.partitionBy("section").orderBy(F.desc("n"), "label")
    return counts.withColumn("_r", F.row_number().over(order)).where(~F.col("section").isin("category", "unit") | (F.col("_r") <= F.when(F.col("section") == "unit", 10).otherwise(top))).drop("_r")


def group_list(groups: DataFrame, parent: str, people: DataFrame, centre: DataFrame) -> DataFrame:
    """Totals of each parent with its rate for 100,000 people and its centre."""
    j = groups.groupBy(parent).agg(F.sum("n").alias("n")).join(people, parent, "left").join(centre, parent, "left")
    return j.withColumn("rate_100k", safe_rate(F.col("n") * 100_000, "people", 2))


def heat(cells: DataFrame, year: int | None, cap: int) -> DataFrame:
    """Cells of a year, or of all years summed, largest first, at most `cap`; `capped` says whether there were more."""
    from fieldbook.operators.ranking import topn_cap

    got = only(cells, year=year).groupBy("cell_lat", "cell_lon").agg(F.sum("n").alias("n"))
    return topn_cap(got, "n", ["cell_lat", "cell_lon"], cap)


def one_series(table: DataFrame, level: str, key: str | None, category: str | None) -> DataFrame:
    """Exactly one series: the asked one, or the first key and category of the level."""
    own = table.where(F.col("level") == level)
    if key is not None:
        own = own.where(F.col("key") == key)
    if category is not None:
        own = own.where(F.col("category") == category)
    first = own.agg(F.min(F.struct("key", "category")).alias("f")).select("f.*")
    return own.join(F.broadcast(first), ["key", "category"], "left_semi")


def search(nodes: DataFrame, text: str, kind: str | None, sort: str, allowed: Sequence[str], limit: object, offset: int = 0) -> DataFrame:
    """Nodes whose name holds a text, of one type if asked, in a whitelisted order, with the number of hits of each type."""
    from fieldbook.operators.ranking import sort_page

    hits = nodes.where(F.lower("node").contains(text.lower()))
    hits = hits if kind is None else hits.where(F.substring_index("node", ":", 1) == kind)
    typed = counted(hits.withColumn("type", F.substring_index("node", ":", 1)), "type")
    return sort_page(typed, sort, allowed, "node", limit, offset)


def rule_list(rules: DataFrame, kind: str | None, text: str | None, limit: object) -> DataFrame:
    """Rules by lift and then cases, those of a type or that name a text; `rule_type_count` over all that pass."""
    kept = only(rules, rule_type=kind)
    if text:
        kept = kept.where(F.lower("src").contains(text.lower()) | F.lower("dst").contains(text.lower()))
    return counted(kept, "rule_type").orderBy(F.desc("lift"), F.desc("cases"), "src_type", "src", "dst_type", "dst").limit(clamp(limit, 300, 100))


def one_or_parent(table: DataFrame, key: str, wanted: str, parents: Mapping[str, str]) -> DataFrame:
    """Rows of a key; if it is a member of a parent, the parent's."""
    return table.where(F.col(key) == parents.get(wanted, wanted))


def coverage(cases: DataFrame, lat: str, tag: str) -> DataFrame:
    """(measure, value): located share and the share of each tag."""
    n = F.count("*").cast("double")
    one = cases.agg(rounded(F.count(lat) / n).alias("value")).select(F.lit("located").alias("measure"), "value")
    total = cases.agg(F.count("*").alias("_all"))
    mix = cases.groupBy(tag).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(total)).select(F.concat(F.lit("share "), tag).alias("measure"), rounded(F.col("_n").cast("double") / F.col("_all")).alias("value"))
    return one.unionByName(mix)
