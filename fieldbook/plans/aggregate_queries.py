"""Queries of the aggregates, rankings and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import scalars as S
from fieldbook.operators import aggregates as A
from fieldbook.operators import ranking as R
from fieldbook.plans.bindings import CASES, LINES, cases, lines
from fieldbook.plans.registry import query, rounded_sql
from fieldbook.plans.scalar_queries import CITED, RULES, _rules_sql, citation_texts
from fieldbook.session import table


@query(f"WITH {CASES} SELECT grp, year, month, category, count(*) AS n FROM cases GROUP BY ALL")
def agg_group_month(spark, d):
    return A.count_by(cases(spark, d), ["grp", "year", "month", "category"])


@query(f"WITH {CASES} SELECT {rounded_sql('lat', 2)} AS cell_lat, {rounded_sql('lon', 2)} AS cell_lon, segment, year, count(*) AS n FROM cases WHERE lat IS NOT NULL GROUP BY ALL")
def agg_grid(spark, d):
    return A.grid(cases(spark, d), "lat", "lon", ["segment", "year"])


TIMED = (("1-", "first"), ("2-", "second"), ("5-", "last"))
TIMED_SQL = "CASE WHEN contains(category, '1-') THEN 'first' WHEN contains(category, '2-') THEN 'second' WHEN contains(category, '5-') THEN 'last' END"


@query(f"WITH {CASES}, b AS (SELECT *, {TIMED_SQL} AS bucket FROM cases) SELECT {rounded_sql('lat', 2)} AS cell_lat, {rounded_sql('lon', 2)} AS cell_lon, bucket, status, year, count(*) AS n FROM b WHERE lat IS NOT NULL AND bucket IS NOT NULL AND segment <> 'MACHINERY' GROUP BY ALL")
def agg_grid_timed(spark, d):
    c = cases(spark, d).where("segment <> 'MACHINERY'").withColumn("bucket", S.observed_bucket("category", TIMED))
    return A.grid(c, "lat", "lon", ["bucket", "status", "year"], where=F.col("bucket").isNotNull())


@query(f"WITH {CASES} SELECT unit_id, grp, count(*) AS n, count(lat) AS n_located, {rounded_sql('avg(CAST(lat AS DECIMAL(20,10)))', 6)} AS mean_lat, {rounded_sql('avg(CAST(lon AS DECIMAL(20,10)))', 6)} AS mean_lon FROM cases GROUP BY ALL")
def agg_unit(spark, d):
    return A.unit_summary(cases(spark, d), ["unit_id", "grp"], "lat", "lon")


FUNNEL = {"reported_rate": ("shipped", "ordered"), "returned_rate": ("returned", "shipped"), "kept_rate": ("kept", "returned"), "final_rate": ("final", "ordered")}


def _funnel_lines(spark, d):
    q = F.col("quantity")
    return lines(spark, d).select("kind", q.alias("ordered"), F.when(F.col("state") == "F", q).otherwise(0).alias("shipped"), F.when(F.col("flag") == "R", q).otherwise(0).alias("returned"), F.when(F.col("flag") == "A", q).otherwise(0).alias("kept"), F.when((F.col("state") == "F") & (F.col("flag") == "N"), q).otherwise(0).alias("final"))


@query(f"""WITH {LINES}, s AS (SELECT kind, count(*) AS n, count(*) FILTER (flag_r > 0) AS n_flagged, CAST(sum(quantity) AS BIGINT) AS ordered, CAST(sum(CASE WHEN state = 'F' THEN quantity ELSE 0 END) AS BIGINT) AS shipped,
  CAST(sum(flag_r) AS BIGINT) AS returned, CAST(sum(CASE WHEN flag = 'A' THEN quantity ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN state = 'F' AND flag = 'N' THEN quantity ELSE 0 END) AS BIGINT) AS final
  FROM (SELECT *, CASE WHEN flag = 'R' THEN quantity ELSE 0 END AS flag_r FROM lines) GROUP BY kind)
SELECT *, coalesce({rounded_sql('CAST(shipped AS DOUBLE) / nullif(ordered, 0)')}, 0) AS reported_rate, coalesce({rounded_sql('CAST(returned AS DOUBLE) / nullif(shipped, 0)')}, 0) AS returned_rate,
  coalesce({rounded_sql('CAST(kept AS DOUBLE) / nullif(returned, 0)')}, 0) AS kept_rate, coalesce({rounded_sql('CAST(final AS DOUBLE) / nullif(ordered, 0)')}, 0) AS final_rate FROM s""")
def agg_outcomes(spark, d):
    return A.funnel(_funnel_lines(spark, d), ["kind"], ["ordered", "shipped", "returned", "kept", "final"], F.col("returned") > 0, FUNNEL)


@query(f"WITH {CASES} SELECT grp, status, count(*) AS n FROM cases GROUP BY ALL")
def agg_status(spark, d):
    return A.count_by(cases(spark, d), ["grp", "status"])


@query(f"SELECT p_type, {_rules_sql('p_name', 1, repr('other'))} AS bucket, {_rules_sql('p_name', 2, repr('none'))} AS method, count(*) AS n FROM part GROUP BY ALL")
def agg_modeled_bucket(spark, d):
    p = table(spark, d, "part").select("p_type", S.first_match("p_name", RULES, ("other", "none")).alias("m")).select("p_type", "m.*")
    return A.count_by(p, ["p_type", "bucket", "method"])


@query(f"WITH {CASES} SELECT CAST(isodow(day) - 1 AS INT) AS dow, month, grp, count(*) AS n FROM cases WHERE day IS NOT NULL GROUP BY ALL")
def agg_temporal(spark, d):
    return A.count_by(cases(spark, d).withColumn("dow", S.day_of_week("day")), ["dow", "month", "grp"], where=F.col("day").isNotNull())


CODE_SQL = "CASE WHEN unit_id % 7 = 0 THEN '' ELSE 'C' || lpad(CAST(unit_id % 7 AS VARCHAR), 2, '0') END"


@query(f"WITH {CASES}, c AS (SELECT {CODE_SQL} AS code FROM cases) SELECT code, count(*) AS n FROM c WHERE code <> '' GROUP BY code")
def agg_by_code(spark, d):
    code = F.when(F.col("unit_id") % 7 == 0, "").otherwise(F.format_string("C%02d", F.col("unit_id") % 7))
    return A.count_by(cases(spark, d).withColumn("code", code), ["code"], where=F.col("code") != "")


@query(f"WITH {CASES} SELECT 'category' AS dimension, category AS value, count(*) AS n FROM cases GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM cases GROUP BY ALL UNION ALL SELECT 'segment', segment, count(*) FROM cases GROUP BY ALL UNION ALL SELECT 'grp', grp, count(*) FROM cases GROUP BY ALL")
def dim_counts(spark, d):
    return A.value_counts(cases(spark, d), ["category", "status", "segment", "grp"])


@query("SELECT code, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'PI' WHEN s_suppkey % 3 = 1 THEN 'ASI' ELSE '' END AS code FROM supplier) WHERE code <> '' GROUP BY code")
def dim_suffix_code(spark, d):
    raw = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, "   (p.I)").when(F.col("s_suppkey") % 3 == 1, " (A S I) ").otherwise(""))
    return A.count_by(table(spark, d, "supplier").select(S.extract_suffix_code(raw)["code"].alias("code")), ["code"], where=F.col("code") != "")


@query(f"""WITH {CITED} SELECT 'act' AS level, act, '' AS section, count(*) AS n FROM (SELECT unnest(acts) AS act FROM cited) GROUP BY act
UNION ALL SELECT 'section', act, CAST(size AS VARCHAR), count(*) FROM pairs GROUP BY act, size""")
def dim_citations(spark, d):
    acts, pairs = A.citation_counts(citation_texts(spark, d), "citation")
    return acts.select(F.lit("act").alias("level"), "act", F.lit("").alias("section"), "n").unionByName(pairs.select(F.lit("section").alias("level"), "act", "section", "n"))


ITEMS = "distinct_items AS (SELECT DISTINCT case_id, item FROM lines)"
EDGES = f"""{CASES}, {LINES}, {ITEMS}, edges AS (
  SELECT 'category' AS src_type, category AS src, 'item' AS dst_type, item AS dst, count(*) AS weight FROM cases JOIN distinct_items USING (case_id) GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT 'item', a.item, 'item', b.item, count(*) FROM distinct_items a JOIN distinct_items b ON a.case_id = b.case_id AND a.item < b.item GROUP BY ALL HAVING count(*) >= 300
  UNION ALL SELECT 'category', category, 'group', grp, count(*) FROM cases GROUP BY ALL)"""


def edges(spark, d):
    return A.cooccurrence(cases(spark, d), A.case_items(lines(spark, d), "case_id", "item"), "case_id", "category", "grp", 10, 300)


@query(f"WITH {EDGES} SELECT * FROM edges")
def cooccur_edges(spark, d):
    return edges(spark, d)


@query(f"WITH {LINES}, {ITEMS}, c AS (SELECT case_id, count(*) AS k FROM distinct_items GROUP BY case_id) SELECT count(*) AS n_cases, count(*) FILTER (k > 1) AS n_multi, {rounded_sql('avg(k)')} AS items_per_case FROM c")
def multi_item_cases(spark, d):
    return A.multi_item(A.case_items(lines(spark, d), "case_id", "item"))


@query(f"""WITH {CASES}, g AS (SELECT grp, count(*) FILTER (status = 'F') AS n_positive, count(*) FILTER (status = 'O') AS n_negative, count(*) AS n FROM cases GROUP BY grp)
SELECT *, n - n_positive - n_negative AS n_excluded, coalesce({rounded_sql('CAST(n_positive AS DOUBLE) / nullif(n_positive + n_negative, 0)')}, 0) AS rate FROM g""")
def outcomes_by_group(spark, d):
    return A.outcome_rates(cases(spark, d), ["grp"], "status", ["F"], ["O"])


SERIES = f"""{CASES}, base AS (SELECT CAST(year * 12 + month - 1 AS INT) AS t, grp, category, count(*) AS n FROM cases GROUP BY ALL),
topc AS (SELECT category FROM base GROUP BY category ORDER BY sum(n) DESC, category LIMIT 3),
own AS (SELECT grp, category FROM (SELECT grp, category, row_number() OVER (PARTITION BY grp ORDER BY sum(n) DESC, category) AS r FROM base GROUP BY grp, category) WHERE r <= 2),
series AS (SELECT 'total' AS level, 'ALL' AS key, 'ALL' AS category, t, CAST(sum(n) AS BIGINT) AS n FROM base GROUP BY ALL
  UNION ALL SELECT 'group', grp, 'ALL', t, CAST(sum(n) AS BIGINT) FROM base GROUP BY ALL
  UNION ALL SELECT 'category', 'ALL', category, t, CAST(sum(n) AS BIGINT) FROM base WHERE category IN (SELECT category FROM topc) GROUP BY ALL
  UNION ALL SELECT 'group_category', base.grp, base.category, t, n FROM base JOIN own ON base.grp = own.grp AND base.category = own.category)"""


def series(spark, d):
    return A.series_levels(cases(spark, d).withColumn("t", F.col("year") * 12 + F.col("month") - 1), "t", "grp", "category", 3, 2)


@query(f"WITH {SERIES} SELECT * FROM series")
def series_levels(spark, d):
    return series(spark, d)


@query(f"""WITH {CASES}, u AS (SELECT unit_id, parent, lat, lon, count(*) AS k FROM cases GROUP BY ALL)
SELECT parent, CAST(sum(k) AS BIGINT) AS weight, {rounded_sql('CAST(sum(CAST(lat AS DECIMAL(20,8)) * k) AS DOUBLE) / CAST(sum(k) AS DOUBLE)', 6)} AS lat, {rounded_sql('CAST(sum(CAST(lon AS DECIMAL(20,8)) * k) AS DOUBLE) / CAST(sum(k) AS DOUBLE)', 6)} AS lon FROM u WHERE lat IS NOT NULL GROUP BY parent""")
def weighted_centroid(spark, d):
    u = A.count_by(cases(spark, d), ["unit_id", "parent", "lat", "lon"], "k")
    return A.weighted_centroid(u, ["parent"], "lat", "lon", "k")


@query(f"""WITH {CASES}, m AS (SELECT unit_id, category, count(*) AS k FROM cases GROUP BY ALL), x AS (SELECT unit_id, string_agg(category || ' x' || k, '; ' ORDER BY k DESC, category) AS mix FROM m GROUP BY unit_id)
SELECT unit_id, count(*) AS n, count(DISTINCT status) AS n_groups, string_agg(CAST(case_id AS VARCHAR), ';' ORDER BY case_id) AS case_ids, min(year) AS first_year, max(year) AS last_year, any_value(mix) AS mix FROM cases JOIN x USING (unit_id) GROUP BY unit_id HAVING count(*) >= 2""")
def group_profile(spark, d):
    return A.entity_profiles(cases(spark, d), "unit_id", "case_id", "status", "category", "year")


@query(f"""WITH {LINES}, o AS (SELECT DISTINCT case_id, item, flag FROM lines) SELECT a.item AS a, b.item AS b, CASE WHEN a.flag = b.flag THEN 'same' ELSE 'cross' END AS edge, count(*) AS n
FROM o a JOIN o b ON a.case_id = b.case_id AND ((a.flag = b.flag AND a.item < b.item) OR a.flag < b.flag) GROUP BY ALL""")
def group_self_pairs(spark, d):
    return A.role_pairs(lines(spark, d), "case_id", "item", "flag")


CLASSES = {"high": ("1-URGENT", "2-HIGH"), "low": ("5-LOW",)}


@query(f"""WITH {CASES} SELECT grp, year, {rounded_sql("CAST(count(*) FILTER (category IN ('1-URGENT', '2-HIGH')) AS DOUBLE) / count(*)")} AS share_high, {rounded_sql("CAST(count(*) FILTER (category = '5-LOW') AS DOUBLE) / count(*)")} AS share_low FROM cases GROUP BY ALL""")
def share_by_class(spark, d):
    return A.class_shares(cases(spark, d), ["grp", "year"], "category", CLASSES)


# Rankings


@query(f"WITH {CASES}, g AS (SELECT grp, category, CAST(count(*) AS BIGINT) AS total FROM cases GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY total DESC, category) AS INT) AS rank FROM g) WHERE rank <= 3")
def topk_per_group(spark, d):
    return R.topk_per_group(cases(spark, d).withColumn("one", F.lit(1)), ["grp"], "category", "one", 3)


@query(f"WITH {CASES}, g AS (SELECT grp, category, CAST(count(*) AS BIGINT) AS total FROM cases GROUP BY ALL) SELECT grp, category, total FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY total DESC, category) AS r FROM g) WHERE r = 1")
def argmax_per_group(spark, d):
    return R.argmax_per_group(cases(spark, d).withColumn("one", F.lit(1)), ["grp"], "category", "one")


@query(f"""WITH {CASES}, g AS (SELECT grp, category, count(*) AS n FROM cases WHERE category NOT IN ('3-MEDIUM', '1-URGENT') GROUP BY ALL), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, category) AS r FROM g) WHERE r = 1)
SELECT a.grp, coalesce(m.category, 'n/a') AS category, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT grp FROM cases) a LEFT JOIN m ON a.grp = m.grp""")
def mode_with_exclusions(spark, d):
    return R.mode_per_group(cases(spark, d), ["grp"], "category", ["3-MEDIUM", "1-URGENT"], "n/a")


@query(f"""WITH {CASES}, g AS (SELECT {rounded_sql('lat', 1)} AS cell_lat, {rounded_sql('lon', 1)} AS cell_lon, segment, count(*) AS n FROM cases WHERE lat IS NOT NULL GROUP BY ALL)
SELECT cell_lat, cell_lon, segment, n FROM (SELECT *, row_number() OVER (PARTITION BY cell_lat, cell_lon ORDER BY n DESC, segment) AS r FROM g) WHERE r = 1""")
def dominant_tag(spark, d):
    c = cases(spark, d).where("lat is not null").select(S.rounded(F.col("lat"), 1).alias("cell_lat"), S.rounded(F.col("lon"), 1).alias("cell_lon"), "segment")
    return R.mode_per_group(c, ["cell_lat", "cell_lon"], "segment")


MONTHLY = f"""{CASES}, gm AS (SELECT grp, year, month, count(*) AS n FROM cases WHERE year <= 2000 GROUP BY ALL),
sx AS (SELECT *, avg(n) OVER w AS expected, coalesce(stddev_samp(n) OVER w, 0) AS std FROM gm WINDOW w AS (PARTITION BY grp, month))"""


@query(f"WITH {MONTHLY} SELECT grp, year, month, n, {rounded_sql('expected')} AS expected, {rounded_sql('n - expected')} AS residual, {rounded_sql('(n - expected) / (std + 1e-6)')} AS z, {rounded_sql('ln((n + 1) / (expected + 1))')} AS log_ratio FROM sx")
def seasonal_expectation(spark, d):
    from fieldbook.operators.timeseries import seasonal_expectation as op

    got = op(A.count_by(cases(spark, d).where("year <= 2000"), ["grp", "year", "month"]), ["grp"], "month", "n")
    return got.select("grp", "year", "month", "n", *(S.rounded(F.col(c)).alias(c) for c in ("expected", "residual", "z", "log_ratio")))


@query(f"""WITH {CASES}, y AS (SELECT grp, year, count(*) AS n FROM cases WHERE year <= 2000 GROUP BY ALL), q AS (SELECT quantile_cont(n, [0.35, 0.6, 0.8]) AS e FROM y)
SELECT grp, year, n, CASE WHEN n <= e[1] THEN 'Low' WHEN n <= e[2] THEN 'Moderate' WHEN n <= e[3] THEN 'High' ELSE 'Critical' END AS tier FROM y, q""")
def quantile_tier(spark, d):
    y = A.count_by(cases(spark, d).where("year <= 2000"), ["grp", "year"])
    return R.tiers(y, "n", [0.35, 0.6, 0.8], ["Low", "Moderate", "High", "Critical"], "tier")


@query(f"WITH {CASES}, g AS (SELECT grp, count(*) AS n FROM cases GROUP BY grp), e AS (SELECT ln(1 + min(n)) AS lo, ln(1 + max(n)) AS hi FROM g) SELECT grp, n, {rounded_sql('8 + 92 * (ln(1 + n) - lo) / (hi - lo)')} AS score FROM g, e")
def log_index(spark, d):
    got = R.log_index(A.count_by(cases(spark, d), ["grp"]), "n", "score")
    return got.select("grp", "n", S.rounded(F.col("score")).alias("score"))


@query(f"WITH {CASES}, g AS (SELECT grp, count(*) AS n FROM cases GROUP BY grp) SELECT grp, rank FROM (SELECT grp, row_number() OVER (ORDER BY n DESC, grp) AS rank FROM g) WHERE grp = 'NATION_8' OR grp = (SELECT max(grp) FROM g)")
def rank_of_entity(spark, d):
    g = A.count_by(cases(spark, d), ["grp"])
    last = g.agg(F.max("grp")).first()[0]
    names = [n for n in dict.fromkeys(("NATION_8", last)) if n is not None]
    found = [R.rank_of(g, "grp", "n", n).join(g.select("grp"), "grp", "left_semi") for n in names]
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 20")
def sort_page(spark, d):
    return R.sort_page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_totalprice"], "o_orderkey", "100000", 20)


@query(f"WITH {CASES}, g AS (SELECT unit_id, count(*) AS n FROM cases GROUP BY unit_id) SELECT unit_id, n, (SELECT count(*) > 250 FROM g) AS capped FROM g ORDER BY n DESC, unit_id LIMIT 250")
def topn_cap(spark, d):
    return R.topn_cap(A.count_by(cases(spark, d), ["unit_id"]), "n", ["unit_id"], 250)


@query(f"""WITH {CASES}, a AS (SELECT grp FROM cases WHERE year = 1999 GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 5), b AS (SELECT grp FROM cases WHERE year = 2000 GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 5)
SELECT count(*) AS shared FROM a JOIN b USING (grp)""")
def topk_overlap(spark, d):
    c = cases(spark, d)
    return R.topk_overlap(A.count_by(c.where("year = 1999"), ["grp"]), A.count_by(c.where("year = 2000"), ["grp"]), "grp", "n")


PEAK = f"""{CASES}, g AS (SELECT CAST(isodow(day) - 1 AS INT) AS dow, month, count(*) AS k FROM cases GROUP BY ALL),
f AS (SELECT CAST(d AS INT) AS dow, CAST(m AS INT) AS month, coalesce(k, 0) AS n FROM range(7) a(d) CROSS JOIN range(1, 13) b(m) LEFT JOIN g ON g.dow = d AND g.month = m),
p AS (SELECT dow AS peak_dow, month AS peak_month, n AS peak_n FROM f ORDER BY n DESC, dow, month LIMIT 1),
r AS (SELECT dow AS top_dow FROM f GROUP BY dow ORDER BY sum(n) DESC, dow LIMIT 1), c AS (SELECT month AS top_month FROM f GROUP BY month ORDER BY sum(n) DESC, month LIMIT 1)"""


@query(f"WITH {PEAK} SELECT f.dow, f.month, f.n, p.*, r.*, c.* FROM f, p, r, c")
def peak_cell(spark, d):
    c = A.count_by(cases(spark, d).withColumn("dow", S.day_of_week("day")), ["dow", "month"], "k")
    return R.grid_peak(c, "dow", 7, "month", 12, "k")


# Sets and samples


@query("SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def union_all(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key")))


@query(f"WITH {LINES}, p AS (SELECT DISTINCT case_id, item FROM lines WHERE flag = 'R'), q AS (SELECT DISTINCT case_id, item FROM lines WHERE flag = 'N') SELECT case_id, item FROM p INTERSECT SELECT case_id, item FROM q")
def pair_intersect(spark, d):
    own = lines(spark, d)
    return own.where("flag = 'R'").select("case_id", "item").intersect(own.where("flag = 'N'").select("case_id", "item"))


@query(f"WITH {CASES} SELECT DISTINCT grp, parent FROM cases")
def distinct_values(spark, d):
    return cases(spark, d).select("grp", "parent").distinct().orderBy("grp", "parent")


@query("SELECT least(300, count(*)) AS n, TRUE AS distinct_keys FROM orders")
def random_sample(spark, d):
    got = R.hash_sample(table(spark, d, "orders"), ["o_orderkey"], 300)
    return got.agg(F.count("*").alias("n"), (F.countDistinct("o_orderkey") == F.count("*")).alias("distinct_keys"))


@query(f"WITH {CASES}, g AS (SELECT grp, count(*) AS n FROM cases GROUP BY grp) SELECT grp, least(n, CAST(greatest(1, round(500.0 * n / (SELECT sum(n) FROM g))) AS BIGINT)) AS n FROM g")
def stratified_sample(spark, d):
    return A.count_by(R.stratified_sample(cases(spark, d).select("case_id", "grp"), "grp", ["case_id"], 500), ["grp"])


@query(f"WITH {CASES}, g AS (SELECT status, count(*) AS k FROM cases GROUP BY status) SELECT status, CAST(f AS INT) AS fold, CAST(k // 3 + CASE WHEN f < k % 3 THEN 1 ELSE 0 END AS BIGINT) AS n FROM g, range(3) t(f)")
def stratified_kfold(spark, d):
    return A.count_by(R.stratified_folds(cases(spark, d).select("case_id", "status"), "status", ["case_id"], 3), ["status", "fold"])
