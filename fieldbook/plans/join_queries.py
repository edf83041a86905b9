"""Queries of the lookups, spatial joins and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import scalars as S
from fieldbook.operators import aggregates as A
from fieldbook.operators import joins as J
from fieldbook.operators import spatial as P
from fieldbook.operators.ranking import argmax_per_group
from fieldbook.plans.bindings import CASES, cases
from fieldbook.plans.registry import query, rounded_sql
from fieldbook.plans.scalar_queries import HAVERSINE
from fieldbook.session import table, written

#: One region plays the part that isn't geographic.
DIM = """dim AS (SELECT n_name AS member, r_name AS parent, 'K' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, r_name <> 'MIDDLE EAST' AS is_geographic, n_nationkey
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def dim(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("member"), F.col("r_name").alias("parent"), F.format_string("K%02d", "n_nationkey").alias("code"), (F.col("r_name") != "MIDDLE EAST").alias("is_geographic"), "n_nationkey")


RAW_KEY = "CASE WHEN unit_id % 11 = 0 THEN 'Atlantis' ELSE grp END"


def _raw_cases(spark, d):
    key = F.when(F.col("unit_id") % 11 == 0, "Atlantis").otherwise(F.col("grp"))
    return cases(spark, d).select("case_id", F.concat(F.lit(" "), key, F.lit("  ")).alias("raw"))


@query(f"WITH {CASES}, {DIM}, c AS (SELECT case_id, {RAW_KEY} AS k FROM cases) SELECT case_id, coalesce(dim.parent, 'UNKNOWN') AS parent, coalesce(dim.code, '') AS code FROM c LEFT JOIN dim ON k = member")
def conform_dimension(spark, d):
    return J.conform_dimension(_raw_cases(spark, d), "raw", dim(spark, d), "member", {"parent": "UNKNOWN", "code": ""}).select("case_id", "parent", "code")


@query(f"WITH {CASES} SELECT 'Atlantis' AS raw, count(*) AS n FROM cases WHERE unit_id % 11 = 0 HAVING count(*) > 0")
def unmatched_keys(spark, d):
    return J.unmatched_keys(_raw_cases(spark, d), "raw", dim(spark, d), "member")


@query(f"WITH {DIM} SELECT parent, string_agg(member, '; ' ORDER BY member) AS members, count(*) AS n_members, arg_min(code, member) AS code FROM dim WHERE is_geographic GROUP BY parent")
def parent_rollup(spark, d):
    return J.parent_rollup(dim(spark, d), "member", "parent", "code", F.col("is_geographic"))


@query(f"WITH {DIM}, {CASES} SELECT CASE WHEN code = 'K03' THEN 'K24' ELSE code END AS code, count(*) AS n FROM cases JOIN dim ON grp = member GROUP BY ALL")
def code_override(spark, d):
    own = dim(spark, d).select("member", J.code_override("code", {"K03": "K24"}).alias("code"))
    return A.count_by(cases(spark, d).join(own, F.col("grp") == F.col("member")), ["code"])


RATIO = "(100.0 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE))"
SORTED = "array_to_string(list_sort(string_split(upper(trim({x})), ' ')), ' ')"


@query(f"""WITH {DIM}, refs AS (SELECT 'first' AS reference, member AS k, code AS c, member AS n FROM dim WHERE n_nationkey % 6 <> 1
  UNION ALL SELECT 'second', member, CASE WHEN n_nationkey % 4 = 2 THEN 'X' || code ELSE code END, CASE WHEN n_nationkey % 5 = 3 THEN 'NEW ' || member ELSE member END FROM dim),
j AS (SELECT r.reference, dim.member, refs.k, refs.c, refs.n, dim.code FROM (SELECT DISTINCT reference FROM refs) r CROSS JOIN dim LEFT JOIN refs ON refs.reference = r.reference AND refs.k = dim.member)
SELECT * FROM (SELECT reference, member, CASE WHEN k IS NULL THEN 'error: missing' WHEN code <> c THEN 'error: code' WHEN {RATIO.format(a=SORTED.format(x='member'), b=SORTED.format(x='n'))} < 80 THEN 'warn: name' END AS issue FROM j) WHERE issue IS NOT NULL""")
def crosscheck_dim(spark, d):
    own = dim(spark, d)
    k = F.col("n_nationkey")
    first = own.where(k % 6 != 1).select(F.col("member").alias("key"), "code", F.col("member").alias("name"))
    second = own.select(F.col("member").alias("key"), F.when(k % 4 == 2, F.concat(F.lit("X"), "code")).otherwise(F.col("code")).alias("code"), F.when(k % 5 == 3, F.concat(F.lit("NEW "), "member")).otherwise(F.col("member")).alias("name"))
    return J.crosscheck(own, "member", "code", "member", {"first": first, "second": second}, 80)


TIERS = f"""{CASES}, seg AS (SELECT parent, segment, min(struct_pack(lat := lat, lon := lon)) AS p FROM units WHERE lat IS NOT NULL AND unit_id % 3 = 0 AND segment <> 'MACHINERY' GROUP BY ALL),
own AS (SELECT segment, min(struct_pack(lat := lat, lon := lon)) AS p FROM units WHERE lat IS NOT NULL AND unit_id % 3 = 0 AND segment IN ('MACHINERY', 'BUILDING') AND parent <> 'ASIA' GROUP BY ALL)"""


@query(f"""WITH {TIERS} SELECT unit_id, {rounded_sql('coalesce(units.lat, seg.p.lat, own.p.lat)', 3)} AS lat, {rounded_sql('coalesce(units.lon, seg.p.lon, own.p.lon)', 3)} AS lon,
  CASE WHEN units.lat IS NOT NULL THEN 'own' WHEN seg.p IS NOT NULL THEN 'exact' WHEN own.p IS NOT NULL THEN 'name' ELSE 'none' END AS precision
FROM units LEFT JOIN seg ON units.parent = seg.parent AND units.segment = seg.segment LEFT JOIN own ON units.segment = own.segment WHERE unit_id IN (SELECT o_custkey FROM orders)""")
def tiered_resolve(spark, d):
    units = cases(spark, d).select("unit_id", "parent", "segment", F.col("lat").alias("own_lat"), F.col("lon").alias("own_lon")).distinct()
    known = _units(spark, d).where("lat is not null and unit_id % 3 = 0")
    tiers = [("exact", known.where("segment <> 'MACHINERY'").select("parent", "segment", "lat", "lon"), ["parent", "segment"]), ("name", known.where("segment in ('MACHINERY', 'BUILDING') and parent <> 'ASIA'").select("segment", "lat", "lon"), ["segment"])]
    got = J.tiered_resolve(units, ["parent", "segment"], "own_lat", "own_lon", tiers)
    return got.select("unit_id", S.rounded(F.col("lat"), 3).alias("lat"), S.rounded(F.col("lon"), 3).alias("lon"), "precision")


def _units(spark, d):
    """All customers as units, those without cases too."""
    c = table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    key = F.col("c_custkey")
    lat, lon = F.lit(11.4) + (key * 7919 % 7300).cast("double") / 1000, F.lit(73.8) + (key * 104729 % 5100).cast("double") / 1000
    ok = ~(key % 10).isin(0, 2)
    return c.join(F.broadcast(places), c.c_nationkey == places.n_nationkey).select(key.alias("unit_id"), F.col("n_name").alias("grp"), F.col("r_name").alias("parent"), F.col("c_mktsegment").alias("segment"), F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))


@query(f"""WITH {CASES}, c AS (SELECT grp, unit_id, lat, lon, pow(lat - 15.0, 2) + pow(lon - 76.0, 2) AS d2 FROM units WHERE lat IS NOT NULL)
SELECT grp, unit_id, {rounded_sql('lat', 3)} AS lat, {rounded_sql('lon', 3)} AS lon FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY d2, unit_id) AS r FROM c) WHERE r = 1""")
def nearest_candidate(spark, d):
    u = _units(spark, d).where("lat is not null").withColumns({"ref_lat": F.lit(15.0), "ref_lon": F.lit(76.0)})
    got = J.nearest_candidate(u, ["grp"], "lat", "lon", "ref_lat", "ref_lon", "unit_id")
    return got.select("grp", "unit_id", S.rounded(F.col("lat"), 3).alias("lat"), S.rounded(F.col("lon"), 3).alias("lon"))


NAMES = "names AS (SELECT DISTINCT p_type AS block, p_name AS name FROM part), variants AS (SELECT DISTINCT block, reverse(string_split(reverse(name), ' ')[1]) || ' ' || string_split(name, ' ')[1] || 's' AS variant FROM names)"


@query(f"""WITH {NAMES}, s AS (SELECT v.block, variant, name, CAST(round(CAST({RATIO.format(a=SORTED.format(x='variant'), b=SORTED.format(x='name'))} AS DECIMAL(38,10)), 2) AS DOUBLE) AS score FROM variants v JOIN names n ON v.block = n.block)
SELECT block, variant, name, score FROM (SELECT *, row_number() OVER (PARTITION BY block, variant ORDER BY score DESC, name) AS r FROM s WHERE score >= 80) WHERE r = 1""")
def fuzzy_best_match(spark, d):
    names = table(spark, d, "part").select(F.col("p_type").alias("block"), F.col("p_name").alias("name")).distinct()
    word = F.split("name", " ")
    variants = names.select("block", F.concat(F.element_at(word, -1), F.lit(" "), F.element_at(word, 1), F.lit("s")).alias("variant"))
    return J.fuzzy_best_match(variants, "variant", names, "name", "block", 80)


SITES = f"""{CASES}, sites AS (SELECT s_suppkey AS site, n_name AS site_grp, 11.4 + CAST(s_suppkey * 6007 % 7300 AS DOUBLE) / 1000 AS slat, 73.8 + CAST(s_suppkey * 90001 % 5100 AS DOUBLE) / 1000 AS slon FROM supplier JOIN nation ON s_nationkey = n_nationkey),
located AS (SELECT unit_id, lat, lon FROM units WHERE lat IS NOT NULL)"""


def sites(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    k = F.col("s_suppkey")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(k.alias("site"), F.col("n_name").alias("site_grp"), (F.lit(11.4) + (k * 6007 % 7300).cast("double") / 1000).alias("lat"), (F.lit(73.8) + (k * 90001 % 5100).cast("double") / 1000).alias("lon"))


@query(f"""WITH {SITES}, p AS (SELECT unit_id, site, {HAVERSINE.format(a='lat', b='lon', c='slat', d='slon')} AS km FROM located, sites)
SELECT unit_id, site, {rounded_sql('km', 3)} AS km FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY km, site) AS r FROM p) WHERE r = 1""")
def knn1_join(spark, d):
    return P.knn1_join(_units(spark, d), "unit_id", sites(spark, d), "site").select("unit_id", "site", S.rounded(F.col("km"), 3).alias("km"))


@query(f"WITH {SITES}, p AS (SELECT unit_id, site, {HAVERSINE.format(a='lat', b='lon', c='slat', d='slon')} AS km FROM located, sites) SELECT unit_id, site, {rounded_sql('km', 3)} AS km FROM p WHERE km <= 20")
def radius_join(spark, d):
    got = P.radius_join(_units(spark, d).where("lat is not null").select("unit_id", "lat", "lon"), sites(spark, d).select("site", "lat", "lon"), 20.0)
    return got.select("unit_id", F.col("r_site").alias("site"), S.rounded(F.col("km"), 3).alias("km"))


#: Cells of one decimal place, and the weight of their cases.
CELLS = f"""{CASES}, cells AS (SELECT CAST(round(lat * 10) * 100000 + round(lon * 10) AS BIGINT) AS cell, {rounded_sql('lat', 1)} AS lat, {rounded_sql('lon', 1)} AS lon, count(*) AS w FROM cases WHERE lat IS NOT NULL GROUP BY ALL),
pairs AS (SELECT a.cell AS a, b.cell AS b, b.w AS w, {HAVERSINE.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} AS km FROM cells a, cells b)"""


def cells(spark, d):
    c = cases(spark, d).where("lat is not null").select(S.rounded(F.col("lat"), 1).alias("lat"), S.rounded(F.col("lon"), 1).alias("lon"))
    return A.count_by(c, ["lat", "lon"], "w").withColumn("cell", (F.round(F.col("lat") * 10) * 100000 + F.round(F.col("lon") * 10)).cast("bigint"))


CELLS = CELLS.replace("CAST(round(lat * 10) * 100000 + round(lon * 10) AS BIGINT) AS cell, ", "").replace("cells AS (SELECT", "cells0 AS (SELECT").replace("GROUP BY ALL),\npairs", "GROUP BY ALL),\ncells AS (SELECT CAST(round(lat * 10) * 100000 + round(lon * 10) AS BIGINT) AS cell, lat, lon, w FROM cells0),\npairs")


@query(f"WITH {CELLS} SELECT a AS cell, {rounded_sql('sum(w * exp(-km * km / (2 * 10.0 * 10.0)))')} AS density FROM pairs WHERE km <= 30 GROUP BY a")
def kde_density(spark, d):
    return P.kde_density(cells(spark, d), "cell", "w", 10.0)


DBSCAN = f"""{CELLS.replace('WITH ', '')}, near AS (SELECT * FROM pairs WHERE km <= 25), cores AS (SELECT a FROM near GROUP BY a HAVING sum(w) >= 105),
links AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM cores) AND b IN (SELECT a FROM cores)),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node), nums AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster FROM (SELECT DISTINCT component FROM comp)),
core_of AS (SELECT node, cluster FROM comp JOIN nums USING (component)), border AS (SELECT near.a, min(cluster) AS c FROM near JOIN core_of ON near.b = core_of.node GROUP BY near.a),
clusters AS (SELECT cell, lat, lon, w, CAST(coalesce(core_of.cluster, border.c, -1) AS INT) AS cluster FROM cells LEFT JOIN core_of ON cell = node LEFT JOIN border ON cell = border.a)"""


def clusters(spark, d):
    c = written(cells(spark, d))  # read several times, made from all cases
    return written(c.join(P.dbscan_weighted(c, "cell", "w", 25.0, 105), "cell"))


@query(f"WITH RECURSIVE {DBSCAN} SELECT cell, cluster FROM clusters")
def dbscan_weighted(spark, d):
    return clusters(spark, d).select("cell", "cluster")


@query(f"""WITH RECURSIVE {DBSCAN}, s AS (SELECT * FROM clusters WHERE cluster >= 0), d AS (SELECT x.cell, x.cluster AS cx, y.cluster AS cy, avg({HAVERSINE.format(a='x.lat', b='x.lon', c='y.lat', d='y.lon')}) AS d FROM s x, s y WHERE x.cell <> y.cell GROUP BY ALL),
p AS (SELECT cell, max(CASE WHEN cx = cy THEN d END) AS own, min(CASE WHEN cx <> cy THEN d END) AS other FROM d GROUP BY cell)
SELECT count(*) AS n, {rounded_sql('avg(coalesce((other - own) / greatest(own, other), 0))')} AS silhouette FROM p""")
def silhouette(spark, d):
    return P.silhouette(clusters(spark, d), "cell", "cluster")


@query(f"""WITH RECURSIVE {DBSCAN}, {SITES.split('units AS', 1)[0]}sites AS (SELECT s_suppkey AS site, n_name AS site_grp, 11.4 + CAST(s_suppkey * 6007 % 7300 AS DOUBLE) / 1000 AS slat, 73.8 + CAST(s_suppkey * 90001 % 5100 AS DOUBLE) / 1000 AS slon FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT cluster, count(*) AS n_cells, CAST(sum(w) AS BIGINT) AS total, {rounded_sql('CAST(sum(CAST(lat AS DECIMAL(20,8)) * w) AS DOUBLE) / sum(w)', 6)} AS lat, {rounded_sql('CAST(sum(CAST(lon AS DECIMAL(20,8)) * w) AS DOUBLE) / sum(w)', 6)} AS lon FROM clusters WHERE cluster >= 0 GROUP BY cluster),
r AS (SELECT c.cluster, {rounded_sql("quantile_cont(" + HAVERSINE.format(a='k.lat', b='k.lon', c='c.lat', d='c.lon') + ", 0.9)", 3)} AS radius_km FROM clusters k JOIN c ON k.cluster = c.cluster GROUP BY c.cluster),
n AS (SELECT cluster, site_grp FROM (SELECT cluster, site_grp, row_number() OVER (PARTITION BY cluster ORDER BY {HAVERSINE.format(a='c.lat', b='c.lon', c='slat', d='slon')}, site) AS q FROM c, sites) WHERE q = 1),
t AS (SELECT grp, category FROM (SELECT grp, category, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, category) AS q FROM cases GROUP BY grp, category) WHERE q = 1)
SELECT c.*, radius_km, site_grp, category FROM c JOIN r USING (cluster) JOIN n USING (cluster) LEFT JOIN t ON site_grp = grp""")
def cluster_summary(spark, d):
    top = argmax_per_group(cases(spark, d).withColumn("one", F.lit(1)), ["grp"], "category", "one").select(F.col("grp").alias("site_grp"), "category")
    return P.cluster_summary(clusters(spark, d), "cluster", "cell", "w", sites(spark, d), "site", "site_grp", top).select("cluster", "n_cells", "total", "lat", "lon", "radius_km", "site_grp", "category")


#: Each region is a diamond around a point of its own; a point is inside if a ray to the east crosses an odd number of its edges, so a border belongs to the inside in the west.
DIAMONDS = """diamonds AS (SELECT r_regionkey, 12.5e0 + CAST(r_regionkey AS DOUBLE) * 1.2e0 AS y, 74.5e0 + CAST(r_regionkey AS DOUBLE) * 0.8e0 AS x FROM region),
edges AS (SELECT *, y + 0.9e0 AS y1, x AS x1, y AS y2, x + 0.9e0 AS x2 FROM diamonds UNION ALL SELECT *, y, x + 0.9e0, y - 0.9e0, x FROM diamonds
  UNION ALL SELECT *, y - 0.9e0, x, y, x - 0.9e0 FROM diamonds UNION ALL SELECT *, y, x - 0.9e0, y + 0.9e0, x FROM diamonds),
crossed AS (SELECT lat, lon, r_regionkey FROM (SELECT DISTINCT lat, lon FROM cases) JOIN edges ON lat BETWEEN y - 0.9e0 AND y + 0.9e0 AND lon BETWEEN x - 0.9e0 AND x + 0.9e0
  AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"WITH {CASES}, {DIAMONDS} SELECT unit_id, count(*) AS n FROM cases WHERE EXISTS (SELECT 1 FROM crossed WHERE crossed.lat = cases.lat AND crossed.lon = cases.lon) GROUP BY unit_id")
def point_in_polygon(spark, d):
    k = F.col("r_regionkey").cast("double")
    lat, lon = F.lit(12.5) + k * 1.2, F.lit(74.5) + k * 0.8
    p = lambda a, b: F.struct((lon + b).alias("lon"), (lat + a).alias("lat"))
    rings = table(spark, d, "region").select(F.array(p(0.9, 0.0), p(0.0, 0.9), p(-0.9, 0.0), p(0.0, -0.9)).alias("ring"))
    return A.count_by(P.point_in_polygon(cases(spark, d), rings), ["unit_id"])


@query(f"""WITH {DIM}, {CASES}, f AS (SELECT grp, count(*) AS n FROM cases GROUP BY grp), p AS (SELECT n_name AS grp, count(*) * 1000 AS people, count(*) FILTER (c_acctbal > 5000) * 1000 AS part FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT grp, n, people, part, coalesce({rounded_sql('CAST(n * 100000 AS DOUBLE) / nullif(people, 0)', 2)}, 0) AS rate_100k, coalesce({rounded_sql('CAST(part AS DOUBLE) / nullif(people, 0)')}, 0) AS part_share, coalesce({rounded_sql('CAST(part * 1000 AS DOUBLE) / nullif(people, 0)', 2)}, 0) AS part_ratio FROM f LEFT JOIN p USING (grp)""")
def per_capita(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    people = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("grp")).agg((F.count("*") * 1000).alias("people"), (F.count_if(F.col("c_acctbal") > 5000) * 1000).alias("part"))
    return J.per_capita(A.count_by(cases(spark, d), ["grp"]), "grp", "n", people, "people", "part")


@query(f"WITH {CASES}, {DIM} SELECT grp, count(*) AS n FROM cases WHERE grp IN (SELECT member FROM dim WHERE is_geographic) GROUP BY grp")
def semi_filter(spark, d):
    keys = dim(spark, d).where("is_geographic").select(F.col("member").alias("grp"))
    return A.count_by(cases(spark, d).join(keys, "grp", "left_semi"), ["grp"])


@query(f"WITH {CASES} SELECT status, count(*) AS n, CAST(0 AS BIGINT) AS shared FROM cases WHERE case_id % 10 <> 3 GROUP BY status")
def anti_split(spark, d):
    c = cases(spark, d)
    held = c.where("case_id % 10 = 3").select("case_id")
    pool = J.anti_split(c, "case_id", held).join(held.withColumn("in_both", F.lit(1)), "case_id", "left")
    return pool.groupBy("status").agg(F.count("*").alias("n"), F.count("in_both").alias("shared"))


@query(f"""WITH {CASES}, a AS (SELECT grp, count(*) AS v FROM cases WHERE year = 1999 GROUP BY grp), b AS (SELECT grp, count(*) AS v FROM cases WHERE year = 2000 AND status = 'F' GROUP BY grp), c AS (SELECT grp, count(DISTINCT unit_id) AS v FROM cases GROUP BY grp)
SELECT grp, a.v AS prior, b.v AS recent, c.v AS units FROM a JOIN b USING (grp) JOIN c USING (grp)""")
def align_rankings(spark, d):
    c = cases(spark, d)
    count = lambda df: A.count_by(df, ["grp"], "value")
    return J.align("grp", prior=count(c.where("year = 1999")), recent=count(c.where("year = 2000 and status = 'F'")), units=c.groupBy("grp").agg(F.countDistinct("unit_id").alias("value")))


#: What a user of the tables relies on: (entity, field).
CONTRACT = (("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_clerk"), ("customer", "c_custkey"), ("customer", "c_phone"), ("invoice", "i_id"), ("supplier", "s_name"), ("part", "p_size"))
CONTRACT_SQL = "contract AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CONTRACT) + ") t(entity, field))"
PRESENT_SQL = "present AS (SELECT 'orders' AS entity, 'o_orderkey' AS field, count(o_orderkey) AS n_values FROM orders UNION ALL SELECT 'orders', 'o_custkey', count(o_custkey) FROM orders UNION ALL SELECT 'customer', 'c_custkey', count(c_custkey) FROM customer UNION ALL SELECT 'supplier', 's_name', count(s_name) FROM supplier UNION ALL SELECT 'part', 'p_size', count(p_size) FROM part)"


def conformance(spark, d):
    names = spark.createDataFrame(list(CONTRACT), "entity string, field string")
    return J.contract_conformance(names, J.value_counts_of_tables({t: table(spark, d, t) for t in ("orders", "customer", "supplier", "part")}))


CONFORMANCE_SQL = f"""{CONTRACT_SQL}, {PRESENT_SQL}, conf AS (SELECT c.entity, c.field,
  CASE WHEN c.entity = 'invoice' THEN 'absent' WHEN p.field IS NULL THEN 'missing' WHEN n_values = 0 THEN 'empty' ELSE 'populated' END AS status,
  CASE WHEN c.entity = 'invoice' THEN 'no source table' WHEN p.field IS NULL THEN 'no source column' WHEN n_values = 0 THEN 'no values' ELSE '' END AS blocker FROM contract c LEFT JOIN present p USING (entity, field))"""


@query(f"WITH {CONFORMANCE_SQL} SELECT * FROM conf")
def contract_conformance(spark, d):
    return conformance(spark, d)


@query("""SELECT 'lineitem-orders' AS relation, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_keys,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS most_children, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS childless
UNION ALL SELECT 'orders-customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)), (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def relationship_check(spark, d):
    t = lambda name: table(spark, d, name)
    return J.relationship_check(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem-orders").unionByName(J.relationship_check(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders-customer"))


