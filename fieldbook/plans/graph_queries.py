"""Queries of the graph and linkage jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import scalars as S
from fieldbook.operators import aggregates as A
from fieldbook.operators import graph as G
from fieldbook.operators import linkage as K
from fieldbook.operators.components import connected_components as components
from fieldbook.plans.aggregate_queries import EDGES, edges
from fieldbook.plans.bindings import cases, lines
from fieldbook.plans.registry import query, rounded_sql
from fieldbook.session import table, written

COLLAPSED = f"""{EDGES}, ce AS (SELECT least(src_type || ':' || src, dst_type || ':' || dst) AS a, greatest(src_type || ':' || src, dst_type || ':' || dst) AS b, CASE WHEN src_type = 'group' OR dst_type = 'group' THEN 'where' ELSE 'what' END AS kind, weight FROM edges),
col AS (SELECT a, b, kind, CAST(sum(weight) AS BIGINT) AS weight, ln(1 + sum(weight)) AS lw FROM ce WHERE a <> b GROUP BY ALL),
ways AS (SELECT a AS node, b AS other, weight, lw FROM col UNION ALL SELECT b, a, weight, lw FROM col)"""


def collapsed(spark, d):
    return G.collapse_edges(edges(spark, d))


@query(f"WITH {COLLAPSED} SELECT a, b, kind, weight, {rounded_sql('lw', 6)} AS lw FROM col")
def collapse_edges(spark, d):
    return collapsed(spark, d).withColumn("lw", S.rounded(F.col("lw"), 6))


@query(f"""WITH RECURSIVE {COLLAPSED}, reach AS (SELECT node, other FROM ways UNION SELECT reach.node, ways.other FROM reach JOIN ways ON reach.other = ways.node), comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
n AS (SELECT count(DISTINCT node) AS n_nodes FROM ways), e AS (SELECT count(*) AS n_edges FROM col) SELECT n_nodes, n_edges, (SELECT count(DISTINCT c) FROM comp) AS n_components, {rounded_sql('2.0::DOUBLE * n_edges / (n_nodes * (n_nodes - 1))')} AS density FROM n, e""")
def graph_stats(spark, d):
    return G.graph_stats(collapsed(spark, d))


DEGREES = "deg AS (SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM ways GROUP BY node)"


@query(f"WITH {COLLAPSED}, {DEGREES} SELECT * FROM deg")
def degrees(spark, d):
    return G.degrees(collapsed(spark, d))


def _pagerank_sql(rounds: int) -> str:
    steps = ["share AS (SELECT node, other, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY node) AS p FROM ways)", "cnt AS (SELECT count(DISTINCT node) AS n FROM ways)", "r0 AS (SELECT DISTINCT node, 1.0::DOUBLE / n AS rank FROM ways, cnt)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT other AS node, 0.15::DOUBLE / any_value(n) + 0.85 * sum(p * rank) AS rank FROM share JOIN r{i} USING (node), cnt GROUP BY other)")
    return ", ".join(steps)


RANKS = f"{COLLAPSED}, {_pagerank_sql(20)}, ranks AS (SELECT node, rank FROM r20)"


@query(f"WITH {RANKS} SELECT node, {rounded_sql('rank', 7)} AS rank FROM ranks")
def pagerank(spark, d):
    return G.pagerank(collapsed(spark, d)).select("node", S.rounded(F.col("rank"), 7).alias("rank"))


@query(f"WITH {RANKS} SELECT node, {rounded_sql('rank', 7)} AS rank FROM ranks ORDER BY ranks.rank DESC, node LIMIT 15")
def hubs(spark, d):
    top = G.pagerank(collapsed(spark, d)).orderBy(F.desc("rank"), "node").limit(15)
    return top.select("node", S.rounded(F.col("rank"), 7).alias("rank"))


@query()
def betweenness(spark, d):
    return G.betweenness(collapsed(spark, d)).select("node", S.rounded(F.col("betweenness"), 8).alias("betweenness"))


@query()
def louvain(spark, d):
    return G.louvain(collapsed(spark, d))


#: Given labels: each node's community is its type and the last sign of its name.
LABELS = "labels AS (SELECT DISTINCT node, CAST(CASE WHEN node LIKE 'item:%' THEN CAST(right(node, 1) AS INT) % 3 WHEN node LIKE 'group:%' THEN 3 ELSE 4 END AS INT) AS community FROM ways)"


def labels(spark, d):
    nodes = G.both_ways(collapsed(spark, d)).select("node").distinct()
    return nodes.withColumn("community", F.when(F.col("node").startswith("item:"), F.substring("node", -1, 1).try_cast("int") % 3).when(F.col("node").startswith("group:"), 3).otherwise(4).cast("int"))


@query(f"""WITH {COLLAPSED}, {LABELS}, e AS (SELECT x.community AS ca, y.community AS cb, lw AS w FROM col JOIN labels x ON a = x.node JOIN labels y ON b = y.node),
ends AS (SELECT ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS l FROM e UNION ALL SELECT cb, w, 0 FROM e), per AS (SELECT c, sum(w) AS d, sum(l) AS l FROM ends GROUP BY c), m AS (SELECT sum(d) / 2 AS m FROM per)
SELECT {rounded_sql('sum(l) / any_value(m) - sum(d * d) / (4 * any_value(m) * any_value(m))', 6)} AS modularity, count(*) AS n_communities FROM per, m""")
def modularity(spark, d):
    return G.modularity(collapsed(spark, d), labels(spark, d))


@query(f"""WITH {COLLAPSED}, w AS (SELECT a, b, weight FROM col WHERE kind = 'where'), ww AS (SELECT a AS node, b AS other, weight FROM w UNION ALL SELECT b, a, weight FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS r FROM ww WHERE node NOT LIKE 'group:%' AND other LIKE 'group:%') SELECT node, string_agg(other, '; ' ORDER BY r) AS places FROM t WHERE r <= 3 GROUP BY node""")
def node_where(spark, d):
    return G.node_where(collapsed(spark, d))


COMMUNITIES = f"""{COLLAPSED}, {LABELS}, {DEGREES}, j AS (SELECT deg.*, community, row_number() OVER (PARTITION BY community ORDER BY weighted_degree DESC, node) AS r FROM deg JOIN labels USING (node)),
communities AS (SELECT community, count(*) AS size, count(*) FILTER (node LIKE 'item:%') AS n_items, count(*) FILTER (node LIKE 'category:%') AS n_categories, CAST(sum(weighted_degree) AS BIGINT) AS total,
  string_agg(node, '; ' ORDER BY r) FILTER (r <= 8) AS members, arg_min(node, r) AS top_member FROM j GROUP BY community)"""


def communities(spark, d):
    return G.community_summary(labels(spark, d), G.degrees(collapsed(spark, d)))


@query(f"WITH {COMMUNITIES} SELECT * FROM communities")
def community_summary(spark, d):
    return communities(spark, d)


MARGINALS = f"""{EDGES}, marg AS (SELECT 'category' AS type, category AS name, count(*) AS n_cases FROM cases GROUP BY ALL UNION ALL SELECT 'group', grp, count(*) FROM cases GROUP BY ALL UNION ALL SELECT 'item', item, count(*) FROM distinct_items GROUP BY ALL)"""


def marginals(spark, d):
    return G.entity_marginals(cases(spark, d), A.case_items(lines(spark, d), "case_id", "item"), "case_id", "category", "grp")


@query(f"WITH {MARGINALS} SELECT * FROM marg")
def entity_marginals(spark, d):
    return marginals(spark, d)


RULES = f"""{MARGINALS}, total AS (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey), both_e AS (SELECT * FROM edges UNION ALL SELECT dst_type, dst, src_type, src, weight FROM edges),
ru AS (SELECT e.src_type, e.src, e.dst_type, e.dst, e.weight AS cases, {rounded_sql('CAST(weight AS DOUBLE) / n', 6)} AS support, {rounded_sql('CAST(weight AS DOUBLE) / x.n_cases')} AS confidence, {rounded_sql('CAST(weight AS DOUBLE) * n / (CAST(x.n_cases AS DOUBLE) * y.n_cases)')} AS lift
  FROM both_e e JOIN marg x ON x.type = src_type AND x.name = src JOIN marg y ON y.type = dst_type AND y.name = dst, total WHERE NOT (src_type = 'group' AND dst_type = 'group') AND weight >= 30),
rules AS (SELECT *, CASE WHEN src_type = 'group' OR dst_type = 'group' THEN 'spatial_affinity' ELSE 'co_occurrence' END AS rule_type FROM ru WHERE confidence >= 0.1 AND lift > 1)"""


def rules(spark, d):
    n = cases(spark, d).count()
    return G.association_rules(edges(spark, d), marginals(spark, d), n, 30, 0.1)


@query(f"WITH {RULES} SELECT * FROM rules")
def association_rules(spark, d):
    return rules(spark, d)


FOCUS = "category:1-URGENT"


@query(f"WITH {COLLAPSED}, k AS (SELECT other AS n FROM ways WHERE node = '{FOCUS}' UNION SELECT '{FOCUS}') SELECT a, b, kind, weight FROM col WHERE a IN (SELECT n FROM k) AND b IN (SELECT n FROM k)")
def ego_network(spark, d):
    return G.ego_network(collapsed(spark, d), FOCUS)


#: Communities found as `louvain` finds them: a step of walk is a turn, and the next level starts where nobody wants to move any more.
FOUND = """links AS MATERIALIZED (SELECT a, b, sum(lw) AS w FROM col GROUP BY ALL), mass AS (SELECT sum(w) AS m FROM links),
walk AS (SELECT 0 AS step, 0 AS turn, TRUE AS halves, CAST(NULL AS BIGINT) AS wanted, node, node AS base, node AS c FROM (SELECT DISTINCT node FROM ways)
  UNION ALL SELECT * FROM (WITH pairs AS (SELECT x.base AS p, y.base AS q, sum(w) AS w FROM links JOIN walk x ON x.node = a JOIN walk y ON y.node = b GROUP BY ALL),
    near AS (SELECT p, q, w FROM pairs WHERE p <> q UNION ALL SELECT q, p, w FROM pairs WHERE p <> q), deg2 AS (SELECT p AS base, sum(w) AS k FROM (SELECT p, w FROM pairs UNION ALL SELECT q, w FROM pairs) GROUP BY p),
    own AS (SELECT DISTINCT base, c, k FROM walk JOIN deg2 USING (base)), size AS (SELECT c, sum(k) AS dc FROM own GROUP BY c),
    kin AS (SELECT base, target, sum(w) AS kin FROM (SELECT p AS base, c AS target, w FROM near JOIN own ON base = q UNION ALL SELECT base, c, 0.0::DOUBLE FROM own) GROUP BY ALL),
    gains AS (SELECT base, own.c, target, round(kin - k * (dc - CASE WHEN target = own.c THEN k ELSE 0.0::DOUBLE END) / (2 * m), 9) AS gain FROM kin JOIN own USING (base) JOIN size ON size.c = target, mass),
    best AS (SELECT *, max(gain) FILTER (target = c) OVER (PARTITION BY base) AS stay, row_number() OVER (PARTITION BY base ORDER BY gain DESC, target = c DESC, target DESC) AS r FROM gains),
    wishes AS (SELECT base, target, gain - stay AS rise, c FROM best WHERE r = 1), n AS (SELECT count(*) FILTER (target <> c) AS wants FROM wishes),
    claims AS (SELECT base, row_number() OVER (PARTITION BY touched ORDER BY rise DESC, base DESC) AS r FROM (SELECT c AS touched, rise, base FROM wishes WHERE target <> c UNION ALL SELECT target, rise, base FROM wishes WHERE target <> c)),
    go AS (SELECT base FROM claims WHERE r = 1 GROUP BY base HAVING count(*) = 2),
    plan AS (SELECT walk.*, target, wants, wants > 0 AS goes, halves AND (wanted IS NULL OR wants < wanted) AS half FROM walk JOIN wishes USING (base), n WHERE wants > 0 OR turn > 0)
    SELECT step + 1, CASE WHEN goes THEN turn + 1 ELSE 0 END, NOT goes OR half, CASE WHEN goes THEN wants END, node, CASE WHEN goes THEN base ELSE c END,
      CASE WHEN goes AND CASE WHEN half THEN md5(base || ':' || turn) < '8' ELSE base IN (SELECT base FROM go) END THEN target ELSE c END FROM plan)),
found AS (SELECT node, CAST(dense_rank() OVER (ORDER BY size DESC, first) - 1 AS INT) AS community FROM (SELECT node, count(*) OVER (PARTITION BY c) AS size, min(node) OVER (PARTITION BY c) AS first FROM walk WHERE step = (SELECT max(step) FROM walk)))"""


@query(f"""WITH RECURSIVE {RANKS}, {FOUND}, c AS (SELECT greatest(1, count(*)) AS n FROM cases WHERE category = '1-URGENT') SELECT w.node, other, CAST(w.weight AS BIGINT) AS weight, {rounded_sql('CAST(w.weight AS DOUBLE) / c.n')} AS share,
  (SELECT count(*) + 1 FROM ranks WHERE rank > (SELECT rank FROM ranks WHERE node = '{FOCUS}')) AS focus_rank, community FROM (SELECT node, other, sum(weight) AS weight FROM ways WHERE node = '{FOCUS}' GROUP BY ALL) w JOIN found USING (node), c""")
def entity_detail(spark, d):
    n = cases(spark, d).where("category = '1-URGENT'").count()
    e = written(collapsed(spark, d))  # a row for each pair of nodes, made from all lines
    found = G.louvain(e).withColumn("community", F.col("community").cast("int"))
    return G.entity_detail(e, G.pagerank(e), found, FOCUS, n)


@query(f"""WITH {EDGES}, o AS (SELECT src, dst, weight FROM edges WHERE src_type = 'category' AND dst_type = 'item'), r AS (SELECT src FROM o GROUP BY src ORDER BY sum(weight) DESC, src LIMIT 4), c AS (SELECT dst FROM o GROUP BY dst ORDER BY sum(weight) DESC, dst LIMIT 6),
f AS (SELECT r.src, c.dst, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM r CROSS JOIN c LEFT JOIN o ON o.src = r.src AND o.dst = c.dst) SELECT *, coalesce({rounded_sql('CAST(weight AS DOUBLE) / nullif(sum(weight) OVER (PARTITION BY src), 0)')}, 0) AS share FROM f""")
def cooccur_matrix(spark, d):
    return G.cooccur_matrix(edges(spark, d), "category", "item", 4, 6)


@query(f"""WITH {COLLAPSED}, s AS (SELECT DISTINCT node FROM ways WHERE node LIKE 'category:%' AND node < 'category:3'), x AS (SELECT a AS node, b AS other, kind, weight FROM col UNION ALL SELECT b, a, kind, weight FROM col),
h AS (SELECT other AS node, min(struct_pack(o := CASE kind WHEN 'what' THEN 1 ELSE 99 END, w := -weight)) AS m FROM x WHERE node IN (SELECT node FROM s) AND other NOT IN (SELECT node FROM s) GROUP BY other),
u AS (SELECT node, TRUE AS is_seed, 0 AS o, 0 AS w FROM s UNION ALL SELECT node, FALSE, m.o, m.w FROM h) SELECT node, is_seed FROM u ORDER BY o, w, node LIMIT 30""")
def seeded_neighbourhood(spark, d):
    c = collapsed(spark, d)
    seeds = G.both_ways(c).select("node").distinct().where(F.col("node").startswith("category:") & (F.col("node") < "category:3"))
    return G.seeded_neighbourhood(c, seeds, ["what"], 30)


@query(f"WITH RECURSIVE {COLLAPSED}, l AS (SELECT node, other FROM ways WHERE node LIKE 'item:%' AND other LIKE 'item:%' AND weight > 340), reach AS (SELECT node, other FROM l UNION SELECT reach.node, l.other FROM reach JOIN l ON reach.other = l.node) SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node")
def connected_components(spark, d):
    own = collapsed(spark, d).where(F.col("a").startswith("item:") & F.col("b").startswith("item:") & (F.col("weight") > 340))
    return components(own, "a", "b")


# Linkage


TITLES = ["MR", "DR"]


def records(spark, d):
    """Distinct part names as records, each with variants whose truth is known: swapped order, an initial, a title; ages that differ a
    little or aren't known, and the other name of another record, which one variant lacks."""
    base = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("age"), F.min("p_type").alias("gate"), F.min("p_partkey").alias("truth"), F.max("p_type").alias("other"))
    w = F.split("name", " ")
    first, last = F.element_at(w, 1), F.element_at(w, -1)
    entry = lambda k, n, age, other: F.struct(F.lit(k).alias("k"), F.upper(n).alias("n"), age.cast("int").alias("age"), other.alias("second"))
    age, second = F.col("age"), F.concat_ws(" ", F.lower("other"), last)
    kinds = F.array(
        entry(0, F.col("name"), age, second), entry(1, F.concat(last, F.lit(" "), first), age + 1, F.concat_ws(" ", last, F.lower("other"))),
        entry(2, F.concat(F.substring(first, 1, 1), F.lit(". "), last), age, F.lit("")), entry(3, F.concat(F.lit("Dr. "), F.col("name")), F.lit(0), second),
    )
    got = base.select("truth", "gate", F.explode(kinds).alias("x"))
    return got.select((F.col("truth") * 10 + F.col("x.k")).alias("id"), F.col("x.n").alias("text"), "truth", "x.age", "gate", F.col("x.second").alias("second"))


def _norm_sql(x: str) -> str:
    x = rf"regexp_replace(upper(trim({x})), '\b(?:MR|DR)\.?\s+', '', 'g')"
    return f"trim(regexp_replace(replace(translate(regexp_replace({x}, '[^A-Z. ]', ' ', 'g'), 'W', 'V'), 'EE', 'I'), ' +', ' ', 'g'))"


RECORDS = f"""base AS (SELECT p_name AS name, min(p_size) AS age, min(p_type) AS gate, min(p_partkey) AS truth, lower(max(p_type)) AS other, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last FROM part GROUP BY p_name),
rec AS (SELECT truth * 10 AS id, upper(name) AS text, truth, age, gate, other || ' ' || last AS second FROM base UNION ALL SELECT truth * 10 + 1, upper(last || ' ' || first), truth, age + 1, gate, last || ' ' || other FROM base
  UNION ALL SELECT truth * 10 + 2, upper(substr(first, 1, 1) || '. ' || last), truth, age, gate, '' FROM base UNION ALL SELECT truth * 10 + 3, upper('Dr. ' || name), truth, 0, gate, other || ' ' || last FROM base),
norm AS (SELECT *, {_norm_sql('text')} AS norm, {_norm_sql('second')} AS norm2 FROM rec),
tok AS (SELECT DISTINCT id, text, unnest(string_split(replace(norm, '.', ''), ' ')) AS t FROM norm),
key0 AS (SELECT DISTINCT id, text, CASE WHEN regexp_replace(t, '[AEIOU]', '', 'g') <> '' THEN substr(regexp_replace(t, '[AEIOU]', '', 'g'), 1, 3) ELSE substr(t, 1, 2) END AS block FROM tok WHERE length(t) > 1),
blocks AS (SELECT * FROM key0 UNION ALL SELECT DISTINCT id, text, '?' FROM norm WHERE id NOT IN (SELECT id FROM key0))"""


@query(f"WITH {RECORDS} SELECT text, norm, count(*) AS n FROM norm GROUP BY ALL")
def link_normalize(spark, d):
    return records(spark, d).select("text", K.normalized(F.col("text"), TITLES).alias("norm")).groupBy("text", "norm").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT DISTINCT text, block FROM blocks")
def link_block(spark, d):
    return records(spark, d).select("text", F.explode(K.block_keys(K.normalized(F.col("text"), TITLES))).alias("block")).distinct()


@query(f"WITH {RECORDS}, d AS (SELECT DISTINCT text, block FROM blocks) SELECT block, count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs FROM d GROUP BY block")
def block_sizes(spark, d):
    return K.block_sizes(records(spark, d).select("text", K.normalized(F.col("text"), TITLES).alias("norm")).distinct(), "text", "norm")


@query(f"WITH {RECORDS} SELECT count(*) AS comparisons, (SELECT count(*) * (count(*) - 1) // 2 FROM (SELECT DISTINCT text FROM norm)) AS every_pair FROM (SELECT DISTINCT a.text, b.text FROM blocks a JOIN blocks b ON a.block = b.block AND a.text < b.text) t")
def candidate_pairs(spark, d):
    r = records(spark, d).select("text", K.normalized(F.col("text"), TITLES).alias("norm")).distinct()
    every = r.agg((F.count("*") * (F.count("*") - 1) / 2).cast("bigint").alias("every_pair"))
    return K.candidate_pairs(r, "text", "norm").agg(F.count("*").alias("comparisons")).crossJoin(every)


# Names of two tokens only: the first takes the better token of the other name (the first of equals), the second what is left.


def _like_sql(x: str, y: str) -> str:
    return f"CASE WHEN length({x}) = 1 OR length({y}) = 1 THEN CASE WHEN substr({x}, 1, 1) = substr({y}, 1, 1) THEN 0.92::DOUBLE ELSE 0.0::DOUBLE END ELSE jaro_winkler_similarity({x}, {y}) END"


def _similar_sql(x: str, y: str) -> str:
    """Similarity of two lists of two tokens each."""
    l = lambda i, j: _like_sql(f"{x}[{i}]", f"{y}[{j}]")  # noqa: E731,E741
    straight = f"({l(1, 1)} + {l(2, 2)}) / 2"
    crossed = f"({l(1, 2)} + {l(2, 1)}) / 2"
    none = f"greatest({l(2, 1)}, {l(2, 2)}) / 2"
    return f"CASE WHEN {l(1, 1)} = 0 AND {l(1, 2)} = 0 THEN {none} WHEN {l(1, 1)} >= {l(1, 2)} THEN {straight} ELSE {crossed} END"


SCORED = f"""{RECORDS}, names AS (SELECT *, string_split(replace(norm, '.', ''), ' ') AS t1, string_split(replace(norm2, '.', ''), ' ') AS t2 FROM norm),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM blocks a JOIN blocks b ON a.block = b.block AND a.id < b.id),
scores AS (SELECT a, b, {_similar_sql('x.t1', 'y.t1')} AS name_score, CASE WHEN x.norm2 <> '' AND y.norm2 <> '' THEN {_similar_sql('x.t2', 'y.t2')} END AS second_score, greatest(0.0::DOUBLE, 1 - abs(x.age - y.age) / 10.0::DOUBLE) AS age_score
  FROM cand JOIN names x ON x.id = a JOIN names y ON y.id = b WHERE x.gate = y.gate AND (x.age = 0 OR y.age = 0 OR abs(x.age - y.age) <= 6)),
scored AS (SELECT a, b, {rounded_sql('name_score')} AS name_score, {rounded_sql('CASE WHEN second_score IS NULL THEN 0.85::DOUBLE * name_score ELSE 0.65::DOUBLE * name_score + 0.20::DOUBLE * second_score END + 0.15::DOUBLE * age_score')} AS score FROM scores)"""


@query("WITH n AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[-1] AS last FROM part) SELECT a.name AS a, b.name AS b, CAST(round(CAST(CASE WHEN len(string_split(a.name, ' ')) = 2 AND len(string_split(b.name, ' ')) = 2 THEN " + _similar_sql("string_split(a.name, ' ')", "string_split(b.name, ' ')") + " END AS DECIMAL(38,10)), 6) AS DOUBLE) AS score FROM n a JOIN n b ON a.last = b.last AND a.name < b.name")
def pair_similarity(spark, d):
    """Whole names that share their last word."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), F.element_at(F.split("p_name", " "), -1).alias("last")).distinct()
    pairs = names.select(F.col("name").alias("a"), "last").join(names.select(F.col("name").alias("b"), "last"), "last").where("a < b").select("a", "b")
    return K.pair_similarity(pairs, "a", "b", "s").select("a", "b", S.rounded(F.col("s"), 6).alias("score"))


def scored_pairs(spark, d):
    r = records(spark, d).withColumns({"norm": K.normalized(F.col("text"), TITLES), "other": K.normalized(F.col("second"), TITLES)})
    side = lambda s: r.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("norm", "other", "age", "gate")))
    pairs = K.candidate_pairs(r, "id", "norm", ["gate"]).join(side("a"), "a").join(side("b"), "b").where(K.gates(F.col("gate_a"), F.col("gate_b"), F.col("age_a"), F.col("age_b")))
    alike = K.pair_similarity(pairs.drop("gate_a", "gate_b"), "norm_a", "norm_b", "name_score")
    alike = K.pair_similarity(alike, "other_a", "other_b", "second_score")
    both = (F.col("other_a") != "") & (F.col("other_b") != "")
    return alike.withColumn("score", S.rounded(K.pair_score(F.col("name_score"), F.col("second_score"), both, F.col("age_a"), F.col("age_b"))))


@query(f"WITH {SCORED} SELECT * FROM scored")
def pair_score(spark, d):
    return scored_pairs(spark, d).select("a", "b", S.rounded(F.col("name_score")).alias("name_score"), "score")


@query(f"""WITH RECURSIVE {SCORED}, l AS (SELECT a, b FROM scored WHERE score >= 0.92 UNION SELECT b, a FROM scored WHERE score >= 0.92), reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
own AS (SELECT id, least(id, coalesce((SELECT min(b) FROM reach WHERE a = id), id)) AS cluster FROM rec) SELECT id, cluster, 'PT-' || substr(sha256('salt:' || CAST(cluster AS VARCHAR)), 1, 12) AS token FROM own""")
def link_cluster(spark, d):
    return K.link_cluster(records(spark, d), "id", scored_pairs(spark, d).where("score >= 0.92").select("a", "b"), "salt")


@query(f"""WITH q AS (SELECT p_partkey, p_brand AS truth, p_type || CAST(p_size % 3 AS VARCHAR) AS cluster FROM part), p2 AS (SELECT count(*) * (count(*) - 1) / 2 AS k FROM q GROUP BY truth, cluster), p1 AS (SELECT count(*) * (count(*) - 1) / 2 AS k FROM q GROUP BY cluster), p0 AS (SELECT count(*) * (count(*) - 1) / 2 AS k FROM q GROUP BY truth),
s AS (SELECT CAST((SELECT sum(k) FROM p2) AS BIGINT) AS true_positive, CAST((SELECT sum(k) FROM p1) AS BIGINT) AS predicted, CAST((SELECT sum(k) FROM p0) AS BIGINT) AS actual)
SELECT *, {rounded_sql('CAST(true_positive AS DOUBLE) / predicted')} AS precision, {rounded_sql('CAST(true_positive AS DOUBLE) / actual')} AS recall, {rounded_sql('2.0::DOUBLE * true_positive / (predicted + actual)')} AS f1 FROM s""")
def pairwise_quality(spark, d):
    q = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("truth"), F.concat("p_type", (F.col("p_size") % 3).cast("string")).alias("cluster"))
    return K.pairwise_quality(q, "truth", "cluster")


