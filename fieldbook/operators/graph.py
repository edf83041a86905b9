"""Graph jobs on edge tables: collapse, degrees, PageRank, betweenness, communities, rules, neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded
from fieldbook.operators.components import connected_components
from fieldbook.operators.ranking import dense_index, hash_sample
from fieldbook.session import settled, written


def collapse_edges(edges: DataFrame, where_types: Sequence[str] = ("group",)) -> DataFrame:
    """(a, b, weight, lw, kind): no self loops, endpoints (type:name) in order, weights summed, lw = log1p.

    kind is `where` if an end has one of where_types, else `what`.
    """
    s, t = F.concat_ws(":", "src_type", "src"), F.concat_ws(":", "dst_type", "dst")
    kind = F.when(F.col("src_type").isin(*where_types) | F.col("dst_type").isin(*where_types), "where").otherwise("what")
    own = edges.select(F.least(s, t).alias("a"), F.greatest(s, t).alias("b"), "weight", kind.alias("kind")).where("a <> b")
    return own.groupBy("a", "b", "kind").agg(F.sum("weight").alias("weight")).withColumn("lw", F.log1p("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, weight, lw), a row for each end."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight", "lw").union(edges.select("b", "a", "weight", "lw"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and components."""
    nodes = both_ways(edges).agg(F.countDistinct("node").alias("n_nodes"))
    n_edges = edges.agg(F.count("*").alias("n_edges"))
    parts = connected_components(edges, "a", "b").agg(F.countDistinct("component").alias("n_components"))
    n = F.col("n_nodes").cast("double")
    return nodes.crossJoin(n_edges).crossJoin(parts).withColumn("density", F.coalesce(rounded(F.try_divide(2.0 * F.col("n_edges"), n * (n - 1))), F.lit(0.0)))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def pagerank(edges: DataFrame, weight: str = "weight", rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds on the weighted undirected graph; every node has an edge, so nothing dangles."""
    out = both_ways(edges).select("node", "other", F.col(weight).cast("double").alias("w"))
    share = settled(out.join(out.groupBy("node").agg(F.sum("w").alias("total")), "node").select("node", "other", (F.col("w") / F.col("total")).alias("p")))
    nodes = share.select("node").distinct()
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        moved = share.join(ranks, "node").groupBy(F.col("other").alias("node")).agg((F.lit((1 - damping) / n) + damping * F.sum(F.col("p") * F.col("rank"))).alias("rank"))
        ranks = settled(moved) if (i + 1) % 5 == 0 or i + 1 == rounds else moved
    return ranks


def betweenness(edges: DataFrame, pivots: int = 300) -> DataFrame:
    """(node, betweenness): unweighted, normalised, from at most `pivots` sources by hash order (all of them: exact).

    (source, node, paths) grows a level at a time by joins on the edges; a level's neighbours lie in the level before, itself or the
    next, so only these two are excluded. Dependencies are summed back level by level. Each level is a checkpoint of at most
    sources times nodes rows, and there are as many as the longest shortest path has edges.
    """
    pairs = edges.select("a", "b").where("a <> b")
    links = settled(pairs.union(pairs.select("b", "a")).distinct().toDF("node", "next"))
    nodes = settled(dense_index(links.select("node").distinct(), ["node"], "id"))
    n = nodes.count()
    sources = hash_sample(nodes, ["id"], min(pivots, n))
    levels = [settled(sources.select("node", F.col("node").alias("source"), F.lit(1.0).alias("paths")))]
    while True:
        seen = levels[-1].select("source", "node")
        if len(levels) > 1:
            seen = seen.union(levels[-2].select("source", "node"))
        reached = levels[-1].join(links, "node").groupBy("source", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        following = settled(reached.join(seen, ["source", "node"], "left_anti"))
        if following.isEmpty():
            break
        levels.append(following)
    lies = nodes.select("node", F.lit(0.0).alias("lies"))
    below = None
    for level in reversed(levels[1:]):
        if below is not None:
            passed = below.join(links, "node").select("source", F.col("next").alias("node"), ((1 + F.col("lies")) / F.col("paths")).alias("share")).groupBy("source", "node").agg(F.sum("share").alias("share"))
            level = level.join(passed, ["source", "node"], "left")
        else:
            level = level.withColumn("share", F.lit(0.0))
        below = settled(level.select("source", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("lies")))
        lies = lies.union(below.groupBy("node").agg(F.sum("lies").alias("lies")))
    scale, norm = n / max(1, min(pivots, n)), max(1.0, (n - 1) * (n - 2))
    return lies.groupBy("node").agg((F.sum("lies") * scale / norm).alias("betweenness"))


def modularity(edges: DataFrame, labels: DataFrame, weight: str = "lw") -> DataFrame:
    """One row: sum over communities of inner weight / m - (degree / 2m) squared. labels: (node, community)."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(la, "a").join(lb, "b").select("ca", "cb", F.col(weight).cast("double").alias("w"))
    ends = e.select(F.col("ca").alias("c"), "w", (F.col("ca") == F.col("cb")).cast("double").alias("inner")).union(e.select("cb", "w", F.lit(0.0)))
    per = ends.groupBy("c").agg(F.sum("w").alias("d"), F.sum(F.col("w") * F.col("inner")).alias("l"))
    m = F.sum("d") / 2
    return per.agg(rounded(F.sum("l") / m - F.sum(F.col("d") * F.col("d")) / (4 * m * m), 6).alias("modularity"), F.count("*").alias("n_communities"))


def louvain(edges: DataFrame, weight: str = "lw") -> DataFrame:
    """(node, community): parallel local moving, until no move of a node to a neighbouring community would raise modularity; then communities
    become nodes, and the next level starts. It ends with a level where no node wants to move. Communities are numbered from 0, largest first.

    In a turn half of the nodes (by hash) may move to the community with the best gain (the greater name of equals), as long as fewer nodes want
    to move than the turn before. From then on a node moves if its gain is the largest of all moves from or to either community (the greater
    name of equals): such moves don't touch each other, so modularity rises in every turn and the level ends.
    """
    current = written(edges.select("a", "b", F.col(weight).cast("double").alias("w")))
    # What was written is read for the nodes too, so that the edges are made once.
    total = current.agg(F.sum("w")).first()[0]
    membership = written(current.select(F.col("a").alias("node")).union(current.select("b")).distinct().withColumn("community", F.col("node")))
    if not total:
        return membership
    while True:
        near = current.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"), "w").union(current.where("a <> b").select("b", "a", "w"))
        near = written(near)
        own_loops = current.where("a = b").select(F.col("a").alias("node"), (2 * F.col("w")).alias("k"))
        degree = written(near.select("node", F.col("w").alias("k")).union(own_loops).groupBy("node").agg(F.sum("k").alias("k")))
        labels = degree.select("node", F.col("node").alias("c"), "k")
        turn, halves, wanted = 0, True, None
        while True:
            size = labels.groupBy("c").agg(F.sum("k").alias("dc"))
            to = near.join(labels.select(F.col("node").alias("other"), F.col("c").alias("to")), "other").select("node", "to", F.col("w").alias("kin"))
            stay = labels.select("node", F.col("c").alias("to"), F.lit(0.0).alias("kin"))
            options = to.union(stay).groupBy("node", "to").agg(F.sum("kin").alias("kin")).join(labels, "node").join(size.withColumnRenamed("c", "to"), "to")
            own = F.col("to") == F.col("c")
            dc = F.col("dc") - F.when(own, F.col("k")).otherwise(0.0)
            # In units of weight, so that its digits don't depend on the size of the graph.
            gain = F.round(F.col("kin") - F.col("k") * dc / (2 * total), 9)
            best = options.groupBy("node", "c", "k").agg(F.max(F.struct(gain.alias("gain"), own.alias("own"), "to")).alias("m"), F.max(F.when(own, gain)).alias("stay"))
            wishes = written(best.select("node", "c", "k", F.col("m.to").alias("to"), (F.col("m.gain") - F.col("stay")).alias("rise")))
            moves = wishes.where("to <> c")
            wants = moves.count()
            if not wants:
                break
            halves = halves and (wanted is None or wants < wanted)
            if halves:
                may = F.md5(F.concat("node", F.lit(f":{turn}"))) < "8"
                labels = wishes.select("node", F.when(may, F.col("to")).otherwise(F.col("c")).alias("c"), "k")
            else:
                claims = moves.select(F.col("c").alias("touched"), "rise", "node").union(moves.select("to", "rise", "node"))
                first = claims.groupBy("touched").agg(F.max(F.struct("rise", "node")).alias("m")).select("m.node")
                go = first.groupBy("node").agg((F.count("*") == 2).alias("may"))
                labels = wishes.join(go, "node", "left").select("node", F.when(F.col("may"), F.col("to")).otherwise(F.col("c")).alias("c"), "k")
            turn, wanted = turn + 1, wants
        if not turn:
            break
        labels = wishes.select("node", "c")
        membership = written(membership.join(labels.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")))
        la, lb = labels.select(F.col("node").alias("a"), F.col("c").alias("ca")), labels.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        current = written(current.join(la, "a").join(lb, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
    sizes = membership.groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    numbers = dense_index(sizes, [F.desc("n"), "first"], "number")
    return membership.join(numbers.select("community", "number"), "community").select("node", F.col("number").alias("community"))


def node_where(edges: DataFrame, k: int = 3) -> DataFrame:
    """(node, places): the k groups with the largest weight, from the edges of kind `where`."""
    own = both_ways(edges.where("kind = 'where'")).where(~F.col("node").startswith("group:") & F.col("other").startswith("group:"))
    top = own.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other"))).where(F.col("r") <= k)
    return top.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]), "; ").alias("places"))


def community_summary(labels: DataFrame, degree: DataFrame, members: int = 8) -> DataFrame:
    """Per community: size, nodes of each type, total weight, the top member and the first members by weight."""
    j = labels.join(degree, "node").withColumn("type", F.substring_index("node", ":", 1))
    order = Window.partitionBy("community").orderBy(F.desc("weighted_degree"), "node")
    top = j.withColumn("r", F.row_number().over(order)).where(F.col("r") <= members)
    first = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]), "; ").alias("members"), F.min_by("node", "r").alias("top_member"))
    sums = j.groupBy("community").agg(F.count("*").alias("size"), F.count_if(F.col("type") == "item").alias("n_items"), F.count_if(F.col("type") == "category").alias("n_categories"), F.sum("weighted_degree").alias("total"))
    return sums.join(first, "community")


def entity_marginals(cases: DataFrame, items: DataFrame, case: str, category: str, group: str) -> DataFrame:
    """(type, name, n_cases) of categories, items and groups."""
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n_cases")).select(F.lit(kind).alias("type"), "name", "n_cases")
    return count(cases, "category", category).unionByName(count(cases, "group", group)).unionByName(count(items.select(case, F.explode("items").alias("item")), "item", "item"))


def association_rules(edges: DataFrame, marginals: DataFrame, n: int, min_cases: int, min_confidence: float) -> DataFrame:
    """Rules in both directions: support, confidence, lift over 1; `spatial_affinity` if an end is a group, pairs of groups left out."""
    both = edges.union(edges.select("dst_type", "dst", "src_type", "src", "weight"))
    both = both.where(~((F.col("src_type") == "group") & (F.col("dst_type") == "group")) & (F.col("weight") >= min_cases))
    x = marginals.select(F.col("type").alias("src_type"), F.col("name").alias("src"), F.col("n_cases").alias("nx"))
    y = marginals.select(F.col("type").alias("dst_type"), F.col("name").alias("dst"), F.col("n_cases").alias("ny"))
    j = both.join(x, ["src_type", "src"]).join(y, ["dst_type", "dst"])
    w = F.col("weight").cast("double")
    j = j.select("src_type", "src", "dst_type", "dst", F.col("weight").alias("cases"), rounded(w / n, 6).alias("support"), rounded(w / F.col("nx")).alias("confidence"), rounded(w * n / (F.col("nx").cast("double") * F.col("ny"))).alias("lift"))
    kind = F.when((F.col("src_type") == "group") | (F.col("dst_type") == "group"), "spatial_affinity").otherwise("co_occurrence")
    return j.where((F.col("confidence") >= min_confidence) & (F.col("lift") > 1)).withColumn("rule_type", kind)


def ego_network(edges: DataFrame, focus: str) -> DataFrame:
    """Edges with both ends among the focus and its neighbours."""
    near = both_ways(edges).where(F.col("node") == focus).select(F.col("other").alias("k")).union(edges.sparkSession.range(1).select(F.lit(focus))).distinct()
    return edges.join(near.withColumnRenamed("k", "a"), "a", "left_semi").join(near.withColumnRenamed("k", "b"), "b", "left_semi").select("a", "b", "kind", "weight")


def entity_detail(edges: DataFrame, ranks: DataFrame, labels: DataFrame, focus: str, cases: int) -> DataFrame:
    """Neighbours of the focus with their share of its cases, its rank and its community."""
    near = both_ways(edges).where(F.col("node") == focus).groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    own = ranks.where(F.col("node") == focus).select(F.col("rank").alias("_r"))
    place = ranks.crossJoin(F.broadcast(own)).agg((F.count_if(F.col("rank") > F.col("_r")) + 1).alias("focus_rank"))
    community = labels.where(F.col("node") == focus).select("node", "community")
    return near.withColumn("share", rounded(F.col("weight") / F.lit(float(max(1, cases))))).crossJoin(F.broadcast(place)).join(community, "node", "left")


def cooccur_matrix(edges: DataFrame, row_type: str, column_type: str, rows: int, columns: int) -> DataFrame:
    """Top rows by top columns, zero-filled, with each cell's share of its row. rows * columns cells, whatever the data."""
    own = edges.where((F.col("src_type") == row_type) & (F.col("dst_type") == column_type)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    top = lambda c, k: own.groupBy(c).agg(F.sum("weight").alias("t")).orderBy(F.desc("t"), c).limit(k).select(c)
    full = top("src", rows).crossJoin(F.broadcast(top("dst", columns))).join(own, ["src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    total = F.sum("weight").over(Window.partitionBy("src"))
    return full.withColumn("share", F.coalesce(rounded(F.try_divide(F.col("weight").cast("double"), total.cast("double"))), F.lit(0.0)))


def seeded_neighbourhood(edges: DataFrame, seeds: DataFrame, preferred: Sequence[str], cap: int = 350) -> DataFrame:
    """(node, is_seed): seeds and their neighbours, edges of preferred kinds first, up to `cap` nodes in a fixed order."""
    order = F.array_position(F.array(*map(F.lit, preferred)), F.col("kind"))
    order = F.when(order == 0, 99).otherwise(order)
    ways = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "kind", "weight").union(edges.select("b", "a", "kind", "weight"))
    hop = ways.join(seeds.select("node"), "node", "left_semi").groupBy(F.col("other").alias("node")).agg(F.min(F.struct(order.alias("o"), (-F.col("weight")).alias("w"))).alias("m")).join(seeds, "node", "left_anti")
    every = seeds.select("node", F.lit(True).alias("is_seed"), F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("w")).union(hop.select("node", F.lit(False), "m.o", "m.w"))
    return every.orderBy("o", "w", "node").limit(cap).select("node", "is_seed")
