"""Joins and clusters on a sphere: grid-bucket equi-joins with exact tests, never all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import haversine, rounded
from fieldbook.operators.components import connected_components
from fieldbook.operators.ranking import dense_index, quantiles

KM_A_DEGREE = 111.19


def _steps(km: float, max_lat: float) -> tuple[float, float]:
    """Cell heights and widths in degrees that hold a radius, with some slack."""
    lat = km / KM_A_DEGREE * 1.001
    return lat, lat / max(0.01, math.cos(math.radians(min(89.0, max_lat))))


def radius_join(left: DataFrame, right: DataFrame, km: float, lat: str = "lat", lon: str = "lon", max_lat: float = 60.0) -> DataFrame:
    """All pairs within km: columns of left as they are, those of right with the prefix r_, and km.

    The right side is copied to the nine cells around each point and meets the left side by cell. max_lat bounds the
    latitudes: cells are as wide as they must be there.
    """
    dy, dx = _steps(km, max_lat)
    a = left.withColumns({"_y": F.floor(F.col(lat) / dy), "_x": F.floor(F.col(lon) / dx)})
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    around = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    b = b.withColumn("_o", around).withColumns({"_y": F.floor(F.col(f"r_{lat}") / dy) + F.col("_o.i"), "_x": F.floor(F.col(f"r_{lon}") / dx) + F.col("_o.j")}).drop("_o")
    pairs = a.join(b, ["_y", "_x"]).drop("_y", "_x")
    return pairs.withColumn("km", haversine(lat, lon, f"r_{lat}", f"r_{lon}")).where(F.col("km") <= km)


def knn1_join(queries: DataFrame, key: str, points: DataFrame, point: str, lat: str = "lat", lon: str = "lon", small: int = 5000, start_km: float = 25.0) -> DataFrame:
    """The nearest point of each query (ties to the smaller point) and its distance. Places count once, however many queries or points share them.

    Up to `small` points and a thousand times as many pairs, which is checked, the points are broadcast. Beyond, the search radius starts at start_km
    or, where that meets more than PAIRS_A_QUERY points for each query, at a quarter of it, and so on; it grows for those that have found
    none within it, so that each round is a grid join; those that are far from all points look through cells of one degree first.
    """
    from fieldbook.session import settled

    every = queries.select(key, lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    q = settled(every.select(lat, lon).distinct().withColumns({"_q": F.struct(lat, lon)}))
    p = points.select(F.col(point), F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).where("_lat is not null and _lon is not null")
    right = settled(p.groupBy(F.col("_lat").alias(lat), F.col("_lon").alias(lon)).agg(F.min(point).alias("p")).select("p", lat, lon))
    nearest = _nearest(q, right, lat, lon, small, start_km)
    return every.join(nearest, [lat, lon]).select(key, F.col("p").alias(point), "km")


#: Points that a query meets on average in the first round of a search.
PAIRS_A_QUERY = 32


def _nearest(q: DataFrame, right: DataFrame, lat: str, lon: str, small: int, start_km: float) -> DataFrame:
    """(lat, lon, p, km) of distinct places; both sides are settled."""
    from fieldbook.session import settled

    best = lambda df, p: df.groupBy("_q").agg(F.min(F.struct("km", F.col(p).alias("p"))).alias("m")).select("_q", "m.p", "m.km")
    told = lambda df: df.select(f"_q.{lat}", f"_q.{lon}", "p", "km")
    n, n_points = q.count(), right.count()
    if n_points <= small and n * n_points <= 1000 * small:
        r = right.select("p", F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
        return told(best(q.crossJoin(F.broadcast(r)).withColumn("km", haversine(lat, lon, "_lat", "_lon")), "p"))
    top = q.select(lat).union(right.select(lat)).agg(F.max(F.abs(lat))).first()[0] or 0.0
    # A circle around a point of latitude y reaches no farther than its radius by the cosine of y and the radius.
    reach = lambda km: min(85.0, top + km / KM_A_DEGREE)
    found, radius = None, start_km
    for _ in range(8):
        if _met(q, right, radius, lat, lon, reach(radius)) <= PAIRS_A_QUERY * n:
            break
        radius /= 4
    while radius < 1.3e4:
        near = settled(best(radius_join(q, right, radius, lat, lon, reach(radius)), "r_p"))
        found = near if found is None else found.unionByName(near)
        q = settled(q.join(near.select("_q"), "_q", "left_anti"))
        if q.isEmpty():
            return told(found)
        radius *= 4
    return told(found.unionByName(_farthest(q, "_q", right, "p", lat, lon)))


def _met(left: DataFrame, right: DataFrame, km: float, lat: str, lon: str, max_lat: float) -> int:
    """How many pairs a radius join would test, from the counts of its cells."""
    dy, dx = _steps(km, max_lat)
    count = lambda df, n: df.groupBy(F.floor(F.col(lat) / dy).alias("_y"), F.floor(F.col(lon) / dx).alias("_x")).agg(F.count("*").alias(n))
    around = F.explode(F.expr("flatten(transform(sequence(_y - 1, _y + 1), y -> transform(sequence(_x - 1, _x + 1), x -> struct(y as _y, x as _x))))"))
    b = count(right, "m").select(around.alias("_o"), "m").select("_o.*", "m")
    return count(left, "n").join(b, ["_y", "_x"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _farthest(q: DataFrame, key: str, points: DataFrame, point: str, lat: str, lon: str) -> DataFrame:
    """The nearest point of queries that are far from all: cells of one degree, at most 180 * 361 of them, are looked through first.

    No point of a cell is farther from its centre than `reach`, so only cells whose centre is within twice that of the nearest
    centre can hold the nearest point; queries meet the points of these alone, by cell.
    """
    reach = 1.5 * KM_A_DEGREE
    at = {"_y": F.floor(lat), "_x": F.floor(lon)}
    held = points.withColumns(at)
    cells = held.select("_y", "_x").distinct()
    centre = haversine(lat, lon, F.col("_y") + 0.5, F.col("_x") + 0.5)
    bounds = q.crossJoin(F.broadcast(cells)).withColumn("_d", centre)
    least = bounds.groupBy(key).agg((F.min("_d") + 2 * reach).alias("_most"))
    tried = bounds.join(least, key).where("_d <= _most").select(key, F.col(lat).alias("_qlat"), F.col(lon).alias("_qlon"), "_y", "_x")
    met = tried.join(held.select("_y", "_x", "p", lat, lon), ["_y", "_x"]).withColumn("km", haversine("_qlat", "_qlon", lat, lon))
    return met.groupBy(key).agg(F.min(F.struct("km", "p")).alias("m")).select(key, F.col("m.p").alias(point), F.col("m.km").alias("km"))


def kde_density(cells: DataFrame, key: str, weight: str, bandwidth: float, cutoff: float = 3.0, lat: str = "lat", lon: str = "lon", max_lat: float = 60.0) -> DataFrame:
    """Gaussian density at each cell: weights of the cells within cutoff bandwidths, itself included."""
    pairs = radius_join(cells.select(key, lat, lon), cells.select(key, weight, lat, lon), cutoff * bandwidth, lat, lon, max_lat)
    share = F.col(f"r_{weight}") * F.exp(-F.col("km") * F.col("km") / (2 * bandwidth * bandwidth))
    return pairs.groupBy(key).agg(rounded(F.sum(share), 4).alias("density"))


def dbscan_weighted(cells: DataFrame, key: str, weight: str, eps_km: float, least: float, lat: str = "lat", lon: str = "lon", max_lat: float = 60.0) -> DataFrame:
    """(key, cluster): cores have neighbours (themselves included) of at least `least` weight; linked cores are a cluster.

    A border cell takes the smallest cluster among its neighbouring cores; noise is -1. Clusters are numbered from 0 by their smallest
    core.
    """
    from fieldbook.session import settled

    pairs = settled(radius_join(cells.select(key, lat, lon), cells.select(key, weight, lat, lon), eps_km, lat, lon, max_lat).select(F.col(key).alias("a"), F.col(f"r_{key}").alias("b"), F.col(f"r_{weight}").alias("w")))
    cores = settled(pairs.groupBy("a").agg(F.sum("w").alias("near")).where(F.col("near") >= least).select("a"))
    links = pairs.join(cores, "a", "left_semi").join(cores.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    labels = connected_components(links, "a", "b")
    numbers = dense_index(labels.select("component").distinct(), ["component"], "cluster")
    core_of = settled(labels.join(numbers, "component").select(F.col("node").alias("b"), "cluster"))
    border = pairs.join(core_of, "b").groupBy("a").agg(F.min("cluster").alias("near_cluster"))
    own = cells.select(key).join(core_of.select(F.col("b").alias(key), F.col("cluster").alias("own")), key, "left").join(border.withColumnRenamed("a", key), key, "left")
    return own.select(key, F.coalesce("own", "near_cluster", F.lit(-1)).cast("int").alias("cluster"))


def silhouette(points: DataFrame, key: str, cluster: str, lat: str = "lat", lon: str = "lon", block_rows: int = 1024) -> DataFrame:
    """Mean silhouette (haversine) of all clustered points; a point alone in its cluster counts 0.

    Every block of points meets every block, and distances are summed by point and cluster before they are shuffled: the work grows
    with the pairs, the rows that move with the points times the blocks and clusters.
    """
    from fieldbook.session import settled

    s = settled(points.where(F.col(cluster) >= 0).select(key, cluster, lat, lon))
    parts = max(1, -(-s.count() // block_rows))
    own, other = F.pmod(F.xxhash64(key), F.lit(parts)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    a = s.select(F.col(key).alias("a"), F.col(cluster).alias("ca"), F.col(lat).alias("la"), F.col(lon).alias("oa"), own.alias("i"), other.alias("j"))
    b = s.select(F.col(key).alias("b"), F.col(cluster).alias("cb"), F.col(lat).alias("lb"), F.col(lon).alias("ob"), own.alias("j"), other.alias("i"))
    d = a.join(b, ["i", "j"]).where("a <> b").groupBy("a", "ca", "cb").agg(F.avg(haversine("la", "oa", "lb", "ob")).alias("d"))
    per = d.groupBy("a").agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("own"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("other"))
    value = F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0))
    return per.agg(F.count("*").alias("n"), rounded(F.avg(value), 4).alias("silhouette"))


def cluster_summary(points: DataFrame, cluster: str, key: str, weight: str, units: DataFrame, unit: str, group: str, category: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Per cluster: weighted centroid, cells, weight, 90th percentile radius, the group of the nearest unit and that group's top category.

    units: (unit, group, lat, lon); category: (group, category). Largest first is the caller's order.
    """
    inside = points.where(F.col(cluster) >= 0)
    w = F.col(weight).cast("decimal(18,0)")
    mean = lambda c: rounded(F.sum(F.col(c).cast("decimal(20,8)") * w).cast("double") / F.sum(w).cast("double"), 6)
    centre = inside.groupBy(cluster).agg(F.count("*").alias("n_cells"), F.sum(weight).alias("total"), mean(lat).alias("lat"), mean(lon).alias("lon"))
    radius = inside.join(centre.select(cluster, F.col("lat").alias("_la"), F.col("lon").alias("_lo")), cluster).select(cluster, haversine(lat, lon, "_la", "_lo").alias("_km"))
    radius = quantiles(radius, "_km", [0.9], [cluster]).select(cluster, rounded(F.get("edges", F.lit(0)), 3).alias("radius_km"))
    near = knn1_join(centre.select(cluster, lat, lon), cluster, units, unit, lat, lon).join(units.select(unit, group), unit).select(cluster, group)
    return centre.join(radius, cluster).join(near, cluster).join(category, group, "left")


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting: whether a point is inside a ring (an array of structs lon, lat; closed or not): a ray to the east crosses an odd number of edges."""
    crossings = F.aggregate(
        F.sequence(F.lit(1), F.size(ring)),
        F.lit(False),
        lambda inside, i: F.when(_crosses(lat, lon, F.element_at(ring, i), F.element_at(ring, F.when(i == F.size(ring), 1).otherwise(i + 1))), ~inside).otherwise(inside),
    )
    return crossings


def _crosses(lat: Column, lon: Column, p: Column, q: Column) -> Column:
    spans = (p["lat"] > lat) != (q["lat"] > lat)
    return spans & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.when(q["lat"] == p["lat"], 1.0).otherwise(q["lat"] - p["lat"]) + p["lon"])


def _edge_distance(lat: Column, lon: Column, ring: Column) -> Column:
    """Smallest distance in degrees from a point to the ring's edges."""

    def to_edge(i: Column) -> Column:
        p, q = F.element_at(ring, i), F.element_at(ring, F.when(i == F.size(ring), 1).otherwise(i + 1))
        vx, vy = q["lon"] - p["lon"], q["lat"] - p["lat"]
        along = F.coalesce(F.try_divide((lon - p["lon"]) * vx + (lat - p["lat"]) * vy, vx * vx + vy * vy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.sqrt(F.pow(lon - p["lon"] - t * vx, F.lit(2.0)) + F.pow(lat - p["lat"] - t * vy, F.lit(2.0)))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(ring)), to_edge))


def point_in_polygon(points: DataFrame, polygons: DataFrame, lat: str = "lat", lon: str = "lon", buffer: float = 0.0, ring: str = "ring") -> DataFrame:
    """Points inside the union of the polygons, widened by `buffer` degrees. Distinct places are tested once and joined back.

    A polygon's box is tested before its edges; of its border, what the rule of `in_polygon` gives in double precision is inside. The polygons are a dimension; the planner broadcasts them if they are small.
    """
    places = points.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).where("_lat is not null and _lon is not null").distinct()
    lats, lons = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    boxes = polygons.select(ring, (F.array_min(lats) - buffer).alias("_s"), (F.array_max(lats) + buffer).alias("_n"), (F.array_min(lons) - buffer).alias("_w"), (F.array_max(lons) + buffer).alias("_e"))
    boxed = places.join(boxes, F.col("_lat").between(F.col("_s"), F.col("_n")) & F.col("_lon").between(F.col("_w"), F.col("_e")))
    hit = in_polygon(F.col("_lat"), F.col("_lon"), F.col(ring))
    if buffer > 0:
        hit = hit | (_edge_distance(F.col("_lat"), F.col("_lon"), F.col(ring)) <= buffer)
    inside = boxed.where(hit).select("_lat", "_lon").distinct()
    return points.join(inside, (F.col(lat) == F.col("_lat")) & (F.col(lon) == F.col("_lon")), "left_semi")
