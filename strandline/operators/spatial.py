"""Nearest neighbours on the sphere: count-split trees on both sides and a pruned descent, level by level.

Positions are points of the unit sphere in space, so neither poles nor the date line are special.  The rows of
a side are dealt by range of a space-filling key and numbered; a node of the tree is a run of 16, 256, ... numbers with
the tight box around its points.  Where points are dense the nodes are small, so a town that holds most points
is many nodes, and an empty ocean is none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.storage import staging_path

LEAF_BITS = 4  # points of a leaf, and children of a node, as powers of two
CELL_BITS = (6, 3)  # queries of a cell, coarse and fine
TOP_NODES = 64
_AXES = ("x", "y", "z")
_SLACK = 1e-9  # chord lengths closer than this (6 mm) are settled by exact distances


def on_sphere(lat: str | Column, lon: str | Column) -> list[Column]:
    """Position on the unit sphere as columns x, y, z."""
    phi, lam = F.radians(lat), F.radians(lon)
    return [(F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z")]


def _interleaved() -> Column:
    """Bits of the three coordinates, 21 of each, in turn: near points have near keys."""
    steps = F.transform(F.array(*_AXES), lambda v: F.floor((v + 1) * (((1 << 21) - 1) / 2)))
    spread = lambda v, k: F.aggregate(
        F.sequence(F.lit(0), F.lit(20)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", v, i).bitwiseAND(F.lit(1).cast("long")), i * 3 + k))
    )
    return F.aggregate(F.transform(steps, spread), F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(v))


def numbered(points: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Points (with x, y, z) with a number ``_n`` that follows space, written to the shared folder; and the bits it uses.

    One shuffle by range, which is cut by counts, and a sort inside each task; equal keys are ordered by position.
    """
    spark, path = points.sparkSession, staging_path(points.sparkSession, name)
    keyed = points.withColumn("_key", _interleaved())
    dealt = keyed.repartitionByRange("_key", *_AXES).sortWithinPartitions("_key", *_AXES).withColumn("_at", F.monotonically_increasing_id())
    dealt.drop("_key").write.parquet(path)
    staged = spark.read.parquet(path)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    top = staged.agg(F.max(part).alias("part"), F.max(place).alias("place")).first()
    inner, outer = (top["place"] or 0).bit_length(), (top["part"] or 0).bit_length()
    return staged.withColumn("_n", F.shiftleft(part, inner).bitwiseOR(place)).drop("_at"), inner + outer


def _boxes(points: DataFrame, node: Column, groups: bool) -> DataFrame:
    """One row per node: its box, and the smallest and largest group inside."""
    sides = [f(c).alias(f"{c}_{n}") for c in _AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(node.alias("node")).agg(*sides, *([F.min("g").alias("g_lo"), F.max("g").alias("g_hi")] if groups else []))


def _parents(nodes: DataFrame, bits: int, groups: bool) -> DataFrame:
    sides = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in _AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return nodes.groupBy(F.shiftright("node", bits).alias("node")).agg(*sides, *([F.min("g_lo").alias("g_lo"), F.max("g_hi").alias("g_hi")] if groups else []))


def _between() -> tuple[Column, Column]:
    """Least and greatest distance between a point of the cell's box (``q_``) and one of the node's box."""
    least, most = F.lit(0.0), F.lit(0.0)
    for c in _AXES:
        lo, hi, q_lo, q_hi = (F.col(n) for n in (f"{c}_lo", f"{c}_hi", f"q_{c}_lo", f"q_{c}_hi"))
        gap = F.greatest(F.lit(0.0), lo - q_hi, q_lo - hi)
        span = F.greatest(hi - q_lo, q_hi - lo)
        least, most = least + gap * gap, most + span * span
    return F.sqrt(least), F.sqrt(most)


def _prune(frontier: DataFrame, groups: bool) -> DataFrame:
    """Drop nodes that are further from their cell than some point surely is.

    With groups a point counts only if it is of another group than the query.  A node of several groups has one for
    every query, and so have two nodes of one group each if these differ.
    """
    least, most = _between()
    f = frontier.withColumn("_least", least).withColumn("_most", most)
    cell = Window.partitionBy("cell")
    if not groups:
        return f.withColumn("_bound", F.min("_most").over(cell)).where(F.col("_least") <= F.col("_bound") + _SLACK)
    single = F.col("g_lo") == F.col("g_hi")
    f = f.where(~(single & (F.col("q_g_lo") == F.col("q_g_hi")) & (F.col("g_lo") == F.col("q_g_lo"))))
    first = F.min(F.struct("_most", F.when(single, F.col("g_lo")).alias("g"))).over(cell)
    f = f.withColumn("_first", first)
    alone = single & (F.col("g_lo") == F.col("_first.g"))
    # the first node is enough for cells without its group
    enough = F.col("_first.g").isNull() | (F.col("_first.g") < F.col("q_g_lo")) | (F.col("_first.g") > F.col("q_g_hi"))
    second = F.min(F.when(~alone, F.col("_most"))).over(cell)
    bound = F.when(enough, F.col("_first._most")).otherwise(F.greatest(F.col("_first._most"), second))
    return f.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound") + _SLACK))


def nearest(points: DataFrame, grid: DataFrame, pid: str, gid: str, lat: str = "lat", lon: str = "lon", group: str | None = None) -> DataFrame:
    """Nearest grid point of each point: ``pid, gid, km``; ties (to 1e-9 km) go to the smaller id.

    Queries go together in cells of at most 64 neighbours.  A cell starts with the top nodes of the grid's tree (at most 64, so
    they can be broadcast) and goes down a level at a time: children of the nodes still in question, minus those whose box is further than the nearest
    box surely reaches.  Then the cells are split to 8 queries and to one, each time with the same test, and the points of the few leaves
    left are measured.  Neither a cell nor a leaf grows with the density, and copies of a position count once on both sides: each distinct
    position is looked up once and joined back to its points.  ``pid`` names a point.

    With ``group`` the two sides must differ in that column; rows without a group have no partner.  Points without coordinates are left out.
    """
    g = [F.col(group).alias("g")] if group else []
    needed = [lat, lon, *([group] if group else [])]
    at = {"_lat": F.col(lat), "_lon": F.col(lon)} | ({"g": F.col(group)} if group else {})
    located = points.dropna(subset=needed).select(F.col(pid).alias("_pid"), *[c.alias(n) for n, c in at.items()])
    asked = located.select(*at).distinct()
    spots = asked.select("*", *on_sphere("_lat", "_lon"))
    places = grid.dropna(subset=needed).groupBy(F.col(lat).alias("_glat"), F.col(lon).alias("_glon"), *g).agg(F.min(gid).alias("_gid"))
    places, bits = numbered(places.select("*", *on_sphere("_glat", "_glon")), "grid")
    best = _nearest_places(spots, places, bits, bool(group))
    return located.join(best, list(at)).select(F.col("_pid").alias(pid), F.col("gid").alias(gid), "km")


def _nearest_places(asked: DataFrame, places: DataFrame, bits: int, has_group: bool) -> DataFrame:
    """Nearest place ``(_lat, _lon, g, km, gid)`` of every distinct position."""
    fields = ["_gid", "_glat", "_glon", *(["g"] if has_group else [])]
    key = ["_lat", "_lon", *(["g"] if has_group else [])]
    if 1 << bits <= TOP_NODES:  # few places: each position meets them all, as it would meet the top nodes
        few = places.agg(F.collect_list(F.struct(*fields)).alias("_members"))  # a single row of at most 64
        met = asked.crossJoin(F.broadcast(few)).withColumn("_b", _best_of(has_group, "g")).where("_b IS NOT NULL")
        return met.select(*key, "_b.km", "_b.gid")
    asked, _ = numbered(asked, "queries")
    depths = max(0, math.ceil((bits - LEAF_BITS - math.log2(TOP_NODES)) / LEAF_BITS))
    levels = [_boxes(places, F.shiftright("_n", LEAF_BITS), has_group)]
    for _ in range(depths):
        levels.append(_parents(levels[-1], LEAF_BITS, has_group))
    sides = {f"{c}_{n}": f"q_{c}_{n}" for c in (*_AXES, *(["g"] if has_group else [])) for n in ("lo", "hi")}
    queried = list(sides.values())
    coarse, fine = (_boxes(asked, F.shiftright("_n", b), has_group).withColumnsRenamed({"node": "cell"} | sides) for b in CELL_BITS)
    frontier = _prune(coarse.crossJoin(F.broadcast(levels[-1])), has_group)  # at most 64 rows are broadcast
    for nodes in levels[-2::-1]:
        at = frontier.select("cell", F.col("node").alias("_parent"), *queried)
        frontier = _prune(at.join(nodes.withColumn("_parent", F.shiftright("node", LEAF_BITS)), "_parent"), has_group)
    # the leaves are settled: now the cells go down to single queries, as sparse ones are wide
    boxes = ["node", *sides]
    frontier = frontier.select(F.col("cell").alias("_parent"), *boxes).join(fine.withColumn("_parent", F.shiftright("cell", CELL_BITS[0] - CELL_BITS[1])), "_parent")
    frontier = _prune(frontier, has_group).select(F.col("cell").alias("_parent"), *boxes)
    single = asked.select(
        F.shiftright("_n", CELL_BITS[1]).alias("_parent"), F.col("_n").alias("cell"), "_lat", "_lon",
        *[F.col(c).alias(f"q_{c}_{n}") for c in (*_AXES, *(["g"] if has_group else [])) for n in ("lo", "hi")],
    )
    own = ["cell", "_lat", "_lon", *(["q_g_lo"] if has_group else [])]
    frontier = _prune(frontier.join(single, "_parent"), has_group).select("node", *own)
    leaves = places.groupBy(F.shiftright("_n", LEAF_BITS).alias("node")).agg(F.collect_list(F.struct(*fields)).alias("_members"))  # at most 16
    met = frontier.join(leaves, "node").withColumn("_b", _best_of(has_group, "q_g_lo")).where("_b IS NOT NULL")
    found = met.groupBy("cell").agg(F.min(F.struct("_b.km", "_b.gid", *own[1:])).alias("_b"))
    return found.select("_b.*").withColumnsRenamed({"q_g_lo": "g"})


def _best_of(has_group: bool, own: str) -> Column:
    """Best of the row's ``_members`` as (km, gid); null if all are of the row's group."""
    members = F.filter("_members", lambda m: m["g"] != F.col(own)) if has_group else F.col("_members")
    km = lambda m: F.round(C.haversine_km("_lat", "_lon", m["_glat"], m["_glon"]), 9)
    return F.array_min(F.transform(members, lambda m: F.struct(km(m).alias("km"), m["_gid"].alias("gid"))))
