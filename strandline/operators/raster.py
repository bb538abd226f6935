"""Raster operators on pixel tables ``(scene keys, iy, ix, value)``.

Neighbourhoods are built by scattering a pixel to its neighbours and aggregating by cell
(one shuffle, spread over cells), or by windows along one image row or column, whose length
is the image width or height.  A scene is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import connected_components
from strandline.operators.ordering import exact_quantiles

CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def _moved(iy: Column, ix: Column, dy, dx, shape: tuple[int, int] | None) -> tuple[Column, Column]:
    y, x = iy + dy, ix + dx
    return (F.pmod(y, F.lit(shape[0])), F.pmod(x, F.lit(shape[1]))) if shape else (y, x)


def neighbours(pixels: DataFrame, keys: Sequence[str], x: Column, shape: tuple[int, int] | None = None, offsets=CROSS) -> DataFrame:
    """Own value, and sum and count of the neighbours' values, per pixel.

    With ``shape`` the edges wrap.
    """
    places = F.array(F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(1).alias("own")), *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(0).alias("own")) for dy, dx in offsets])
    sent = pixels.select(*keys, "iy", "ix", x.cast("double").alias("_v"), F.inline(places))
    y, xx = _moved(F.col("iy"), F.col("ix"), F.col("dy"), F.col("dx"), shape)
    own = F.col("own") == 1
    out = sent.select(*keys, y.cast("int").alias("iy"), xx.cast("int").alias("ix"), "_v", "own").groupBy(*keys, "iy", "ix").agg(
        F.max(F.when(own, F.col("_v"))).alias("own"), F.max("own").alias("_here"), F.sum(F.when(~own, F.col("_v"))).alias("near_sum"), F.count(F.when(~own, F.col("_v"))).alias("near_n")
    )
    return out.where("_here = 1").drop("_here")


def label_patches(pixels: DataFrame, scene: str, mask: Column, shape: tuple[int, int], periodic: bool = False) -> DataFrame:
    """4-neighbour patches of the masked pixels: adds ``label``, the smallest cell number of the patch.

    Runs along image rows come first (windows of one row); only runs that touch across rows
    become graph edges, so the component search works on far fewer nodes than pixels.
    ``scene`` is a whole-number column.
    """
    ny, nx = shape
    cells = pixels.where(mask).select(scene, "iy", "ix")
    row = Window.partitionBy(scene, "iy").orderBy("ix")
    fresh = F.when(F.col("ix") - F.lag("ix").over(row) == 1, 0).otherwise(1)
    runs = cells.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.col(scene).cast("long") * (ny * nx)
    first = F.min("ix").over(Window.partitionBy(scene, "iy", "_run"))
    runs = runs.withColumn("_id", base + F.col("iy").cast("long") * nx + first).select(scene, "iy", "ix", "_id")
    below = runs.select(scene, (F.pmod(F.col("iy") - 1, F.lit(ny)) if periodic else F.col("iy") - 1).cast("int").alias("iy"), "ix", F.col("_id").alias("_o"))
    edges = runs.join(below, [scene, "iy", "ix"]).select("_id", "_o").distinct()
    if periodic:
        ends = runs.groupBy(scene, "iy").agg(F.max(F.when(F.col("ix") == 0, F.col("_id"))).alias("_id"), F.max(F.when(F.col("ix") == nx - 1, F.col("_id"))).alias("_o"))
        edges = edges.unionByName(ends.where("_id IS NOT NULL AND _o IS NOT NULL").select("_id", "_o"))
    comp = connected_components(edges, "_id", "_o", runs.select(F.col("_id").alias("id")).distinct())
    out = runs.join(comp.withColumnRenamed("id", "_id"), "_id")
    return out.select(scene, "iy", "ix", (F.col("component") - base).alias("label"))


def patch_stats(labels: DataFrame, scene: str, ny: int) -> DataFrame:
    """Number of patches, largest share, and whether one patch joins top and bottom."""
    size = labels.groupBy(scene, "label").agg(
        F.count(F.lit(1)).alias("size"), (F.max(F.when(F.col("iy") == 0, 1).otherwise(0)) * F.max(F.when(F.col("iy") == ny - 1, 1).otherwise(0))).alias("_spans")
    )
    return size.groupBy(scene).agg(
        F.count(F.lit(1)).alias("patches"), F.sum("size").alias("cells"), F.max("size").alias("largest"), (F.max("size") / F.sum("size")).alias("largest_share"), (F.max("_spans") == 1).alias("spans")
    )


def clump_index(pixels: DataFrame, scene: str, mask: Column, shape: tuple[int, int]) -> DataFrame:
    """Cover around vegetated cells over mean cover, edges wrapped; null when all or none is covered."""
    n = neighbours(pixels, [scene], F.when(mask, 1.0).otherwise(0.0), shape)
    rho = F.avg("own")
    q = F.avg(F.when(F.col("own") == 1, F.col("near_sum") / 4))
    return n.groupBy(scene).agg(F.when((rho > 0) & (rho < 1), q / rho).alias("clump"), rho.alias("cover"))


def otsu_threshold(pixels: DataFrame, scene: str, x: str, bins: int = 256) -> DataFrame:
    """Threshold with the largest between-class variance of a histogram per scene.

    Pixels collapse to at most ``bins`` rows per scene before the running sums.
    """
    span = pixels.groupBy(scene).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    b = F.least(F.floor(F.try_divide(F.col(x) - F.col("_lo"), wide) * bins), F.lit(bins - 1))
    hist = pixels.where(F.col(x).isNotNull()).join(span, scene).where(wide > 0).groupBy(scene, b.alias("_b"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("_n"))
    mid = F.col("_lo") + (F.col("_b") + 0.5) * wide / bins
    one = Window.partitionBy(scene)
    run = one.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("_n") / F.sum("_n").over(one)
    h = hist.withColumn("_mid", mid).withColumn("_p", p)
    h = h.withColumn("_w", F.sum("_p").over(run)).withColumn("_m", F.sum(F.col("_p") * F.col("_mid")).over(run)).withColumn("_all", F.sum(F.col("_p") * F.col("_mid")).over(one))
    between = F.pow(F.col("_all") * F.col("_w") - F.col("_m"), F.lit(2)) / F.greatest(F.col("_w") * (F.lit(1.0) - F.col("_w")), F.lit(1e-12))
    # the last bin holds everything, so it separates nothing
    h = h.withColumn("_s", F.when(F.col("_w") < 1 - 1e-12, between).otherwise(0.0))
    return h.groupBy(scene).agg(F.min_by("_mid", F.struct(-F.round("_s", 12), F.col("_b"))).alias("threshold"))


def cover_match_threshold(pixels: DataFrame, scene: str, x: str, rho: float) -> DataFrame:
    """Quantile that leaves a share ``rho`` of the pixels above it."""
    return exact_quantiles(pixels, [scene], x, [1 - rho]).select(scene, F.col(x).alias("threshold"))


def block_mean(pixels: DataFrame, keys: Sequence[str], xs: Sequence[str], k: int, shape: tuple[int, int]) -> DataFrame:
    """Means of k x k blocks; the ragged edge is dropped."""
    ny, nx = shape[0] // k, shape[1] // k
    by, bx = F.floor(F.col("iy") / k).cast("int"), F.floor(F.col("ix") / k).cast("int")
    out = pixels.select(*keys, by.alias("iy"), bx.alias("ix"), *xs).where((F.col("iy") < ny) & (F.col("ix") < nx))
    return out.groupBy(*keys, "iy", "ix").agg(*[F.avg(x).alias(x) for x in xs])


def slope(pixels: DataFrame, keys: Sequence[str], z: str, step: float, out: str = "slope") -> DataFrame:
    """Slope in degrees: central differences inside, one-sided at the edges."""
    def grad(line: Window) -> Column:
        before, after = F.lag(z).over(line), F.lead(z).over(line)
        gap = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
        return (F.coalesce(after, F.col(z)) - F.coalesce(before, F.col(z))) / (gap * step)

    gx = grad(Window.partitionBy(*keys, "iy").orderBy("ix"))
    gy = grad(Window.partitionBy(*keys, "ix").orderBy("iy"))
    return pixels.withColumn("_gx", gx).withColumn("_gy", gy).withColumn(out, F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))))).drop("_gx", "_gy")


def _padded(df: DataFrame, axis: str, n: int, length: int, mode: str) -> DataFrame:
    """Copies of the pixels outside the image along one axis: mirrored or edge-replicated."""
    a = F.col(axis)
    if mode == "reflect":
        images = F.array(a, -a - 1, F.lit(2 * length - 1) - a)
        images = F.array_distinct(F.filter(images, lambda v: v.between(-n, length + n - 1)))
    else:
        outside = F.when(a == 0, F.sequence(F.lit(-n), F.lit(0))).when(a == length - 1, F.sequence(F.lit(length - 1), F.lit(length + n - 1))).otherwise(F.array(a))
        images = outside
    return df.withColumn(axis, F.explode(images.cast("array<int>")))


def box_sums(pixels: DataFrame, keys: Sequence[str], xs: Sequence[str], n: int, shape: tuple[int, int], mode: str = "nearest") -> DataFrame:
    """Sum of each value over the (2n+1)-square around every pixel, edges padded.

    Two running sums, one along rows and one along columns, each read at two offsets: the
    cost per pixel does not grow with n.
    """
    keys = list(keys)
    if n >= min(shape):
        raise ValueError("the box must be smaller than the image")
    out = pixels.select(*keys, "iy", "ix", *xs)
    for axis, other, length in (("ix", "iy", shape[1]), ("iy", "ix", shape[0])):
        line = Window.partitionBy(*keys, other).orderBy(axis)
        upto = line.rowsBetween(Window.unboundedPreceding, 0)
        padded = _padded(out, axis, n, length, mode)
        runs = padded.select(*keys, "iy", "ix", *[F.sum(x).over(upto).alias(x) for x in xs])
        sums = [(F.lead(x, n).over(line) - F.coalesce(F.lag(x, n + 1).over(line), F.lit(0.0))).alias(x) for x in xs]
        out = runs.select(*keys, "iy", "ix", *sums).where(F.col(axis).between(0, length - 1))
    return out


def topographic_position(pixels: DataFrame, keys: Sequence[str], z: str, n: int, shape: tuple[int, int], out: str = "tpi") -> DataFrame:
    """Value minus the mean of its surroundings, edges replicated."""
    mean = box_sums(pixels, keys, [z], n, shape).withColumnRenamed(z, "_box")
    return pixels.join(mean, [*keys, "iy", "ix"]).withColumn(out, F.col(z) - F.col("_box") / float((2 * n + 1) ** 2)).drop("_box")


def distance_to_mask(pixels: DataFrame, keys: Sequence[str], mask: Column, step: float, none: float = 300.0, out: str = "distance") -> DataFrame:
    """Distance to the nearest masked cell, exact and separable.

    Along each row the nearest masked cell by two running windows; then down each column the
    least of row distance squared plus offset squared (one column of the image per group).
    """
    keys = list(keys)
    line = Window.partitionBy(*keys, "iy").orderBy("ix")
    hit = F.when(mask, F.col("ix"))
    left = F.last(hit, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys, "iy").orderBy(F.desc("ix"))
    right = F.last(hit, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = pixels.withColumn("_g", F.least(F.col("ix") - left, right - F.col("ix")).cast("double")).select(*keys, "iy", "ix", "_g")
    packed = rows.groupBy(*keys, "ix").agg(F.collect_list("iy").alias("_y"), F.collect_list(F.coalesce("_g", F.lit(float("inf")))).alias("_d"))
    types = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def columns(batches):
        for pdf in batches:
            out_d = []
            for y, g in zip(pdf["_y"], pdf["_d"]):
                y, g = np.asarray(y, dtype=float), np.asarray(g, dtype=float)
                seen = np.isfinite(g)
                gap = np.subtract.outer(y, y[seen]) ** 2 + g[seen] ** 2
                out_d.append(np.sqrt(gap.min(axis=1)) * step if seen.any() else np.full(len(y), none))
            yield pdf[[*keys, "ix", "_y"]].assign(_d=out_d)

    near = packed.mapInPandas(columns, f"{types}, ix int, _y array<int>, _d array<double>")
    far = near.select(*keys, "ix", F.inline(F.arrays_zip("_y", "_d"))).select(*keys, "ix", F.col("_y").alias("iy"), F.col("_d").alias(out))
    return pixels.join(far, [*keys, "iy", "ix"])


def bilinear_regrid(coarse: DataFrame, fine: DataFrame, keys: Sequence[str], x: str, fid: str, shape: tuple[int, int]) -> DataFrame:
    """Coarse cells onto fine points given in coarse row and column units; edges clamp.

    The four corners of every square between cells are gathered first, so a point meets one square per key and its
    value is made in that row; nothing is summed by point.  ``fid`` names a point.
    """
    keys = list(keys)
    ny, nx = shape
    row, colm = F.least(F.greatest(F.col("row"), F.lit(0.0)), F.lit(ny - 1.0)), F.least(F.greatest(F.col("col"), F.lit(0.0)), F.lit(nx - 1.0))
    y0, x0 = F.least(F.floor(row), F.lit(max(ny - 2, 0))), F.least(F.floor(colm), F.lit(max(nx - 2, 0)))
    one = F.lit(1.0)
    points = fine.select(fid, y0.cast("int").alias("_y"), x0.cast("int").alias("_x"), (row - y0).alias("_fy"), (colm - x0).alias("_fx"))
    at = [(0, 0), (0, 1), (1, 0), (1, 1)]
    square = F.array(*[F.struct((F.col("iy") - dy).alias("_y"), (F.col("ix") - dx).alias("_x"), F.lit(k).alias("_k")) for k, (dy, dx) in enumerate(at)])
    mine = lambda k, c: F.when(F.col("_k") == k, c)
    squares = coarse.select(*keys, F.col(x).alias("_v"), F.inline(square)).groupBy(*keys, "_y", "_x").agg(
        *[F.count(mine(k, F.lit(1))).alias(f"_n{k}") for k in range(4)], *[F.sum(mine(k, F.col("_v"))).alias(f"_v{k}") for k in range(4)]
    )
    weight = [(F.col("_fy") if dy else one - F.col("_fy")) * (F.col("_fx") if dx else one - F.col("_fx")) for dy, dx in at]
    met = [(weight[k] > 0) & (F.col(f"_n{k}") > 0) for k in range(4)]
    terms = [F.when(met[k], weight[k] * F.col(f"_v{k}")) for k in range(4)]
    value = F.when(F.coalesce(*terms).isNotNull(), sum((F.coalesce(v, F.lit(0.0)) for v in terms), F.lit(0.0)))
    return points.join(squares, ["_y", "_x"]).where(met[0] | met[1] | met[2] | met[3]).select(*keys, fid, value.alias(x))


def nearest_cell(points: DataFrame, seen: DataFrame, keys: Sequence[str], size: tuple[int, ...] = (2, 8, 64, 1 << 30)) -> DataFrame:
    """Nearest seen cell of each cell ``(iy, ix)`` within the same keys; ties by row, then column.

    Larger and larger tiles: a hit nearer than one tile edge is final.
    """
    keys = list(keys)
    todo, found = points.select(*keys, "iy", "ix"), []
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    for k, s in enumerate(size):
        tile = lambda c: F.floor(F.col(c) / s)
        filed = seen.select(*keys, F.col("iy").alias("_sy"), F.col("ix").alias("_sx"))
        if k < len(size) - 1:
            filed = filed.withColumn("_dy", step).withColumn("_dx", step)
        else:
            filed = filed.withColumn("_dy", F.lit(0)).withColumn("_dx", F.lit(0))
        filed = filed.withColumn("_ty", tile("_sy") + F.col("_dy")).withColumn("_tx", tile("_sx") + F.col("_dx")).drop("_dy", "_dx")
        d2 = F.pow(F.col("iy") - F.col("_sy"), F.lit(2)) + F.pow(F.col("ix") - F.col("_sx"), F.lit(2))
        hits = todo.withColumn("_ty", tile("iy")).withColumn("_tx", tile("ix")).join(filed, [*keys, "_ty", "_tx"])
        best = hits.groupBy(*keys, "iy", "ix").agg(F.min(F.struct(d2.alias("d2"), F.col("_sy").alias("y"), F.col("_sx").alias("x"))).alias("_b"))
        done = best.select(*keys, "iy", "ix", F.col("_b.y").alias("near_iy"), F.col("_b.x").alias("near_ix"), F.sqrt("_b.d2").alias("cells"))
        if k < len(size) - 1:
            done = done.where(F.col("cells") <= s)
            todo = todo.join(done.select(*keys, "iy", "ix"), [*keys, "iy", "ix"], "left_anti")
        found.append(done)
    return reduce(DataFrame.unionByName, found)


def gap_offset_fill(df: DataFrame, d: str, x: str, model: str, out: str = "filled") -> DataFrame:
    """Fill gaps in ``x`` by the model value plus the cell's mean clear offset of that month.

    A cell never seen clear in a month takes the offset of the nearest cell that was.
    """
    month = df.withColumn("_m", F.month(d))
    offs = month.groupBy("_m", "iy", "ix").agg(F.avg(F.col(x) - F.col(model)).alias("_off"))
    seen = offs.where("_off IS NOT NULL")
    near = nearest_cell(offs.where("_off IS NULL"), seen, ["_m"])
    lent = near.join(seen.select("_m", F.col("iy").alias("near_iy"), F.col("ix").alias("near_ix"), "_off"), ["_m", "near_iy", "near_ix"]).select("_m", "iy", "ix", "_off")
    offsets = seen.unionByName(lent)
    return month.join(offsets, ["_m", "iy", "ix"], "left").withColumn(out, F.coalesce(F.col(x), F.col(model) + F.coalesce("_off", F.lit(0.0)))).drop("_m", "_off")


def zonal_stats(pixels: DataFrame, keys: Sequence[str], zones: DataFrame, zid: str, x: str, hot: Column, radius: int, ring: tuple[int, int]) -> DataFrame:
    """Count, mean, maximum and hot pixels inside a disc per zone, and the mean of a ring around it.

    A zone is spread over the cells it covers, so the join is by cell.
    """
    keys = list(keys)
    reach = max(radius, ring[1])
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    cover = zones.select(zid, "cy", "cx").withColumn("_dy", step).withColumn("_dx", step)
    r2 = F.col("_dy") * F.col("_dy") + F.col("_dx") * F.col("_dx")
    cover = cover.withColumn("_in", r2 <= radius * radius).withColumn("_ring", (r2 > ring[0] * ring[0]) & (r2 <= ring[1] * ring[1])).where("_in OR _ring")
    cover = cover.select(zid, (F.col("cy") + F.col("_dy")).alias("iy"), (F.col("cx") + F.col("_dx")).alias("ix"), "_in", "_ring")
    inside = lambda v: F.when(F.col("_in"), v)
    return pixels.withColumn("_hot", hot).join(cover, ["iy", "ix"]).groupBy(*keys, zid).agg(
        F.count(inside(F.col(x))).alias("n"), F.avg(inside(F.col(x))).alias("mean"), F.max(inside(F.col(x))).alias("top"),
        F.count(F.when(F.col("_in") & F.col("_hot"), 1)).alias("hot"), F.avg(F.when(F.col("_ring"), F.col(x))).alias("ring_mean"),
    )


def pick_scene(scenes: DataFrame, by: Sequence[str], cloud: str, sid: str, worst: bool = False) -> DataFrame:
    """Clearest (or cloudiest) scene per site; ties go to the smaller id."""
    key = F.struct((-F.col(cloud) if worst else F.col(cloud)).alias("c"), F.col(sid))
    return scenes.groupBy(*by).agg(F.min_by(F.struct(sid, cloud), key).alias("_b")).select(*by, "_b.*")


def verify_sites(pixels: DataFrame, site: str, scene: str, hot: Column, shape: tuple[int, int]) -> DataFrame:
    """A site is verified when two scenes show two hot pixels; position of the largest hot patch
    of its best scene."""
    counts = pixels.groupBy(site, scene).agg(F.count(F.when(hot, 1)).alias("_hot"))
    sites = counts.groupBy(site).agg(F.sum("_hot").alias("hot_pixels"), F.count(F.when(F.col("_hot") >= 2, 1)).alias("scenes_hot"), F.min_by(scene, F.struct(-F.col("_hot"), F.col(scene))).alias(scene))
    best = sites.where("scenes_hot >= 1").select(scene)
    labels = label_patches(pixels.join(best, scene, "left_semi"), scene, hot, shape)
    patches = labels.groupBy(scene, "label").agg(F.count(F.lit(1)).alias("size"), F.avg("iy").alias("cy"), F.avg("ix").alias("cx"))
    big = patches.groupBy(scene).agg(F.min_by(F.struct("cy", "cx", "size"), F.struct(-F.col("size"), F.col("label"))).alias("_b"))
    return sites.join(big, scene, "left").select(site, "hot_pixels", "scenes_hot", (F.col("scenes_hot") >= 2).alias("verified"), "_b.cy", "_b.cx", F.col("_b.size").alias("patch_size"))


def ring_contrast(pixels: DataFrame, keys: Sequence[str], x: str, guard: int, outer: int, shape: tuple[int, int]) -> DataFrame:
    """z-score of each pixel against the ring between two boxes, image mirrored at its edges."""
    keys = list(keys)
    base = pixels.select(*keys, "iy", "ix", F.col(x).alias("_s"), (F.col(x) * F.col(x)).alias("_q"))
    big = box_sums(base, keys, ["_s", "_q"], outer, shape, "reflect").withColumnsRenamed({"_s": "_s1", "_q": "_q1"})
    small = box_sums(base, keys, ["_s", "_q"], guard, shape, "reflect")
    n = float((2 * outer + 1) ** 2 - (2 * guard + 1) ** 2)
    mean = (F.col("_s1") - F.col("_s")) / n
    sd = F.sqrt(F.greatest((F.col("_q1") - F.col("_q")) / n - mean * mean, F.lit(1e-6)))
    at = [*keys, "iy", "ix"]
    return pixels.join(big, at).join(small, at).withColumn("z", (F.col(x) - mean) / sd).drop("_s", "_q", "_s1", "_q1")


def static_mask(pixels: DataFrame, keys: Sequence[str], scene: str, bright: Column, n: int, shape: tuple[int, int], share: float = 0.6) -> DataFrame:
    """Cells that are mostly bright around them in most passes (land): one vote per pass."""
    keys = list(keys)
    votes = pixels.withColumn("_b", F.when(bright, 1.0).otherwise(0.0))
    near = box_sums(votes, [*keys, scene], ["_b"], n, shape, "reflect")
    vote = F.when(F.col("_b") / float((2 * n + 1) ** 2) > 0.5, 1.0).otherwise(0.0)
    return near.groupBy(*keys, "iy", "ix").agg((F.avg(vote) > share).alias("land"))


def detect_objects(pixels: DataFrame, scene: str, hit: Column, x: str, shape: tuple[int, int], size: tuple[int, int], peak: float, elongation: float) -> DataFrame:
    """Objects among the hit pixels, by size, brightness and elongation of their shape."""
    labels = label_patches(pixels, scene, hit, shape)
    obj = labels.join(pixels.select(scene, "iy", "ix", x), [scene, "iy", "ix"]).groupBy(scene, "label").agg(
        F.count(F.lit(1)).alias("size"), F.avg("iy").alias("cy"), F.avg("ix").alias("cx"), F.max(x).alias("peak"),
        F.coalesce(F.var_samp("iy"), F.lit(0.0)).alias("_yy"), F.coalesce(F.var_samp("ix"), F.lit(0.0)).alias("_xx"), F.coalesce(F.covar_samp("iy", "ix"), F.lit(0.0)).alias("_xy"),
    )
    half = (F.col("_yy") + F.col("_xx")) / 2
    root = F.sqrt(F.pow((F.col("_yy") - F.col("_xx")) / 2, F.lit(2)) + F.col("_xy") * F.col("_xy"))
    long = F.sqrt((half + root) / F.greatest(half - root, F.lit(0.25)))
    keep = F.col("size").between(*size) & (F.col("peak") >= peak) & ((F.col("size") < 8) | (long <= elongation))
    return obj.where(keep).select(scene, "label", "size", "cy", "cx", "peak", long.alias("elongation"))


def morans_i(pixels: DataFrame, scene: str, x: str, shape: tuple[int, int]) -> DataFrame:
    """Spatial autocorrelation over the upper and left neighbours, edges wrapped."""
    mean = pixels.groupBy(scene).agg(F.avg(x).alias("_m"))
    z = pixels.join(mean, scene).select(scene, "iy", "ix", (F.col(x) - F.col("_m")).alias("_z"))
    n = neighbours(z, [scene], F.col("_z"), shape, ((1, 0), (0, 1)))
    return n.groupBy(scene).agg(F.try_divide(F.sum(F.col("own") * F.col("near_sum")), F.sum(F.col("own") * F.col("own")) * 2).alias("moran"))


def block_variance(pixels: DataFrame, scene: str, x: str, k: int, shape: tuple[int, int]) -> DataFrame:
    """Variance of the positive k x k block means (ddof 0)."""
    b = block_mean(pixels, [scene], [x], k, shape).where(F.col(x) > 0)
    return b.groupBy(scene).agg(F.var_pop(x).alias("block_variance"), F.count(F.lit(1)).alias("blocks"))


def grid_profile(points: DataFrame, grid: DataFrame, pid: str, gid: str, x: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point's nearest grid site and that site's percentile among all sites."""
    from strandline.operators.spatial import nearest
    from strandline.operators.ordering import value_ranks

    ranks = value_ranks(grid, [], x).select(x, (F.col("n_below") / F.col("n_all") * 100).alias("percentile"))
    known = grid.select(gid, x).join(ranks, x)
    return nearest(points, grid, pid, gid, lat, lon).join(known, gid).select(pid, gid, "km", x, "percentile")
