"""Raster, spatial and graph operators, and data-quality checks."""

from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators import quality as Q
from strandline.operators import raster as R
from strandline.plans.family_c import _located, located_sql
from strandline.plans.registry import query

SHAPE = (8, 8)


def r(c, n=6):
    return F.round(c, n)


def _patch_sql(wrap):
    near = "(abs(a.iy - b.iy) + abs(a.ix - b.ix) = 1" + (" OR (a.iy = b.iy AND abs(a.ix - b.ix) = 7) OR (a.ix = b.ix AND abs(a.iy - b.iy) = 7)" if wrap else "") + ")"
    return f"""WITH RECURSIVE m AS (SELECT scene, iy, ix, iy * 8 + ix AS c FROM pixels WHERE v > 0.02),
    e AS (SELECT a.scene, a.c AS x, b.c AS y FROM m a JOIN m b ON a.scene = b.scene AND {near}),
    q AS (SELECT scene, c AS x, c AS y FROM m UNION SELECT q.scene, q.x, e.y FROM q JOIN e ON e.scene = q.scene AND e.x = q.y),
    l AS (SELECT scene, x, min(y) AS label FROM q GROUP BY 1, 2)"""


@query("h1_label_patches", _patch_sql(False) + " SELECT l.scene, m.iy, m.ix, CAST(label AS BIGINT) AS label FROM l JOIN m ON m.scene = l.scene AND m.c = l.x", "pixels")
def h1(t):
    return R.label_patches(t.pixels(), "scene", F.col("v") > 0.02, SHAPE)


@query("h1_label_patches_periodic", _patch_sql(True) + " SELECT l.scene, m.iy, m.ix, CAST(label AS BIGINT) AS label FROM l JOIN m ON m.scene = l.scene AND m.c = l.x", "pixels")
def h1p(t):
    return R.label_patches(t.pixels(), "scene", F.col("v") > 0.02, SHAPE, True)


@query(
    "h2_patch_stats",
    _patch_sql(False) + """, s AS (SELECT l.scene, label, count(*) AS size, max((iy = 0)::INT) * max((iy = 7)::INT) AS sp FROM l JOIN m ON m.scene = l.scene AND m.c = l.x GROUP BY 1, 2)
    SELECT scene, count(*) AS patches, CAST(sum(size) AS BIGINT) AS cells, max(size) AS largest, round(max(size) / sum(size), 6) AS largest_share, max(sp) = 1 AS spans FROM s GROUP BY 1""",
    "pixels",
)
def h2(t):
    return R.patch_stats(R.label_patches(t.pixels(), "scene", F.col("v") > 0.02, SHAPE), "scene", 8).withColumn("largest_share", r("largest_share"))


_NEAR = "(abs(a.iy - b.iy) + abs(a.ix - b.ix) = 1 OR (a.iy = b.iy AND abs(a.ix - b.ix) = 7) OR (a.ix = b.ix AND abs(a.iy - b.iy) = 7))"


@query(
    "h3_clump_index",
    f"""WITH n AS (SELECT a.scene, a.iy, a.ix, any_value(a.v) > 0.02 AS me, sum((b.v > 0.02)::INT) / 4 AS q FROM pixels a JOIN pixels b ON a.scene = b.scene AND {_NEAR} GROUP BY 1, 2, 3)
    SELECT scene, CASE WHEN avg(me::INT) > 0 AND avg(me::INT) < 1 THEN round(avg(q) FILTER (WHERE me) / avg(me::INT), 6) END AS clump, round(avg(me::INT), 6) AS cover FROM n GROUP BY 1""",
    "pixels",
)
def h3(t):
    return R.clump_index(t.pixels(), "scene", F.col("v") > 0.02, SHAPE).select("scene", r("clump").alias("clump"), r("cover").alias("cover"))


@query(
    "h4_otsu_threshold",
    """WITH s AS (SELECT label, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY 1),
    h AS (SELECT p.label, lo, hi, least(floor((v - lo) / (hi - lo) * 256), 255) AS b, count(*) AS n FROM pixels p JOIN s ON s.label = p.label GROUP BY 1, 2, 3, 4),
    q AS (SELECT label, b, lo + (b + 0.5) * (hi - lo) / 256 AS mid, n / sum(n) OVER (PARTITION BY label) AS p FROM h),
    w AS (SELECT *, sum(p) OVER k AS w, sum(p * mid) OVER k AS m, sum(p * mid) OVER (PARTITION BY label) AS a FROM q WINDOW k AS (PARTITION BY label ORDER BY b)),
    z AS (SELECT label, b, mid, CASE WHEN w < 1 - 1e-12 THEN pow(a * w - m, 2) / greatest(w * (1 - w), 1e-12) ELSE 0 END AS s FROM w)
    SELECT label, round(arg_min(mid, (-round(s, 12), b)), 6) AS threshold FROM z GROUP BY 1""",
    "pixels",
)
def h4(t):
    return R.otsu_threshold(t.pixels(), "label", "v").select("label", r("threshold").alias("threshold"))


@query("h5_cover_match_threshold", "SELECT label, round(quantile_cont(v, 0.7), 6) AS threshold FROM pixels GROUP BY 1", "pixels")
def h5(t):
    return R.cover_match_threshold(t.pixels(), "label", "v", 0.3).select("label", r("threshold").alias("threshold"))


@query("h6_block_mean", "SELECT scene, CAST(iy // 3 AS INTEGER) AS iy, CAST(ix // 3 AS INTEGER) AS ix, round(avg(v), 6) AS v FROM pixels WHERE iy < 6 AND ix < 6 GROUP BY 1, 2, 3", "pixels")
def h6(t):
    return R.block_mean(t.pixels(), ["scene"], ["v"], 3, SHAPE).withColumn("v", r("v"))


@query(
    "h7_slope",
    """WITH g AS (SELECT scene, iy, ix, (coalesce(lead(v) OVER x, v) - coalesce(lag(v) OVER x, v)) / CASE WHEN ix IN (0, 7) THEN 0.1 ELSE 0.2 END AS gx,
        (coalesce(lead(v) OVER y, v) - coalesce(lag(v) OVER y, v)) / CASE WHEN iy IN (0, 7) THEN 0.1 ELSE 0.2 END AS gy FROM pixels
        WINDOW x AS (PARTITION BY scene, iy ORDER BY ix), y AS (PARTITION BY scene, ix ORDER BY iy))
    SELECT scene, iy, ix, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope FROM g""",
    "pixels",
)
def h7(t):
    return R.slope(t.pixels(), ["scene"], "v", 0.1).select("scene", "iy", "ix", r("slope", 5).alias("slope"))


@query(
    "h7_topographic_position",
    """WITH o AS (SELECT unnest(range(-2, 3)) AS dy), p AS (SELECT unnest(range(-2, 3)) AS dx)
    SELECT a.scene, a.iy, a.ix, round(any_value(a.v) - avg(b.v), 6) AS tpi FROM pixels a, o, p JOIN pixels b ON b.scene = a.scene AND b.iy = least(greatest(a.iy + dy, 0), 7) AND b.ix = least(greatest(a.ix + dx, 0), 7) GROUP BY 1, 2, 3""",
    "pixels",
)
def h7t(t):
    return R.topographic_position(t.pixels(), ["scene"], "v", 2, SHAPE).select("scene", "iy", "ix", r("tpi").alias("tpi"))


@query(
    "h7_distance_to_mask",
    "SELECT a.scene, a.iy, a.ix, round(coalesce(min(sqrt(pow(a.iy - b.iy, 2) + pow(a.ix - b.ix, 2))), 300), 6) AS distance FROM pixels a LEFT JOIN pixels b ON a.scene = b.scene AND b.v > 0.2 GROUP BY 1, 2, 3",
    "pixels",
)
def h7d(t):
    return R.distance_to_mask(t.pixels(), ["scene"], F.col("v") > 0.2, 1.0).select("scene", "iy", "ix", r("distance").alias("distance"))


@query(
    "h8_bilinear_regrid",
    """WITH f AS (SELECT c_custkey AS fid, least(greatest((c_custkey % 90) / 10.0 - 0.5, 0), 7) AS row, least(greatest((c_custkey % 83) / 10.0 - 0.3, 0), 7) AS col FROM customer),
    g AS (SELECT fid, row, col, least(floor(row), 6) AS y0, least(floor(col), 6) AS x0 FROM f),
    k AS (SELECT fid, y0 + dy AS iy, x0 + dx AS ix, CASE dy WHEN 1 THEN row - y0 ELSE 1 - (row - y0) END * CASE dx WHEN 1 THEN col - x0 ELSE 1 - (col - x0) END AS w
        FROM g, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)), c AS (SELECT label, iy, ix, avg(v) AS v FROM pixels GROUP BY 1, 2, 3)
    SELECT label, fid, round(sum(w * v), 6) AS v FROM k JOIN c ON c.iy = k.iy AND c.ix = k.ix GROUP BY 1, 2""",
    "pixels",
)
def h8(t):
    key = F.col("c_custkey")
    fine = t.raw("customer").select(key.alias("fid"), ((key % 90) / 10.0 - 0.5).alias("row"), ((key % 83) / 10.0 - 0.3).alias("col"))
    coarse = t.pixels().groupBy("label", "iy", "ix").agg(F.avg("v").alias("v"))
    return R.bilinear_regrid(coarse, fine, ["label"], "v", "fid", SHAPE).withColumn("v", r("v"))


_GAPS = "g AS (SELECT scene, CAST(scene % 12 + 1 AS INTEGER) AS mon, iy, ix, CASE WHEN v > -0.05 AND (iy * 8 + ix + scene % 12) % 5 <> 0 THEN v END AS x, iy * 0.01 + ix * 0.02 AS skin FROM pixels)"


@query(
    "h8_gap_offset_fill",
    f"""WITH {_GAPS}, o AS (SELECT mon, iy, ix, avg(x - skin) AS off FROM g GROUP BY 1, 2, 3),
    z AS (SELECT a.mon, a.iy, a.ix, CASE WHEN a.off IS NOT NULL THEN a.off ELSE (SELECT arg_min(b.off, (pow(a.iy - b.iy, 2) + pow(a.ix - b.ix, 2), b.iy, b.ix)) FROM o b WHERE b.mon = a.mon AND b.off IS NOT NULL) END AS off FROM o a)
    SELECT g.scene, g.iy, g.ix, round(coalesce(x, skin + coalesce(off, 0)), 6) AS filled FROM g JOIN z ON z.mon = g.mon AND z.iy = g.iy AND z.ix = g.ix""",
    "pixels",
)
def h8g(t):
    mon = F.col("scene") % 12
    g = t.pixels().select(
        "scene", F.make_date(F.lit(2000), (mon + 1).cast("int"), F.lit(1)).alias("d"), "iy", "ix",
        F.when((F.col("v") > -0.05) & ((F.col("iy") * 8 + F.col("ix") + mon) % 5 != 0), F.col("v")).alias("x"), (F.col("iy") * 0.01 + F.col("ix") * 0.02).alias("skin"),
    )
    return R.gap_offset_fill(g, "d", "x", "skin").select("scene", "iy", "ix", r("filled").alias("filled"))


def _order_chain(t):
    """Successive orders of a customer as a path: long chains, many components."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.raw("orders").select(F.lag("o_orderkey").over(w).alias("src"), F.col("o_orderkey").alias("dst"))
    return o.where("src IS NOT NULL")


@query("h9_connected_components", "SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def h9(t):
    return G.connected_components(_order_chain(t), "src", "dst", t.raw("orders").select(F.col("o_orderkey").alias("id")))


_DEG = """de AS (SELECT id, sum(o) AS k, sum(i) AS j FROM (SELECT 's' || src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT 'c' || dst, 0, 1 FROM edges) GROUP BY 1)"""


def _named_edges(t):
    return t.edges().select(F.concat(F.lit("s"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("dst").cast("string")).alias("dst"))


@query("h10_degree_stats", f"WITH {_DEG} SELECT id, CAST(k AS BIGINT) AS out_degree, CAST(j AS BIGINT) AS in_degree FROM de", "edges")
def h10(t):
    return G.degree_stats(_named_edges(t), "src", "dst")


@query(
    "h10_percolation_threshold",
    f"""WITH {_DEG}
    SELECT count(*) AS nodes, round(avg(k) / nullif(avg(j * k), 0), 8) AS directed, round(avg(k + j) / (avg(pow(k + j, 2)) - avg(k + j)), 8) AS undirected FROM de""",
    "edges",
)
def h10t(t):
    return G.percolation_threshold(G.degree_stats(_named_edges(t), "src", "dst")).select("nodes", r("directed", 8).alias("directed"), r("undirected", 8).alias("undirected"))


@query(
    "h11_assortativity",
    f"""WITH {_DEG}, p AS (SELECT a.k + a.j AS x, b.k + b.j AS y FROM edges JOIN de a ON a.id = 's' || src JOIN de b ON b.id = 'c' || dst)
    SELECT round((SELECT corr(x, y) FROM (SELECT x, y FROM p UNION ALL SELECT y, x FROM p)), 6) AS r, (SELECT count(*) FROM p) AS edges""",
    "edges",
)
def h11(t):
    return G.assortativity(_named_edges(t), "src", "dst").select(r("r").alias("r"), "edges")


@query("h11_correlated_threshold")
def h11c(t):
    return G.correlated_threshold(_named_edges(t), "src", "dst").select(r("threshold", 8).alias("threshold"), "degrees")


@query("h12_thin_edges")
def h12(t):
    return G.thin_edges(t.edges(), "src", "dst", 0.3, 5).groupBy("draw").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("src").alias("suppliers"))


_SUPPLY = """su AS (SELECT DISTINCT l_partkey * 4 AS src, l_suppkey * 4 + 1 AS dst FROM lineitem UNION SELECT src * 4 + 1, dst * 4 + 2 FROM edges)"""


def _supply(t):
    parts = t.raw("lineitem").select((F.col("l_partkey") * 4).alias("src"), (F.col("l_suppkey") * 4 + 1).alias("dst")).distinct()
    return parts.unionByName(t.edges().select((F.col("src") * 4 + 1).alias("src"), (F.col("dst") * 4 + 2).alias("dst")))


@query(
    "h13_cascade_reach",
    f"""WITH RECURSIVE {_SUPPLY}, re AS (SELECT p_partkey * 4 AS id FROM part WHERE p_partkey % 50 = 7 UNION SELECT dst FROM re JOIN su ON src = id) SELECT id FROM re""",
    "edges",
)
def h13(t):
    seeds = t.raw("part").where("p_partkey % 50 = 7").select((F.col("p_partkey") * 4).alias("id"))
    return G.cascade_reach(_supply(t), seeds, "src", "dst").select("id")


@query("h13_output_loss")
def h13l(t):
    """Mean loss over thinned copies of the supplier network: balance-weighted customers reached."""
    thin = G.thin_edges(_supply(t), "src", "dst", 0.05, 4)
    seeds = t.raw("part").where("p_partkey % 20 = 7").select((F.col("p_partkey") * 4).alias("id")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(3))))
    reached = G.cascade_reach(thin, seeds, "src", "dst", ["draw"])
    nodes = t.raw("customer").select((F.col("c_custkey") * 4 + 2).alias("id"), F.greatest("c_acctbal", F.lit(0.0)).alias("w"))
    return G.output_loss(nodes, reached, ["draw"], "w", F.lit(True)).withColumn("loss", r("loss"))


@query("h14_threshold_cascade")
def h14(t):
    seeds = t.raw("supplier").where("s_nationkey < 8").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return G.threshold_cascade(_named_edges(t), "src", "dst", seeds, 0.3)


@query(
    "h15_tail_by_model",
    """SELECT l_returnflag AS model, l_linenumber AS level, count(*) AS n, round(avg(l_discount), 6) AS mean, round(avg((l_discount > 0.05)::INT), 6) AS p_over_5, round(avg((l_discount > 0.08)::INT), 6) AS p_over_8,
    round(quantile_cont(l_discount, 0.95), 6) AS p95, round(quantile_cont(l_discount, 0.99), 6) AS p99 FROM lineitem GROUP BY 1, 2""",
)
def h15(t):
    li = t.raw("lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("level"), "l_discount")
    out = G.tail_by_model(li, ["model", "level"], "l_discount", {"p_over_5": 0.05, "p_over_8": 0.08})
    return out.select("model", "level", "n", *[r(c).alias(c) for c in ("mean", "p_over_5", "p_over_8", "p95", "p99")])


@query(
    "h16_zonal_stats",
    """WITH z AS (SELECT n_nationkey AS zone, n_nationkey % 8 AS cy, (n_nationkey * 3) % 8 AS cx FROM nation),
    j AS (SELECT scene, zone, v, pow(iy - cy, 2) + pow(ix - cx, 2) AS d FROM pixels, z WHERE pow(iy - cy, 2) + pow(ix - cx, 2) <= 16)
    SELECT scene, zone, count(*) FILTER (WHERE d <= 4) AS n, round(avg(v) FILTER (WHERE d <= 4), 6) AS mean, round(max(v) FILTER (WHERE d <= 4), 6) AS top, count(*) FILTER (WHERE d <= 4 AND v > 0.1) AS hot,
    round(avg(v) FILTER (WHERE d > 9), 6) AS ring_mean FROM j GROUP BY 1, 2""",
    "pixels",
)
def h16(t):
    key = F.col("n_nationkey")
    zones = t.raw("nation").select(key.alias("zone"), (key % 8).alias("cy"), ((key * 3) % 8).alias("cx"))
    out = R.zonal_stats(t.pixels(), ["scene"], zones, "zone", "v", F.col("v") > 0.1, 2, (3, 4))
    return out.select("scene", "zone", "n", r("mean").alias("mean"), r("top").alias("top"), "hot", r("ring_mean").alias("ring_mean"))


@query(
    "h17_pick_scene",
    """SELECT l_suppkey, arg_min(l_orderkey * 8 + l_linenumber, (l_discount, l_orderkey * 8 + l_linenumber)) AS sid, min(l_discount) AS cloud FROM lineitem GROUP BY 1""",
)
def h17(t):
    s = t.raw("lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sid"), F.col("l_discount").alias("cloud"))
    return R.pick_scene(s, ["l_suppkey"], "cloud", "sid")


@query(
    "h18_verify_sites",
    """WITH c AS (SELECT label AS site, scene, count(*) FILTER (WHERE v > 0.2) AS hot FROM pixels GROUP BY 1, 2)
    SELECT site, CAST(sum(hot) AS BIGINT) AS hot_pixels, count(*) FILTER (WHERE hot >= 2) AS scenes_hot, count(*) FILTER (WHERE hot >= 2) >= 2 AS verified FROM c GROUP BY 1""",
    "pixels",
)
def h18(t):
    p = t.pixels().withColumnRenamed("label", "site")
    return R.verify_sites(p, "site", "scene", F.col("v") > 0.2, SHAPE).select("site", "hot_pixels", "scenes_hot", "verified")


@query("h18_hot_centroids")
def h18c(t):
    p = t.pixels().withColumnRenamed("label", "site")
    return R.verify_sites(p, "site", "scene", F.col("v") > 0.2, SHAPE).select("site", "verified", r("cy").alias("cy"), r("cx").alias("cx"), "patch_size")


_MIRROR = """(SELECT scene, unnest(list_distinct(list_filter([iy, -1 - iy, 15 - iy], lambda q: q >= -3 AND q <= 10))) AS iy, ix, v FROM pixels)"""


@query(
    "h19_ring_contrast",
    f"""WITH py AS {_MIRROR}, pa AS (SELECT scene, iy, unnest(list_distinct(list_filter([ix, -1 - ix, 15 - ix], lambda q: q >= -3 AND q <= 10))) AS ix, v FROM py),
    s AS (SELECT a.scene, a.iy, a.ix, any_value(a.v) AS v, sum(b.v) AS s, sum(b.v * b.v) AS q FROM pixels a JOIN pa b ON b.scene = a.scene AND greatest(abs(b.iy - a.iy), abs(b.ix - a.ix)) IN (2, 3) GROUP BY 1, 2, 3)
    SELECT scene, iy, ix, round((v - s / 40) / sqrt(greatest(q / 40 - pow(s / 40, 2), 1e-6)), 5) AS z FROM s""",
    "pixels",
)
def h19(t):
    return R.ring_contrast(t.pixels(), ["scene"], "v", 1, 3, SHAPE).select("scene", "iy", "ix", r("z", 5).alias("z"))


@query("h19_static_mask")
def h19s(t):
    p = t.pixels()
    return R.static_mask(p, ["label"], "scene", F.col("v") > 0.0, 1, SHAPE, 0.5).select("label", "iy", "ix", "land")


@query("h19_detect_objects")
def h19d(t):
    z = R.ring_contrast(t.pixels(), ["scene"], "v", 1, 3, SHAPE)
    out = R.detect_objects(z, "scene", F.col("z") > 1.5, "v", SHAPE, (1, 40), 0.1, 6.0)
    return out.select("scene", "label", "size", r("cy").alias("cy"), r("cx").alias("cx"), r("peak").alias("peak"), r("elongation").alias("elongation"))


@query(
    "h20_morans_i",
    """WITH z AS (SELECT scene, iy, ix, v - avg(v) OVER (PARTITION BY scene) AS z FROM pixels)
    SELECT a.scene, round(sum(a.z * (b.z + c.z)) / (2 * sum(a.z * a.z)), 6) AS moran FROM z a JOIN z b ON b.scene = a.scene AND b.ix = a.ix AND b.iy = (a.iy + 7) % 8 JOIN z c ON c.scene = a.scene AND c.iy = a.iy AND c.ix = (a.ix + 7) % 8 GROUP BY 1""",
    "pixels",
)
def h20(t):
    return R.morans_i(t.pixels(), "scene", "v", SHAPE).withColumn("moran", r("moran"))


@query(
    "h20_block_variance",
    """WITH b AS (SELECT scene, iy // 2 AS y, ix // 2 AS x, avg(v) AS v FROM pixels GROUP BY 1, 2, 3) SELECT scene, round(var_pop(v), 8) AS block_variance, count(*) AS blocks FROM b WHERE v > 0 GROUP BY 1""",
    "pixels",
)
def h20b(t):
    return R.block_variance(t.pixels(), "scene", "v", 2, SHAPE).withColumn("block_variance", r("block_variance", 8))


_HAV = """12742.0 * asin(sqrt(least(1.0, pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2))))"""


@query(
    "h21_grid_profile",
    f"""WITH p AS {located_sql('customer', 'c_custkey', 'c_nationkey')}, g AS (SELECT x.*, s_acctbal FROM {located_sql('supplier', 's_suppkey', 's_nationkey')} x JOIN supplier USING (s_suppkey)),
    k AS (SELECT c_custkey, arg_min(s_suppkey, (round({_HAV}, 9), s_suppkey)) AS s_suppkey, round(min({_HAV}), 4) AS km FROM p, g GROUP BY 1)
    SELECT c_custkey, k.s_suppkey, km, round((SELECT count(*) FROM supplier q WHERE q.s_acctbal < s.s_acctbal) * 100.0 / (SELECT count(*) FROM supplier), 6)::DOUBLE AS percentile FROM k JOIN supplier s ON s.s_suppkey = k.s_suppkey""",
    "sites",
)
def h21(t):
    points = _located(t, "customer", "c_custkey", "c_nationkey")
    grid = _located(t, "supplier", "s_suppkey", "s_nationkey").join(t.raw("supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    out = R.grid_profile(points, grid, "c_custkey", "s_suppkey", "s_acctbal")
    return out.select("c_custkey", "s_suppkey", r("km", 4).alias("km"), r("percentile").alias("percentile"))


# ---- quality: an hourly cube from the events, with the sun as a rule on the hour --------------

_CUBE = """cu AS (SELECT h, entity AS cell, CASE WHEN n >= 2 THEN value * 1000 ELSE NULL END AS ssrd, value AS "2t", greatest(0.0, cos(2 * pi() * (h % 24 - 12) / 24)) AS ins FROM hourly),
    pv AS (SELECT *, coalesce(lag(ins) OVER (PARTITION BY cell ORDER BY h), ins) AS prev FROM cu)"""


def cube(t):
    h = F.col("h")
    ins = F.greatest(F.lit(0.0), F.cos((h % 24 - 12) * (2 * 3.141592653589793) / 24))
    return t.hourly().select("h", F.col("entity").alias("cell"), F.when(F.col("n") >= 2, F.col("value") * 1000).alias("ssrd"), F.col("value").alias("2t"), ins.alias("ins"))


@query(
    "i1_check_time_axis",
    """WITH d AS (SELECT DISTINCT entity, h FROM hourly), g AS (SELECT entity, h, lead(h) OVER (PARTITION BY entity ORDER BY h) - h AS gap FROM d)
    SELECT entity, count(*) AS steps, count(*) FILTER (WHERE gap <> 1) AS irregular, min(h) FILTER (WHERE gap <> 1) AS first_after, count(*) FILTER (WHERE gap <> 1) = 0 AS ok FROM g GROUP BY 1""",
    "hourly",
)
def i1(t):
    return Q.check_time_axis(t.hourly(), "h", 1, ["entity"])


@query("i2_check_missing", f"WITH {_CUBE} SELECT 'ssrd' AS variable, count(*) - count(ssrd) AS missing, count(*) = count(ssrd) AS ok FROM cu UNION ALL SELECT '2t', count(*) - count(\"2t\"), count(*) = count(\"2t\") FROM cu", "hourly")
def i2(t):
    return Q.check_missing(cube(t), ["ssrd", "2t"])


@query(
    "i3_check_ranges",
    f"""WITH {_CUBE} SELECT 'ssrd' AS variable, min(ssrd) AS lowest, max(ssrd) AS highest, NOT (min(ssrd) < 0 OR max(ssrd) > 4899600) AS ok FROM cu
    UNION ALL SELECT '2t', min("2t"), max("2t"), NOT (min("2t") < 200 OR max("2t") > 335) FROM cu""",
    "hourly",
)
def i3(t):
    return Q.check_ranges(cube(t), {c: Q.RANGES[c] for c in ("ssrd", "2t")})


@query("i4_check_units", f"WITH {_CUBE} SELECT max(ssrd) AS peak, max(ssrd) >= 10000 AS ok FROM cu", "hourly")
def i4(t):
    return Q.check_units(cube(t), "ssrd")


_OVER = "ssrd / 3600 > greatest(ins, prev) * 1361.0 * 1.02 + 1.0"
_DARK = "ins <= 0 AND prev <= 0"


@query("i5_check_upper_bound", f'WITH {_CUBE} SELECT count(*) FILTER (WHERE {_OVER}) AS "over", min(h) FILTER (WHERE {_OVER}) AS "first", count(*) FILTER (WHERE {_OVER}) = 0 AS ok FROM pv', "hourly")
def i5(t):
    return Q.check_upper_bound(cube(t), "h", ["cell"], "ssrd", "ins")


@query("i6_check_zero_when_dark", f"WITH {_CUBE} SELECT count(*) FILTER (WHERE {_DARK} AND ssrd / 3600 > 1) AS lit, count(*) FILTER (WHERE {_DARK}) AS night, count(*) FILTER (WHERE {_DARK} AND ssrd / 3600 > 1) = 0 AS ok FROM pv", "hourly")
def i6(t):
    return Q.check_zero_when_dark(cube(t), "h", ["cell"], "ssrd", "ins")


@query(
    "i7_run_checks",
    f"""WITH {_CUBE}, ax AS (SELECT count(*) FILTER (WHERE gap <> 1) AS v FROM (SELECT lead(h) OVER (ORDER BY h) - h AS gap FROM (SELECT DISTINCT h FROM cu))),
    a AS (SELECT count(*) - count(ssrd) + count(*) - count("2t") + count(*) - count(ins) AS missing, (min(ssrd) < 0 OR max(ssrd) > 4899600)::INT + (min("2t") < 200 OR max("2t") > 335)::INT AS ranges, max(ssrd) AS peak,
        count(*) FILTER (WHERE {_OVER}) AS ov, count(*) FILTER (WHERE {_DARK} AND ssrd / 3600 > 1) AS lit FROM pv)
    SELECT 'time axis' AS "check", v = 0 AS ok, CAST(v AS BIGINT) AS detail FROM ax UNION ALL SELECT 'missing values', missing = 0, missing FROM a UNION ALL SELECT 'physical ranges', ranges = 0, ranges FROM a
    UNION ALL SELECT 'units', peak >= 10000, CAST(floor(peak) AS BIGINT) FROM a UNION ALL SELECT 'upper bound', ov = 0, ov FROM a UNION ALL SELECT 'dark at night', lit = 0, lit FROM a""",
    "hourly",
)
def i7(t):
    return Q.run_checks(cube(t), "h", 1, ["cell"], "ssrd", "ins", {c: Q.RANGES[c] for c in ("ssrd", "2t")})


@query(
    "i7_own_checks",
    f"""WITH {_CUBE}, a AS (SELECT count(*) - count(ssrd) + count(*) - count("2t") + count(*) - count(ins) AS missing, max(ssrd) AS peak, count(*) FILTER (WHERE "2t" < 280) AS cold, count(DISTINCT cell) AS cells FROM pv)
    SELECT 'missing values' AS "check", missing = 0 AS ok, CAST(missing AS BIGINT) AS detail FROM a UNION ALL SELECT 'units', peak >= 5, CAST(floor(peak) AS BIGINT) FROM a
    UNION ALL SELECT 'cold hours', cold = 0, cold FROM a UNION ALL SELECT 'cells', cells > 1, cells FROM a""",
    "hourly",
)
def i7own(t):
    own = {
        "units": (F.floor(F.max("ssrd")), lambda v: v >= 5), "cold hours": (F.count(F.when(F.col("2t") < 280, 1)), lambda v: v == 0),
        "cells": (F.count_distinct("cell"), lambda v: v > 1), "unused": (F.count(F.lit(1)), lambda v: v > 0),
    }
    skip = ["time axis", "physical ranges", "upper bound", "dark at night", "unused"]
    return Q.run_checks(cube(t), "h", 1, ["cell"], "ssrd", "ins", {c: Q.RANGES[c] for c in ("ssrd", "2t")}, own, skip)
