"""Graph operators as joins and aggregates over an edge table.

Loops stop when a fingerprint of the state stays the same.  Each round ends in a reliable
checkpoint, so a lost executor costs one round.  A hub's edges meet only in joins (split by
the adaptive skew join) and in aggregates with partial combining.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.resample import hash_uniform
from strandline.storage import cut_lineage


def _fingerprint(df: DataFrame) -> tuple:
    """Count and order-free hash of a table: one small row."""
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame, src: str, dst: str, nodes: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """``(id, component)``: the smallest id reachable from each node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which end in a star per
    component after few rounds whatever the diameter.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if nodes is None:
        nodes = edges.select(F.col(src).alias("id")).union(edges.select(F.col(dst).alias("id"))).distinct()
    return nodes.join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def degree_stats(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Out- and in-degree of every node: one aggregate over both ends of each edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def percolation_threshold(deg: DataFrame) -> DataFrame:
    """Directed <k>/<jk> and undirected <k>/(<k^2> - <k>)."""
    k, j = F.col("out_degree"), F.col("in_degree")
    d = k + j
    return deg.agg(
        F.count(F.lit(1)).alias("nodes"), F.try_divide(F.avg(k), F.avg(j * k)).alias("directed"), F.try_divide(F.avg(d), F.avg(d * d) - F.avg(d)).alias("undirected")
    )


def _edge_degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    deg = degree_stats(edges, src, dst).select("id", (F.col("out_degree") + F.col("in_degree")).alias("k"))
    a = deg.select(F.col("id").alias(src), F.col("k").alias("ka"))
    b = deg.select(F.col("id").alias(dst), F.col("k").alias("kb"))
    pairs = edges.select(src, dst).join(a, src).join(b, dst).groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("n"))
    return pairs


def assortativity(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Degree correlation over both directions of each edge, from degree-pair counts."""
    p = _edge_degrees(edges, src, dst)
    n = F.sum("n") * 2
    s = F.sum(F.col("n") * (F.col("ka") + F.col("kb"))) / n
    q = F.sum(F.col("n") * (F.col("ka") * F.col("ka") + F.col("kb") * F.col("kb"))) / n
    x = F.sum(F.col("n") * F.col("ka") * F.col("kb") * 2) / n
    return p.agg(F.try_divide(x - s * s, q - s * s).alias("r"), F.sum("n").alias("edges"))


def correlated_threshold(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """1 / largest eigenvalue of (k' - 1) P(k' | k), on the table of distinct degree pairs."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ks = np.unique(pdf[["ka", "kb"]].to_numpy())
        a, b = np.searchsorted(ks, pdf["ka"]), np.searchsorted(ks, pdf["kb"])
        e = np.zeros((len(ks), len(ks)))
        np.add.at(e, (a, b), pdf["n"])
        np.add.at(e, (b, a), pdf["n"])
        m = e / e.sum(axis=1, keepdims=True) * (ks - 1)[None, :]
        return pd.DataFrame([{"threshold": float(1 / np.abs(np.linalg.eigvals(m)).max()), "degrees": len(ks)}])

    return _edge_degrees(edges, src, dst).withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda p: solve(p), "threshold double, degrees long")


def thin_edges(edges: DataFrame, src: str, dst: str, share: float, draws: int, seed: int = 0) -> DataFrame:
    """Copies of the graph in which each link is kept with the given probability."""
    many = edges.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return many.where(hash_uniform(seed, F.col("draw"), F.col(src), F.col(dst)) < share)


def cascade_reach(edges: DataFrame, seeds: DataFrame, src: str, dst: str, by: Sequence[str] = ()) -> DataFrame:
    """Everything downstream of the seeds: ``(by, id, step)``, frontier by frontier.

    A frontier joins the edges, drops what was reached before and becomes the next one; each
    round is checkpointed and the visited set grows by that round only.
    """
    by = list(by)
    frontier = cut_lineage(seeds.select(*by, "id").distinct())
    reached, step = frontier.withColumn("step", F.lit(0)), 0
    steps = [reached]
    visited = frontier
    while True:  # every round reaches new nodes, so it ends
        step += 1
        nxt = frontier.withColumnRenamed("id", src).join(edges.select(*by, src, dst), [*by, src]).select(*by, F.col(dst).alias("id")).distinct()
        frontier = cut_lineage(nxt.join(visited, [*by, "id"], "left_anti"))
        if frontier.isEmpty():
            break
        steps.append(frontier.withColumn("step", F.lit(step)))
        visited = visited.unionByName(frontier)
        if step % 8 == 0:
            visited = cut_lineage(visited)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def output_loss(nodes: DataFrame, reached: DataFrame, by: Sequence[str], weight: str, counted: Column) -> DataFrame:
    """Weighted share of the counted nodes that was reached, per draw."""
    by = list(by)
    total = nodes.where(counted).agg(F.sum(weight).alias("_all"))
    hit = reached.join(nodes.where(counted).select("id", weight), "id").groupBy(*by).agg(F.sum(weight).alias("_lost"), F.count(F.lit(1)).alias("n"))
    return hit.crossJoin(F.broadcast(total)).select(*by, "n", F.try_divide("_lost", "_all").alias("loss"))  # a single row


def threshold_cascade(edges: DataFrame, src: str, dst: str, seeds: DataFrame, phi: float, max_rounds: int = 1000, slice_rows: int = 1 << 20) -> DataFrame:
    """Nodes that end up failed when one fails once a share ``phi`` of its neighbours has.

    Only the newly failed nodes send a signal in a round; counts add up per node.  Pairs are made distinct before they are turned round.
    Pairs and links are dealt into slices whose number follows the rows (``slice_rows`` on average), so that a task doesn't grow with the graph.
    """
    x, y = F.col(src), F.col(dst)
    turn = (x > y) | y.isNull()
    pairs = cut_lineage(edges.select(F.when(turn, y).otherwise(x).alias("x"), F.when(turn, x).otherwise(y).alias("y")))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * pairs.count() // slice_rows))
    both = F.array_distinct(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    links = pairs.repartition(parts, "x", "y").distinct().select(F.explode(both).alias("l")).select("l.*")
    links = cut_lineage(links)
    deg = cut_lineage(links.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("deg")))
    fresh = cut_lineage(seeds.select("id").distinct().withColumn("round", F.lit(0)))
    failed, hits = fresh, None
    for step in range(1, max_rounds + 1):
        new = fresh.select(F.col("id").alias("a")).repartition(parts, "a").join(links.repartition(parts, "a"), "a").groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("h"))
        hits = new if hits is None else hits.unionByName(new).groupBy("id").agg(F.sum("h").alias("h"))
        hits = cut_lineage(hits)
        over = hits.join(deg, "id").where(F.col("h") >= F.col("deg") * phi).select("id").join(failed, "id", "left_anti")
        fresh = cut_lineage(over.withColumn("round", F.lit(step)))
        if fresh.isEmpty():
            return failed
        failed = cut_lineage(failed.unionByName(fresh))
    raise RuntimeError(f"cascade did not settle in {max_rounds} rounds")


def tail_by_model(losses: DataFrame, by: Sequence[str], x: str, thresholds: dict[str, float]) -> DataFrame:
    """Mean, exact P95 and P99, and exceedance shares per model and level."""
    from strandline.operators.ordering import quantile_columns

    base = losses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), *[F.avg(F.when(F.col(x) > v, 1.0).otherwise(0.0)).alias(n) for n, v in thresholds.items()]
    )
    return base.join(quantile_columns(losses, by, x, {"p95": 0.95, "p99": 0.99}), list(by))
