"""Jaccard self-join of documents on word shingles: rounds on bands of minima, then prefix candidates and a prefix-tree check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.batches import WordHashes, mix, pieces, raw, shingles, tidy
from strandline.llm.sketch import frequency_levels, slot, slot_bitmap
from strandline.operators.graph import connected_components
from strandline.storage import staging_path


def shingle_set(words: list[bytes], cache: WordHashes, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; of the whole sequence if it is shorter than a shingle."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(shingles(cache.of(words), min(size, len(words))))


def ordered(hashes: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The set in the global order, as positive longs: less frequent first, then by hash."""
    return np.sort((levels[slot(hashes, bits)].astype(np.uint64) << np.uint64(57)) | (hashes >> np.uint64(7))).view(np.int64)


def set_bands(hashes: np.ndarray, number: int, width: int = 3) -> np.ndarray:
    """Hashes of ``width`` minima of the sorted set each: sets agree in a band with about their Jaccard similarity to that power.

    The hash range is cut evenly; a part without a shingle takes the next one's least.
    """
    edges = (np.arange(number * width, dtype=np.float64) * (2.0**64 / (number * width))).astype(np.uint64)
    least = hashes[np.searchsorted(hashes, edges) % len(hashes)].reshape(number, width)
    out = np.arange(number, dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ least[:, k])
    return out.view(np.int64)


def overlap_needed(a: np.ndarray | Column, b, percent: int):
    """Fewest shared shingles at which sets of these sizes reach the threshold."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """``_count_needed`` of arrays: fewest shingles that the prefixes of a linked pair share."""
    return np.maximum(overlap_needed(a, b, percent) + (-percent * np.maximum(a, b)) // 100 + 1, 1)


def _rest(n: Column, percent: int) -> Column:
    """Set size without its prefix: a linked partner shares at least one shingle more than that."""
    return F.ceil(n * percent / F.lit(100.0)) - 1


def _count_needed(na: Column, nb: Column, percent: int) -> Column:
    """Fewest shingles that the prefixes of a linked pair share: those outside one of the prefixes can't make up for more."""
    return F.greatest(F.ceil((na + nb) * percent / F.lit(100.0 + percent)) - F.greatest(_rest(na, percent), _rest(nb, percent)), F.lit(1))


def _least_needed(n: Column, low: Column, high: Column, percent: int) -> Column:
    """No more than ``_count_needed`` of ``n`` with any size from ``low`` to ``high``.

    Up to ``n`` the need grows with the partner.  Beyond, it is a difference of two rounded numbers whose exact difference falls, so
    a smaller partner may need one less than the largest one.
    """
    return F.greatest(F.least(_count_needed(n, low, percent), _count_needed(n, high, percent) - F.when(high > n, 1).otherwise(0)), F.lit(1))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token: those of tokens that two rows have.  Only the last row is held back."""
    names, held, again = ["token", "row", "n"], None, False
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in names]
        if held is not None:
            cols = [np.concatenate([[h], c]) for h, c in zip(held, cols)]
        same = cols[0][1:] == cols[0][:-1]
        # the first row here may have a partner in what has been given out; the last one waits
        keep = np.concatenate([[again], same])[:-1] | same if len(same) else np.zeros(0, bool)
        again = bool(same[-1]) if len(same) else again
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep], pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)], names=names)
        held = [c[-1] for c in cols]
    if held is not None and again:
        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32() if i == 2 else pa.int64()) for i, h in enumerate(held)], names=names)


def _hub_pairs(hubs: int, percent: int):
    """Task function over (token, row, n, component) sorted by token: each row with the first ``hubs`` rows of its token.

    Pairs of one component or of sizes too far apart are left out; equal pairs are counted.  Only the hubs of the
    current token are held.  A column ``rem``, if there, is how many shared prefix tokens a row has from this one on: a linked pair
    has the need left at both ends where it first meets, so pairs with less are left out as well.
    """
    names = ["token", "row", "n", "component", "rem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        for b in batches:
            if not b.num_rows:
                continue
            old = len(held[0])
            new = [b.column(c).to_numpy().astype(np.int64) for c in names if c in b.schema.names]
            if len(new) < len(names):
                new.append(np.full(b.num_rows, np.iinfo(np.int64).max))
            token, row, n, component, rem = cols = [np.concatenate([h, c]) for h, c in zip(held, new)]
            index = np.arange(len(token))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], token[1:] != token[:-1]]), index, 0))
            found = []
            for j in range(hubs):
                i = index[(index - start > j) & (index >= old)]
                hub = start[i] + j
                ok = (component[hub] != component[i]) & (n[hub] * 100 >= n[i] * percent) & (n[i] * 100 >= n[hub] * percent)
                ok &= np.minimum(rem[hub], rem[i]) >= prefix_overlap(n[hub], n[i], percent)
                found.append(np.stack([row[hub[ok]], row[i[ok]], n[hub[ok]], n[i[ok]]], 1))
            pairs, counts = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(pairs[:, k]) for k in range(4)), pa.array(counts.astype(np.int64))], names=["a", "b", "na", "nb", "c"])
            last = (start == start[-1]) & (index - start < hubs)
            held = [c[last] for c in cols]

    return run


def _climb(own: np.ndarray, member: np.ndarray, shared: int, counts: np.ndarray, percent: int, block: int) -> tuple[bool, np.ndarray]:
    """Go down the tree to ``member``, from the path of the one before it.

    ``shared`` tokens of the path are common, and ``counts`` holds the overlap with ``own`` at each of its nodes visited.  Stops as soon as
    the overlap so far plus what remains of the shorter set can't reach the need.
    """
    need = overlap_needed(len(own), len(member), percent)
    depth = min(shared, len(counts) - 1)
    counts = counts[: depth + 1]
    got, seen = int(counts[-1]), [counts]
    at = int(np.searchsorted(own, member[depth - 1], "right")) if depth else 0
    while depth < len(member) and got + min(len(member) - depth, len(own) - at) >= need:
        step = member[depth : depth + block]
        place = np.searchsorted(own, step)
        hit = own[np.minimum(place, len(own) - 1)] == step
        seen.append(got + np.cumsum(hit))
        got, depth, at = int(seen[-1][-1]), depth + len(step), int(place[-1]) + int(hit[-1])
    return depth == len(member) and got >= need, np.concatenate(seen)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        tokens = b.column("tokens")
        flat, offsets = tokens.flatten().to_numpy(), tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        yield b, [flat[lo:hi] for lo, hi in zip(offsets, offsets[1:])]


def _walk(percent: int, block: int = 64):
    """Task function over (a, chunk, b, tokens) sorted by a, chunk, b's absence and tokens.

    The first row of a group is the set of ``a``; the sets of its partners follow in the order of a depth-first walk through
    their prefix tree.  A partner keeps the overlap counted along the path it shares with the one before; a subtree that
    can't reach the need is left without counting again.  Only one path of the tree is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, path, counts = None, None, None, None
        for b, sets in _sets(batches):
            links: tuple[list, list] = ([], [])
            for a, chunk, partner, these in zip(b.column("a").to_pylist(), b.column("chunk").to_pylist(), b.column("b").to_pylist(), sets):
                if partner is None:
                    group, own, path, counts = (a, chunk), these, these[:0], np.zeros(1, np.int64)
                    continue
                if group != (a, chunk):
                    raise ValueError(f"no set arrived for row {a}")
                linked, counts = _climb(own, these, _common(path, these), counts, percent, block)
                path = these
                if linked:
                    links[0].append(a), links[1].append(partner)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    return run


def _probe(percent: int, block: int = 64):
    """Task function over (tree, chunk, salt, probe, row, tokens) sorted in this order.

    The members of a chunk of a component come first, in the order of their prefix tree, and are held; each probe after them walks
    the tree until a member links to it, which joins the probe to the component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, tree, shared = None, [], [], []
        for b, sets in _sets(batches):
            links: tuple[list, list] = ([], [])
            for key, probe, row, these in zip(zip(*(b.column(c).to_pylist() for c in ("tree", "chunk", "salt"))), b.column("probe").to_pylist(), b.column("row").to_pylist(), sets):
                if key != group:
                    group, rows, tree, shared = key, [], [], []
                if not probe:
                    shared.append(_common(tree[-1], these) if tree else 0)
                    rows.append(row), tree.append(these)
                    continue
                counts = np.zeros(1, np.int64)
                for member, other, common in zip(rows, tree, shared):
                    linked, counts = _climb(these, other, common, counts, percent, block)
                    if linked:
                        links[0].append(row), links[1].append(member)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 4, percent: int = 85, bits: int = 22, hubs: int = 8, rounds: int = 2, hub_chunk: int = 256, bands: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when their sets of lower-case (A-Z) word shingles have a Jaccard similarity of ``percent`` / 100.
    Sets are ordered by a global order, less frequent shingles first (frequencies from a sketch of fixed size; any order is exact),
    and linked sets share enough of their first shingles.

    The first rounds only join what is alike at low cost: each set meets a few hubs per band of minima that it shares, other bands and
    hubs in each round, so a group of n near copies costs a multiple of n checks however many shingles it shares, and sets
    that share some shingles by chance don't meet.  What they miss is left to the last round, which is exact: each set of a smaller
    component that shares enough prefix shingles with a larger one walks the prefix tree of the larger one's sets, in chunks,
    until one links.  No pair that could link two components is left out, and pairs inside a component can't change it.

    Equal sets are combined inside each task.  A null or empty text has 0 shingles and no links.  Rows of equal id and text are one
    document; equal ids with different texts are one document with several texts.  A null id is
    linked with nothing and keeps a null component.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")

    def sets(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        cache = WordHashes()
        for p in pieces(iter([b])):
            for text in raw(p):
                yield shingle_set(text.lower().split(), cache, shingle)

    levels = spark.sparkContext.broadcast(frequency_levels(rows.select("text"), sets, bits, steps=4))  # 2**bits bytes

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, leaders = WordHashes(), {}
        for b in pieces(batches, limit=1 << 20):
            token, row, n, leader, minima = [], [], [], [], []
            for d, r, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), raw(b)):
                own = shingle_set(text.lower().split(), cache, shingle)
                size = len(own)
                print_ = (size, int(own.sum()), int(np.bitwise_xor.reduce(own * own)))  # 128 bits of the set
                first = r if d is None or not size else leaders.setdefault(print_, r)
                token.append(np.zeros(1, np.int64)), row.append(np.array([r])), n.append(np.array([size])), leader.append((d, first)), minima.append(None)
                if d is not None and size and first == r:
                    minima[-1] = set_bands(own, rounds * bands) if rounds else None
                    prefix = ordered(own, levels.value, bits)[: size + (-percent * size // 100) + 1]
                    token.append(prefix), row.append(np.full(len(prefix), r)), n.append(np.full(len(prefix), size))
                    leader.extend([(None, None)] * len(prefix)), minima.extend([None] * len(prefix))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(token), pa.int64()), pa.array(np.concatenate(row), pa.int64()), pa.array(np.concatenate(n), pa.int32()),
                    pa.array([x[0] for x in leader], pa.int64()), pa.array([x[1] for x in leader], pa.int64()), pa.array(minima, pa.list_(pa.int64())),
                ],
                names=["token", "row", "n", "doc_id", "leader", "minima"],
            )

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = staging_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    found = staged(rows.mapInArrow(tidy(prefixes), "token long, row long, n int, doc_id long, leader long, minima array<long>"), "prefixes")
    members = found.where("leader IS NOT NULL").select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), "leader")
    def sent(asks: DataFrame, keys: str) -> DataFrame:
        """The columns ``keys`` and ``tokens``, the set of ``row``, for each row of ``asks``.

        Texts travel once to what is asked of them, with other rows dropped where they are read; each becomes a set once.
        """
        marks = spark.sparkContext.broadcast(slot_bitmap(asks.select(F.xxhash64("row").alias("row")), "row", 22))

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(marks.value[slot(b.column("mark").to_numpy().view(np.uint64), 22)])).select(["row", "text"])

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for p in pieces(batches, limit=1 << 20):
                own = [ordered(shingle_set(t.lower().split(), cache, shingle), levels.value, bits) for t in raw(p)]
                asked, ends = p.column("asks").flatten(), p.column("asks").offsets.to_numpy() - p.column("asks").offsets[0].as_py()
                at = np.repeat(np.arange(len(own)), np.diff(ends))
                size = np.cumsum([len(own[i]) for i in at])
                cuts = np.unique(np.searchsorted(size, np.arange(0, size[-1] if len(size) else 0, 1 << 18)).tolist() + [0, len(at)])
                for lo, hi in zip(cuts, cuts[1:]):  # a set that many ask for leaves in several batches
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(own[i]) for i in at[lo:hi])]).astype(np.int32)), pa.array(np.concatenate([own[i] for i in at[lo:hi]]), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*asked.slice(lo, hi - lo).flatten(), lists], names=[*names, "tokens"])

        names = [k.split()[0] for k in keys.split(", ")]
        whole = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("row", F.xxhash64("row").alias("mark"), "text")
        whole = whole.mapInArrow(tidy(marked), "row long, text string").dropDuplicates(["row"])
        asks = asks.groupBy("row").agg(F.collect_list(F.struct(*names)).alias("asks"))
        return whole.join(asks, "row").select("text", "asks").mapInArrow(tidy(full), f"{keys}, tokens array<long>")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the threshold."""
        pairs = staged(pairs, f"{name}-pairs")
        chunks = pairs.groupBy("a").agg(F.ceil(F.count("b") / hub_chunk).alias("chunks"))
        dealt = pairs.join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
        own = dealt.select(F.col("a").alias("row"), "a", "chunk", F.lit(None).cast("long").alias("b")).distinct()
        asks = own.unionByName(dealt.select(F.col("b").alias("row"), "a", "chunk", "b"))
        walk = sent(asks, "a long, chunk int, b long").repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").isNotNull(), "tokens", "b")
        return staged(walk.mapInArrow(tidy(_walk(percent)), "a long, b long"), f"{name}-links")

    links = joined = None
    for i in range(rounds):
        mine = F.posexplode(F.slice("minima", i * bands + 1, bands)).alias("band", "token")
        dealt = found.where("minima IS NOT NULL").select("row", "n", mine).drop("band").dropDuplicates(["token", "row"])
        dealt = dealt.withColumn("component", F.col("row")) if joined is None else dealt.join(joined, "row", "left").withColumn("component", F.coalesce("component", "row"))
        dealt = dealt.select("token", "row", "n", "component").repartition("token").sortWithinPartitions("token", F.xxhash64("row", F.lit(i)), "row")
        some = dealt.mapInArrow(tidy(_hub_pairs(hubs, percent)), "a long, b long, na long, nb long, c long")
        some = some.groupBy("a", "b").agg(F.sum("c").alias("c")).where(F.col("c") >= min(2, bands)).select("a", "b")  # one band may be a common passage
        new = verified(some, f"hub{i}")
        links = new if links is None else links.unionByName(new)
        joined = staged(connected_components(links, "a", "b").withColumnRenamed("id", "row"), f"hub{i}-joined")
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
        joined = spark.createDataFrame([], "row long, component long")
    sizes = joined.groupBy("component").agg(F.count("row").alias("size"))
    labels = staged(joined.join(sizes, "component").select("row", "component", "size"), "labels")
    postings = found.where("leader IS NULL").select("token", "row", "n").repartition("token").sortWithinPartitions("token", "row")
    left = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("token")))  # a row's prefix is bounded by its text
    held = postings.mapInArrow(tidy(_repeated), "token long, row long, n int").join(labels, "row", "left").withColumn("rem", left)
    held = staged(held.withColumns({"component": F.coalesce("component", "row"), "size": F.coalesce("size", F.lit(1).cast("long"))}), "held")
    # what may still join two components: rows of the smaller one that meet the larger one where both have the need left in their prefixes
    groups = held.groupBy("token", F.col("component").alias("tree"), F.col("size").alias("tree_size"))
    groups = groups.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rem").alias("tree_rem"))
    least, most = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / F.lit(100.0))), F.least(F.col("high"), F.floor(F.col("n") * F.lit(100.0) / percent))
    meet = (least <= most) & (F.least("rem", "tree_rem") >= _least_needed(F.col("n"), least, most, percent))
    probes = held.join(groups, "token").where((F.struct("size", "component") < F.struct("tree_size", "tree")) & meet)
    probes = staged(probes.select("row", "tree", F.col("tree_size").alias("size")).distinct(), "probes")
    trees = probes.groupBy("tree", "size").agg(F.count("row").alias("probes"))
    trees = trees.select("tree", F.ceil(F.col("size") / hub_chunk).alias("chunks"), F.ceil(F.col("probes") / (4 * hub_chunk)).alias("salts"))
    stored = held.select(F.col("component").alias("tree"), "row").distinct().join(trees, "tree")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stored = stored.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks"))).withColumn("salt", spread("salts")).withColumn("probe", F.lit(False))
    asking = probes.join(trees, "tree").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).withColumn("chunk", spread("chunks")).withColumn("probe", F.lit(True))
    keys = ["tree", "chunk", "salt", "probe", "row"]
    walk = sent(stored.select(*keys).unionByName(asking.select(*keys)), "tree long, chunk long, salt long, probe boolean, row long")
    walk = walk.repartition("tree", "chunk", "salt").sortWithinPartitions("tree", "chunk", "salt", "probe", "tokens", "row")
    more = staged(walk.mapInArrow(tidy(_probe(percent)), "a long, b long"), "probe-links")

    ids = members.where("doc_id IS NOT NULL").select("row", "doc_id").distinct()
    edges = links.unionByName(more).unionByName(members.where("doc_id IS NOT NULL AND row <> leader").select(F.col("row").alias("a"), F.col("leader").alias("b")))
    edges = edges.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select("x", "y").where("x <> y").distinct()
    found = connected_components(edges, "x", "y").toDF("doc_id", "component_id")
    return members.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
