"""Exact near-duplicate join of embeddings in a metric space.

Unit vectors have cosine >= c exactly when their distance is at most r = sqrt(2 - 2 c), so the links are a
range join. Equal vectors of a label are one point with a multiplicity. Each (label, dimension) gets pivots in
proportion to its points (one per ``CELL`` points, at most ``PIVOTS`` each and ``PIVOT_BYTES`` in all; chosen by hash);
a label of up to ``CELL`` points is one cell without a pivot. A point belongs to the cell
of its nearest pivot p and is replicated to the cell of pivot q when it may lie within r of a point there: by the
triangle inequality only if its distance to the plane between p and q, (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)), is at
most r. Cells are joined on their own, and inside a cell of more than ``BLOCK`` points only bands of distance to the pivot that are at most r
apart. A band is cut into blocks of about ``BLOCK`` points, and one task joins a block of home points with a block of the cell's points: about 2 * ``BLOCK`` rows
whatever the label, the cell or a dense crowd around one pivot holds. A block returns its links per home point and a
spanning forest of them, never the pairs.

Cases: a null or zero vector, or one with a null or non-finite component, and any vector with a null label links
with nothing; vectors of different lengths do not link; repeated vec_ids are separate rows with the same answer; a null
vec_id keeps its row; an empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_arrow, stage
from flowlens.llm.graph import components, forest

CELL = 1_024
BLOCK = 4_096
PIVOTS = 256
PIVOT_BYTES = 64 << 20
ANSWERS, ASKS, BOTH = range(3)
SLACK = 1e-6  # on r, for rounding in the bounds; links themselves are decided by the cosine


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def points(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, raw) with raw the vector as little-endian doubles; null where it cannot link."""
    def run(b):
        label = b.column("label").to_pylist()
        raw, dim = [], []
        for v, k in zip(b.column("embedding").to_pylist(), label):
            a = None if v is None or k is None or None in v else np.array(v, "<f8")
            if a is not None and (not len(a) or not np.isfinite(a).all() or not a.any()):
                a = None
            raw.append(None if a is None else (a + 0.0).tobytes())  # + 0.0: one zero
            dim.append(None if a is None else len(a))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(label, pa.int64()), pa.array(dim, pa.int64()), pa.array(raw, pa.binary())],
                                         names=["vec_id", "label", "dim", "raw"])
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return map_arrow(vectors, run, "vec_id long, label long, dim long, raw binary")


def pivots(distinct: DataFrame, cell: int) -> dict[tuple[int, int], np.ndarray]:
    """Unit pivots of every (label, dim) of more than one cell: a bounded sample of the points by hash."""
    sizes = distinct.groupBy("label", "dim").count().where(F.col("count") > cell)
    total = sizes.agg(F.sum("count").alias("n")).first()["n"] or 1
    share = F.greatest(F.floor(F.col("count") / total * PIVOT_BYTES / (8 * F.col("dim"))), F.lit(1))
    sizes = sizes.withColumn("k", F.least(F.ceil(F.col("count") / cell), F.lit(PIVOTS), share))
    h = F.xxhash64("raw")
    # thinned to about three times the wanted number before the rows of a label meet
    thin = distinct.join(sizes, ["label", "dim"]).where(F.pmod(h, F.lit(1 << 30)) * F.col("count") <= F.lit(3 << 30) * (F.col("k") + 4))
    best = thin.groupBy("label", "dim", "k").agg(F.slice(F.array_sort(F.collect_set(F.struct(h.alias("h"), "raw"))), 1, PIVOTS).alias("p"))
    return {(r["label"], r["dim"]): _unit(np.stack([np.frombuffer(x["raw"], "<f8") for x in r["p"][:r["k"]]])) for r in best.collect()}


def _cells(x: np.ndarray, piv: np.ndarray, radius: float):
    """Rows and the cells they go to, the home cell of each row, and squared distances to the pivots."""
    sq = np.maximum(0, 2 - 2 * x @ piv.T)
    home = sq.argmin(axis=1)
    between = np.sqrt(np.maximum(0, 2 - 2 * piv @ piv.T))[home]
    gap = sq - sq[np.arange(len(x)), home][:, None]
    reach = gap <= 2 * (radius + SLACK) * between + SLACK
    reach[np.arange(len(x)), home] = True
    row, cell = np.nonzero(reach)
    return row, cell, home, sq


def replicate(distinct: DataFrame, chosen: dict, radius: float) -> DataFrame:
    """(label, dim, cell, home, to_pivot, id, n, raw): each point in its own cell and those it may reach."""
    shared = distinct.sparkSession.sparkContext.broadcast(chosen)

    def run(b):
        label, dim = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "dim"))
        for key in sorted(set(zip(label.tolist(), dim.tolist()))):
            at = np.flatnonzero((label == key[0]) & (dim == key[1]))
            piv = shared.value.get(key)
            if piv is None:
                row, cell, home, sq = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros((len(at), 1))
            else:
                row, cell, home, sq = _cells(_unit(_matrix(b.column("raw").take(pa.array(at)), key[1])), piv, radius)
            part = b.take(pa.array(at[row]))
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("dim"), pa.array(cell), pa.array(cell == home[row]), pa.array(np.sqrt(sq[row, cell])),
                 part.column("id"), part.column("n"), part.column("raw")],
                names=["label", "dim", "cell", "home", "to_pivot", "id", "n", "raw"])
    return map_arrow(distinct, run, "label long, dim long, cell long, home boolean, to_pivot double, id long, n long, raw binary")


def join_block(rows: pa.Table, cosine: float, radius: float) -> pa.Table:
    """Links of the asked points of one block with its other points: (a, b null, n) the linked vectors of a, and (a, b) a forest."""
    rows = rows.sort_by([("to_pivot", "ascending"), ("id", "ascending")])
    dim = rows.column("dim")[0].as_py()
    asked = rows.column("asked").to_numpy()
    raw = _matrix(rows.column("raw").combine_chunks(), dim)
    norm = np.sqrt((raw * raw).sum(axis=1))
    ids, n, d = (rows.column(c).to_numpy() for c in ("id", "n", "to_pivot"))
    query, target = np.flatnonzero(asked != ANSWERS), np.flatnonzero(asked != ASKS)
    there = d[target]
    nodes, node = np.unique(ids, return_inverse=True)
    total = np.zeros(len(query), np.int64)
    forest_a, forest_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(query), 256):
        q = query[lo:lo + 256]
        a, z = np.searchsorted(there, d[q[0]] - radius - SLACK), np.searchsorted(there, d[q[-1]] + radius + SLACK, side="right")
        for s in range(a, z, 4096):
            t = target[s:min(z, s + 4096)]
            cos = (raw[q] @ raw[t].T) / (norm[q][:, None] * norm[t][None, :])
            i, j = np.nonzero(cos >= cosine)
            other = ids[q[i]] != ids[t[j]]
            i, j = i[other], t[j[other]]
            np.add.at(total, lo + i, n[j])
            forest_a, forest_b = forest(np.concatenate([forest_a, node[q[i]]]), np.concatenate([forest_b, node[j]]), len(nodes))
    some = np.flatnonzero(total)
    none = np.ones(len(some), bool)
    return pa.table({
        "a": np.concatenate([ids[query[some]], nodes[forest_a]]),
        "b": pa.array(np.concatenate([ids[query[some]], nodes[forest_b]]), mask=np.concatenate([none, np.zeros(len(forest_a), bool)])),
        "n": np.concatenate([total[some], np.zeros(len(forest_a), np.int64)])})


def blocks(cells: DataFrame, radius: float, block: int) -> DataFrame:
    """The rows of each block: (label, dim, cell, band, other, part, other_part, asked, to_pivot, id, n, raw).

    A cell of up to ``block`` points is one block, in which home points ask and all answer. In a larger one home points of ``band``, in
    ``part``, ask and all points of the cell's band ``other``, the same or a neighbour, in ``other_part``, answer.
    """
    key = ["label", "dim", "cell"]
    carried = ["to_pivot", "id", "n", "raw"]
    whole = stage(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("points")).select(*key, (F.col("points") > block).alias("large")), "cell-sizes")
    sized = cells.join(whole, key)
    zero = F.lit(0).cast("long")
    small = sized.where("not large").select(*key, zero.alias("band"), zero.alias("other"), zero.alias("part"), zero.alias("other_part"),
                                            F.when(F.col("home"), BOTH).otherwise(ANSWERS).alias("asked"), *carried)
    rows = sized.where("large").drop("large").withColumn("band", F.floor(F.col("to_pivot") / (radius + 2 * SLACK)))
    sizes = rows.groupBy(*key, "band").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("points"))
    sizes = stage(sizes.select(*key, "band", F.ceil(F.col("homes") / block).alias("parts"), F.ceil(F.col("points") / block).alias("other_parts")), "bands")
    near = sizes.where("parts > 0").select(*key, "band", "parts", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("other"))
    near = near.join(sizes.select(*key, F.col("band").alias("other"), "other_parts"), [*key, "other"])
    ask = rows.where("home").join(near, [*key, "band"]).select(
        *key, "band", "other", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"),
        F.explode(F.sequence(zero, F.col("other_parts") - 1)).alias("other_part"), F.lit(ASKS).alias("asked"), *carried)
    answer = rows.withColumnRenamed("band", "other").join(near, [*key, "other"]).select(
        *key, "band", "other", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("other_parts")).alias("other_part"), F.lit(ANSWERS).alias("asked"), *carried)
    return small.unionByName(ask).unionByName(answer)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    radius = float(np.sqrt(2 - 2 * cosine))
    rows = stage(points(vectors), "vectors")
    # a class: vectors of a label that are equal; its id is its least vec_id (a null one sorts last)
    key = ["label", "dim", "raw"]
    classes = stage(rows.where("raw is not null").groupBy(*key).agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    cells = stage(replicate(classes.select(*key, "id", "n"), pivots(classes, cell), radius), "vector-cells")
    found = stage(blocks(cells, radius, block).groupBy("label", "dim", "cell", "band", "other", "part", "other_part").applyInArrow(
        lambda t: join_block(t, cosine, radius), "a long, b long, n long"), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("other"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("id"), "root")
    named = (classes.join(counts.withColumnRenamed("a", "id"), "id", "left").join(roots, "id", "left")
             .select(*key, "n", "least", F.coalesce("other", F.lit(0)).alias("other"), F.coalesce("root", "id").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select(*key, (F.col("other") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.where("raw is not null").join(named, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
