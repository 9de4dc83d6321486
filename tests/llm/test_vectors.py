"""Embedding near-dedup (op 9) against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import op9_vectors, registry
from tests.llm.cases import SF, sf_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v, label):
    return v is not None and label is not None and len(v) and None not in v and all(math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if usable(v, label)]
    unit = {i: np.array(rows[i][1], float) for i in ok}
    linked = {i: [] for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])) >= cosine:
                    linked[a].append(b)
                    linked[b].append(a)
    out, done = [], {}
    for i in range(len(rows)):
        if i not in done:
            todo, members = [i], {i}
            while todo:
                for j in linked[todo.pop()]:
                    if j not in members:
                        members.add(j)
                        todo.append(j)
            done.update(dict.fromkeys(members, min((rows[m][0] for m in members if rows[m][0] is not None), default=None)))
        out.append((str(rows[i][0]), len(linked[i]), str(done[i]), rows[i][0] is not None and rows[i][0] == done[i]))
    return sorted(out)


def result(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


def test_table_against_brute_force(spark):
    got = result(registry.QUERIES["op9_embedding_near_dedup"](spark, SF))
    assert got == brute([(r["vec_id"], r["embedding"], r["label"]) for r in sf_rows("embeddings")])


@pytest.mark.parametrize("cell, block", [(1_024, 4_096), (16, 9), (64, 60)])
def test_crowds_copies_and_chains(spark, cell, block):
    rng = np.random.default_rng(8)
    rows, k = [], 0
    base = rng.normal(size=(6, 12))
    for i in range(260):
        v = base[i % 6] + rng.normal(size=12) * rng.choice([0.02, 0.08, 0.2, 1.0])
        rows.append((k, [float(x) for x in np.float32(v * rng.uniform(0.1, 9))], int(i % 7 == 0)))
        k += 1
    rows += [(k + i, rows[i % 3][1], rows[i % 3][2]) for i in range(30)]  # copies
    k += 30
    angle = np.linspace(0, 3, 40)  # a chain in which only neighbours are close
    rows += [(k + i, [float(np.float32(math.cos(a))), float(np.float32(math.sin(a)))], 1) for i, a in enumerate(angle)]
    k += 40
    rows += [(k, None, 1), (k + 1, [0.0] * 12, 0), (k + 2, [float("nan")] + [1.0] * 11, 0), (k + 3, [None] + [1.0] * 11, 0), (k + 4, [], 0),
             (k + 5, rows[0][1], None), (5, rows[5][1], rows[5][2]), (None, rows[1][1], rows[1][2]), (k + 6, [float("inf")] * 12, 0)]
    df = spark.createDataFrame([r + ("c",) for r in rows], SCHEMA + ", id string")
    assert result(op9_vectors.near_duplicates(df, 0.98, cell, block)) == brute(rows)


def test_blocks_are_bounded_whatever_the_crowd(spark):
    """A dense label around one direction: no block holds more than about twice its size, and every pair of points meets once each way."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=8) + 0.01 * rng.normal(size=(900, 8))
    df = spark.createDataFrame([(k, [float(x) for x in np.float32(a)], 1) for k, a in enumerate(v)], SCHEMA)
    rows = op9_vectors.points(df).withColumn("id", F.col("vec_id")).withColumn("n", F.lit(1).cast("long"))
    cells = op9_vectors.replicate(rows.select("label", "dim", "raw", "id", "n"), {}, 0.2)
    dealt = op9_vectors.blocks(cells, 0.2, 50).groupBy("cell", "band", "other", "part", "other_part").agg(
        F.sum((F.col("asked") == op9_vectors.ASKS).cast("long")).alias("q"), F.sum((F.col("asked") == op9_vectors.ANSWERS).cast("long")).alias("t")).collect()
    assert max(r["q"] for r in dealt) <= 90 and max(r["t"] for r in dealt) <= 90 and len(dealt) == 18 * 18
    assert sum(r["q"] * r["t"] for r in dealt) == 900 * 900


def test_empty_table(spark):
    assert op9_vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
