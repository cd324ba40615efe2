"""Operator 1: near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label form a class at once, and one of them, of the smallest id, stands for it with its multiplicity. For each label
(and length of vectors) with more than CELL classes, spherical k-means on a bounded sample (SAMPLE rows in all) gives about one centre per CELL classes. Every vector
belongs to the cell of its nearest centre. A pair linked across two cells lies near the plane between their centres: a vector whose
distance to that plane is over the chord of the threshold can't have a partner beyond it. So each vector also visits just those cells whose
plane is near enough, only those of smaller number, and every pair is compared once and none is lost, however good the centres are.

Cells are cut into blocks of about BLOCK rows by a hash of the id; each pair of blocks is one group of bounded size, whose cosines are one
matrix product in double precision. A group gives back, for each row, its number of links and the root of its local component, never pairs; so a
dense cell costs arithmetic but no rows. Roots are joined to components at the end, and one representative of each component is kept.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows of null label, have no links. Rows of null id have no
links, component null, and are kept. Repeated rows are vectors of their own that link. Vectors of different length don't link. An empty
table gives an empty result; other columns don't matter. A cosine equal to the threshold links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, written
from .components import components

CELL, BLOCK, SAMPLE, STEPS = 1024, 1024, 20_000, 10


def unit(rows: list, dim: int) -> np.ndarray:
    """Vectors as unit rows in double precision."""
    x = np.array(rows, dtype=np.float64).reshape(len(rows), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """k unit centres of unit rows; empty cells are given the worst-fitting rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        cosines = x @ centres.T
        of = cosines.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        bad = norm < 1e-9
        if bad.any():
            worst = np.argsort(cosines.max(axis=1), kind="stable")[: int(bad.sum())]
            sums[bad], norm[bad] = x[worst], 1.0
        centres = sums / norm[:, None]
    return centres


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, v (doubles) of the rows that can link."""
    v = F.col(vector)
    fine = F.col(label).isNotNull() & F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.cast("array<double>").alias("v"))


def centres_of(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Centres of the labels that have more than CELL classes; SAMPLE rows in all come to the driver."""
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    large = {(r.label, r.dim): r.n for r in sizes.orderBy(F.desc("n"), "label", "dim").limit(SAMPLE // 64).collect()}  # smaller ones stay one cell, cut into blocks
    total = sum(large.values())
    if not total:
        return {}
    keep = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / total) * (1 << 30)))
    names = classes.sparkSession.createDataFrame(list(large), "label string, dim int")  # SAMPLE / 64 rows at most
    sample = classes.where(keep).withColumn("dim", F.size("v")).join(F.broadcast(names), ["label", "dim"]).select("label", "id", "v").toPandas()
    out = {}
    for (label, dim), n in large.items():
        own = sample[(sample["label"] == label) & (sample["v"].map(len) == dim)].sort_values("id")
        k = min(math.ceil(n / CELL), len(own) // 4)
        if k > 1:
            out[label, dim] = spherical_kmeans(unit(own["v"].tolist(), dim), k)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = written(usable(vectors, key, vector, label), "vectors")
    classes = written(rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    sent = spark.sparkContext.broadcast(centres_of(classes))  # at most SAMPLE / 4 centres
    chord = math.sqrt(2 - 2 * threshold) + 1e-9

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            labels, vs = batch.column("label").to_pylist(), batch.column("v").to_pylist()
            take, cells, home = [], [], []
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (k, v) in enumerate(zip(labels, vs, strict=True)):
                groups.setdefault((k, len(v)), []).append(i)
            for group, members in groups.items():
                c = centres.get(group)
                own = np.zeros(len(members), np.int64)
                if c is not None:
                    cosines = unit([vs[i] for i in members], group[1]) @ c.T
                    own = cosines.argmax(axis=1)
                    gap = np.sqrt(np.maximum(1e-18, 2 - 2 * c @ c.T))
                    near = (cosines[np.arange(len(members)), own][:, None] - cosines) <= chord * gap[own]
                    near &= np.arange(len(c))[None, :] < own[:, None]
                    for at, cell in zip(*np.nonzero(near), strict=True):
                        take.append(members[at])
                        cells.append(int(cell))
                        home.append(False)
                take += members
                cells += own.tolist()
                home += [True] * len(members)
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int64()), pa.array(home, pa.bool_())], names=[*batch.schema.names, "cell", "home"])

    cells = written(classes.mapInArrow(placed, "label string, v array<double>, id long, copies long, cell long, home boolean"), "cells")
    group = ["label", "dim", "cell"]
    cells = cells.withColumn("dim", F.size("v"))
    sizes = cells.groupBy(*group).agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("kh"), F.ceil(F.sum((~F.col("home")).cast("int")) / BLOCK).cast("int").alias("kv"))
    sized = cells.join(sizes, group).where("kh > 0")
    chunk = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("home"), F.col("kh")).otherwise(F.col("kv"))).cast("int")
    sized = sized.withColumn("chunk", chunk)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    inside = F.transform(upto(F.col("kh")), lambda j: block(0, F.least("chunk", j), F.greatest("chunk", j)))
    visited = F.transform(upto(F.col("kv")), lambda v: block(1, v, F.col("chunk")))
    visiting = F.transform(upto(F.col("kh")), lambda j: block(1, F.col("chunk"), j))
    tiles = sized.withColumn("tile", F.explode(F.when(F.col("home"), F.concat(inside, visited)).otherwise(visiting)))

    def compared(t: pa.Table) -> pa.Table:
        chunk, ids = t.column("chunk").to_numpy(), t.column("id").to_numpy()
        copies, at_home = t.column("copies").to_numpy(), t.column("home").to_numpy()
        tile = t.column("tile")[0].as_py()
        x = unit(t.column("v").to_pylist(), int(t.column("dim")[0].as_py()))
        if tile["kind"]:
            left, right = np.nonzero(~at_home)[0], np.nonzero(at_home)[0]
        else:
            left, right = np.nonzero(chunk == tile["i"])[0], np.nonzero(chunk == tile["j"])[0]
        same = not tile["kind"] and tile["i"] == tile["j"]
        n = len(ids)
        links, root = np.zeros(n, np.int64), np.arange(n)
        if len(left) and len(right):
            linked = x[left] @ x[right].T >= threshold
            if same:
                np.fill_diagonal(linked, False)
            links[left] += linked @ copies[right]
            if not same:
                links[right] += linked.T @ copies[left]
            order = np.argsort(ids, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            least = rank.copy()
            while True:  # the least rank in each local component
                before = least.copy()
                least[left] = np.minimum(least[left], np.where(linked, least[right][None, :], n).min(axis=1))
                least[right] = np.minimum(least[right], np.where(linked, least[left][:, None], n).min(axis=0))
                least = least[order][least]
                if (before == least).all():
                    break
            root = order[least]
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some], "root": ids[root][some]})

    found = tiles.groupBy(*group, "tile").applyInArrow(compared, "id long, links long, root long")
    found = written(found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = written(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "vector-components")
    done = classes.join(counts, "id", "left").join(of, "id", "left")
    done = done.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.join(done, ["label", "v"]).select("id", "n_links", "component_id").where("n_links > 0").distinct()  # rows of equal id and vector are one here
    linked = linked.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(key).cast("long").alias(key)).join(linked, F.col(key) == F.col("id"), "left")
    component = F.coalesce("component_id", key)
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(key), F.lit(True)).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, by cosines of 0.93 or more within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.id LEFT JOIN degree ON degree.a = e.vec_id
"""
