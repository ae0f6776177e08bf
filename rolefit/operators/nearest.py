"""The best matches of a vector among all vectors of a table, without comparing all pairs (section G).

Vectors are compared by angle. Every job belongs to the cell of its nearest centroid; a cell knows how far its farthest member is from the centroid. The angle
between a query and any member of a cell is at least the angle to the centroid less that radius, so a cell whose bound lies below the k-th best
score that a query has already found needs no look. A search therefore goes in two rounds: the nearest cells of each query first, then, for
the exact result, those cells that its k-th score leaves open.

Cells are cut into blocks of bounded size and the queries of a block into chunks; both meet as matrices, and only the k best of a block for each query leave
the task. Centroids are fitted on a bounded sample; every row is indexed. What the driver holds is a few numbers per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.sources.corpus import materialise

#: Rows the centroids are fitted on, centroids, rounds of fitting.
SAMPLE_ROWS, CELLS, FIT_ROUNDS = 4096, 64, 8
#: Jobs of a block, queries of a chunk, cells that a query looks at first.
BLOCK_ROWS, CHUNK_ROWS, PROBES = 8192, 4096, 4


def _units(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; a zero vector stays zero."""
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def fit_centroids(vectors: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Spherical k-means over SAMPLE_ROWS rows drawn by hash; fewer centroids if there are fewer rows. vectors: (id, embedding)."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    if not len(sample):
        return np.zeros((0, 0))
    rows = np.unique(_units(sample["embedding"]), axis=0)
    rows = rows[(rows != 0).any(axis=1)]
    if not len(rows):
        return np.zeros((0, 0))
    centres = rows[np.random.default_rng(7).permutation(len(rows))[:cells]]
    for _ in range(FIT_ROUNDS):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def index_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cell, angle, unit) of every row as a written table; zero vectors are in a cell of their own behind the others."""
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            units = _units(batch["embedding"])
            zero = ~(units != 0).any(axis=1)
            cosine = units @ centres.T if len(centres) else np.zeros((len(units), 1))
            cell = np.where(zero, len(centres), cosine.argmax(axis=1))
            angle = np.where(zero, 0.0, np.arccos(np.clip(cosine.max(axis=1), -1, 1)))
            yield pd.DataFrame({"id": batch["id"], "cell": cell.astype(np.int32), "angle": angle, "unit": list(units)})

    id_type = vectors.schema["id"].dataType.simpleString()
    return materialise(vectors.mapInPandas(step, f"id {id_type}, cell int, angle double, unit array<double>"), "cells")


def _scanned(probes: DataFrame, blocks: DataFrame, parts: list[int], k: int, id_type: str) -> DataFrame:
    """(query, job, score): of every block that a query looks at the k best jobs, ties by the smaller id. probes: (query, cell, unit)."""
    def best(queries: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(jobs):
            return pd.DataFrame({"query": [], "job": [], "score": []})
        jobs = jobs.sort_values("id")
        ids, matrix = jobs["id"].to_numpy(), np.stack(jobs["unit"])
        out = []
        for at in range(0, len(queries), 256):
            some = queries.iloc[at:at + 256]
            scores = np.round(np.maximum(np.stack(some["unit"]) @ matrix.T, 0.0) * 100, 2)
            first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query": np.repeat(some["query"].to_numpy(), first.shape[1]), "job": ids[first].ravel(),
                                     "score": np.take_along_axis(scores, first, axis=1).ravel()}))
        return pd.concat(out)

    counted = F.array(*[F.lit(n) for n in parts])
    spread = probes.select("query", "cell", "unit", F.explode(F.sequence(F.lit(0), F.get(counted, F.col("cell")) - 1)).alias("part"))
    load = {(r.cell, r.part): r.n for r in spread.groupBy("cell", "part").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK_ROWS).collect()}
    chunks = F.lit(1)
    for (cell, part), n in load.items():
        chunks = F.when((F.col("cell") == cell) & (F.col("part") == part), -(-n // CHUNK_ROWS)).otherwise(chunks)
    left = spread.withColumn("chunk", F.pmod(F.xxhash64("query"), chunks).cast("int"))
    right = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    key = ["cell", "part", "chunk"]
    return left.groupBy(*key).cogroup(right.select(*key, "id", "unit").groupBy(*key)).applyInPandas(
        lambda q, j: best(q, j), f"query {id_type}, job {id_type}, score double")


def _k_best(found: DataFrame, k: int) -> DataFrame:
    ordered = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "job"))), 1, k)
    return found.groupBy("query").agg(ordered.alias("best"))


def top_matches(queries: DataFrame, jobs: DataFrame, k: int, exact: bool = True, probes: int = PROBES) -> DataFrame:
    """(resume_id, job_id, match_score, rank): the k best of all jobs for every query by 100 x max(0, cosine) rounded to two places, ties by job_id.

    queries: (resume_id, embedding), jobs: (job_id, embedding), ids of one integer type and unique; rows without vector are left out, a zero vector
    scores 0 with everything. With exact=False only the nearest cells are looked at.
    """
    vectors = jobs.select(F.col("job_id").alias("id"), "embedding").where("embedding IS NOT NULL")
    id_type = vectors.schema["id"].dataType.simpleString()
    centres = fit_centroids(vectors)
    cells = index_cells(vectors, centres)
    facts = {r.cell: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    size = len(centres) + 1
    filled = np.array([c in facts for c in range(size)])
    radius = np.array([facts[c].radius if c in facts else 0.0 for c in range(size)])
    parts = [-(-facts[c].n // BLOCK_ROWS) if c in facts else 1 for c in range(size)]
    blocks = cells.select("cell", F.pmod(F.xxhash64("id"), F.get(F.array(*[F.lit(n) for n in parts]), F.col("cell"))).cast("int").alias("part"), "id", "unit")

    def angles(units: np.ndarray) -> np.ndarray:
        near = np.arccos(np.clip(units @ centres.T, -1, 1)) if len(centres) else np.zeros((len(units), 0))
        return np.c_[near, np.full(len(units), np.pi / 2)]

    def nearest(units: np.ndarray) -> np.ndarray:
        order = np.argsort(np.where(filled, np.maximum(angles(units) - radius, 0) + 1e-3 * angles(units), np.inf), axis=1, kind="stable")
        chosen = np.zeros((len(units), size), bool)
        np.put_along_axis(chosen, order[:, :probes], True, axis=1)
        return chosen & filled

    def chosen_cells(batches: Iterator[pd.DataFrame], pick) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            units = _units(batch["embedding"])
            row, cell = np.nonzero(pick(units, batch))
            if len(row):
                yield pd.DataFrame({"query": batch["query"].to_numpy()[row], "cell": cell.astype(np.int32), "unit": list(units[row])})

    def first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from chosen_cells(batches, lambda units, _: nearest(units))

    def second_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pick(units: np.ndarray, batch: pd.DataFrame) -> np.ndarray:
            bound = np.cos(np.maximum(angles(units) - radius - 1e-9, 0)) * 100
            reach = np.round(np.maximum(bound, 0) + 1e-6, 2) >= batch["least"].to_numpy()[:, None]
            return reach & filled & ~nearest(units)

        yield from chosen_cells(batches, pick)

    asked = queries.select(F.col("resume_id").alias("query"), "embedding").where("embedding IS NOT NULL")
    schema = f"query {id_type}, cell int, unit array<double>"
    found = materialise(_k_best(_scanned(asked.mapInPandas(first_round, schema), blocks, parts, k, id_type), k), "matches")
    result = found
    if exact:
        # the score that a further job must reach; any, while there are fewer than k
        least = F.when(F.size("best") >= k, -F.get("best", F.lit(k - 1))["s"]).otherwise(-1.0)
        open_ = asked.join(found.select("query", least.alias("least")), "query", "left").na.fill(-1.0, ["least"])
        more = _scanned(open_.mapInPandas(second_round, schema), blocks, parts, k, id_type)
        rows = found.select("query", F.explode("best").alias("b")).select("query", F.col("b.job").alias("job"), (-F.col("b.s")).alias("score"))
        result = _k_best(rows.unionByName(more), k)
    return result.select(F.col("query").alias("resume_id"), F.posexplode("best").alias("rank", "b")).select(
        "resume_id", F.col("b.job").alias("job_id"), (-F.col("b.s")).alias("match_score"), (F.col("rank") + 1).alias("rank"))
