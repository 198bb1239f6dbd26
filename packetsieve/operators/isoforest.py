"""Isolation forest (Liu, Ting, Zhou 2008): fit, path length, score and flag."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FEATURES, FOREST_SCHEMA, ROW_ID, SAMPLE_PER_TREE, SEED
from ..session import scratch_path

SCORE = "iso_score"
FLAG = "is_anomaly"
# Fixed values of the hash (splitmix64): steps between trees and seeds, then shifts and factors.
STEP = 0x9E3779B97F4A7C15
TURN = 0xD1B54A32D192ED03
MIX_ROUNDS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
LAST_SHIFT = 31
# Rows below the bound of a sample, as a multiple of the sample.
SLACK = 2.0
EULER = 0.5772156649
# Rows that take a step together.
SLICE = 8192
LEAF = -1
# Hash digits behind a uniform number: 13 hexadecimal digits are 52 bits.
DIGITS = 13
UNIT = float(1 << (4 * DIGITS))


def uniform(text: Column) -> Column:
    """Uniform number in [0, 1) from the hash of a text, the same in any engine."""
    digits = F.substring(F.md5(text), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(UNIT)


def uniform_of(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16) / UNIT


def mean_depth(n: int) -> float:
    """Mean depth at which a search in a random tree over ``n`` rows ends."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def priorities(ids: np.ndarray, tree: int, seed: int = SEED) -> np.ndarray:
    """64-bit hash of each row id for a tree: the rows with the smallest ones are its sample."""
    offset = (tree + 1) * STEP + seed * TURN & (1 << 64) - 1
    x = ids.astype(np.uint64) + np.uint64(offset)
    for shift, factor in MIX_ROUNDS:
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(LAST_SHIFT)
    return x


def sample_rows(features: DataFrame, trees: int, seed: int = SEED, slack: float = SLACK) -> DataFrame:
    """``(tree, row_id)``: min(n, 256) different rows per tree, uniform over the input.

    Every row has a hash for every tree, and a tree takes the rows with the
    smallest ones (of equal hashes the smallest id): a bottom-k sample, which
    hangs on the ids alone and merges over tasks. Tasks pass on only what lies
    below a bound that about ``slack`` times the sample is expected to meet; if a
    tree has too few, the bound is raised and the ids are read again. Row ids are
    neither sorted nor shuffled.
    """
    ids = features.select(F.col(ROW_ID).cast("long").alias(ROW_ID))
    n = ids.count()
    size = min(n, SAMPLE_PER_TREE)
    by_hash = Window.partitionBy("tree").orderBy("_hash", ROW_ID)
    while True:
        share = 1.0 if n == 0 else min(1.0, slack * (size + 16) / n)
        bound = (1 << 64) - 1 if share >= 1.0 else int(share * 2.0**64)

        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy()
                for tree in range(trees):
                    hashes = priorities(own, tree, seed)
                    kept = np.flatnonzero(hashes <= np.uint64(bound))
                    if len(kept):
                        # Shifted so that signed order is that of the hashes.
                        signed = (hashes[kept] ^ np.uint64(1 << 63)).view(np.int64)
                        columns = [np.full(len(kept), tree, np.int32), signed, own[kept]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in columns], ["tree", "_hash", ROW_ID]
                        )

        path = scratch_path(features.sparkSession, "sample")
        schema = f"tree int, _hash long, {ROW_ID} long"
        ranked = ids.mapInArrow(below, schema).withColumn("_place", F.row_number().over(by_hash))
        ranked.where(F.col("_place") <= size).select("tree", ROW_ID).write.parquet(path)
        sample = features.sparkSession.read.schema(f"tree int, {ROW_ID} long").parquet(path)
        if share >= 1.0 or sample.count() == trees * size:
            return sample
        slack *= 4


def grow_tree(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one tree over its sample, numbered as a heap with root 1.

    A node picks, by hash, a feature that varies in it and a cut between that
    feature's ends; rows up to the cut go left. Depth ends at log2 of the sample.
    """
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes = []
    waiting = [(1, 0, np.arange(len(x)))]
    while waiting:
        node, depth, rows = waiting.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth == limit or len(varying) == 0:
            nodes.append((tree, node, LEAF, None, None, None, depth, len(rows)))
            continue
        feature = min(
            varying,
            key=lambda f: hashlib.md5(f"{seed}|{tree}|{node}|{f}".encode()).hexdigest(),
        )
        ends = low[feature], high[feature]
        cut = ends[0] + uniform_of(f"{seed}|cut|{tree}|{node}") * (ends[1] - ends[0])
        cut = ends[0] if cut >= ends[1] else cut
        left = part[:, feature] <= cut
        nodes.append(
            (tree, node, int(feature), float(cut), 2 * node, 2 * node + 1, depth, len(rows))
        )
        waiting.append((2 * node, depth + 1, rows[left]))
        waiting.append((2 * node + 1, depth + 1, rows[~left]))
    return nodes


def fit_forest(features: DataFrame, trees: int, seed: int = SEED) -> DataFrame:
    """Forest table. Each tree grows in its own group, which holds at most 256 rows."""
    sample = sample_rows(features, trees, seed)
    # At most trees * 256 pairs of two numbers.
    rows = features.join(F.broadcast(sample), ROW_ID).select("tree", ROW_ID, *FEATURES)

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ROW_ID)
        nodes = grow_tree(int(key[0]), group[list(FEATURES)].to_numpy(np.float64), seed)
        columns = [
            "tree", "node", "feature", "threshold", "left", "right", "depth", "n_samples"
        ]
        return pd.DataFrame(nodes, columns=columns).astype(
            {"left": "Int32", "right": "Int32", "threshold": "float64"}
        )

    return rows.groupBy("tree").applyInPandas(grow, FOREST_SCHEMA)


def forest_arrays(nodes: list) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, features, cuts and path lengths of a forest as complete heaps, one row per tree.

    A leaf above the last level hands its path length down to the level below,
    where both sides lead to the same value, so every row takes the same steps.
    """
    depth = max((n["depth"] for n in nodes), default=0)
    place = {t: i for i, t in enumerate(sorted({n["tree"] for n in nodes}))}
    shape = len(place), 2 ** (depth + 1)
    feature = np.zeros(shape, dtype=np.intp)
    threshold = np.full(shape, np.inf)
    path = np.zeros(shape)
    for n in nodes:
        at = place[n["tree"]], n["node"]
        if n["feature"] == LEAF:
            below = depth - n["depth"]
            first = n["node"] << below
            path[at[0], first : first + (1 << below)] = n["depth"] + mean_depth(n["n_samples"])
        else:
            feature[at], threshold[at] = n["feature"], n["threshold"]
    return depth, feature, threshold, path


def mean_path(matrix: np.ndarray, depth: int, feature, threshold, path) -> np.ndarray:
    """Mean path length of each row of a matrix over all trees.

    The rows go down a tree together, one level per step; the steps reuse their
    buffers.
    """
    rows = len(matrix)
    flat = np.ascontiguousarray(matrix.T).ravel()
    place = np.arange(rows, dtype=np.intp)
    node, at = np.empty(rows, dtype=np.intp), np.empty(rows, dtype=np.intp)
    value, cut = np.empty(rows), np.empty(rows)
    right = np.empty(rows, dtype=bool)
    total = np.zeros(rows)
    for starts, cuts, ends in zip(feature * rows, threshold, path):
        node.fill(1)
        for _ in range(depth):
            np.take(starts, node, out=at, mode="clip")
            np.add(at, place, out=at)
            np.take(flat, at, out=value, mode="clip")
            np.take(cuts, node, out=cut, mode="clip")
            np.greater(value, cut, out=right)
            np.left_shift(node, 1, out=node)
            np.add(node, right, out=node)
        np.take(ends, node, out=value, mode="clip")
        total += value
    return total / len(feature)


def collect_forest(forest: DataFrame) -> list:
    """The nodes on the driver: at most 511 per tree, about 12 kB."""
    return forest.select("tree", "node", "feature", "threshold", "depth", "n_samples").collect()


def with_iso_score(df: DataFrame, forest: DataFrame, columns=FEATURES) -> DataFrame:
    """``df`` plus the decision score and the anomaly flag; lower is more anomalous.

    Only the 16 features travel to Python, in whole Arrow batches.
    """
    nodes = collect_forest(forest)
    shared = df.sparkSession.sparkContext.broadcast(forest_arrays(nodes))

    @F.pandas_udf("double")
    def path_of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        arrays = shared.value
        for batch in batches:
            matrix = np.column_stack([s.to_numpy(np.float64) for s in batch])
            parts = [
                mean_path(matrix[i : i + SLICE], *arrays) for i in range(0, len(matrix), SLICE)
            ]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    sample = max((n["n_samples"] for n in nodes), default=0)
    scale = F.lit(mean_depth(sample) or 1.0)
    return (
        df.withColumn("_path", path_of(*[F.col(c) for c in columns]))
        .withColumn(SCORE, F.lit(0.5) - F.pow(F.lit(2.0), -F.col("_path") / scale))
        .drop("_path")
        .withColumn(FLAG, F.col(SCORE) < 0)
    )
