"""k-means: fit with restarts, assignment and distance.

All restarts share their passes over the data. A pass reads the rows as packed
blocks, reduces each task's blocks to one row per restart and cluster, and adds
those up; only such sums reach the driver.

Once the centres slow down, a full pass also finds for each row and restart how
much nearer its centre is than each other one. Until the two centres have moved by
that much together, the row cannot change from the one to the other. Rows that
some more steps could change are kept with their clusters; the passes that follow
read only those, and add what changes to the sums of that full pass. When a pair
of centres has moved further, a full pass marks the rows anew. The centres are
those of full passes throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CENTROID_SCHEMA, CLUSTERS, FEATURES, ROW_ID, SEED

CLUSTER = "cluster"
DISTANCE = "kmeans_distance"
BLOCK_SCHEMA = "ids binary, matrix binary"
# Rows that a pass handles at a time.
SLICE = 1024
# Tasks whose sums reach the driver as they are; those of more tasks are added up before.
DIRECT_TASKS = 64
# Full passes before rows are marked, as the centres move too far at first.
FULL_PASSES = 3
# Rows are kept if as many steps as the last one could change their cluster.
HORIZON = 8
# A centre that stands nearly still is expected to move by this share of the fastest one's step.
LEAST_PACE = 0.05
# Marks on more than this share of the rows save too little: the next ones are tried later.
MARKED_SHARE = 0.5
# Up to so many marked rows (9 MB) come to the driver, which makes the passes itself.
DRIVER_ROWS = 1 << 16
# Relative error of a squared distance, with room to spare.
ROUNDING = 1e-12


# Assignment


def squared_distance(centre, columns=FEATURES) -> Column:
    """Squared Euclidean distance of a row to a fixed centre, summed in column order."""
    gaps = [f"(`{c}` - ({float(v)!r}D))" for c, v in zip(columns, centre)]
    return F.expr(" + ".join(f"{g} * {g}" for g in gaps))


def centres_of(centroids: DataFrame) -> list[tuple[int, list[float]]]:
    """The centroid table on the driver: one row per cluster, in cluster order."""
    return sorted((r["cluster"], list(r["centre"])) for r in centroids.collect())


def assign(df: DataFrame, centres, columns=FEATURES) -> DataFrame:
    """``df`` plus the nearest cluster and the distance to its centre.

    Equal distances go to the lowest cluster number. The centres are literals,
    so this is one projection without a join. Features are never null; saying
    so keeps the generated method small enough for the JVM to compile.
    """
    distances = {f"_d{k}": squared_distance(centre, columns) for k, centre in centres}
    names = list(distances)
    nearest = F.least(*names) if len(names) > 1 else F.col(names[0])
    choice = F.expr(
        "CASE " + " ".join(f"WHEN _d{k} = _nearest THEN {k}" for k, _ in centres) + " END"
    )
    return (
        df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
        .withColumns(distances)
        .withColumn("_nearest", nearest)
        .withColumns({CLUSTER: choice.cast("int"), DISTANCE: F.sqrt("_nearest")})
        .drop("_nearest", *names)
    )


# Fit


@dataclass(frozen=True)
class Blocks:
    """Rows packed as coded matrices of doubles, moved so that each column has mean 0."""

    table: DataFrame
    mean: np.ndarray
    variance: float
    rows: int
    columns: tuple[str, ...]
    tasks: int


@contextmanager
def packed(features: DataFrame, columns=FEATURES) -> Iterator[Blocks]:
    """Features packed into one block per Arrow batch, persisted while in use.

    A lost block is packed again from ``features``, which should be a table.
    """
    columns = tuple(columns)
    shape = features.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.var_pop(c).alias(f"var_{c}") for c in columns],
    ).first()
    if shape["n"] == 0:
        raise ValueError("no rows to cluster")
    mean = np.array([shape[f"mean_{c}"] for c in columns])
    variance = float(np.mean([shape[f"var_{c}"] for c in columns]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            matrix = np.column_stack(values) - mean
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.tobytes()]), pa.array([_coded(matrix)])], ["ids", "matrix"]
            )

    table = (
        features.select(F.col(ROW_ID).cast("long"), *columns)
        .mapInArrow(pack, BLOCK_SCHEMA)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        yield Blocks(table, mean, variance, shape["n"], columns, table.rdd.getNumPartitions())
    finally:
        table.unpersist()


def _coded(matrix: np.ndarray) -> bytes:
    """A matrix by columns: places in the column's distinct values, or its plain values if they take less room.

    What a pass moves to Python is most of its time, and codes repeat in packets. No value changes.
    """
    rows, width = matrix.shape
    sizes, parts = [], []
    for column in matrix.T:
        bits = np.ascontiguousarray(column).view(np.uint64)
        distinct, codes = np.unique(bits, return_inverse=True)
        kind = np.uint8 if len(distinct) <= 1 << 8 else np.uint16 if len(distinct) <= 1 << 16 else None
        if kind is None or 8 * len(distinct) + rows * kind().itemsize >= 8 * rows:
            sizes.append(0)
            parts.append(bits.tobytes())
        else:
            sizes.append(len(distinct))
            parts += [distinct.tobytes(), codes.astype(kind).tobytes()]
    return np.array([rows, *sizes], dtype=np.int64).tobytes() + b"".join(parts)


def _decoded(block, width: int) -> np.ndarray:
    """The matrix of :func:`_coded`."""
    rows, *sizes = np.frombuffer(block, dtype=np.int64, count=1 + width).tolist()
    matrix, at = np.empty((rows, width)), 8 * (1 + width)
    for j, n in enumerate(sizes):
        if n == 0:
            matrix[:, j] = np.frombuffer(block, dtype=np.float64, count=rows, offset=at)
            at += 8 * rows
            continue
        kind = np.uint8 if n <= 1 << 8 else np.uint16
        codes = np.frombuffer(block, dtype=kind, count=rows, offset=at + 8 * n)
        matrix[:, j] = np.frombuffer(block, dtype=np.float64, count=n, offset=at)[codes]
        at += 8 * n + codes.nbytes
    return matrix


def _matrices(batches: Iterator[pa.RecordBatch], width: int):
    """Matrix of a slice of rows that fits the processor cache, and its row ids if the batches have them."""
    for batch in batches:
        with_ids = "ids" in batch.schema.names
        for number, block in enumerate(batch.column("matrix")):
            matrix = _decoded(block.as_buffer(), width)
            ids = np.frombuffer(batch.column("ids")[number].as_buffer(), dtype=np.int64) if with_ids else None
            for first in range(0, len(matrix), SLICE):
                yield ids[first : first + SLICE] if with_ids else None, matrix[first : first + SLICE]


def _distances(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(restarts, centres, rows) squared distances less the row's own squared length.

    ``centres`` is (restarts, centres, width).
    """
    restarts, k, width = centres.shape
    flat = centres.reshape(-1, width)
    distances = flat @ (-2.0 * matrix.T)
    distances += np.einsum("ij,ij->i", flat, flat)[:, None]
    return distances.reshape(restarts, k, len(matrix))


def _least(distances: np.ndarray) -> np.ndarray:
    """Smallest distance per restart and row."""
    best = distances[:, 0].copy()
    for k in range(1, distances.shape[1]):
        np.minimum(best, distances[:, k], out=best)
    return best


def _members(distances: np.ndarray, best: np.ndarray) -> np.ndarray:
    """(restarts, centres, rows) marks of the nearest centre; ties go to the lowest number."""
    marks = distances == best[:, None, :]
    if np.count_nonzero(marks) != best.size:
        marks &= np.cumsum(marks, axis=1) == 1
    return marks


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Number in (0, 1] per row id and salt, the same for a row in every run."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def _draw_next(blocks: Blocks, chosen: np.ndarray, seeds: list[int]) -> np.ndarray:
    """One more starting centre per restart, a row drawn by its squared distance to the chosen.

    Every row races with an exponential time over its weight; the first one
    wins, so a draw is a minimum and needs one pass.
    """
    width, taken = len(blocks.columns), chosen.shape[1]

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = [np.inf] * len(seeds)
        points = [None] * len(seeds)
        for ids, matrix in _matrices(batches, width):
            if taken:
                weights = _least(_distances(matrix, chosen))
                weights += np.einsum("ij,ij->i", matrix, matrix)
            for r, seed in enumerate(seeds):
                time = -np.log(_uniform(ids, seed * 1000 + taken))
                if taken:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        time = np.where(weights[r] > 0, time / weights[r], np.inf)
                first = int(np.argmin(time))
                if points[r] is None or time[first] < times[r]:
                    times[r], points[r] = float(time[first]), matrix[first].tolist()
        found = [r for r in range(len(seeds)) if points[r] is not None]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found, pa.int32()),
                    pa.array([times[r] for r in found], pa.float64()),
                    pa.array([points[r] for r in found], pa.list_(pa.float64())),
                ],
                ["restart", "time", "point"],
            )

    winners = blocks.table.mapInArrow(race, "restart int, time double, point array<double>")
    if blocks.tasks > DIRECT_TASKS:
        first = F.min(F.struct("time", "point")).alias("first")
        winners = winners.groupBy("restart").agg(first).select("restart", "first.*")
    points = {}
    for w in winners.collect():
        points[w["restart"]] = min(points.get(w["restart"], w[1:]), w[1:])
    new = np.array([[points[r][1]] for r in range(len(seeds))])
    return np.concatenate([chosen, new], axis=1)


def kmeans_plus_plus(blocks: Blocks, k: int, seeds: list[int]) -> np.ndarray:
    """Starting centres of all restarts, (restarts, k, width), in ``k`` passes."""
    chosen = np.zeros((len(seeds), 0, len(blocks.columns)))
    for _ in range(k):
        chosen = _draw_next(blocks, chosen, seeds)
    return chosen


def _totals(matrices, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the rows nearest to each centre, and each restart's cost."""
    restarts, k, width = centres.shape
    sums, counts = np.zeros((restarts * k, width)), np.zeros(restarts * k)
    costs = np.zeros(restarts)
    for matrix in matrices:
        distances = _distances(matrix, centres)
        best = _least(distances)
        members = _members(distances, best).reshape(restarts * k, -1)
        sums += members.astype(np.float64) @ matrix
        counts += np.count_nonzero(members, axis=1)
        costs += best.sum(axis=1) + np.einsum("ij,ij->", matrix, matrix)
    return sums, counts, costs


def _means(sums: np.ndarray, counts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """New centres; one without rows stays."""
    moved = centres.reshape(-1, centres.shape[2]).copy()
    filled = counts > 0
    moved[filled] = sums[filled] / counts[filled, None]
    return moved.reshape(centres.shape)


def _shift(moved: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((moved - centres) ** 2).sum(axis=(1, 2))


def _sum_names(width: int) -> list[str]:
    return ["n", "cost", *[f"s{j}" for j in range(width)]]


def _sums_schema(width: int) -> str:
    return "restart int, cluster int, " + ", ".join(f"{c} double" for c in _sum_names(width))


def _sum_columns(sums: np.ndarray, counts: np.ndarray, costs: np.ndarray, k: int) -> list[pa.Array]:
    """One task's sums as columns; the first cluster of a restart carries its cost."""
    restarts = len(costs)
    return [
        pa.array(np.repeat(np.arange(restarts, dtype=np.int32), k)),
        pa.array(np.tile(np.arange(k, dtype=np.int32), restarts)),
        pa.array(counts.astype(np.float64)),
        pa.array(np.where(np.arange(restarts * k) % k == 0, np.repeat(costs, k), 0.0)),
        *[pa.array(sums[:, j].copy()) for j in range(sums.shape[1])],
    ]


def _gathered(totals: DataFrame, tasks: int, restarts: int, k: int, width: int, more=()) -> np.ndarray:
    """Counts, costs, sums and ``more`` (restarts * k, 2 + width + ...) over all tasks."""
    measures = [*_sum_names(width), *more]
    totals = totals.select("restart", "cluster", *measures)
    if tasks > DIRECT_TASKS:
        totals = totals.groupBy("restart", "cluster").sum(*measures).toDF("restart", "cluster", *measures)
    table = totals.toArrow()
    place = table["restart"].to_numpy() * k + table["cluster"].to_numpy()
    sums = np.zeros((restarts * k, len(measures)))
    np.add.at(sums, place, np.column_stack([table[c].to_numpy() for c in measures]))
    return sums


def lloyd_pass(blocks: Blocks, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the rows nearest to each centre, and each restart's cost before the move.

    A centre without rows stays.
    """
    restarts, k, width = centres.shape

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, costs = _totals((m for _, m in _matrices(batches, width)), centres)
        names = ["restart", "cluster", *_sum_names(width)]
        yield pa.RecordBatch.from_arrays(_sum_columns(sums, counts, costs, k), names)

    totals = blocks.table.select("matrix").mapInArrow(reduce, _sums_schema(width))
    sums = _gathered(totals, blocks.tasks, restarts, k, width)
    costs = sums[:, 1].reshape(restarts, k).sum(axis=1)
    return _means(sums[:, 2:], sums[:, 0], centres), costs


# Passes over rows that can change their cluster


def _near_change(matrix: np.ndarray, centres: np.ndarray, bounds: np.ndarray):
    """Clusters (restarts, rows), rows that may change one, and squared distances less the row's squared length.

    A row may change from its centre to another one if that is farther by no more
    than ``bounds`` (restarts, centres, centres) of the two.
    """
    distances = _distances(matrix, centres)
    labels = distances.argmin(axis=1)
    best = np.take_along_axis(distances, labels[:, None, :], axis=1)[:, 0]
    square = np.einsum("ij,ij->i", matrix, matrix)
    error = ROUNDING * (square + np.einsum("rkj,rkj->rk", centres, centres).max())
    near = np.sqrt(np.maximum(best + square, 0.0) + error)
    distances += square - error
    np.sqrt(np.maximum(distances, 0.0, out=distances), out=distances)
    within = np.zeros(len(matrix), dtype=bool)
    for r, own in enumerate(labels):
        limit = bounds[r][own].T
        limit += near[r]
        close = distances[r] <= limit
        close[own, np.arange(len(own))] = False
        within |= close.any(axis=0)
    return labels.astype(np.int8), np.flatnonzero(within), best


def _changes(matrix: np.ndarray, labels: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows add to the sums and counts when their clusters (restarts, rows) become the ``centres``'."""
    restarts, k, width = centres.shape
    sums, counts = np.zeros((restarts * k, width)), np.zeros(restarts * k)
    for first in range(0, len(matrix), SLICE):
        part, before = matrix[first : first + SLICE], labels[:, first : first + SLICE]
        after = _distances(part, centres).argmin(axis=1)
        restart, row = np.nonzero(after != before)
        for sign, cluster in ((-1.0, before), (1.0, after)):
            at = restart * k + cluster[restart, row]
            np.add.at(sums, at, sign * part[row])
            np.add.at(counts, at, sign)
    return sums, counts


def _unpacked(block, labels, width: int, restarts: int) -> tuple[np.ndarray, np.ndarray]:
    matrix = _decoded(block.as_buffer(), width)
    return matrix, np.frombuffer(labels.as_buffer(), dtype=np.int8).reshape(restarts, -1)


class Marks:
    """Rows that may change their cluster, with the clusters they had in a full pass.

    ``table`` has one row for each block of them (matrix, clusters of all restarts).
    ``sums`` are those of the full pass, and ``moved`` is how far each centre has come
    since. The other rows stay in their clusters as long as no two centres have moved
    by more than their ``bounds`` together.
    """

    def __init__(self, blocks: Blocks, table: DataFrame, restarts: np.ndarray, bounds: np.ndarray, sums: np.ndarray, rows: int):
        self.blocks, self.table, self.restarts, self.bounds, self.sums, self.rows = blocks, table, restarts, bounds, sums, rows
        self.moved = np.zeros(bounds.shape[:2])
        self.local = self._collected() if rows <= DRIVER_ROWS else None

    def _held(self) -> DataFrame:
        return self.table.where("matrix IS NOT NULL").select("matrix", "labels")

    def _collected(self) -> list:
        width = len(self.blocks.columns)
        batches = self._held().toArrow().to_batches()
        return [_unpacked(*row, width, len(self.restarts)) for batch in batches for row in zip(*batch.columns)]

    def hold(self, active: np.ndarray) -> bool:
        """Whether no row beyond the marked ones can have changed its cluster."""
        places = np.searchsorted(self.restarts, active)
        moved, k = self.moved[places], self.moved.shape[1]
        within = moved[:, :, None] + moved[:, None, :] <= self.bounds[places]
        return bool((within | np.eye(k, dtype=bool)).all())

    def step(self, active: np.ndarray, distances: np.ndarray) -> None:
        self.moved[np.searchsorted(self.restarts, active)] += distances * (1.0 + 1e-9)

    def totals(self, centres: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Counts, costs (of the full pass) and sums of the active restarts for these centres."""
        count, k, width = centres.shape
        places, total = np.searchsorted(self.restarts, active), len(self.restarts)
        base = self.sums.reshape(total, k, -1)[places].reshape(count * k, -1)

        def added(rows) -> tuple[np.ndarray, np.ndarray]:
            sums, counts = np.zeros((count * k, width)), np.zeros(count * k)
            for matrix, labels in rows:
                more, members = _changes(matrix, labels[places], centres)
                sums, counts = sums + more, counts + members
            return sums, counts

        if self.local is not None:
            sums, counts = added(self.local)
            return base + np.column_stack([counts, np.zeros(count * k), sums])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (_unpacked(*row, width, total) for batch in batches for row in zip(*batch.columns))
            names = ["restart", "cluster", *_sum_names(width)]
            yield pa.RecordBatch.from_arrays(_sum_columns(*added(rows), np.zeros(count), k), names)

        changes = self._held().mapInArrow(compare, _sums_schema(width))
        return base + _gathered(changes, self.blocks.tasks, count, k, width)

    def drop(self) -> None:
        self.table.unpersist()


def marking_pass(
    blocks: Blocks, centres: np.ndarray, restarts: np.ndarray, pace: np.ndarray, horizon: int = HORIZON
) -> Marks:
    """A full pass that also keeps the rows that ``horizon`` steps of the last ``pace`` (restarts, k) may change."""
    count, k, width = centres.shape
    names = ["restart", "cluster", *_sum_names(width), "matrix", "labels", "rows"]
    expected = np.maximum(pace, LEAST_PACE * pace.max(axis=1, keepdims=True)) * horizon
    bounds = expected[:, :, None] + expected[:, None, :]
    too_many, all_rows = (1 + MARKED_SHARE) / 2, blocks.rows

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, costs = np.zeros((count * k, width)), np.zeros(count * k), np.zeros(count)
        marked, futile = 0, False
        for batch in batches:
            for block in batch.column("matrix"):
                whole = _decoded(block.as_buffer(), width)
                if futile:
                    some = (whole[i : i + SLICE] for i in range(0, len(whole), SLICE))
                    sums, counts, costs = (x + y for x, y in zip((sums, counts, costs), _totals(some, centres)))
                    marked += len(whole)
                    continue
                kept = []
                for first in range(0, len(whole), SLICE):
                    matrix = whole[first : first + SLICE]
                    labels, near, best = _near_change(matrix, centres, bounds)
                    members = (labels[:, None, :] == np.arange(k)[None, :, None]).reshape(count * k, -1)
                    sums += members.astype(np.float64) @ matrix
                    counts += np.count_nonzero(members, axis=1)
                    costs += best.sum(axis=1) + np.einsum("ij,ij->", matrix, matrix)
                    if len(near):
                        kept.append((matrix[near], labels[:, near]))
                held = sum(len(m) for m, _ in kept)
                if len(whole) >= SLICE and held > too_many * len(whole):
                    # marks on so many rows are dropped: the task keeps no more of them and only adds up
                    futile, marked = True, all_rows + 1
                elif kept:
                    parts = [np.concatenate([m for m, _ in kept]), np.concatenate([n for _, n in kept], axis=1)]
                    marked += len(parts[0])
                    none = [pa.nulls(1, pa.int32())] * 2 + [pa.nulls(1, pa.float64())] * (2 + width)
                    own = [pa.array([x], pa.binary()) for x in (_coded(parts[0]), np.ascontiguousarray(parts[1]).tobytes())]
                    yield pa.RecordBatch.from_arrays([*none, *own, pa.nulls(1, pa.int64())], names)
        rows = np.zeros(count * k, dtype=np.int64)
        rows[0] = marked
        none = [pa.nulls(count * k, pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([*_sum_columns(sums, counts, costs, k), *none, pa.array(rows)], names)

    schema = _sums_schema(width) + ", matrix binary, labels binary, rows long"
    table = blocks.table.select("matrix").mapInArrow(mark, schema).persist(StorageLevel.MEMORY_AND_DISK)
    sums = _gathered(table.where("restart IS NOT NULL"), blocks.tasks, count, k, width, ["rows"])
    return Marks(blocks, table, restarts, bounds, sums[:, :-1], int(sums[:, -1].sum()))


def settled_centres(blocks: Blocks, centres: np.ndarray, limit: float, max_iter: int) -> np.ndarray:
    """Centres of all restarts after they have come to rest, or after ``max_iter`` passes."""
    centres = centres.copy()
    active = np.arange(len(centres))
    marks, pace, next_try, horizon = None, np.zeros(centres.shape[:2]), FULL_PASSES, HORIZON
    try:
        for number in range(max_iter):
            old = centres[active]
            if marks is not None and not marks.hold(active):
                marks.drop()
                marks = None
            if marks is not None:
                sums = marks.totals(old, active)
                moved = _means(sums[:, 2:], sums[:, 0], old)
            elif number >= next_try:
                marks = marking_pass(blocks, old, active, pace[active], horizon)
                # Passes on the driver cost next to nothing, so the next marks may hold for longer.
                horizon = 3 * HORIZON if marks.rows <= DRIVER_ROWS // 2 else HORIZON
                moved = _means(marks.sums[:, 2:], marks.sums[:, 0], old)
                if marks.rows > MARKED_SHARE * blocks.rows:
                    marks.drop()
                    marks, next_try = None, number + HORIZON // 2
            else:
                moved, _ = lloyd_pass(blocks, old)
            pace[active] = np.sqrt(((moved - old) ** 2).sum(axis=2))
            if marks is not None:
                marks.step(active, pace[active])
            centres[active] = moved
            active = active[_shift(moved, old) > limit]
            if len(active) == 0:
                break
    finally:
        if marks is not None:
            marks.drop()
    return centres


def lloyd_rounds(
    features: DataFrame, centres: list, rounds: int, columns=FEATURES
) -> list[tuple[int, list[float]]]:
    """Centres after a fixed number of rounds from fixed starting centres."""
    with packed(features, columns) as blocks:
        moving = np.array([[centre for _, centre in centres]]) - blocks.mean
        for _ in range(rounds):
            moving, _ = lloyd_pass(blocks, moving)
    return _numbered(moving[0] + blocks.mean)


def _numbered(centres: np.ndarray) -> list[tuple[int, list[float]]]:
    return [(k, [float(x) for x in centre]) for k, centre in enumerate(centres)]


def hashed_start(df: DataFrame, k: int = CLUSTERS, columns=FEATURES):
    """The ``k`` rows with the smallest hash of their id as starting centres."""
    rows = df.orderBy(F.md5(F.col(ROW_ID).cast("string")), ROW_ID).limit(k)
    return [
        (i, [r[c] for c in columns]) for i, r in enumerate(rows.select(*columns).collect())
    ]


def centroid_table(spark: SparkSession, centres) -> DataFrame:
    return spark.createDataFrame(
        [(k, [float(x) for x in centre]) for k, centre in centres], CENTROID_SCHEMA
    )


def restart_fits(
    features: DataFrame,
    restarts: int,
    k: int = CLUSTERS,
    seed: int = SEED,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> list[tuple[float, list]]:
    """Cost and centres of each restart, in their order.

    Restart ``i`` starts by k-means++ with seed ``seed + i`` and moves over all
    rows until its centres shift by no more
    than ``tol`` times the mean variance of the features. Restarts that stand
    still leave the later passes.
    """
    with packed(features) as blocks:
        if blocks.rows < k:
            raise ValueError(f"{blocks.rows} rows cannot form {k} clusters")
        centres = kmeans_plus_plus(blocks, k, [seed + i for i in range(restarts)])
        centres = settled_centres(blocks, centres, tol * blocks.variance, max_iter)
        _, costs = lloyd_pass(blocks, centres)
    return [(float(costs[i]), _numbered(centres[i] + blocks.mean)) for i in range(restarts)]


def fit_restarts(features: DataFrame, restarts: int, **options) -> list[tuple[float, list]]:
    """The same, the lowest cost first."""
    return sorted(restart_fits(features, restarts, **options), key=lambda f: f[0])


def fit_kmeans(features: DataFrame, restarts: int, **options) -> DataFrame:
    """Centroid table of the restart with the lowest cost."""
    _, centres = fit_restarts(features, restarts, **options)[0]
    return centroid_table(features.sparkSession, centres)
