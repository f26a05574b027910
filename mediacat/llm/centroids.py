"""Groups of nodes by their measured speeds: centroids over dot products that are kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from mediacat.llm.shared import removed, shared_folder, written

COMPONENTS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Whole numbers up to this keep 64 squared differences within 64 bits.
LARGEST = 2.0**27

STATE = "node_id bigint, vec binary, dots binary, cluster int, was int, distance bigint"
SUMS = "cluster int, component int, total bigint"


def speed_vectors(nodes: DataFrame, encoders: list[str], node_id: str = "id", benchmarks: str = "benchmarks") -> DataFrame:
    """The nodes table as node_id, speeds: each node's measured speeds in the order of `encoders`, 0 where
    it has none."""
    speeds = [F.coalesce(F.try_element_at(F.col(benchmarks), F.lit(e)), F.lit(0.0)).cast("double") for e in encoders]
    return nodes.select(F.col(node_id).alias("node_id"), F.array(*speeds).alias("speeds"))


def _whole_numbers(scale: int, components: int):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            vecs = np.floor(x * float(scale)).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in vecs], pa.binary())], names=["node_id", "vec"])

    return convert


def _rows_of(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _advance(change: np.ndarray, centroids: np.ndarray):
    """Bring the dot products up to date with `change` of the centroids, at its nonzero components only, and
    assign anew. Rows without dot products start from centroids at zero."""
    k, components = centroids.shape
    moved = [(j, np.flatnonzero(change[j])) for j in range(k) if change[j].any()]
    norms = (centroids * centroids).sum(1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                vecs = _rows_of(part.column("vec"), "<i4", components).astype(np.int64)
                held = part.column("dots").null_count == 0
                dots = _rows_of(part.column("dots"), "<i8", k).copy() if held else np.zeros((len(part), k), np.int64)
                for j, places in moved:
                    dots[:, j] += vecs[:, places] @ change[j, places]
                score = norms - 2 * dots
                cluster = score.argmin(1)
                distance = (vecs * vecs).sum(1) + score[np.arange(len(part)), cluster]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node_id"), part.column("vec"), pa.array([d.tobytes() for d in dots.astype("<i8")], pa.binary()),
                        pa.array(cluster.astype(np.int32)), part.column("cluster"), pa.array(distance),
                    ],
                    names=["node_id", "vec", "dots", "cluster", "was", "distance"],
                )

    return step


def _moves(clusters: int, components: int):
    """What the vectors that changed cluster add to and take from the sums; component -1 counts them."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((clusters, components + 1), np.int64)
        for batch in batches:
            vecs = _rows_of(batch.column("vec"), "<i4", components).astype(np.int64)
            now = batch.column("cluster").to_numpy(zero_copy_only=False)
            was = batch.column("was").fill_null(-1).to_numpy(zero_copy_only=False)
            for j in range(clusters):
                for sign, owner in ((1, now), (-1, was)):
                    own = vecs[owner == j]
                    sums[j, 1:] += sign * own.sum(0)
                    sums[j, 0] += sign * len(own)
        j, c = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(j.astype(np.int32)), pa.array((c - 1).astype(np.int32)), pa.array(sums[j, c])], names=["cluster", "component", "total"]
        )

    return add_up


def cluster_speeds(
    nodes: DataFrame, node_id: str = "node_id", speeds: str = "speeds", components: int = COMPONENTS, scale: int = SCALE,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """Nodes in groups of like speeds: node_id, cluster, distance, cluster_inertia, inertia, centroid.

    A node counts if it has exactly `components` speeds, none NULL, NaN, infinite or, times `scale`, beyond 2**27
    in size (64-bit distances end there); the others have no row. A speed x becomes floor(scale * x). The first
    centroids are the nodes with the smallest SHA-256 of `seed:node_id` (equal ones by vector, NULL ids last; fewer
    nodes than `clusters` give fewer centroids). `rounds` times every node goes to the nearest centroid (squared
    Euclidean distance, ties to the smaller number) and each centroid that has nodes becomes floor(sum / count) of
    them, component by component; then all are assigned once more. All of it is in whole numbers and exact.

    A node's dot products with the centroids are kept in a written table, its distance matrix but for the two
    norms. A round adds vector times change only for the components of centroids that changed, and sums only the
    nodes that moved. Once no centroid changes, later rounds would change nothing and are left out. The driver
    sees `clusters` vectors, whatever the number of nodes; no node is shuffled. Each round's table replaces the one
    before.

    No rows give no rows; repeated rows count each; other columns are not looked at.
    """
    spark = nodes.sparkSession
    folder = shared_folder(spark)
    found = nodes.select(F.col(node_id).cast("bigint").alias("node_id"), F.col(speeds).cast("array<double>").alias("speeds"))
    sound = F.forall("speeds", lambda x: F.coalesce((F.abs(x * scale) < LARGEST) & ~F.isnan(x), F.lit(False)))
    found = found.where((F.size("speeds") == components) & sound)
    table = written(found.mapInArrow(_whole_numbers(scale, components), "node_id bigint, vec binary"), folder, "vectors")

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("node_id").cast("string")), 256)
    first = table.orderBy(order.asc_nulls_last(), "vec").limit(clusters).collect()
    if not first:
        return table.select(
            "node_id", F.lit(None).cast("int").alias("cluster"),
            *[F.lit(None).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit(None).cast("array<bigint>").alias("centroid"),
        )
    centroids = np.stack([np.frombuffer(r["vec"], "<i4").astype(np.int64) for r in first])
    k = len(centroids)
    change, sums, before = centroids, np.zeros((k, components + 1), object), "vectors"
    table = table.select(
        "node_id", "vec", F.lit(None).cast("binary").alias("dots"),
        *[F.lit(None).cast("int").alias(c) for c in ("cluster", "was")], F.lit(None).cast("bigint").alias("distance"),
    )
    for turn in range(rounds + 1):
        name = f"assigned{turn}"
        table = written(table.mapInArrow(_advance(change, centroids), STATE), folder, name)
        removed(spark, folder, before)
        before = name
        if turn == rounds:
            break
        changed = table.where(~F.col("cluster").eqNullSafe(F.col("was"))).select("vec", "cluster", "was")
        totals = changed.mapInArrow(_moves(k, components), SUMS).groupBy("cluster", "component")
        for r in totals.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # one row for each centroid and component
            sums[r["cluster"], r["component"] + 1] += int(r["total"])
        moved = [[int(s) // int(row[0]) for s in row[1:]] if row[0] else own for row, own in zip(sums, centroids.tolist())]
        change = np.array(moved, np.int64) - centroids
        if not change.any():
            break
        centroids = centroids + change

    inertia = {r["cluster"]: r["s"] for r in table.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = [
        Row(cluster=j, cluster_inertia=int(inertia.get(j, 0)), inertia=int(sum(inertia.values())), centroid=centroids[j].tolist())
        for j in range(k)
    ]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return table.select("node_id", "cluster", "distance").join(F.broadcast(facts), "cluster")
