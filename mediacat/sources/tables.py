"""Keyed table writers on Parquet folders.

Each write goes to a new version folder and the caller switches to it, so a job that loses
executors half-way leaves the old version whole.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.operators.keyed import latest_per_key


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], order: list[str], kept: list[str] | None = None
) -> DataFrame:
    """Old rows replaced by new ones with the same key; several new rows: the latest by `order`.

    Columns in `kept` stay as they were once they have a value.
    """
    fresh = latest_per_key(new, keys, order)
    kept = kept or []
    renamed = fresh.withColumnsRenamed({c: f"__new_{c}" for c in fresh.columns if c not in keys})
    renamed = renamed.withColumn("__hit", F.lit(True))

    def pick(name: str):
        if name in keys:
            return F.col(name)
        newer = F.col(f"__new_{name}") if name in new.columns else F.lit(None)
        if name in kept:
            return F.coalesce(F.col(name), newer).alias(name)
        if name not in new.columns:
            return F.col(name)
        return F.when(F.col("__hit"), newer).otherwise(F.col(name)).alias(name)

    return old.join(renamed, keys, "full").select(*[pick(c) for c in old.columns])


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def write_version(table: DataFrame, folder: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write a table as `folder/v=<version>` and return that path."""
    target = f"{folder.rstrip('/')}/v={version}"
    writer = table.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, which all executors share; a temporary one on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/mediacat-scratch"
    return f"{base.rstrip('/')}/mediacat-{uuid.uuid4().hex}"


def _below(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Run:
    """Sorted out rows of batches low..high of one bucket: hash % 2**level = bucket."""

    low: int
    high: int
    level: int
    bucket: int
    rows: int
    path: str


LOG = "low bigint, high bigint, level int, bucket bigint, rows bigint, path string, credit bigint, at_level int"


def families(runs: list[Run]) -> list[list[Run]]:
    """Runs by the coarsest bucket that covers them; a family shares no key with another one."""
    roots: dict[tuple[int, int], list[Run]] = {}
    for run in sorted(runs, key=lambda r: r.level):
        root = next(((k, run.bucket % 2**k) for k in range(run.level) if (k, run.bucket % 2**k) in roots), (run.level, run.bucket))
        roots.setdefault(root, []).append(run)
    return list(roots.values())


def newest_to_merge(family: list[Run]) -> list[Run]:
    """The newest runs of a family, back to the first that has more rows than all newer ones together.

    So a row is rewritten at most once each time the rows behind it double, and a bucket holds
    about as many runs as its rows have binary digits.
    """
    by_batch: dict[int, list[Run]] = defaultdict(list)
    for run in family:
        by_batch[run.high].append(run)
    order = sorted(by_batch, reverse=True)
    taken, size = list(by_batch[order[0]]), sum(r.rows for r in by_batch[order[0]])
    for n, high in enumerate(order[1:], 1):
        rows = sum(r.rows for r in by_batch[high])
        if rows > size:
            return taken if n > 1 else []
        taken, size = taken + by_batch[high], size + rows
    return taken if len(order) > 1 else []


class KeyedTable:
    """A table kept by key as a log: every batch adds delta files, which are merged bit by bit.

    Rows lie in 2**level buckets by a hash of the key. A batch writes its own rows once, in the buckets it has
    keys of, and then merges the newest runs of some buckets (`newest_to_merge`), those with the most runs first,
    as far as its credit goes: `merge_rows` rows for each row written, what is not used is kept for later
    batches. The level goes up by one when buckets hold over `bucket_rows` rows on average; older runs
    keep their coarser buckets until they are merged, which splits them. Reading is one aggregate over all runs,
    and none if no bucket has two.

    Of rows with one key the newest batch counts, within a batch the latest by `order`; columns in `kept` stay as
    they were once they have a value. Every batch ends with a list of runs, written last: a batch that fails
    half-way changes nothing, one that is run again after it finished does nothing. Runs that neither this
    list nor the one before it names are deleted, so a reader has the time of one batch to finish.
    """

    def __init__(
        self, folder: str, schema: str | T.StructType, keys: list[str], order: list[str], kept: list[str] | None = None,
        bucket_rows: int = 2_000_000, merge_rows: int = 4,
    ):
        self.folder, self.keys, self.order, self.kept = folder.rstrip("/"), keys, order, kept or []
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.stored = T.StructType([*self.schema.fields, T.StructField("__batch", T.LongType())])
        self.bucket_rows, self.merge_rows = bucket_rows, merge_rows

    def runs(self, spark: SparkSession, back: int = 0) -> tuple[int, int, int, list[Run]]:
        """Batch number, credit, level and runs of the newest finished list, or of one `back` before it."""
        lists = sorted(
            (n for n in (int(x.removeprefix("v=")) for x in _below(spark, f"{self.folder}/lists") if x.startswith("v="))
             if "_SUCCESS" in _below(spark, f"{self.folder}/lists/v={n}")), reverse=True,
        )
        if len(lists) <= back:
            return 0, 0, 0, []
        rows = spark.read.schema(LOG).json(f"{self.folder}/lists/v={lists[back]}").collect()
        facts = next(r for r in rows if r["path"] is None)
        runs = [Run(*[r[c] for c in ("low", "high", "level", "bucket", "rows", "path")]) for r in rows if r["path"] is not None]
        return lists[back], facts["credit"], facts["at_level"], runs

    def _bucket(self, level: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(2**level)).alias("b")

    def _files(self, spark: SparkSession, runs: list[Run]) -> DataFrame:
        return spark.read.schema(self.stored).parquet(*[r.path for r in runs])

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row a key. Kept columns come from the oldest batch that has a value."""
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = F.max_by(F.struct(*[c for c in rest if c not in self.kept], F.col("__batch")), "__batch").alias("__new")
        oldest = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__batch"))).alias(c) for c in self.kept]
        whole = rows.groupBy(*self.keys).agg(newest, *oldest)
        names = [*self.schema.names, "__batch"]
        return whole.select(*[F.col(c) if c in self.keys or c in self.kept else F.col("__new")[c].alias(c) for c in names])

    def _write(self, rows: DataFrame, level: int, name: str) -> dict[int, int]:
        """Rows by bucket below runs/`name`; how many each has.

        A rebalance, not a repartition by bucket: a first batch has but one bucket, which AQE cuts into tasks of its
        advisory size, so that no task sorts a whole bucket.
        """
        spark, path = rows.sparkSession, f"{self.folder}/runs/{name}"
        rows.withColumn("b", self._bucket(level)).hint("rebalance", "b").write.mode("overwrite").partitionBy("b").parquet(path)
        written = spark.read.schema(T.StructType([*self.stored.fields, T.StructField("b", T.LongType())])).parquet(path)
        return {r["b"]: r["count"] for r in written.groupBy("b").count().collect()}  # a row for each bucket

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Bring a batch in; `foreachBatch` can call it."""
        spark, number = batch.sparkSession, batch_id + 1
        done, credit, level, runs = self.runs(spark)
        if done >= number:
            return
        fresh = latest_per_key(batch.select(*self.schema.names), self.keys, self.order)
        counts = self._write(fresh.withColumn("__batch", F.lit(number).cast("bigint")), level, f"v={number}")
        runs = runs + [Run(number, number, level, b, n, f"{self.folder}/runs/v={number}/b={b}") for b, n in counts.items()]
        while sum(r.rows for r in runs) > self.bucket_rows * 2**level:
            level += 1
        credit += self.merge_rows * sum(counts.values())

        chosen: list[tuple[Run, list[Run]]] = []
        for family in sorted(families(runs), key=lambda f: -len({r.high for r in f})):
            merge = newest_to_merge(family)
            cost = sum(r.rows for r in merge)
            if merge and cost <= credit:
                chosen.append((family[0], merge))
                credit -= cost
        if chosen:
            old = {r for _, merge in chosen for r in merge}
            counts = self._write(self._merged(self._files(spark, list(old))), level, f"m={number}")
            runs = [r for r in runs if r not in old]
            for root, merge in chosen:
                low, high = min(r.low for r in merge), max(r.high for r in merge)
                own = [b for b in counts if b % 2**root.level == root.bucket]
                runs += [Run(low, high, level, b, counts[b], f"{self.folder}/runs/m={number}/b={b}") for b in own]
        self._list(spark, number, credit, level, runs)

    def _list(self, spark: SparkSession, number: int, credit: int, level: int, runs: list[Run]) -> None:
        rows = [(r.low, r.high, r.level, r.bucket, r.rows, r.path, None, None) for r in runs]
        rows.append((None, None, None, None, None, None, credit, level))
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").json(f"{self.folder}/lists/v={number}")
        before, *_, held = self.runs(spark, back=1)
        older, *_, gone = self.runs(spark, back=2)
        used = {r.path for r in [*runs, *held]}
        for path in {r.path for r in gone} - used:
            _delete(spark, path)
        if older:
            _delete(spark, f"{self.folder}/lists/v={older}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The table after its last finished batch."""
        *_, runs = self.runs(spark)
        if not runs:
            return spark.createDataFrame([], self.schema)
        rows = self._files(spark, runs)
        several = any(len({r.high for r in family}) > 1 for family in families(runs))
        return (self._merged(rows) if several else rows).select(*self.schema.names)
