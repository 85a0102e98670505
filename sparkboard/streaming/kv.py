"""A keyed store of versions, compacted by levels.

Each batch is a run of level 0. Compaction merges the runs of level 0 into the run of level 1 and, while
that is larger than its level may be, on into the next; each level below 0 has one run, so a reader meets a bounded
number of runs and every row is written about once for each level. Deletions are dropped once nothing lies below them.

A manifest names the runs that make up the store. It is written after its runs are complete, and readers take the newest
complete one, so a compaction that breaks off changes nothing. Runs that neither of the two newest manifests names are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete_folder

BASE, RATIO = 100_000, 10


class KeyValue:
    """Rows by ``key``; of a key's rows the largest ``order`` counts, of equal ones the later batch. ``deleted`` marks deletions."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, deleted: str = "deleted", base: int = BASE, ratio: int = RATIO) -> None:
        self.spark, self.path, self.key, self.order, self.deleted = spark, path.rstrip("/"), key, order, deleted
        self.schema, self.base, self.ratio = schema, base, ratio

    def _complete(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))

    def _manifest(self, number: int | None = None) -> list[tuple[int, str, int, int]]:
        """(level, run, rows, last batch) of the newest manifest or of one: a row for each level."""
        numbers = self._complete("manifest")
        if not numbers:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifest/{numbers[-1] if number is None else number}").collect()
        return sorted((r.level, r.run, r.rows, r.upto) for r in rows)

    def _upto(self, manifest: list[tuple[int, str, int, int]]) -> int:
        return max((m[3] for m in manifest), default=-1)

    def write(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch's newest row of each key. A batch that runs again overwrites its run, or does nothing once it is merged."""

        def run(batch: DataFrame, number: int) -> None:
            if number > self._upto(self._manifest()):
                self._newest(batch.withColumn("batch_", F.lit(number).cast("long"))).write.mode("overwrite").parquet(f"{self.path}/batch/{number}")

        return run

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(self.order, "batch_")).alias("r")).select("r.*")

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch_ long").parquet(f"{self.path}/{name}")

    def runs(self) -> list[str]:
        """What a reader meets: the manifest's runs and the batches after it."""
        manifest = self._manifest()
        upto = self._upto(manifest)
        return [m[1] for m in manifest if m[1]] + [f"batch/{n}" for n in self._complete("batch") if n > upto]

    def state(self) -> DataFrame:
        """The present rows, without deleted keys."""
        parts = [self._run(name) for name in self.runs()]
        every = self.spark.createDataFrame([], f"{self.schema}, batch_ long")
        for part in parts:
            every = every.unionByName(part)
        return self._newest(every).where(~F.coalesce(F.col(self.deleted), F.lit(False))).drop("batch_", self.deleted)

    def compact(self) -> None:
        """Merges the batches since the last time into the levels."""
        manifest = self._manifest()
        upto = self._upto(manifest)
        batches = [n for n in self._complete("batch") if n > upto]
        if not batches:
            return
        levels = {m[0]: m for m in manifest if m[1]}
        names, level = [f"batch/{n}" for n in batches], 0
        while True:
            level += 1
            names += [levels.pop(level)[1]] if level in levels else []
            lowest = not any(k > level for k in levels)
            merged = self._run(names[0])
            for name in names[1:]:
                merged = merged.unionByName(self._run(name))
            merged = self._newest(merged)
            if lowest:  # nothing older is left that a deletion would have to hide
                merged = merged.where(~F.coalesce(F.col(self.deleted), F.lit(False)))
            run = f"runs/{uuid.uuid4().hex}"
            merged.write.parquet(f"{self.path}/{run}")
            rows = self._run(run).count()
            names = [run]
            if rows <= self.base * self.ratio ** (level - 1) or lowest and rows <= self.base * self.ratio**level:
                break
        levels[level] = (level, run, rows, batches[-1])
        number = max(self._complete("manifest"), default=-1) + 1
        table = self.spark.createDataFrame([m for m in levels.values()], "level int, run string, rows long, upto long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        self._clean(number)

    def _clean(self, number: int) -> None:
        kept = {m[1] for n in (number - 1, number) if n >= 0 for m in self._manifest(n)}
        old = self._upto(self._manifest(number - 1)) if number else -1
        for n in self._complete("batch"):
            if n <= old:
                delete_folder(self.spark, f"{self.path}/batch/{n}")
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for x in fs.listStatus(folder):
            if f"runs/{x.getPath().getName()}" not in kept:
                fs.delete(x.getPath(), True)
        for n in self._complete("manifest"):
            if n < number - 1:
                delete_folder(self.spark, f"{self.path}/manifest/{n}")
