"""The last value of every gauge as a table that stays small to read.

Every batch adds a delta of its own gauges.  After ``fold_every`` deltas they are folded with the base to a new base,
one row per name and label set, and removed.  A base names the deltas it holds, so a stop between writing it and
removing them counts none twice; a base whose writing did not end is passed over.  Readers see at most one base and
about ``fold_every`` deltas, however long the stream has run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelag.model import METRICS
from tidelag.operators.gauges import last_values
from tidelag.streaming import files


class GaugeTable:
    """One writer, the stream named ``stream``; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, stream: str = "main", fold_every: int = 20):
        self.spark = spark
        self.root = f"{path.rstrip('/')}/{stream}"
        self.fold_every = fold_every

    def add(self, gauges: DataFrame, batch: str | int) -> None:
        """Add the gauges of a batch (name, labels, value, at_ms); repeating a batch replaces its delta."""
        gauges.select(*METRICS.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/delta/{batch}")
        if len(self._deltas()) >= self.fold_every:
            self.fold()

    def _base(self) -> str | None:
        root = f"{self.root}/base"
        whole = [b for b in files.names(self.spark, root) if "_SUCCESS" in files.names(self.spark, f"{root}/{b}/held")]
        return max(whole, key=int, default=None)

    def _held(self, base: str | None) -> set[str]:
        """Deltas that the base holds already."""
        if base is None:
            return set()
        return {r[0] for r in self.spark.read.schema("delta string").parquet(f"{self.root}/base/{base}/held").collect()}

    def _deltas(self) -> list[str]:
        return files.complete(self.spark, f"{self.root}/delta")

    def _rows(self, base: str | None, deltas: list[str]) -> DataFrame:
        paths = [f"{self.root}/delta/{d}" for d in deltas] + ([] if base is None else [f"{self.root}/base/{base}/rows"])
        if not paths:
            return self.spark.createDataFrame([], METRICS)
        return last_values(self.spark.read.schema(METRICS).parquet(*paths))

    def read(self) -> DataFrame:
        """Last value per name and label set."""
        base = self._base()
        held = self._held(base)
        return self._rows(base, [d for d in self._deltas() if d not in held])

    def fold(self) -> None:
        base, deltas = self._base(), self._deltas()
        held = self._held(base)
        number = 0 if base is None else int(base) + 1
        target = f"{self.root}/base/{number}"
        self._rows(base, [d for d in deltas if d not in held]).write.mode("overwrite").parquet(f"{target}/rows")
        # With the names of its deltas, written last, a base counts as whole.
        names = self.spark.createDataFrame([(d,) for d in deltas], "delta string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{target}/held")
        for d in deltas:
            files.delete(self.spark, f"{self.root}/delta/{d}")
        for b in files.names(self.spark, f"{self.root}/base"):
            if int(b) < number - 1:  # the last one may still be read
                files.delete(self.spark, f"{self.root}/base/{b}")
