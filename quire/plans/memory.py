"""A store in the driver's memory: the tables of Store without files, for tests and a few documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store, replaced


class MemoryStore(Store):
    """Store without a folder. Every table is held by the driver as an Arrow table, so it suits only what
    fits there; a missing document gives no rows."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "", 1)
        self.held: dict[str, DataFrame] = {}
        self.versions: str | None = None

    def _exists(self, name: str) -> bool:
        return name in self.held

    def table(self, name: str, document_id: str | None = None) -> DataFrame:
        at = self.held[name]
        return at if document_id is None else at.where(F.col("document_id") == document_id)

    def _replace(self, name: str, rows: DataFrame, ids: DataFrame) -> None:
        self.held[name] = self._stage(name, rows if name not in self.held else replaced(self.held[name], rows, ids))

    def _stage(self, name: str, rows: DataFrame) -> DataFrame:
        return self.spark.createDataFrame(rows.toArrow(), rows.schema)

    def _stamp(self) -> None:
        pass
