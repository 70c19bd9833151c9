"""Caches of raw resources and of parsed documents, as tables that are read through.

Raw resources are keyed by their source and by who may see them, parsed documents by where they came
from, what they hold and how they were normalised: nothing has to be invalidated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ident
from quire.sources import router

from .telemetry import observed

RAW = "key string, source string, final_source string, media_type string, bytes binary, etag string, last_modified string, metadata map<string,string>"


def raw_key(source: Column, profile: Column | None = None) -> Column:
    """A resource's key; what one profile may fetch isn't another's."""
    scope = F.lit("") if profile is None else F.coalesce(profile, F.lit(""))
    return F.sha2(F.concat(ident.binary("raw"), F.unhex(F.lit("00")), scope.cast("binary"), F.unhex(F.lit("00")), source.cast("binary")), 256)


def parsed_key(source: Column, content_hash: Column, normalization: str = ident.NORMALIZATION) -> Column:
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(source.cast("binary"), zero, content_hash.cast("binary"), zero, ident.binary(normalization)), 256)


class Table:
    """Rows by key in a folder; a key's last row counts. Rows are appended, and folded when `compact` is called."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _written(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder + "/*.parquet")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return found is not None and len(found) > 0

    def rows(self) -> DataFrame:
        if not self._written():
            return self.spark.createDataFrame([], self.schema)
        at = self.spark.read.parquet(self.folder)
        names = [c for c in at.columns if c not in ("key", "put_at")]
        return at.groupBy("key").agg(F.max_by(F.struct(*names), "put_at").alias("r")).select("key", "r.*")

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (key)."""
        with observed("cache_get", table=self.folder.rpartition("/")[2]):
            return self.rows().join(keys.select("key").distinct(), "key", "left_semi")

    def put(self, rows: DataFrame) -> None:
        with observed("cache_put", table=self.folder.rpartition("/")[2]):
            rows.withColumn("put_at", F.current_timestamp()).write.mode("append").parquet(self.folder)

    def read_through(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows for all of wanted (key, ...): those that are held, and those that make() gives for the rest,
        which are held from then on. Calls that run again put the same rows again, which changes nothing."""
        missing = wanted.join(self.rows().select("key"), "key", "left_anti")
        self.put(make(missing))
        return self.get(wanted)


def parse_through(resources: DataFrame, folder: str, limits: router.Limits | None = None, normalization: str = ident.NORMALIZATION) -> DataFrame:
    """router.parse(), but only of resources that weren't parsed before under this normalisation."""
    spark = resources.sparkSession
    schema = router.parse(resources.limit(0), limits).schema
    held = Table(spark, folder, "key string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
    hashed = F.concat(F.lit("sha256:"), F.sha2("bytes", 256))
    wanted = resources.withColumn("key", parsed_key(F.col("source"), hashed, normalization))

    def make(missing: DataFrame) -> DataFrame:
        parsed = router.parse(missing, limits)
        return parsed.withColumn("key", parsed_key(F.col("source"), F.col("content_hash"), normalization)).select("key", *schema.names)

    return held.read_through(wanted, make).select(*schema.names)


def revalidation(requests: DataFrame, held: DataFrame) -> DataFrame:
    """What to do for requests (source, profile, force): `fetch` without conditions, fetch with the held
    validators (`conditional`), or `reuse` what is held, which has none to ask with."""
    at = requests.withColumn("key", raw_key(F.col("source"), F.col("profile")))
    known = held.select("key", "etag", "last_modified", F.lit(True).alias("_held"))
    at = at.join(known, "key", "left")
    asks = F.col("etag").isNotNull() | F.col("last_modified").isNotNull()
    action = F.when(F.col("_held").isNull() | F.coalesce("force", F.lit(False)), "fetch").when(asks, "conditional").otherwise("reuse")
    return at.withColumn("action", action).drop("_held")


def settled(answers: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of RAW from answers (key, status, and the columns of RAW): 304 takes the held body, with the
    validators that the answer has, if any."""
    names = [x.split()[0] for x in RAW.split(", ") if not x.startswith("key ")]
    old = held.select("key", *[F.col(c).alias(f"_{c}") for c in names])
    at = answers.join(old, "key", "left")
    same = F.col("status") == 304
    own = lambda c: F.coalesce(c, f"_{c}") if c in ("etag", "last_modified") else F.col(f"_{c}")
    return at.where((F.col("status") == 200) | (same & F.col("_source").isNotNull())).select("key", *[F.when(same, own(c)).otherwise(F.col(c)).alias(c) for c in names])
