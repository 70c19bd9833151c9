"""Parquet tables of documents and what is derived from them, replaced by document.

Tables are partitioned by a bucket of the document id, so that replacing documents rewrites their
buckets only and reading one document reads one bucket. Derived tables carry versions; a store
written with other versions rebuilds them from sections, which stay."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ident
from quire.operators import lexical, units
from quire.sources import router

VERSIONS = {"segmentation": ident.SEGMENTATION, "tokenizer": "quire-tokens/2", "index": "quire-index/4"}
BASE = ("documents", "sections", "blocks")
DERIVED = ("paragraphs", "sentences", "lexical_units", "postings", "indexed")


def replaced(old: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """old with all rows of the documents in ids replaced by those that new has, if any."""
    return old.join(ids.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def stale(documents: DataFrame, indexed: DataFrame, versions: str) -> DataFrame:
    """document_id of documents that have no row in indexed (document_id, versions), or one of other versions."""
    return documents.select("document_id").join(indexed.where(F.col("versions") == versions), "document_id", "left_anti")


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def bucket(self, document_id: Column) -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, name: str) -> bool:
        """Whether a table has data; one without rows has no bucket folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name) + ("/*" if name.startswith("_") else "/bucket=*"))
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return found is not None and len(found) > 0

    def table(self, name: str, document_id: str | None = None) -> DataFrame:
        if not self._exists(name):
            return self.spark.read.parquet(self._path(f"_schemas/{name}"))
        at = self.spark.read.parquet(self._path(name))
        if document_id is not None:  # prunes to one bucket, then to row groups
            number = self.spark.range(1).select(self.bucket(F.lit(document_id))).first()[0]
            at = at.where((F.col("bucket") == number) & (F.col("document_id") == document_id))
        return at.drop("bucket")

    def _replace(self, name: str, rows: DataFrame, ids: DataFrame) -> None:
        """New rows take the place of all rows of the documents in ids; only their buckets are written.
        Rows go to a staging folder first, since buckets are read and overwritten."""
        new = rows.withColumn("bucket", self.bucket(F.col("document_id")))
        if self._exists(name):
            touched = ids.select(self.bucket(F.col("document_id")).alias("bucket")).distinct()  # at most self.buckets rows
            old = self.spark.read.parquet(self._path(name)).join(F.broadcast(touched), "bucket", "left_semi")
            new = replaced(old, new, ids)
        new.drop("bucket").limit(0).coalesce(1).write.mode("overwrite").parquet(self._path(f"_schemas/{name}"))
        staged = self._path(f"_staging/{name}")
        new.write.mode("overwrite").parquet(staged)
        out = self.spark.read.schema(new.schema).parquet(staged).repartition("bucket").sortWithinPartitions("document_id")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._path(name))

    def _stage(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written where steps that read them several times find them."""
        staged = self._path(f"_staging/{name}")
        rows.write.mode("overwrite").parquet(staged)
        return self.spark.read.schema(rows.schema).parquet(staged)

    def put(self, parsed: DataFrame) -> None:
        """Replace the documents that router.parse() gives, and what is derived from them. The documents
        table, by which others know that a document is stored, is written last: after a failure in between,
        its documents are missing or old, and putting them again mends all tables."""
        parsed = self._stage("parsed", parsed)
        secs, blocks = router.sections(parsed), router.blocks(parsed)
        docs = router.documents(parsed)
        docs = docs.join(normalized_hashes(secs, blocks, docs), "document_id", "left")
        ids = docs.select("document_id").distinct()
        self._replace("sections", secs, ids)
        self._replace("blocks", blocks, ids)
        self._derive(docs, secs, blocks, ids)
        self._replace("documents", docs, ids)
        self._stamp()

    def _derive(self, docs: DataFrame, secs: DataFrame, blocks: DataFrame, ids: DataFrame) -> None:
        paras = units.paragraphs(secs, blocks)
        sents = units.sentences(paras)
        self._replace("paragraphs", units.with_paragraph_ids(paras, docs), ids)
        self._replace("sentences", units.with_sentence_ids(sents, docs), ids)
        found = lexical.candidates(secs, paras, sents)
        self._replace("lexical_units", found, ids)
        self._replace("postings", lexical.postings(self.table("lexical_units").join(ids, "document_id", "left_semi")), ids)
        versions = F.lit(json.dumps(VERSIONS, sort_keys=True)).alias("versions")
        self._replace("indexed", ids.select("document_id", versions), ids)

    def _stamp(self) -> None:
        self.spark.createDataFrame([(json.dumps(VERSIONS, sort_keys=True),)], "versions string").coalesce(1).write.mode("overwrite").parquet(self._path("_versions"))

    def current(self) -> bool:
        return self._exists("_versions") and self.spark.read.parquet(self._path("_versions")).first()[0] == json.dumps(VERSIONS, sort_keys=True)

    def unindexed(self) -> DataFrame:
        """document_id of documents whose derived rows are missing, or were made by other versions."""
        docs = self.table("documents").select("document_id")
        if not self._exists("indexed"):
            return docs
        return stale(docs, self.table("indexed"), json.dumps(VERSIONS, sort_keys=True))

    def ensure(self) -> None:
        """Derive again what is missing or was written by other versions, document by document; documents
        and sections are left as they are."""
        if not self._exists("documents"):
            return
        ids = self._stage("unindexed", self.unindexed())
        if not ids.isEmpty():
            some = lambda name: self.table(name).join(ids, "document_id", "left_semi")
            self._derive(some("documents"), some("sections"), some("blocks"), ids)
            self._stamp()

    def invariants(self) -> DataFrame:
        """(rule, document_id, rows) of stored rows that break a rule; none is due. Ranges lie in their
        section and in order, units are numbered from 1 without gaps, and texts are what ranges address."""
        from pyspark.sql import Window

        key = ["document_id", "section_id"]
        content = self.table("sections").select(*key, "content")
        out = []
        for name, number, of in (("paragraphs", "paragraph_index", key), ("sentences", "sentence_index", [*key, "paragraph_index"])):
            at = self.table(name).join(content, key, "left").withColumn("due", F.row_number().over(Window.partitionBy(*of).orderBy("range_start")))
            cut = F.substring("content", F.col("range_start").cast("int") + 1, (F.col("range_end") - F.col("range_start")).cast("int"))
            rules = {
                "owner": F.col("content").isNull(),
                "range": (F.col("range_start") < 0) | (F.col("range_start") >= F.col("range_end")) | (F.col("range_end") > F.char_length("content")),
                "number": F.col("due") != F.col(number),
                "text": cut != F.col("text"),
            }
            broken = F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(f"{name}_{r}")) for r, c in rules.items()]), lambda x: x.isNotNull()))
            out.append(at.select("document_id", broken.alias("rule")))
        return out[0].unionByName(out[1]).groupBy("rule", "document_id").agg(F.count("*").alias("rows"))


def normalized_hashes(secs: DataFrame, blocks: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """document_id, normalized_hash from sections in preorder and, for the documents of docs
    (document_id, has_blocks) that have a block map, from their blocks."""
    c = F.col
    in_order = lambda order, frame: F.transform(F.array_sort(F.collect_list(F.struct(order, frame.alias("frame")))), lambda x: x["frame"])
    frame = ident.section_frame(c("section_id"), c("parent_id"), c("title"), c("level"), c("content"), c("child_count"))
    got = secs.groupBy("document_id").agg(F.count(F.when(c("parent_id").isNull(), 1)).alias("roots"), in_order("dfs_order", frame).alias("frames"))
    if blocks is None:
        return got.select("document_id", ident.normalized_hash(c("roots"), c("frames")).alias("normalized_hash"))
    b = ident.block_frame(c("section_id"), c("block_index"), c("source_order"), c("kind"), c("range_start"), c("range_end"))
    maps = blocks.groupBy("document_id").agg(in_order("source_order", b).alias("blocks"))
    got = got.join(docs.select("document_id", "has_blocks"), "document_id").join(maps, "document_id", "left")
    known = F.when(c("has_blocks"), F.coalesce("blocks", F.array().cast("array<binary>")))
    return got.select("document_id", ident.normalized_hash(c("roots"), c("frames"), ident.block_map(known)).alias("normalized_hash"))
