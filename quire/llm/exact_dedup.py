r"""Exact dedup over an extendible-hash index on shared files, in DataFrame operations only.

Every document gets a 64-bit key of its normalised text (runs of [\x20\x09-\x0D] become one
space). The key's leading bits address a directory. It begins with one bucket; a bucket with more
than `capacity` keys is split by its next bits, and the directory doubles while a bucket is deeper
than it, with no limit but the 64 bits of a key. Entries of one key are a chain, which isn't split.
Copies are one entry (they are counted before they are dealt), so that a text with a third of all
rows never fills a bucket. Splits look at counts by prefix, STEP bits at a time.

The index is a table in the shared folder, dealt by ranges of keys: each owner task has some buckets,
whole, and numbers the entries that are chained under each key. Documents find their entry through
the directory: their key's leading bits name the bucket, and key, length and digest the entry in it.
Where a key has several rows, their bytes are compared: if two texts of one entry differ, the entry is
split by text.

Defined results: null counts as the empty text; a row stays if its id is the smallest of its
group, null ids sorting last; rows equal in id and text are one group and `keep` keeps one of
them; ids may be of any type that can be compared; an empty table gives an empty result; extra columns
pass through `keep` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, if_small, one_of_each, salted_left_join, without

#: Entries of a bucket, and bits by which one pass over overfull buckets may split them.
CAPACITY, STEP = 8192, 8
ENTRY = ["key", "n_bytes", "text_sha256"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def leading(key: Column, bits: int) -> Column:
    """The first bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def buckets(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(depth, prefix) of every bucket: no two overlap, and together they hold all keys. keys is a written
    table of distinct keys. Each round splits the buckets that are still overfull, by STEP bits at most."""
    crowded, depth = keys.sparkSession.range(1).select(F.lit(0).cast("long").alias("prefix")), 0
    done = None
    while True:
        step = min(STEP, 64 - depth)
        at = keys if not depth else keys.join(if_small(crowded, 500_000), leading(F.col("key"), depth) == F.col("prefix"), "left_semi")
        cells = at.groupBy(leading(F.col("key"), depth + step).alias("cell")).agg(F.count("*").alias("n"))
        # how many keys each prefix of depth to depth + step bits holds
        levels = cells.select("n", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("more"), "cell")
        held = cut(levels.groupBy("more", F.expr(f"shiftrightunsigned(cell, {step} - more)").alias("prefix")).agg(F.sum("n").alias("n")), "dedup-held")
        split = held.where((F.col("n") > capacity) & (F.col("more") < step))
        halves = F.array(F.shiftleft("prefix", 1), F.shiftleft("prefix", 1).bitwiseOR(F.lit(1).cast("long")))
        made = crowded.select(F.lit(0).alias("more"), "prefix").unionByName(split.select((F.col("more") + 1).alias("more"), F.explode(halves).alias("prefix")))
        made = made.join(held, ["more", "prefix"], "left").fillna(0, ["n"])
        overfull = (F.col("n") > capacity) & (F.lit(depth) + F.col("more") < 64)
        fits = cut(made.where(~overfull).select((F.col("more") + depth).alias("depth"), "prefix"), "dedup-buckets")
        done = fits if done is None else done.unionByName(fits)
        crowded = cut(made.where(overfull & (F.col("more") == step)).select("prefix"), "dedup-crowded")
        depth += step
        if not crowded.count():
            return done


def directory(made: DataFrame) -> DataFrame:
    """(depth, prefix, bucket): the directory has doubled to 2 ** d slots, d being the depth of the deepest
    bucket; it is kept as one row for all slots of a bucket. A bucket's number is the first key that it
    holds, as an unsigned number less 2 ** 63, so that buckets are in the order of keys."""
    return made.select("depth", "prefix", F.expr("shiftleft(prefix, 64 - depth)").bitwiseXOR(F.lit(-(1 << 63))).alias("bucket"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = key_of, digest: Callable[[Column], Column] = digest_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, index, directory), tables in the shared folder. rows: id, key, n_bytes, text_sha256.
    index: an entry for each distinct text with its bucket, its place in the key's chain, smallest id and
    number of rows."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    rows = cut(norm.select("id", key(F.col("t")).alias("key"), F.octet_length("t").alias("n_bytes"), digest(F.col("t")).alias("text_sha256")), "dedup-rows")
    entries = cut(rows.groupBy(*ENTRY).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-entries")
    slots = cut(directory(buckets(cut(entries.select("key").distinct(), "dedup-keys"), capacity)), "dedup-directory")
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("n_bytes", "text_sha256")).alias("chain")
    index = through(entries, slots).repartitionByRange(owners, "bucket").select("bucket", *ENTRY, "keep_id", "group_size", chain)
    return rows, cut(index, "dedup-index"), slots


def through(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """rows with the bucket that the directory has for their key; buckets of well spread keys have one
    depth or two."""
    depths = sorted(r[0] for r in slots.select("depth").distinct().collect())  # 65 at most
    places = F.array(*[F.struct(F.lit(d).alias("depth"), leading(F.col("key"), d).alias("prefix")) for d in depths])
    at = rows.withColumn("_at", F.explode(places)).withColumn("_d", F.col("_at.depth")).withColumn("_p", F.col("_at.prefix")).drop("_at")
    return at.join(if_small(slots, 500_000), (F.col("_d") == F.col("depth")) & (F.col("_p") == F.col("prefix"))).drop("_d", "_p", "depth", "prefix")


def texts_of_chains(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column], digest: Callable[[Column], Column]) -> DataFrame | None:
    """Entries that hold texts of different bytes, as (key, n_bytes, text_sha256, t, keep_id, group_size)
    of each text; None if there are none. Only rows of keys that several rows have are compared, grouped
    by their bytes before they move."""
    several = cut(index.groupBy("bucket", "key").agg(F.sum("group_size").alias("rows")).where("rows > 1").select("key"), "dedup-several")
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t")).withColumn("key", key(F.col("t")))
    texts = norm.join(if_small(several, 1_000_000), "key", "left_semi").groupBy("key", "t").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    texts = texts.withColumn("n_bytes", F.octet_length("t")).withColumn("text_sha256", digest(F.col("t")))
    clash = cut(texts.groupBy(*ENTRY).agg(F.count("*").alias("texts")).where("texts > 1").select(*ENTRY), "dedup-clash")
    return texts.join(clash, ENTRY, "left_semi") if clash.count() else None


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = key_of, digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows, index, slots = build_index(docs, id_col, text_col, capacity, key, digest)
    split = texts_of_chains(docs, index, id_col, text_col, key, digest)
    shared = index.where("group_size > 1").select("bucket", *ENTRY, "keep_id", "group_size")
    found = salted_left_join(through(rows, slots), shared, ["bucket", *ENTRY], F.xxhash64("id"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    whole = found.select("id", *ENTRY, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if split is not None:  # texts that differ under one key, one length and one digest
        named = split.select(*ENTRY).distinct()
        norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
        norm = norm.withColumn("key", key(F.col("t"))).withColumn("n_bytes", F.octet_length("t")).withColumn("text_sha256", digest(F.col("t")))
        some = norm.join(named, ENTRY, "left_semi").select("id", "t").join(split, "t").select("id", *ENTRY, "keep_id", "group_size")
        whole = whole.join(named, ENTRY, "left_anti").unionByName(some)
    return whole.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """docs with one row of each group of equal texts; its columns unchanged."""
    groups = cut(exact_groups(docs, id_col, text_col, capacity), "dedup-groups")
    key = F.sha2(normalised(F.col(text_col)), 256)
    named = lambda d: d.select(id_col, F.col("text_sha256").alias("_key"))
    losers = cut(named(groups.where("not kept")).distinct(), "dedup-losers")
    # rows equal in id and normalised text: one of each is taken
    again = cut(named(groups.where("kept")).groupBy(id_col, "_key").count().where("count > 1").drop("count"), "dedup-again")
    return one_of_each(without(docs, losers, id_col, key), again, id_col, key)
