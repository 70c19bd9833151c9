r"""Benchmark decontamination in DataFrame operations only.

The benchmark's windows of `n` words (an item of fewer words is one window) are normalised and
hashed; the table of windows is broadcast if it has at most `max_broadcast_bytes`, else joined
by shuffle. Each document's windows are hashed within its row, unrolled in place and looked up; a
hash that is found is verified word by word before it counts. Where the table is broadcast, one further
unrolled element stands for the document itself, so that documents without hits need neither a second
scan nor a join. Where it isn't, only hashes are shuffled, and words are fetched for hits alone.

Words are maximal runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z.

Defined results: a null or empty text has no words and no hits; a null item_id still marks words but
is not counted as an item; repeated items count once; empty tables give no hits or no rows;
repeated documents are scanned each on its own; extra columns are ignored by `scan` and kept by
`remove`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, cut, text_key, unused, without

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The hash that stands for a document itself. A window with this hash fails the check of its words.
SELF = 0
#: What the benchmark's windows may take to be broadcast, and what a row takes besides its phrase.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def windows_of(bench: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """item, width, hash and words of every window, repeated ones once."""
    w = bench.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    w = w.withColumn("width", F.least(F.size("w"), F.lit(n)))
    at = w.select("item", "width", "w", F.explode(F.expr("sequence(1, size(w) - width + 1)")).alias("i"))
    at = at.select("item", "width", F.slice("w", F.col("i"), F.col("width")).alias("ww"))
    return at.select("item", "width", F.xxhash64(F.transform("ww", lambda x: F.xxhash64(x))).alias("h"), F.array_join("ww", " ").alias("phrase")).distinct()


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _hashes(wh: Column, width: int) -> Column:
    """Hashes of all windows of a width, from the array of words' hashes."""
    each = lambda i: F.xxhash64(F.array(*[wh[i + k] for k in range(width)]))
    return F.when(F.size(wh) >= width, F.transform(F.sequence(F.lit(0), F.size(wh) - width), each)).otherwise(F.array().cast("array<bigint>"))


def _unrolled(text: Column, widths: list[int]) -> Column:
    """Struct of the words and of the hashes of SELF and all windows, width after width."""
    own = F.array(F.lit(SELF).cast("long"))
    all_of = lambda wh: F.concat(own, *[_hashes(wh, k) for k in widths])
    return let(words(text), lambda w: F.struct(w.alias("w"), let(F.transform(w, lambda x: F.xxhash64(x)), all_of).alias("hs")))


def _places(at: DataFrame, widths: list[int]) -> DataFrame:
    """Where element p of a row of n_words came from: the widths' windows follow one another."""
    start, width, base = F.lit(None).cast("int"), F.lit(0), F.lit(1)
    for k in widths:
        many = F.greatest(F.col("n_words") - (k - 1), F.lit(0))
        inside = (F.col("p") >= base) & (F.col("p") < base + many)
        start, width = F.when(inside, F.col("p") - base).otherwise(start), F.when(inside, F.lit(k)).otherwise(width)
        base = base + many
    return at.select("*", start.alias("start"), width.alias("width"))


def _said(widths: list[int]) -> Column:
    """The words of w at start, as a phrase."""
    return F.coalesce(*[F.when(F.col("width") == k, F.concat_ws(" ", *[F.expr(f"try_element_at(w, start + {j + 1})") for j in range(k)])) for k in widths])


def _by_broadcast(d: DataFrame, grams: DataFrame, widths: list[int]) -> DataFrame:
    """id, _key, n_words, items and spans of every row of d (row, id, _key, text)."""
    own = d.sparkSession.range(1).select(*[F.lit({"width": 0, "h": SELF}.get(f.name)).cast(f.dataType).alias(f.name) for f in grams.schema])
    lookup = F.broadcast(grams.unionByName(own).withColumnRenamed("width", "gram_width"))
    d = d.select("row", "id", "_key", _unrolled(F.col("text"), widths).alias("u"))
    d = d.select("row", "id", "_key", F.col("u.w").alias("w"), F.size("u.w").alias("n_words"), F.col("u.hs").alias("hs"))
    hit = _places(d.select("row", "id", "_key", "n_words", "w", F.posexplode("hs").alias("p", "h")).join(lookup, "h"), widths)
    itself = (F.col("p") == 0) & (F.col("gram_width") == 0)
    hit = hit.where(itself | ((F.col("p") > 0) & (F.col("gram_width") == F.col("width")) & (F.col("phrase") == _said(widths))))
    span = F.when(F.col("width") > 0, F.struct("start", "width"))
    return hit.groupBy("row", "id", "_key", "n_words").agg(F.collect_set(F.col("item").cast("string")).alias("items"), F.collect_set(span).alias("spans"))


def _by_shuffle(d: DataFrame, grams: DataFrame, widths: list[int]) -> DataFrame:
    """The same; texts are written with their rows' numbers, to which hits refer."""
    d = cut(d, "texts")
    u = d.select("row", _unrolled(F.col("text"), widths).alias("u")).select("row", F.size("u.w").alias("n_words"), F.col("u.hs").alias("hs"))
    at = u.select("row", "n_words", F.posexplode("hs").alias("p", "h")).where("p > 0")
    hit = _places(at.join(grams.withColumnRenamed("width", "gram_width"), "h"), widths).where(F.col("gram_width") == F.col("width"))
    hit = cut(hit.select("row", "item", "phrase", "start", "width"), "candidates")
    named = d.join(hit.select("row").distinct(), "row", "left_semi").select("row", words(F.col("text")).alias("w"))
    sure = hit.join(named, "row").where(F.col("phrase") == _said(widths))
    found = sure.groupBy("row").agg(F.collect_set(F.col("item").cast("string")).alias("items"), F.collect_set(F.struct("start", "width")).alias("spans"))
    out = d.select("row", "id", "_key", F.size(words(F.col("text"))).alias("n_words")).join(found, "row", "left")
    none = {f.name: F.array().cast(f.dataType) for f in found.schema if f.name != "row"}
    return out.select("id", "_key", "n_words", *[F.coalesce(c, e).alias(c) for c, e in none.items()])


def scan(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id_col, _key (of the text), n_words, n_hit, items (sorted as strings) and spans (array of
    (start, width) in words) for every row of docs."""
    grams = cut(windows_of(bench, n, item_col, bench_text_col), "grams")
    widths = sorted(r[0] for r in grams.select("width").distinct().collect()) or [n]  # n values at most
    takes = grams.agg(F.coalesce(F.sum(F.octet_length("phrase") + ROW_BYTES), F.lit(0))).first()[0]
    text = F.col(text_col)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_key(text).alias("_key"), text.alias("text"))
    found = _by_broadcast(d, grams, widths) if takes <= max_broadcast_bytes else _by_shuffle(d, grams, widths)
    spans = F.array_sort("spans")
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["width"]).alias("end"), (a["n"] + F.greatest(s["start"] + s["width"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    return found.select(F.col("id").alias(id_col), "_key", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_sort("items").alias("items"), spans.alias("spans"))


def report(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """A row for each document, as the contract has it."""
    s = scan(docs, bench, **how)
    return s.select(
        how.get("id_col", "doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, bench: DataFrame, what: str = "documents", **how) -> DataFrame:
    """docs without contaminated documents, or (what="spans") with the hit words cut out of their
    texts; the columns of docs, in their order."""
    if what not in ("documents", "spans"):
        raise ValueError("what must be documents or spans")
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    hits = cut(scan(docs, bench, **how).where("n_hit > 0").dropDuplicates([id_col, "_key"]), "contaminated")
    if what == "documents":
        return without(docs, hits.select(id_col, "_key"), id_col, text_key(F.col(text_col)))
    its_id, own, key, spans, w, g = (unused(c, docs) for c in ("its_id", "own_key", "its_key", "its_spans", "its_words", "its_gaps"))
    marks = hits.select(F.col(id_col).alias(its_id), F.col("_key").alias(key), F.col("spans").alias(spans))
    at = docs.withColumn(own, text_key(F.col(text_col)))
    at = at.join(marks, F.col(id_col).eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(key)), "left")
    at = at.withColumn(w, F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).withColumn(g, F.split(F.col(text_col), WORD))
    bare = F.expr(f"array_join(transform({g}, (g, i) -> concat(g, if(i < size({w}) and not exists({spans}, s -> i >= s.start and i < s.start + s.width), {w}[i], ''))), '')")
    return at.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(bare)).select(*docs.columns)
