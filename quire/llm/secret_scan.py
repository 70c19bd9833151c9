r"""Secret scans in DataFrame operations only: exact patterns, and strings that look random.

Base spans are the leftmost non-overlapping matches of three patterns. Beyond them, runs of at
least MIN_TOKEN token characters, with or without digits, are scored by two character Markov
models, one of random strings and one of ordinary identifiers: the mean over the token of
log P(next | this, random) - log P(next | this, ordinary). Those above THRESHOLD become `markov`
spans unless they touch a base span. Both models are learned from labelled samples by counting
pairs of characters; a model is a table of fixed size (pairs of an alphabet), a constant in the plan. Runs without any
letter are numbers or rules and not scored; a repeated character is never a sign of randomness.

Matches are found within the row: the lengths of the pieces between matches and of the matches are
unrolled, and running sums turn them into code-point offsets. One more unrolled element stands for
the document itself.

Defined results: null counts as empty, which has no spans; whole texts are scanned, of any length;
repeated rows are scanned each on its own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the contract: kinds in their order, and the patterns. Minimum lengths follow.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A maximal run of 24 or more is what [0-9a-f]+ gives when shorter matches are dropped.
HEX = r"[0-9a-f]{24,}"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: On held-out documents of sf0.1 no run of letters of 10 and more reaches the threshold. Of 3,000
#: random strings of 16, up to 0.1% of mixed letters, base62 and hex miss it, but 6% of capitals only,
#: 4% of small letters only and 3% of base32.
MIN_TOKEN = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Mean log-likelihood ratio a character from which a token counts as random: dated or numbered
#: names come to about 0.8, random strings to 1.5 and more.
THRESHOLD = 1.1
#: Labelled samples: so many random strings are drawn, and so many documents give identifiers.
RANDOM_SAMPLES, IDENTIFIER_DOCS = 4000, 2000


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def random_samples(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """(token, label 1): digests of a counter written in the alphabets that keys use."""
    d = spark.range(n).select("id", F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256).alias("hex"))
    b64 = F.base64(F.unhex("hex"))
    written = F.element_at(F.array(b64, F.regexp_replace(b64, "[+/=]", ""), F.col("hex"), F.upper("hex"), F.translate(b64, "+/=", "-_")), (F.col("id") % 5 + 1).cast("int"))
    return d.select(written.alias("token"), F.lit(1).alias("label"))


def identifier_samples(docs: DataFrame, n_docs: int = IDENTIFIER_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, label 0): words of letters from a bounded sample of documents, singly and joined as
    identifiers are (camel case, underscores, hyphens, capitals, numbered)."""
    ids = docs.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(n_docs)
    some = docs.select(id_col, text_col).join(F.broadcast(ids), id_col)
    w = some.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])"), F.lit(0))).alias("w")).distinct()
    forms = F.array(F.col("w"), F.lower("w"), F.concat(F.lower("w"), F.initcap("w")), F.concat_ws("_", F.lower("w"), F.lower("w")), F.concat(F.upper("w"), F.lit("_"), F.length("w").cast("string")), F.concat_ws("/", F.lower("w"), F.lower("w")), F.concat_ws("-", F.lower("w"), F.length("w").cast("string")), F.concat_ws("-", F.lower("w"), F.lower("w")), F.concat_ws("_", F.upper("w"), F.upper("w")), F.concat(F.upper("w"), F.initcap("w")))
    return w.select(F.explode(forms).alias("token"), F.lit(0).alias("label"))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of pairs of ALPHABET, row by row, from (token, label 0 or 1)."""
    pairs = samples.where(F.length("token") >= 2).select("label", F.explode(F.regexp_extract_all("token", F.lit("(?s)(?=(..))"), F.lit(1))).alias("pair"))
    counts = {(r[0], r[1]): r[2] for r in pairs.groupBy("label", "pair").count().collect() if all(c in ALPHABET for c in r[1])}  # 2 * 67 ** 2 at most
    size, out = len(ALPHABET), []
    for a in ALPHABET:
        total = [sum(counts.get((k, a + b), 0) for b in ALPHABET) + smooth * size for k in (0, 1)]
        for b in ALPHABET:
            p = [(counts.get((k, a + b), 0) + smooth) / total[k] for k in (0, 1)]
            likely = math.log(p[1] / p[0])
            out.append(min(0.0, likely) if a == b else likely)
    return out


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's pairs."""
    size = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    total = let(
        codes,
        lambda k: F.aggregate(F.sequence(F.lit(0), F.length(token) - 2), F.lit(0.0), lambda a, i: a + F.coalesce(F.get(table, F.get(k, i) * size + F.get(k, i + 1)), F.lit(0.0))),
    )
    return total / (F.length(token) - 1)


def _found(text: Column, pattern: str, kind: int, ok) -> Column:
    """Array of (kind, index, gap before, length, ok) of a pattern's matches; computed where it occurs at all."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def rows(hits: Column) -> Column:
        return let(
            F.split(text, pattern),
            lambda gaps: F.transform(
                hits,
                lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(h).alias("n"), F.coalesce(ok(h), F.lit(False)).alias("ok")),
            ),
        )

    return F.when(text.rlike(pattern), let(whole, rows)).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,ok:boolean>>"))


def spans(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col and spans (array of (start, kind, end), sorted) for every row of docs."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to a constant
    text = F.col("t")
    value = lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= MIN_VALUE
    looks_random = lambda h: F.when(h.rlike("[A-Za-z]"), ratio(h, table) >= threshold).otherwise(False)
    all_found = F.concat(
        F.array(F.struct(*[F.lit(x).alias(c) for c, x in (("kind", -1), ("i", 0), ("gap", 0), ("n", 0))], F.lit(True).alias("ok"))),
        _found(text, ASSIGN, 0, value),
        _found(text, ACCESS, 1, lambda h: F.length(h) >= MIN_ACCESS),
        _found(text, HEX, 2, lambda h: F.length(h) >= MIN_HEX),
        _found(text, TOKEN, 3, looks_random),
    )
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    at = d.select("row", "id", F.explode(all_found).alias("m")).select("row", "id", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).where("ok")
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "kind", F.col("end"))
    got = at.groupBy("row", "id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").between(0, 2), span))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("kind") == 3, span))).alias("more"))
    clear = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return got.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", clear)).alias("spans"))


def written(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = train(random_samples(docs.sparkSession).unionByName(identifier_samples(docs, id_col=id_col, text_col=text_col)))
    s = spans(docs, model, id_col, text_col)
    many = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return s.select(id_col, many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
