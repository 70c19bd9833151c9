"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Trees are grown here, in numpy, from a bounded sample of labelled rows (`max_rows`, those with the
smallest hash of their id); rows whose crc32(id as text) mod 4 is 2 are held out and never trained
on. The trees are flattened into arrays, and a batch of documents walks all trees at once, level
by level. Only the text makes a score.

Defined results: null is scored as the empty text; without labelled rows every score is 0.5; labels
that are null are ignored, a row labelled twice counts by its larger label; repeated rows get equal
scores; an empty table gives an empty result; ids may be of any type; extra columns are ignored by
`report` and kept by `filter_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import frugal

THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "stop_marks", "commas", "exclaims", "bars", "symbols", "quotes",
    "control", "non_ascii", "entropy", "distinct_words", "log_lines", "repeated_lines", "line_length", "short_lines", "lines_ended",
    "distinct_trigrams", "capital_words", "words_with_symbols",
)

_CLASSES = np.zeros((256, 11))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".?", b",;:", b"!", b"|", b"#$%&*+<=>@^_~\\/", b"\"'`()[]{}")):
    _CLASSES[list(_chars), _k] = 1
_CLASSES[[i for i in range(32) if i not in (9, 10, 11, 12, 13)] + [127], 9] = 1
_CLASSES[128:, 10] = 1
_SYMBOLS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = (counts @ _CLASSES) / n
    p = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    trigrams = set(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / m, share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8],
        share[9], share[10], float(-(p * np.log2(p)).sum()), len(set(words)) / m, np.log1p(len(lines)), 1 - len(set(lines)) / k if lines else 0.0, len(raw) / k,
        sum(len(x) < 30 for x in lines) / k, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k,
        len(trigrams) / max(1, len(words) - 2), sum(w.isupper() for w in words) / m, sum(w[-1:] in _SYMBOLS and w[-2:-1] in _SYMBOLS for w in words) / m,
    ]


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf is a node whose children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, l2: float = 1.0) -> Trees:
    """Boost regression trees on the logistic loss; splits are sought over histograms of binned features."""
    f, t, lo, hi, v, roots = [], [], [], [], [], []

    def node(feature=0, threshold=np.inf, value=0.0) -> int:
        f.append(feature), t.append(threshold), lo.append(len(f) - 1), hi.append(len(f) - 1), v.append(value)
        return len(f) - 1

    rate_of_ones = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(*map(np.array, ([0], [np.inf], [0], [0], [0.0], [0])), 0, start if len(y) else 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = bins + 1
    flat = b + np.arange(x.shape[1]) * width
    raw = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = node()
        roots.append(root)
        open_nodes = [(root, np.arange(len(y)), 0)]
        while open_nodes:
            at, rows, level = open_nodes.pop()
            best = None
            if level < depth and len(rows) >= 2 * least:
                cells = flat[rows].ravel()
                shape = (x.shape[1], width)
                hist = [np.bincount(cells, np.repeat(w, x.shape[1]), minlength=shape[0] * width).reshape(shape).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = (q[:, :-1] for q in hist)
                gt, ht, nt = (q[:, -1:] for q in hist)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain = np.where((nl >= least) & (nt - nl >= least), gain, -1)
                j, k = divmod(int(gain.argmax()), width - 1)
                if gain[j, k] > 1e-6 and k < len(edges[j]):
                    best = (j, k)
            if best is None:
                v[at] = -rate * float(g[rows].sum() / (h[rows].sum() + l2))
                raw[rows] += v[at]
                continue
            j, k = best
            f[at], t[at], lo[at], hi[at] = j, float(edges[j][k]), node(), node()
            below = b[rows, j] <= k
            open_nodes += [(lo[at], rows[below], level + 1), (hi[at], rows[~below], level + 1)]
    return Trees(*map(np.array, (f, t, lo, hi, v, roots)), depth, start)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **growth) -> Trees:
    """Trees from at most max_rows labelled rows that aren't held out; their statistics come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    some = docs.select(id_col, text_col).join(F.broadcast(known), id_col)
    some = some.select(F.col(id_col).cast("string"), F.col(text_col), F.col("_y").cast("double"))
    rows = sorted(some.mapInArrow(_stats_part, "id string, y double, x array<double>").collect(), key=lambda r: (r[0], list(r[2])))
    x = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], float), **growth)


def _stats_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])


def score(docs: DataFrame, trees: Trees, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to carry along, as c0, c1 and so on, and score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(trees)  # of fixed size
    some = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    schema = some.drop("text").withColumn("score", F.lit(0.0)).schema

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            x = np.array([statistics(t) for t in b.column(0).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(held.value.score(x))], [*b.schema.names[1:], "score"])

    return some.mapInArrow(frugal(part), schema)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    s = score(docs, train(docs, labels, id_col=id_col, text_col=text_col, **how), text_col, (id_col,))
    return s.select(F.col("c0").alias(id_col), held_out(F.col("c0")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """docs whose score reaches the threshold; its columns unchanged."""
    trees = train(docs, labels, id_col=id_col, text_col=text_col, **how)
    good = score(docs, trees, text_col, tuple(docs.columns)).where(F.col("score") >= threshold)
    return good.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
