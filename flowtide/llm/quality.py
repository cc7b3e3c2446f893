"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are counts and ratios of the whole text. Labels are learned from a
bounded sample of labelled rows (TRAIN_ROWS, drawn by the hash of doc_id) that
does not contain held-out rows; the trees are fitted on it with binned
features, then flattened into arrays. Scoring walks all rows of a batch through
those arrays level by level with numpy, in Spark tasks over all documents.

Defined results: a null text is empty; empty texts get a score; with no usable
labels (or of one kind only) every score is the smoothed share of label 1 (0.5
for no labels); repeated labels of a document all count; a null doc_id is never
held out and never trained on; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.llm.common import bytes_column, slices, texts_of

TRAIN_ROWS = 20_000
SLICE_BYTES = 4 << 20  # text scored at once
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, BINS = 60, 4, 64
RATE, SMOOTH, LEAST = 0.15, 1.0, 10
FEATURES = (
    "bytes words mean_word longest_word distinct_words upper digits spaces line_feeds stops commas marks symbols"
    " high top_byte bare_words repeated_lines short_words one_case mean_line ends entropy"
).split()

_CLASS = np.zeros((256, 9))
for _row, _chars in enumerate((
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?;:", b"#$%&*+/<=>@\\^_|~{}[]`",
)):
    _CLASS[list(_chars), _row] = 1
_CLASS[128:, 8] = 1


def statistics(text: bytes) -> list[float]:
    """The features of one text, from all of it."""
    words = text.split()
    n, w = max(1, len(text)), max(1, len(words))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, spaces, feeds, stops, commas, marks, symbols, high = (counts @ _CLASS).tolist()
    share = counts[counts > 0] / n
    sizes = np.array([len(x) for x in words] or [0])
    lines = text.split(b"\n")
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(sizes.mean()), float(np.log1p(sizes.max())),
        len(set(words)) / w, upper / n, digits / n, spaces / n, feeds / n, stops / w, commas / w, marks / w,
        symbols / n, high / n, float(share.max()) if len(share) else 0.0, sum(x.isalpha() for x in words) / w,
        1 - len(set(lines)) / len(lines), float((sizes <= 3).sum()) / w,
        sum(x.isupper() for x in set(words)) / w, len(text) / len(lines),
        float(text.rstrip()[-1:] in (b".", b"!", b"?")), float(-(share * np.log(share)).sum()) if len(share) else 0.0,
    ]


# --- fitting -----------------------------------------------------------------
def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict:
    """Boosted trees for the log-loss, as flat arrays: feature, cut, left, value, roots."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    model = {"base": float(np.log(prior / (1 - prior))), "feature": [], "cut": [], "left": [], "value": [], "roots": []}
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], axis=1)
        raw = np.full(len(y), model["base"])
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            raw += _grow(model, edges, binned, p - y, p * (1 - p), depth)
    return {k: v if k == "base" else np.array(v, np.float64 if k in ("cut", "value") else np.int32) for k, v in model.items()}


def _grow(model, edges, binned, gradient, curvature, depth) -> np.ndarray:
    """Add one tree, level by level; returns its value for each training row."""
    out = np.zeros(len(gradient))
    model["roots"].append(len(model["feature"]))
    level = [(_node(model), np.arange(len(gradient)))]
    for d in range(depth + 1):
        following = []
        for at, rows in level:
            g, h = gradient[rows].sum(), curvature[rows].sum()
            best = _split(binned[rows], gradient[rows], curvature[rows], g, h) if d < depth else None
            if best is None:
                model["value"][at] = -RATE * g / (h + SMOOTH)
                out[rows] = model["value"][at]
                continue
            feature, bin_ = best
            model["feature"][at], model["cut"][at] = feature, float(edges[feature][bin_])
            model["left"][at] = left = _node(model)
            right = _node(model)
            low = binned[rows, feature] <= bin_
            following += [(left, rows[low]), (right, rows[~low])]
        level = following
    return out


def _node(model) -> int:
    for key, value in (("feature", -1), ("cut", 0.0), ("left", -1), ("value", 0.0)):
        model[key].append(value)
    return len(model["feature"]) - 1


def _split(binned, gradient, curvature, g, h):
    best, gain = None, 1e-6
    for feature in range(binned.shape[1]):
        column = binned[:, feature]
        n = np.cumsum(np.bincount(column, minlength=BINS))[:-1]
        gl = np.cumsum(np.bincount(column, gradient, BINS))[:-1]
        hl = np.cumsum(np.bincount(column, curvature, BINS))[:-1]
        score = gl ** 2 / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH) - g * g / (h + SMOOTH)
        score[(n < LEAST) | (len(column) - n < LEAST)] = 0
        at = int(np.argmax(score))
        if score[at] > gain:
            best, gain = (feature, at), score[at]
    return best


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1: every row walks every tree one level per step."""
    raw = np.full(len(x), model["base"])
    feature, cut, left, value = (model[k] for k in ("feature", "cut", "left", "value"))
    rows = np.arange(len(x))
    for root in model["roots"]:
        at = np.full(len(x), root)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(feature[at], 0)] > cut[at]
            at = np.where(inner, left[at] + right, at)
        raw += value[at]
    return 1 / (1 + np.exp(-raw))


# --- Spark -------------------------------------------------------------------
def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _features(batches):
    for batch in batches:
        x = [statistics(t) for t in bytes_column(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.list_(pa.float64()))],
            names=["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most ``rows`` labelled rows outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # The smallest hashes; most other rows fall out before the sort, so few meet in one task.
    top = -(2**63) + min(2**64 - 1, 2**64 * 2 * rows // max(1, usable.count()))
    sample = usable.where(F.xxhash64("doc_id") <= top).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    # The sample has at most ``rows`` rows of 12 bytes, which bounds the broadcast.
    found = texts_of(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id") \
        .mapInArrow(_features, "doc_id long, quality int, x array<double>") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x", "quality").limit(rows).collect()
    x = np.array([r.x for r in found], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.quality for r in found], np.float64))


def _scorer(model: dict, keep: list[str], inside: int | None = None):
    """Scores of the texts in the column text, or in this field of the column row, so that rows do not travel with a second copy."""
    def texts(batch):
        return batch.column("text") if inside is None else pc.fill_null(pc.struct_field(batch.column("row"), [inside]), "")

    def run(batches):
        needed = (pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], texts(b)], names=[*keep, "text"]) for b in batches)
        for batch in slices(needed, SLICE_BYTES):
            x = np.array([statistics(t) for t in bytes_column(batch.column("text"))], np.float64)
            p = score(model, x.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p)], names=[*keep, "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, rows)
    return texts_of(docs).select("doc_id", "text") \
        .mapInArrow(_scorer(model, ["doc_id"]), "doc_id long, score double") \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that the classifier predicts as label 1, with all their columns."""
    model = train(docs, labels, rows)
    whole = texts_of(docs, whole_rows=True)
    inside = next(i for i, name in enumerate(docs.columns) if name.lower() == "text")
    if docs.schema[inside].dataType == T.StringType():
        whole = whole.select("row")
    else:
        whole, inside = whole.select("row", "text"), None
    kind = T.StructType([whole.schema["row"], T.StructField("score", T.DoubleType())])
    return whole.mapInArrow(_scorer(model, ["row"], inside), kind).where("score >= 0.5").select("row.*")
