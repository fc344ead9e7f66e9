"""Quality classifier: regularised quadratic discriminant.

Statistics of a whole text are transformed to be roughly normal; each class of labelled
documents has a mean and a covariance, shrunk towards the pooled one and its diagonal.
A document's score is the logistic of the difference of the two log densities (from
Mahalanobis distances by cached Cholesky factors) and of the class shares.

Learning sums counts, vectors and outer products over every labelled document, so what
reaches the driver has a fixed size.

Nulls are empty texts, and empty texts have statistics like any other; labels other than
0 and 1 and null labels do not teach; a document with several labels teaches with each.
Without labels of both classes every score is the share of label 1 (0.5 where there is
none). An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, tidy

NAMES = ["words", "word_length", "upper", "symbols", "marks", "bars", "digits", "new_words", "runs", "line_words", "short_words"]
#: Shares of the pooled covariance and of its diagonal in a class's own, and a standard deviation that is added to each statistic.
SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.1, 0.05, 0.02
#: The statistics are not independent and not quite normal, which makes log densities differ too much: this share of the difference counts.
TEMPER = 0.25
_SYMBOLS, _MARKS, _BARS = b"#*$%&<>~^_=\\@", b"!?", b"|"


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    import numpy as np

    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, chars = max(1, len(words)), max(1, int(count.sum() - count[[9, 10, 11, 12, 13, 32]].sum()))
    share = lambda signs: np.log1p(50 * float(count[list(signs)].sum()) / n)
    upper, lower = float(count[65:91].sum()), float(count[97:123].sum())
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(len(words))),
        float(np.log(chars / n)),
        float(np.sqrt(upper / max(1.0, upper + lower))),
        share(_SYMBOLS),
        share(_MARKS),
        share(_BARS),
        float(np.log1p(20 * float(count[48:58].sum()) / chars)),
        float(np.log(len(set(words)) / n if words else 1.0) / np.log1p(np.log1p(n) + 1)),
        float(np.log1p(20 * same / n)),
        float(np.log1p(n / (1 + count[10]))),
        float(np.sqrt(sum(len(w) <= 3 for w in words) / n)),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_features, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = batch.column("y").to_numpy()
        x = np.array(batch.column("x").flatten()).reshape(-1, d)
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["y", "sums"])


def fit(labelled: DataFrame) -> dict:
    """Means and Cholesky factors of both classes from (x, y)."""
    import numpy as np

    d = len(NAMES)
    parts = labelled.where("y in (0, 1)").select(F.col("y").cast("int").alias("y"), "x").mapInArrow(_moments, "y int, sums array<double>")
    total = parts.select("y", F.posexplode("sums").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for y, k, v in total:
        sums[y, k] = v
    n = sums[:, 0]
    if n.min() < 2:
        return {"share": float(n[1] / n.sum()) if n.sum() else 0.5}
    mean = sums[:, 1 : 1 + d] / n[:, None]
    cov = sums[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = np.tensordot(n / n.sum(), cov, 1)
    scale = np.diag(np.diag(pooled) + RIDGE**2)
    cov = (1 - SHRINK_POOLED - SHRINK_DIAGONAL) * cov + SHRINK_POOLED * pooled + SHRINK_DIAGONAL * scale + RIDGE**2 * np.eye(d)
    factor = np.linalg.cholesky(cov)
    # the factors are triangular and inverted once; a batch is multiplied by the inverse
    return {"share": float(n[1] / n.sum()), "mean": mean, "inverse": np.linalg.inv(factor), "log_det": 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1)}


def scores(model: dict, x):
    """Scores of rows of statistics."""
    import numpy as np

    if "mean" not in model:
        return np.full(len(x), model["share"])
    density = [-0.5 * (((x - model["mean"][c]) @ model["inverse"][c].T) ** 2).sum(1) - 0.5 * model["log_det"][c] for c in (0, 1)]
    gap = TEMPER * (density[1] - density[0]) + np.log(model["share"] / (1 - model["share"]))
    return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


@tidy
def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = cut(features(docs, id_col, text_col), "quality-features")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where("y is not null")
    model = fit(rows.where(held(F.col("doc_id"), 4) != 2).join(known, "doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(shared.value, x))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (held(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
