"""Hard negatives by bit-sliced integer products.

Components are whole numbers; a row's score for an anchor is their inner product. A row's
components are cut into bit planes, the sign plane first. The product of an anchor with the
planes down to bit j gives an interval for the score: what the planes below can still add
lies between (2^j - 1) times the sum of the anchor's negative components and as many times
that of its positive ones. A row is dropped as soon as its interval cannot qualify: it lies
outside the scores asked for, or below as many lower ends of sure ones as are asked for. The
first planes are matrix products over all rows; once few pairs of anchor and row are left,
planes are applied to those alone.

The anchors, a stated set of queries, meet all rows in blocks: anchors and rows are dealt to
parts by their own numbers, every pair of parts is one group of bounded size, and a group
returns the best few of each anchor, which are merged by a second group. Nothing passes through the driver.

Two rounds: the nearest rows of the anchor's label, then, with their scores, the best rows of
other labels whose scores are in each one's range. A null label or vector, or a null, NaN or
infinite component takes a row out. Repeated rows are rows of their own; of equal scores the
smaller id goes first, a null id last; an anchor is never its own positive. Vectors of
unlike length are filled up with zeros. Scores beyond 62 bits are refused. An empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is between these shares of the positive's, in hundredths.
LOW, HIGH = 50, 95
#: Components of the rows and of the anchors of a part, rows of a part at least, anchors that are scored together, and the share of pairs from which on only those left are looked at.
ROWS, ANCHORS, LEAST, TOGETHER, SPARSE = 1 << 20, 1 << 18, 512, 64, 0.03
_LAST = (1 << 63) - 1


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(label: Column, vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.forall(vector, fine)


def planes(v, bits: int):
    """Bit planes of a matrix of whole numbers, the sign plane first, and the worth of each."""
    worth = [-(1 << bits)] + [1 << j for j in range(bits - 1, -1, -1)]
    return [(((v >> j) & 1)) for j in range(bits, -1, -1)], worth


def best_rows(anchors, rows, bits: int, ask) -> tuple:
    """Pairs (anchor, row) and their scores, of those rows that can be among what `ask` asks for.

    ask(a, low, high) returns which rows stay, given the ends of their scores' intervals (a
    matrix over the anchors numbered a and all rows).
    """
    import numpy as np

    most = float(np.abs(anchors).sum(1).max(initial=0)) * (1 << (bits + 1))  # every sum below is smaller, and exact
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    sliced, worth = planes(rows, bits)
    sliced = [p.astype(kind) for p in sliced]
    found = []
    for start in range(0, len(anchors), TOGETHER):
        at = np.arange(start, min(start + TOGETHER, len(anchors)))
        a = anchors[at].astype(kind)
        plus, minus = np.maximum(a, 0).sum(1)[:, None], np.minimum(a, 0).sum(1)[:, None]
        part = np.zeros((len(at), len(rows)), kind)
        stay, pairs = np.ones(part.shape, bool), None
        for p, w in zip(sliced, worth, strict=True):
            left = abs(w) - 1  # what the planes below are worth
            if pairs is None:
                part += w * (a @ p.T)
                # an interval wider than all scores so far settles nothing
                if left and (plus - minus).max() * left > 2 * np.abs(part).max():
                    continue
                stay &= ask(at, part + left * minus, part + left * plus, stay)
                if stay.mean() < SPARSE:
                    pairs = np.nonzero(stay)
                    part = part[pairs]
            else:
                x, y = pairs
                part = part + w * np.einsum("ij,ij->i", a[x], p[y])
                low = np.full(stay.shape, _least(kind), kind)
                high = low.copy()
                low[pairs], high[pairs] = part + left * minus[x, 0], part + left * plus[x, 0]
                keep = ask(at, low, high, stay)[pairs]
                stay[x[~keep], y[~keep]] = False
                pairs, part = (x[keep], y[keep]), part[keep]
        if pairs is None:
            pairs = np.nonzero(stay)
            part = part[pairs]
        found.append((at[pairs[0]], pairs[1], part.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _kth(low, k: int):
    """The k-th largest of each line of a matrix; the least number where there are fewer."""
    import numpy as np

    if low.shape[1] < k:
        return np.full((len(low), 1), low.min(initial=0) - 1 if low.size else 0)
    return np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k : low.shape[1] - k + 1]


def _least(kind):
    import numpy as np

    return -(2.0**63) if np.issubdtype(kind, np.floating) else -(1 << 62)


def same_label(labels_a, labels_r, own, k: int):
    """ask: the k best rows of the anchor's label, without the anchor itself (own: its number among the rows, or -1)."""
    import numpy as np

    def ask(at, low, high, stay):
        fits = stay & (labels_a[at][:, None] == labels_r[None, :])
        mine = own[at]
        fits[np.flatnonzero(mine >= 0), mine[mine >= 0]] = False
        sure = np.where(fits, low, _least(low.dtype))
        return fits & (high >= _kth(sure, k))

    return ask


def other_label(labels_a, labels_r, ranges, k: int):
    """ask: for each of the anchor's ranges (least and greatest score) the k best rows of other labels in it."""
    import numpy as np

    def ask(at, low, high, stay):
        fits = stay & (labels_a[at][:, None] != labels_r[None, :])
        keep = np.zeros(fits.shape, bool)
        for j in range(ranges.shape[1]):
            least, most = ranges[at, j, :1].astype(low.dtype), ranges[at, j, 1:].astype(low.dtype)
            meets = fits & (high >= least) & (low <= most)
            sure = np.where(meets & (low >= least) & (high <= most), low, _least(low.dtype))
            keep |= meets & (high >= _kth(sure, k))
        return keep

    return ask


def _matrix(column):
    """Whole-number vectors of a list column as one matrix."""
    import numpy as np

    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(values), int(sizes.max(initial=0))), np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(values)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _wide(a, b):
    import numpy as np

    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _numbers(table: pa.Table, *names: str) -> list:
    return [table.column(c).to_numpy() for c in names]


def _firsts(a, ids, uids, scores, k: int):
    """Which of the pairs are the k best of their group a: by score, then id, then number."""
    import numpy as np

    order = np.lexsort((uids, ids, -scores, a))
    place = np.arange(len(order)) - np.searchsorted(a[order], a[order])
    return order[place < k]


def _positives(left: pa.Table, right: pa.Table, bits: int, k: int) -> pa.Table:
    import numpy as np

    a, r = _wide(_matrix(left.column("v")), _matrix(right.column("v")))
    (la, ua), (lr, ur, ir) = _numbers(left, "label", "uid"), _numbers(right, "label", "uid", "id")
    place = {u: i for i, u in enumerate(ur.tolist())}
    own = np.array([place.get(u, -1) for u in ua.tolist()], np.int64)
    x, y, s = best_rows(a, r, bits, same_label(la, lr, own, k))
    top = _firsts(x, ir[y], ur[y], s, k)
    return pa.table({"anchor": ua[x[top]], "uid": ur[y[top]], "id": ir[y[top]], "score": s[top]})


def _negatives(left: pa.Table, right: pa.Table, bits: int, k: int) -> pa.Table:
    import numpy as np

    a, r = _wide(_matrix(left.column("v")), _matrix(right.column("v")))
    (la, ua), (lr, ur, ir) = _numbers(left, "label", "uid"), _numbers(right, "label", "uid", "id")
    scores = _matrix(left.column("scores"))
    many = np.diff(left.column("scores").combine_chunks().offsets.to_numpy())
    # 100 * n >= LOW * p and 100 * n <= HIGH * p, in whole numbers; an empty range where there is no positive
    ranges = np.stack([-(-LOW * scores // 100), HIGH * scores // 100], axis=2)
    ranges[np.arange(scores.shape[1])[None, :] >= many[:, None]] = (1, 0)
    x, y, s = best_rows(a, r, bits, other_label(la, lr, ranges, k))
    out = []
    for j in range(scores.shape[1]):
        at = np.flatnonzero((s >= ranges[x, j, 0]) & (s <= ranges[x, j, 1]))
        at = at[_firsts(x[at], ir[y[at]], ur[y[at]], s[at], k)]
        out.append(pa.table({"anchor": ua[x[at]], "place": np.full(len(at), j), "uid": ur[y[at]], "id": ir[y[at]], "score": s[at]}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "place", "uid", "id", "score")})


def _parts(n: int, most: int) -> int:
    return max(1, -(-n // most))


def _against_all(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int, int], run, schema: str) -> DataFrame:
    """run(anchors of a part, rows of a part) for every pair of parts; parts are dealt by the rows' numbers, so that they are even.

    sizes: the numbers of anchors, of rows and of components of a vector.
    """
    n_anchors, n_rows, width = sizes
    tasks = anchors.sparkSession.sparkContext.defaultParallelism
    i, j = _parts(n_anchors * width, ANCHORS), max(_parts(n_rows * width, ROWS), min(_parts(n_rows, LEAST), tasks))
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.toDF(*anchors.columns).select("*", dealt(i).alias("i"), every(j).alias("j"))  # named anew: both sides may come from one table
    right = rows.select("*", dealt(j).alias("j"), every(i).alias("i"))
    # a group a task: the session's partitions would put several into one
    left, right = (x.repartition(i * j, "i", "j") for x in (left, right))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


@tidy
def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the first negatives of each anchor and positive."""
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    kept = base.where(usable(F.col("label"), F.col("x"))).select(F.coalesce("vec_id", F.lit(_LAST)).alias("id"), "label", whole(F.col("x"), scale).alias("v"), "anchor")
    rows = cut(kept.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    most = F.array_max(F.transform("v", lambda x: F.greatest(x, -1 - x)))
    seen = rows.agg(F.count("*"), F.sum(F.col("anchor").cast("long")), F.max(most), F.max(F.size("v"))).first()
    n, n_anchors, largest, width = seen[0], seen[1] or 0, seen[2] or 0, seen[3] or 0
    bits = int(largest).bit_length()
    if width * (1 << bits) ** 2 >= 1 << 62:
        raise ValueError(f"scores of {width} components of {bits} bits do not fit into 62 bits")
    anchors = rows.where("anchor").select("uid", "label", "v")
    others = rows.select("uid", "id", "label", "v")
    near = _against_all(anchors, others, (n_anchors, n, width), lambda a, r: _positives(a, r, bits, positives), "anchor long, uid long, id long, score long")
    order = F.struct((-F.col("score")).alias("s"), "id", "uid")
    best = near.groupBy("anchor").agg(F.slice(F.sort_array(F.collect_list(order)), 1, positives).alias("p"))  # a few of each part
    chosen = cut(best.select(F.col("anchor").alias("uid"), F.transform("p", lambda x: -x["s"]).alias("scores"), F.transform("p", lambda x: x["id"]).alias("ids")), "negatives-positives")
    asked = anchors.join(chosen.select("uid", "scores"), "uid")
    far = _against_all(asked, others, (n_anchors, n, width), lambda a, r: _negatives(a, r, bits, negatives), "anchor long, place long, uid long, id long, score long")
    last = far.groupBy("anchor", "place").agg(F.slice(F.sort_array(F.collect_list(order)), 1, negatives).alias("p"))
    each = last.select(F.col("anchor").alias("uid"), "place", F.posexplode("p").alias("k", "x"))
    named = each.join(chosen, "uid").join(rows.where("anchor").select("uid", F.col("id").alias("anchor_id")), "uid")
    known = lambda c: F.when(c != F.lit(_LAST), c)
    return named.select(
        known(F.col("anchor_id")).alias("anchor_id"),
        known(F.get("ids", F.col("place").cast("int"))).alias("positive_id"),
        (F.col("k") + 1).cast("int").alias("rank"),
        known(F.col("x.id")).alias("negative_id"),
        F.get("scores", F.col("place").cast("int")).alias("positive_score"),
        (-F.col("x.s")).alias("negative_score"),
    )
