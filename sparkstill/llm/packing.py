"""Packing of documents into sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits a sequence. The linear program
(as few configurations as cover the length histogram) is solved by multiplicative weights:
each length has a price; knapsack dynamic programming over the sequence's capacity gives
the configurations of (nearly) the highest value; the prices of the lengths that they
cover fall. Any prices bound the number of sequences from below (their sum over the
pieces, divided by the most that a sequence can hold), so the program also tells how far
a plan can be from the best. The counts are rounded so that no length is covered more often
than it occurs; the program is solved again for the pieces that rounding left, and what the
last one leaves is packed best-fit decreasing on the histogram.

The histogram has at most `capacity` entries, whatever the input; it and the plan are all
that the driver holds. Pieces that fill a sequence are one each; others find their place in
the plan by their rank among the pieces of their length, which comes from counts per length
and salt, as many salts as a length's count asks for.

Nulls: a null text is empty (its end id alone). Repeated rows are packed each. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy
from .tokens import encoded

#: SALTED: pieces of one length that are ranked together, about.
CAPACITY, SALTED = 2048, 100_000
PIECE_TYPE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        out: list[tuple] = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded((x.as_py() for x in batch.column("text")), path), strict=True):
            whole = np.append(ids, np.uint32(0)).tobytes()
            n = len(whole) // 4
            head = (n - 1) % capacity + 1
            at = [0, *range(head, n + 1, capacity)]
            out += [(doc_id, k, a, b - a, zlib.crc32(whole[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document with its end id: all but a document's first have `capacity` ids."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(lambda batches: _pieces(batches, vocabulary, capacity), PIECE_TYPE)


def program(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 64, stride: int = 8, rate: float = 0.1, near: float = 0.1) -> tuple[dict[tuple, float], float]:
    """Configurations (lengths and how often each, as one tuple) with how often the program uses them, and a lower bound on the number of sequences.

    rounds, stride, rate, near: of the multiplicative weights: a round takes, for every stride-th length in turn, the best
    configuration that holds it, if its value is within `near` of the best of all; a length's price is its length times
    exp(-rate * its coverage over the mean coverage). Where full sequences are worth as much as others, only they are
    taken. The work depends on `capacity`, not on the number of pieces.
    """
    import numpy as np

    lengths = np.array(sorted(histogram))
    need = np.array([histogram[k] for k in lengths.tolist()], float)
    weight, covered, bound = np.ones(len(lengths)), np.zeros(len(lengths)), 0.0
    used: dict[tuple, float] = {}

    def knapsack(price, exact: bool):
        """The highest value of each room, and the length taken last (-1: none); exact: the room must be filled."""
        best, last = np.full(capacity + 1, -np.inf if exact else 0.0), np.full(capacity + 1, -1)
        best[0] = 0.0
        for c in range(int(lengths[0]), capacity + 1):
            n_fit = int(np.searchsorted(lengths, c, "right"))
            value = price[:n_fit] + best[c - lengths[:n_fit]]
            k = int(value.argmax())
            if exact or value[k] > best[c - 1]:
                best[c], last[c] = value[k], k
            else:
                best[c] = best[c - 1]
        return best, last

    tight = True
    for turn in range(rounds):
        price = weight * lengths
        if not turn % stride or not tight:
            best, last = knapsack(price, False)
            bound = max(bound, float(price @ need) / best[capacity])
        if not turn % stride or tight:
            full = knapsack(price, True)
            tight = bool(full[0][capacity] >= (1 - near) * best[capacity]) if not turn % stride else tight
            best, last = full if tight else (best, last)
        holds = price + best[capacity - lengths]
        for first in range(turn % stride, len(lengths), stride):
            if holds[first] < (1 - near) * best[capacity]:
                continue
            found, c = [first], capacity - int(lengths[first])
            while c > 0:
                if last[c] < 0:
                    c -= 1
                else:
                    found.append(int(last[c]))
                    c -= int(lengths[found[-1]])
            key, count = np.unique(found, return_counts=True)
            share = float((need[key] / count).min())
            at = (*lengths[key].tolist(), *count.tolist())
            used[at] = used.get(at, 0.0) + share
            covered[key] += count * share
        excess = covered / need
        mean = max(1e-12, float(np.average(excess, weights=need * lengths)))
        weight = np.exp(-rate * excess / mean)
        weight /= weight.max()
    return {at: n / mean for at, n in used.items()}, bound


def _rounded(used: dict[tuple, float], left: dict[int, int], least: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of the configurations that hold at least so many ids, taken out of `left`: the whole part of each use, then one more where the pieces are there."""
    plan: dict[tuple, int] = {}
    parts = {at: dict(zip(at[: len(at) // 2], at[len(at) // 2 :], strict=True)) for at in used}
    held = {at: sum(k * c for k, c in x.items()) for at, x in parts.items()}
    order = sorted((x for x in used if held[x] >= least), key=lambda x: (held[x], used[x] % 1, x), reverse=True)
    for more in (0, 1):
        for at in order:
            n = min(1 if more else int(used[at]), *(left[k] // c for k, c in parts[at].items()))
            if n > 0:
                plan[at] = plan.get(at, 0) + n
                for k, c in parts[at].items():
                    left[k] -= c * n
    return [(parts[at], n) for at, n in plan.items()]


#: Least fill of the configurations that are rounded, for each time that the program is solved.
FILLS = (0.999, 0.999, 0.999, 0.998)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]], int]:
    """The plan in two parts, and a lower bound on the number of sequences.

    Both parts are lists of a configuration (length: how often) and how many sequences use it; together they hold every
    piece once. The first part comes from the program, the second from best fit over what rounding leaves.
    """
    import math

    left = {k: n for k, n in histogram.items() if n > 0}
    plan: list[tuple[dict[int, int], int]] = []
    full = left.pop(capacity, 0)
    if full:
        plan.append(({capacity: 1}, full))
    bound = 0.0
    for fill in FILLS:
        left = {k: n for k, n in left.items() if n}
        if not left:
            break
        used, least = program(left, capacity)
        bound = bound or least
        plan += _rounded(used, left, math.ceil(fill * capacity))
    return plan, _best_fit({k: n for k, n in left.items() if n}, capacity), full + math.ceil(bound - 1e-6)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: the largest length opens a sequence, the largest that fit fill it, as often as the counts allow."""
    from bisect import bisect_right

    plan, order = [], sorted(left)
    while order:
        room, holds = capacity, {}
        while True:
            k = bisect_right(order, room) - 1
            while k >= 0 and left[order[k]] <= holds.get(order[k], 0):
                k -= 1
            if k < 0:
                break
            holds[order[k]] = holds.get(order[k], 0) + 1
            room -= order[k]
        n = min(left[x] // c for x, c in holds.items())
        plan.append((holds, n))
        for x, c in holds.items():
            left[x] -= c * n
            if not left[x]:
                del left[x]
                order.remove(x)
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Runs of ranks: length, first rank, first sequence, pieces of this length in each sequence, offset of the first of them."""
    rows, ranks, sequence = [], {}, 0
    for holds, n in plan:
        offset = 0
        for length in sorted(holds, reverse=True):
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, holds[length], offset))
            ranks[length] = first + holds[length] * n
            offset += length * holds[length]
        sequence += n
    table = pd.DataFrame(rows, columns=["length", "first", "sequence", "each", "offset"], dtype="int64")
    return table.sort_values(["length", "first"], ignore_index=True)


def _place(frames: Iterator[pd.DataFrame], runs: pd.DataFrame) -> Iterator[pd.DataFrame]:
    keys = (runs["length"].to_numpy() << 44) + runs["first"].to_numpy()
    for x in frames:
        at = keys.searchsorted((x["length"].to_numpy() << 44) + x["rank"].to_numpy(), "right") - 1
        run = runs.iloc[at]
        inside = x["rank"].to_numpy() - run["first"].to_numpy()
        each = run["each"].to_numpy()
        yield x[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
            sequence_id=run["sequence"].to_numpy() + inside // each, offset=run["offset"].to_numpy() + inside % each * x["length"].to_numpy()
        )


def _salts(histogram: dict[int, int]) -> dict[int, int]:
    return {k: -(-n // SALTED) for k, n in histogram.items()}


@tidy
def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """The pieces of docs with sequence_id and offset (gapless from 0 in each sequence)."""
    rows = cut(pieces(docs, vocabulary, capacity, **columns).withColumn("draw", F.xxhash64(F.rand(42))), "pieces")
    histogram = {x["length"]: x["n"] for x in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    alone = rows.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32")
    alone = alone.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    histogram.pop(capacity, None)
    if not histogram:
        return alone
    first, second, _ = solve(histogram, capacity)
    runs = places(first + second)
    salts = F.create_map(*(F.lit(v) for k, n in _salts(histogram).items() for v in (k, n)))
    rows = rows.where(F.col("length") < capacity).withColumn("salt", F.pmod("draw", F.element_at(salts, F.col("length"))).cast("int"))
    cells = cut(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "draw")) - 1
    ranked = rows.withColumn("own", own).join(F.broadcast(cells), ["length", "salt"])  # a row for SALTED pieces and one a length
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("rank"))
    return alone.unionByName(ranked.mapInPandas(lambda frames: _place(frames, runs), PIECE_TYPE + ", sequence_id long, offset long"))
