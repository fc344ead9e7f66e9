"""Language identification by prediction by partial matching.

For each language a context tree over bytes counts which byte follows each context of up
to `order` bytes. Where a context has not met the byte, an escape (method C: as many
counts as distinct followers) leads to the next shorter context, at last to all 256 bytes
alike. Statistics are frozen after learning, so the code length of a text is a sum of
costs, one for each byte; the language with the shortest code is predicted.

Learning takes a bounded sample of labelled documents per language (`per_lang`, chosen by
a hash of id and language so that every document may be in it; of the text where there is no id); scoring covers every whole text.

Nulls and texts without a letter are `und` with score 0; rows without a language do not
teach; repeated rows count each. An empty table gives no rows. Only the named columns are
read, and ids, languages and sources never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, tidy

ORDER, PER_LANG, UNKNOWN = 3, 1500, "und"
#: Of a stage's cut-offs: share of the median rate, quartile distances, share of the median lead.
SLACK, SPREAD, LEAD = 0.35, 6.0, 0.1
FOUND = "lang_pred string, score double, rate double, lead double"


def grams(raw, size: int):
    """The byte grams of a text as numbers, one for each byte that has size - 1 bytes before it."""
    import numpy as np

    n = len(raw) - size + 1
    out = np.zeros(max(0, n), np.uint32)
    for k in range(size):
        out = (out << np.uint32(8)) | raw[k : k + max(0, n)]
    return out


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            for size in range(1, order + 2):
                sums.setdefault((lang, size), []).append(np.unique(grams(raw, size), return_counts=True))
    for (lang, size), found in sums.items():
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([size] * len(keys), pa.int32()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "size", "gram", "n"])


def sample(rows: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """text and lang of about per_lang documents of each language, out of (doc_id, text, lang) without nulls in text and lang; a language of fewer is taken whole."""
    counts = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select("text", "lang")
    share = F.element_at(F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_lang / n)))), F.col("lang"))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # rows without an id do not share one draw
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "lang", own), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < share).select("text", "lang")


def learn(labelled: DataFrame, order: int = ORDER, per_lang: int = PER_LANG) -> dict:
    """Cost tables from labelled (doc_id, text, lang): what the driver gets is bounded by the sample's distinct grams."""
    drawn = sample(labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()), per_lang)
    found = drawn.mapInArrow(lambda b: _count(b, order), "lang string, size int, gram long, n long")
    counts = found.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toPandas()
    return costs(counts, order) if len(counts) else {"langs": [], "order": order}


def costs(counts, order: int) -> dict:
    """For each gram size the sorted grams of any language and the cost of each under each language, and the same for escapes.

    cost[size]: bits for the last byte of a gram after the bytes before it, escapes included;
    escape[size]: bits of leaving a context of that size, 0 where a language has not met it.
    """
    import numpy as np

    langs = sorted(counts["lang"].unique())
    model: dict = {"langs": langs, "order": order, "grams": {}, "cost": {}, "contexts": {}, "escape": {}}
    floor = np.full((1, len(langs)), 8.0, np.float32)
    for size in range(1, order + 2):
        part = counts[counts["size"] == size]
        keys = np.unique(part["gram"].to_numpy())
        n = np.zeros((len(keys), len(langs)))
        n[np.searchsorted(keys, part["gram"].to_numpy()), [langs.index(x) for x in part["lang"]]] = part["n"].to_numpy()
        context, first = np.unique(keys >> 8, return_index=True)
        total, kinds = np.add.reduceat(n, first, axis=0) if len(keys) else n, np.add.reduceat((n > 0).astype(float), first, axis=0) if len(keys) else n
        escape = np.where(total > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)
        at = np.searchsorted(context, keys >> 8)
        low = lookup(model, keys & ((1 << 8 * (size - 1)) - 1), size - 1) if size > 1 else np.repeat(floor, len(keys), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.log2((total + kinds)[at]) - np.log2(n)
        model["grams"][size], model["contexts"][size - 1] = keys.astype(np.uint32), context.astype(np.uint32)
        model["cost"][size] = np.where(n > 0, own, escape[at] + low).astype(np.float32)
        model["escape"][size - 1] = escape.astype(np.float32)
    return model


def _find(keys, asked):
    """Index of each asked number in sorted keys, -1 where it is not there."""
    import numpy as np

    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def lookup(model: dict, asked, size: int):
    """Bits of each gram's last byte under each language."""
    import numpy as np

    asked = asked.astype(np.uint32)
    if size == 0:
        return np.full((len(asked), len(model["langs"])), 8.0, np.float32)
    at = _find(model["grams"][size], asked)
    out = model["cost"][size][at]
    lost = np.flatnonzero(at < 0)
    if len(lost):
        rest = asked[lost]
        low = lookup(model, rest & np.uint32((1 << 8 * (size - 1)) - 1), size - 1)
        context = _find(model["contexts"][size - 1], rest >> np.uint32(8))
        out[lost] = low + np.where((context >= 0)[:, None], model["escape"][size - 1][context], 0)
    return out


def code_lengths(model: dict, text: str, block: int = 1 << 20):
    """Bits of the whole text under each language."""
    import numpy as np

    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = model["order"] + 1
    total = np.zeros(len(model["langs"]))
    for k in range(1, min(size, len(raw) + 1)):
        total += lookup(model, grams(raw[:k], k), k)[0]
    for at in range(0, max(0, len(raw) - size + 1), block):
        total += lookup(model, grams(raw[at : at + block + size - 1], size), size).sum(0, dtype=float)
    return total


def _batch_lengths(model: dict, texts: list[str]):
    """Code lengths of several texts, looked up together."""
    import numpy as np

    size = model["order"] + 1
    raws = [np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8) for x in texts]
    n = np.array([max(0, len(r) - size + 1) for r in raws])
    out = np.zeros((len(texts), len(model["langs"])))
    for k in range(1, size):
        some = [i for i, r in enumerate(raws) if len(r) >= k]
        if some:
            out[some] += lookup(model, np.concatenate([grams(raws[i][:k], k) for i in some]), k)
    if n.sum():
        bits = lookup(model, np.concatenate([grams(r, size) for r in raws]), size)
        some = np.flatnonzero(n)
        out[some] += np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=float)
    return out


def _predict(batches: Iterator[pa.RecordBatch], model: dict, text_col: str = "text", letter_col: str = "letter", drop: tuple = ("text", "letter"), chars: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The columns that are not dropped with lang_pred, score, rate (bits a byte under that language) and lead (bits a byte over it under the second one, null for one language)."""
    import numpy as np

    langs = model["langs"]
    for batch in batches:
        texts, letters = batch.column(text_col), batch.column(letter_col).to_pylist()
        pred: list = [UNKNOWN] * len(texts)
        score, rate, lead = [0.0] * len(texts), [None] * len(texts), [None] * len(texts)

        def finish(run: list, lengths, pred=pred, score=score, rate=rate, lead=lead) -> None:
            best = lengths.argmin(1)
            share = np.exp2(np.maximum(lengths.min(1)[:, None] - lengths, -1000)).sum(1)
            two = np.sort(lengths, 1)[:, :2]
            for (i, text), b, s, bits in zip(run, best.tolist(), share.tolist(), two.tolist(), strict=True):
                n = len(text.encode("utf-8", "surrogatepass"))
                pred[i], score[i], rate[i] = langs[b], 1 / s, bits[0] / n
                lead[i] = (bits[1] - bits[0]) / n if len(bits) > 1 else None

        run, size = [], 0
        for i, letter in enumerate(letters):
            if letter and langs:
                text = texts[i].as_py()
                if len(text) > chars:
                    finish([(i, text)], code_lengths(model, text)[None])
                    continue
                run.append((i, text))
                size += len(text)
                if size > chars:
                    finish(run, _batch_lengths(model, [t for _, t in run]))
                    run, size = [], 0
        if run:
            finish(run, _batch_lengths(model, [t for _, t in run]))
        keep = [c for c in batch.schema.names if c not in drop]
        found = [pa.array(pred, pa.string()), *(pa.array(x, pa.float64()) for x in (score, rate, lead))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, "lang_pred", "score", "rate", "lead"])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, order: int = ORDER, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Learn from the documents whose crc32 of the id modulo 5 is not 0."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return learn(base.where(held(F.col("doc_id"), 5) != 0), order, per_lang)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rate and lead of every document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), has_letter(F.col(text_col)).alias("letter"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(lambda b: _predict(b, shared.value), f"doc_id {kind}, {FOUND}")


def cutoffs(found: DataFrame) -> DataFrame:
    """known, most (rate) and least (lead) that a document of a language may have, from its labelled documents (lang_pred, rate, lead).

    A text that the language explains costs about what its documents cost: most is the median
    rate and the larger of SLACK of it and SPREAD times the distance to the upper quartile. A
    text of one language leads clearly: least is a share of the median lead. Medians hold
    while junk fills less than half of a language.
    """
    one = found.groupBy(F.col("lang_pred").alias("known")).agg(F.percentile_approx("rate", [0.5, 0.75], 10_000).alias("r"), F.percentile_approx("lead", 0.5, 10_000).alias("l"))
    r = F.col("r")
    return one.select("known", (r[0] + F.greatest(SLACK * r[0], SPREAD * (r[1] - r[0]))).alias("most"), (LEAD * F.col("l")).alias("least"))


@tidy
def accept(docs: DataFrame, model: dict, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents in a learned language, with their own columns.

    A document stays if its language has a score of at least `least`, its bits a byte are
    within what the documents that taught this language have, and so is its lead over the
    second language. A language that no kept fold labels has no cut-offs. Texts are scored
    once and written with what was found.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"c{k}" for k in range(len(docs.columns))]
    text = f"c{docs.columns.index(text_col)}"
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, own, strict=True)), has_letter(F.col(f"`{text_col}`")).alias("letter"))
    schema = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(own, docs.schema.fields, strict=True))
    scored = cut(rows.mapInArrow(lambda b: _predict(b, shared.value, text, "letter", ("letter",)), f"{schema}, {FOUND}"), "language-scored")
    lang, doc_id = (F.col(f"c{docs.columns.index(c)}") for c in (lang_col, id_col))
    bounds = F.broadcast(cutoffs(scored.where((lang == F.col("lang_pred")) & (held(doc_id, 5) != 0))))  # a row a language
    judged = scored.join(bounds, F.col("lang_pred") == F.col("known"), "left")
    fits = (F.col("rate") <= F.coalesce("most", F.lit(float("inf")))) & (F.coalesce("lead", F.lit(float("inf"))) >= F.coalesce("least", F.lit(0.0)))
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & fits)
    return kept.select(*(F.col(k).alias(c) for c, k in zip(docs.columns, own, strict=True)))
