"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, bpe, langid, lines, merkle, negatives, ngrams, packing, quality, rules, sharding, simhash, winnowing
from .common import documents, held

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), VOCABULARY)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_counts(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.next_edits(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (held(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.read(spark, binary.write(documents(spark, sf_dir), VOCABULARY))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    changed = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), changed, vec_id % 50 == 0)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(documents(spark, sf_dir)))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2's base rules count in every text."""
    found = rules.with_stats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *(f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")))


def shard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that op8 deals."""
    return sharding.records(documents(spark, sf_dir)).select("doc_id", "size")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_quality_rules, op3_quality_classifier, op4_line_dedup, op5_bpe, op6_winnowing, op7_language, op8_sharding, op9_simhash, op10_bit_planes, op11_ngram_join, op12_hard_negatives, op13_merkle, quality_statistics, shard_records)
}

_WORD = r"[^\x20\x09-\x0D]"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_NEGATIVES = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select a.vec_id anchor_id, b.vec_id id, a.l = b.l same, list_inner_product(a.v, b.v)::bigint score from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select anchor_id, positive_id, positive_score, id negative_id, score negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, id) k
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, k::int "rank", negative_id, positive_score, negative_score from n where k <= 3"""

#: crc32 of a decimal number, bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1))))"""

_MERKLE = f"""with recursive d as (select *, row_number() over () id from documents),
e as (select id, doc_id, source, {_leaf_sql('text')} leaf, case when xor({_CRC}, 4294967295::bigint) % 2 = 0 then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql('text')} end changed from d),
r as (select *, row_number() over (partition by source order by doc_id) - 1 k, count(*) over (partition by source) n from e),
t as (select source, 0 lv, k, n, leaf h from r union all
  select source, lv + 1, k // 3, max((n + 2) // 3), sha256(string_agg(h, '' order by k)) from t where n > 1 group by source, lv, k // 3),
s as (select source, h subroot, row_number() over (order by source nulls first) - 1 j, count(*) over () n from t where n = 1),
u as (select 0 lv, j k, n, subroot h from s union all
  select lv + 1, k // 3, max((n + 2) // 3), sha256(string_agg(h, '' order by k)) from u where n > 1 group by lv, k // 3),
p as (select r.id, t.lv, t.k, t.h, r.k // (3 ** t.lv)::bigint own from r join t on t.source is not distinct from r.source and t.n > 1 and t.k // 3 = r.k // (3 ** (t.lv + 1))::bigint
  union all select r.id, 100 + u.lv, u.k, u.h, s.j // (3 ** u.lv)::bigint from r join s on s.source is not distinct from r.source join u on u.n > 1 and u.k // 3 = s.j // (3 ** (u.lv + 1))::bigint),
q as (select id, lv, coalesce(string_agg(h, '' order by k) filter (k < own), '') a, coalesce(string_agg(h, '' order by k) filter (k > own), '') b from p group by 1, 2),
w as (select id, list(struct_pack(a := a, b := b) order by lv) steps, sha256(string_agg(a || b, '' order by lv)) proof_sha256 from q group by id),
x as (select r.doc_id, r.leaf, s.subroot, (select h from u where n = 1) root, coalesce(w.proof_sha256, sha256('')) proof_sha256,
  list_reduce(list_prepend(struct_pack(a := r.changed, b := ''), coalesce(w.steps, [])), lambda h, y: struct_pack(a := sha256(y.a || h.a || y.b), b := '')).a folded_root
  from r join s on s.source is not distinct from r.source left join w on w.id = r.id)
select *, folded_root = root verified from x"""

#: Of the others none as a whole has an oracle in SQL: each rests on hashes, libraries or iterations that SQL has no functions for, or is too slow there over whole tables. Two of their parts have.
ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": _NEGATIVES,
    "op13_merkle": _MERKLE,
    "quality_statistics": rf"""with d as (select row_number() over () k, doc_id, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '{_WORD}+') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) l from d),
g as (select k, unnest(range(1, len(w) - 1)) i, w from w where len(w) >= 3),
h as (select k, i, count(*) over (partition by k, w[i], w[i + 1], w[i + 2]) n from g),
r as (select k, count(distinct i + j) n from h, (select unnest([0, 1, 2]) j) where n > 1 group by k),
s as (select doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, coalesce(r.n, 0) n_repeat_words from w left join r using (k))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from s""",
    "shard_records": "select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 16 as bigint) size from documents",
}
