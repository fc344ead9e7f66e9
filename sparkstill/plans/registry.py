"""The registered queries over the supplied tables, and the SQL that checks them.

Roles: `orders` gives a keyed teacher value and a made-up prediction, `documents` with
`labels` gives 0/1 labels and a made-up score, `embeddings` and `documents` are libraries.
Doubles are rounded on both sides, since sums differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, scalars, schema
from ..operators import calibrate, labels, metrics, order, report, similarity, split, student, tune, weights
from ..operators.gate import fit_gate
from ..operators.order import average_ranks
from ..sources import library as library_source
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y (in thousands), p and a group of the orders."""
    o = table(spark, sf_dir, "orders")
    p = F.lit(0.9) * F.col("o_totalprice") + F.lit(30.0) * (F.col("o_orderkey") % 1000).cast("double")
    return o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / F.lit(1000.0)).alias("y"), (p / F.lit(1000.0)).alias("p"), F.col("o_orderpriority").alias("grp"))


TEACHER = """b as (select o_orderkey row_id, o_totalprice/1000e0 y,
  (0.9e0*o_totalprice + 30e0*cast(o_orderkey % 1000 as double))/1000e0 p, o_orderpriority grp from orders)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y (quality) and a score with ties of the labelled documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    s = ((F.col("n_chars") % 500) + (F.col("doc_id") % 97)).cast("double") / F.lit(600.0)
    return d.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("long").alias("y"), s.alias("s"), "lang")


SCORED = """b as (select doc_id row_id, cast(quality as bigint) y,
  cast(n_chars % 500 + doc_id % 97 as double)/600e0 s, lang from documents join labels using (doc_id))"""


def div(a: str, b: str) -> str:
    return f"({a})/nullif({b}, 0)"


def _regression_sql(by: str = "") -> str:
    g, over = (f"{by}, " if by else "", f"partition by {by} " if by else "")
    p2 = f"partition by {by + ', ' if by else ''}"
    join = f"r join m using ({by})" if by else "r, m"
    group = f"group by {by}" if by else ""
    return f"""with {TEACHER},
r as (select *, rank() over({over}order by y)-1+(count(*) over({p2}y)-1)/2e0 ry, rank() over({over}order by p)-1+(count(*) over({p2}p)-1)/2e0 rp from b),
m as (select {g} avg(y) my, avg(p) mp, avg(ry) mry, avg(rp) mrp, quantile_cont(y, 0.9) q9 from r {group})
select {g} count(*) n, round(avg(abs(y-p)),6) mae, round(sqrt(avg((y-p)*(y-p))),6) rmse,
 round(1-{div("sum((y-p)*(y-p))", "sum((y-my)*(y-my))")},6) r2,
 round({div("sum((y-my)*(p-mp))", "sqrt(sum((y-my)*(y-my)))*sqrt(sum((p-mp)*(p-mp)))")},6) pearson,
 round({div("sum((ry-mry)*(rp-mrp))", "sqrt(sum((ry-mry)*(ry-mry)))*sqrt(sum((rp-mrp)*(rp-mrp)))")},6) spearman,
 round(sqrt(avg(case when y>=q9 then (y-p)*(y-p) end)),6) top_decile_rmse from {join} {group}"""


@query(_regression_sql())
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(teacher(spark, sf_dir), "y", "p"))


@query(_regression_sql("grp"))
def regression_metrics_by_group(spark, sf_dir):
    return rounded(metrics.regression_metrics(teacher(spark, sf_dir), "y", "p", ["grp"]))


@query(f"with {SCORED} select row_id, rank() over(order by s)-1+(count(*) over(partition by s)-1)/2e0 as \"rank\" from b")
def average_rank(spark, sf_dir):
    return average_ranks(scored(spark, sf_dir), "s", "rank").select("row_id", "rank")


SWEEP = f"""with {SCORED}, g as (select s, sum(y) t, count(*) c from b group by s),
c as (select s, cast(t as double) t, cast(c as double) c, cast(sum(t) over(order by s desc) as double) tp, cast(sum(c) over(order by s desc) as double) k,
  cast(sum(t) over() as double) np, cast(sum(c) over() as double) n from g)"""


@query(SWEEP + """ select round(s,9) threshold, round((k-tp)/(n-np),9) fpr, round(tp/np,9) tpr from c union all select 'inf'::double, 0e0, 0e0""")
def roc_points(spark, sf_dir):
    return rounded(metrics.roc_points(scored(spark, sf_dir), "y", "s"), 9)


@query(SWEEP + " select round(s,9) threshold, round(tp/np,9) recall, round(tp/k,9) as \"precision\" from c")
def pr_points(spark, sf_dir):
    return rounded(metrics.pr_points(scored(spark, sf_dir), "y", "s"), 9)


@query(SWEEP + """ select round(sum(((k-tp)-(k-c-tp+t))/(n-np)*(tp/np+(tp-t)/np)/2),6) auroc, round(sum(t/np*tp/k),6) average_precision from c""")
def binary_metrics_auroc_ap(spark, sf_dir):
    return rounded(metrics.ranking_metrics(scored(spark, sf_dir), "y", "s"))


TOP = f"""with {SCORED}, r as (select y, row_number() over(order by s desc, row_id) rn from b), t as (select count(*) n, sum(y) np from b)"""


@query(TOP + """, f as (select unnest([0.01e0,0.05e0,0.1e0]) fraction), k as (select fraction, greatest(1, cast(round_even(fraction*n,0) as bigint)) k, n, np from f, t)
select fraction, k, cast(sum(y) as bigint) hits, round(sum(y)/k::double/(np/n::double),6) ef from k join r on rn <= k group by fraction, k, np, n""")
def enrichment_top_k(spark, sf_dir):
    return rounded(metrics.enrichment(scored(spark, sf_dir), "y", "s", "row_id"))


@query(TOP + """, k as (select distinct greatest(1, cast(round_even(pow(10, -3+3*i/39e0)*n,0) as bigint)) k, n, np from range(40) x(i), t)
select k, cast(sum(y) as bigint) hits, round(sum(y)/k::double/(np/n::double),6) ef from k join r on rn <= k group by k, np, n""")
def enrichment_sweep(spark, sf_dir):
    return rounded(report.enrichment_sweep(scored(spark, sf_dir), "y", "s", "row_id"))


@query(SWEEP + """, x as (select sum(((k-tp)-(k-c-tp+t))/(n-np)*(tp/np+(tp-t)/np)/2) auroc, sum(t/np*tp/k) ap, any_value(n) n, any_value(np) np from c),
r as (select y, row_number() over(order by s desc, row_id) rn from b),
e as (select """ + ", ".join(f"sum(case when rn <= greatest(1, cast(round_even({f}e0*(select n from x),0) as bigint)) then y end)/greatest(1, cast(round_even({f}e0*(select n from x),0) as bigint))::double e{i}" for i, f in enumerate(metrics.FRACTIONS)) + """ from r)
select cast(n as bigint) n, cast(np as bigint) n_positive, round(np/n,6) hit_rate, round(auroc,6) auroc, round(ap,6) average_precision, """ + ", ".join(f'round(e{i}/(np/n),6) as "ef_top_{f}"' for i, f in enumerate(metrics.FRACTIONS)) + " from x, e")
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(scored(spark, sf_dir), "y", "s", "row_id"))


SPLIT = f"""with {TEACHER}, r as (select row_id, y, row_number() over(order by y, row_id)-1 as "rank" from b), m as (select count(*) m, greatest(1, least(cast(round_even(count(*)*0.1e0,0) as bigint), count(*)-1)) nv from b),
v as (select distinct cast(case when nv = 1 then 0 else round_even(i*(m-1)::double/(nv-1),0) end as bigint) as "rank" from m, range((select nv from m)) x(i))"""


@query(SPLIT + """ select row_id, round(y,6) y, r."rank", v."rank" is not null is_val from r left join v using ("rank")""")
def stratified_split(spark, sf_dir):
    return rounded(split.stratified_split(teacher(spark, sf_dir), "y", "row_id"))


@query(SPLIT + """ select v."rank" is not null is_val, count(*) n, round(min(y),6) least, round(max(y),6) largest, round(avg(y),6) mean from r left join v using ("rank") group by 1""")
def split_summary(spark, sf_dir):
    rows = split.stratified_split(teacher(spark, sf_dir), "y", "row_id")
    return rounded(rows.groupBy("is_val").agg(F.count("*").alias("n"), F.min("y").alias("least"), F.max("y").alias("largest"), F.avg("y").alias("mean")))


@query(f"with {TEACHER} select count(*) n, round(sum(y),3) total from b where row_id < 2000")
def max_samples_prefix(spark, sf_dir):
    return split.prefix(teacher(spark, sf_dir), "row_id", 2000).agg(F.count("*").alias("n"), F.round(F.sum("y"), 3).alias("total"))


BINS = f"""with {TEACHER}, q as (select quantile_cont(y,0.01) lo, quantile_cont(y,0.99) hi, count(*) n from b),
i as (select row_id, y, case when y < lo+(hi-lo)/20 then 0 else least(19, cast(floor((y-lo)/((hi-lo)/20)) as int)) end bin from b, q),
c as (select x.i::int bin, count(i.bin) as "count" from range(20) x(i) left join i on i.bin = x.i group by 1),
w as (select bin, "count", case when "count" > 0 then least(greatest((select n from q)/(20e0*"count"),1e0),10e0) else 1e0 end weight from c)"""


@query(BINS + ' select bin, "count", round(weight,6) weight from w')
def bin_weights(spark, sf_dir):
    return rounded(weights.bin_weights(teacher(spark, sf_dir), "y"))


@query(BINS + " select row_id, i.bin, round(weight,6) weight from i join w on i.bin = w.bin")
def apply_bin_weights(spark, sf_dir):
    return rounded(weights.apply_bin_weights(teacher(spark, sf_dir), "y").select("row_id", "bin", "weight"))


@query(BINS + """ select round(stddev_pop(nullif("count",0))/avg(nullif("count",0)),6) cv, round(avg(case when "count"=0 then 1e0 else 0e0 end),6) empty_share,
 stddev_pop(nullif("count",0))/avg(nullif("count",0)) > 0.5 or avg(case when "count"=0 then 1e0 else 0e0 end) > 0.3 imbalanced from c""")
def imbalance_profile(spark, sf_dir):
    return rounded(weights.imbalance(teacher(spark, sf_dir), "y"))


@query(BINS + """, s as (select stddev_pop(nullif("count",0))/avg(nullif("count",0)) > 0.5 or avg(case when "count"=0 then 1e0 else 0e0 end) > 0.3 im from c)
select case when not im then 'none' when (select count(*) from b) < 1000 or (select count(distinct y) from b) < 20 then 'bins' else 'kde' end as strategy from s""")
def weight_strategy(spark, sf_dir):
    return spark.createDataFrame([(weights.strategy(teacher(spark, sf_dir), "y")["strategy"],)], "strategy string")


@query(f"""with {TEACHER}, s as (select min(y) lo, max(y) hi, stddev_pop(y) sd, quantile_cont(y,0.75)-quantile_cont(y,0.25) iqr, count(*) n from b),
p as (select *, (hi-lo)/512 dx, greatest(0.9e0*(case when iqr>0 then least(sd,iqr/1.349e0) else sd end)*pow(n,-0.2e0), (hi-lo)/512) bw from s),
h as (select *, greatest(cast(floor(3*bw/dx) as int),1) hf from p),
k as (select sum(exp(-0.5e0*pow(j*dx/bw,2))) norm from h, range(-1100,1101) x(j) where abs(j) <= hf),
c as (select greatest(0,least(511,cast(floor((y-lo)/dx) as int))) i, count(*) c from b, h group by 1),
g as (select x.i::int i from range(512) x(i)),
d as (select g.i, coalesce(sum(c.c*exp(-0.5e0*pow((g.i-c.i)*dx/bw,2))/norm),0) d from g cross join h cross join k left join c on abs(g.i-c.i) <= hf group by g.i),
e as (select d.i, coalesce(c.c,0) n, greatest(d, (select max(d) from d)*1e-6) d from d left join c on c.i = d.i),
t as (select sum(d*n)/sum(n) typical from e)
select e.i as cell, n as "count", round(d,5) density, round(least(greatest(typical/d,1e0),10e0),5) weight from e, t""")
def kde_weights(spark, sf_dir):
    return rounded(weights.density_weights(teacher(spark, sf_dir), "y"), 5)


@query()
def isotonic_fit(spark, sf_dir):
    """The teacher's value on the prediction of all orders; tests compare the fit with a plain pool of violators."""
    return calibrate.fitted(teacher(spark, sf_dir), "p", "y")


@query()
def isotonic_decreasing(spark, sf_dir):
    return calibrate.fitted(teacher(spark, sf_dir).select((-F.col("p")).alias("x"), "y"), "x", "y", sign="auto")


@query("""with a as (select o_orderkey row_id, cast(o_orderkey % 700 as double)/100 - 1 v from orders), k(x0,x1,y0,y1) as (values (0e0,1e0,0.1e0,0.2e0),(1e0,3e0,0.2e0,0.7e0),(3e0,4e0,0.7e0,0.9e0))
select row_id, round(case when v <= 0 then 0.1e0 when v >= 4 then 0.9e0 else y0+(y1-y0)*(v-x0)/(x1-x0) end, 6) y from a left join k on v >= x0 and v < x1""")
def isotonic_apply(spark, sf_dir):
    found = calibrate.IsotonicMap([0.0, 1.0, 3.0, 4.0], [0.1, 0.2, 0.7, 0.9])
    v = (F.col("o_orderkey") % 700).cast("double") / F.lit(100.0) - F.lit(1.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.round(found.apply(v), 6).alias("y"))


@query("select cast(o_custkey as double) x, round(avg(o_totalprice),8) y, cast(count(*) as double) w from orders group by 1")
def tied_group_mean(spark, sf_dir):
    return rounded(calibrate.tied_means(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice"), 8)


BITS = """f as (select vec_id id, label, i from (select vec_id, label, unnest(embedding) e, generate_subscripts(embedding,1) i from embeddings) where e > 0),
c as (select id, count(*) c from f group by id), h as (select * from f where label = 1),
o as (select f.id q, h.id r, count(*) n from f join h on f.i = h.i group by f.id, h.id),
s as (select q, r, cast(n as double)/(a.c+b.c-n) sim from o join c a on a.id=q join c b on b.id=r),
t as (select vec_id id, coalesce(max(sim),0) sim from embeddings left join s on q = vec_id group by vec_id)"""


def _sets(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", similarity.positive(F.col("embedding")).alias("bits"))
    return e, e.where("label = 1")


def _nearest(spark, sf_dir):
    return similarity.nearest(*_sets(spark, sf_dir))


@query(f"with {BITS} select id, round(sim,9) sim from t")
def tanimoto_nn(spark, sf_dir):
    return rounded(_nearest(spark, sf_dir), 9)


@query(f"with {BITS}, k as (select q, r, round(sim,9) sim, row_number() over(partition by q order by round(sim,9) desc, r) as \"rank\" from s) select q, r, sim, \"rank\" from k where \"rank\" <= 3")
def tanimoto_topk(spark, sf_dir):
    return rounded(similarity.neighbours(*_sets(spark, sf_dir), 3), 9)


@query(f"with {BITS} select round(quantile_cont(sim,0.5),6) median, round(quantile_cont(sim,0.99),6) p99, round(max(sim),6) largest, round(avg(case when sim >= 0.4e0 then 1e0 else 0e0 end),6) share_start, round(avg(case when sim >= 0.7e0 then 1e0 else 0e0 end),6) share_full from t")
def similarity_stats(spark, sf_dir):
    return rounded(similarity.reach(_nearest(spark, sf_dir)))


@query(f"""with {BITS}, x as (select sim t, sim - (id % 7)*0.05e0 e from t)
select round(sum((t>0.4e0 and e>0.4e0)::int)/nullif(sum((t>0.4e0)::int),0)::double,6) recall, round(sum((t>0.4e0 and e>0.4e0)::int)/nullif(sum((e>0.4e0)::int),0)::double,6) as "precision" from x""")
def gate_reach(spark, sf_dir):
    rows = _nearest(spark, sf_dir).select(F.col("sim").alias("t"), (F.col("sim") - (F.col("id") % 7) * F.lit(0.05)).alias("e"))
    return rounded(similarity.gate_quality(rows, "t", "e"))


@query(f"with {BITS} select id, round(0.66e0*least(greatest((sim-0.4e0)/(0.7e0-0.4e0),0e0),1e0),6) share from t")
def ramp_weight(spark, sf_dir):
    return rounded(_nearest(spark, sf_dir).select("id", scalars.ramp(F.col("sim")).alias("share")))


@query(f"""with {BITS}, a as (select id, sim, 0.66e0*least(greatest((sim-0.4e0)/(0.7e0-0.4e0),0e0),1e0) a, cast(id % 101 as double)/100 s, cast(id % 53 as double)/52 h from t)
select id, round(sim,6) sim, round((1-a)*s + a*h,6) score from a""")
def blend_prediction(spark, sf_dir):
    soft, hard = (F.col("id") % 101).cast("double") / F.lit(100.0), (F.col("id") % 53).cast("double") / F.lit(52.0)
    return rounded(_nearest(spark, sf_dir).select("id", "sim", scalars.blend(soft, hard, scalars.ramp(F.col("sim"))).alias("score")))


@query("""with a as (select o_orderkey row_id, case when o_orderkey % 11 = 0 then 'nan'::double else cast(o_orderkey % 200 as double)/150 - 0.2e0 end r2, cast(o_orderkey % 10 as double)/10 sim from orders),
e as (select *, case when r2 is null or isnan(r2) then 0 else least(greatest(r2,0),0.66e0) end c from a)
select row_id, round(case when c < 0.1e0 or sim < 0.4e0 then 0e0 else c end,6) ceiling from e""")
def blend_ceiling(spark, sf_dir):
    k = F.col("o_orderkey")
    r2 = F.when(k % 11 == 0, F.lit(float("nan"))).otherwise((k % 200).cast("double") / F.lit(150.0) - F.lit(0.2))
    return rounded(table(spark, sf_dir, "orders").select(k.alias("row_id"), scalars.blend_ceiling(r2, (k % 10).cast("double") / F.lit(10.0)).alias("ceiling")))


@query("select round(avg(case when o_custkey in (select c_custkey from customer where c_custkey % 3 <> 0) then 1e0 else 0e0 end),6) share from orders")
def library_overlap(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"))
    return rounded(labels.library_overlap(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), known, "key"))


ALIGN = """with a as (select doc_id, text from documents), b as (select doc_id, case when doc_id % 150 = 149 then text || '?' else text end text from documents where doc_id CUT),
j as (select coalesce(a.doc_id,b.doc_id) id, a.doc_id l, b.doc_id r, a.text x, b.text y from a full join b on a.doc_id = b.doc_id)
select count(l) n_left, count(r) n_right, min(case when l is null or r is null or x is distinct from y then id end) first_mismatch from j"""


def _changed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d, d.select("doc_id", F.when(F.col("doc_id") % 150 == 149, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))


@query(ALIGN.replace("CUT", "is not null"))
def alignment_first_mismatch(spark, sf_dir):
    return labels.alignment(*_changed(spark, sf_dir), "doc_id", "text")


@query(ALIGN.replace("CUT", "in (select doc_id from labels)"))
def alignment_count_check(spark, sf_dir):
    """All documents against those that have labels."""
    d, other = _changed(spark, sf_dir)
    return labels.alignment(d, other.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text")


@query("""with l as (select doc_id, case when doc_id % 13 = 0 then null else toxic end toxic, quality, n_chars from labels join documents using (doc_id))
""" + " union all ".join(f"""select '{c}' "name", count(*) n, count({c}) n_finite, min({c})::double least, max({c})::double largest, bool_and({c} in (0,1)) is_binary from l""" for c in ("toxic", "quality", "n_chars")))
def column_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return labels.profile(rows.withColumn("toxic", F.when(F.col("doc_id") % 13 != 0, F.col("toxic"))), ["toxic", "quality", "n_chars"])


@query(" union all ".join(f"""select '{c}' "name", count({c}) n, cast(sum({c}) as bigint) positive, cast(count(*)-sum({c}) as bigint) negative, count(*) >= 4 and least(sum({c}), count(*)-sum({c})) >= 2 enough from labels""" for c in ("quality", "toxic")))
def class_balance(spark, sf_dir):
    return labels.class_balance(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query(" union all ".join(f"""select '{c}' "name", case when bool_and({c} in (0,1)) then 'binary' else 'regression' end task from labels join documents using (doc_id)""" for c in ("quality", "n_chars")))
def task_detect(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return labels.profile(rows, ["quality", "n_chars"]).select("name", F.when(F.col("is_binary"), "binary").otherwise("regression").alias("task"))


SHINGLES = """w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(list_transform(range(1, greatest(len(w),1)::bigint), lambda i: w[i] || ' ' || w[i+1])) s from w),
f as (select doc_id row_id, cast(('0x'||substr(md5(s),1,8))::bigint % 2048 as int) i, cast(least(count(*),255) as int) c from s group by 1, 2)"""


@query(f"with {SHINGLES} select row_id, i, c from f")
def hashed_fingerprint(spark, sf_dir):
    return features.hashed_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"with {SHINGLES}, n as (select doc_id row_id, count(i) n, coalesce(sum(c),0) m from documents left join f on row_id = doc_id group by 1) select count(*) n_rows, round(avg(n/2048e0),9) density, round(avg(m::double),6) mean_count, count(*) filter (n = 0) invalid from n")
def fingerprint_density(spark, sf_dir):
    fp = features.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, x: a + x["c"]).cast("double")
    return fp.agg(F.count("*").alias("n_rows"), F.round(F.avg(F.size("features") / F.lit(2048.0)), 9).alias("density"), F.round(F.avg(total), 6).alias("mean_count"), F.count(F.when(~features.parsed(F.col("features")), 1)).alias("invalid"))


@query(f"with {SHINGLES} select doc_id row_id from documents where doc_id not in (select row_id from f)")
def invalid_rows(spark, sf_dir):
    return features.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text").where(~features.parsed(F.col("features"))).select("row_id")


@query(f"with {SHINGLES} select doc_id, cast(quality as double) y, count(*) n_bits from labels join f on row_id = doc_id where quality is not null group by 1, 2")
def hard_label_prepare(spark, sf_dir):
    lib = features.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")
    return labels.prepare_binary(table(spark, sf_dir, "labels"), lib, "doc_id", "quality").select("doc_id", "y", F.size("features").cast("long").alias("n_bits"))


@query(f"""with {SCORED}, e as (select distinct unnest(quantile_cont(s, [{",".join(str(k / 20) for k in range(21))}])) e from b), i as (select e from e where e > (select min(e) from e) and e < (select max(e) from e)),
x as (select s, y, (select count(*) from i where e <= s) bin from b) select cast(bin as int) bin, count(*) n, round(avg(s),6) mean_p, round(avg(y),6) mean_y from x group by 1""")
def calibration_bins(spark, sf_dir):
    return rounded(report.calibration_bins(scored(spark, sf_dir), "y", "s"))


def _bin_sql(v: str, lo: str, hi: str, n: int) -> str:
    return f"case when {v} < {lo}+({hi}-{lo})/{n} then 0 else least({n - 1}, cast(floor(({v}-{lo})/(({hi}-{lo})/{n})) as int)) end"


@query(f"with {TEACHER}, r as (select p-y v from b), m as (select min(v) lo, max(v) hi from r) select {_bin_sql('v', 'lo', 'hi', 60)} bin, count(*) n from r, m group by 1")
def residual_histogram(spark, sf_dir):
    return report.residual_histogram(teacher(spark, sf_dir), "y", "p")


@query(f"with {TEACHER} select round(avg(p-y),6) bias, round(stddev_pop(p-y),6) sd from b")
def residual_moments(spark, sf_dir):
    return rounded(report.residual_moments(teacher(spark, sf_dir), "y", "p"))


@query(f"with {SCORED}, m as (select min(s) lo, max(s) hi from b), t as (select y, count(*) t from b group by y), x as (select y, {_bin_sql('s', 'lo', 'hi', 49)} bin, count(*) n from b, m group by 1, 2) select x.y, bin, n, round(n/t::double/((hi-lo)/49),6) density from x join t on t.y = x.y, m")
def score_by_class(spark, sf_dir):
    return rounded(report.score_by_class(scored(spark, sf_dir), "y", "s"))


@query(f"""with {TEACHER}, m as (select least(min(y),min(p)) lo, greatest(max(y),max(p)) hi from b), v as (select 'a' series, y v from b union all select 'b', p from b)
select series, {_bin_sql('v', 'lo', 'hi', 59)} bin, count(*) n from v, m group by 1, 2""")
def score_distribution(spark, sf_dir):
    return report.score_distributions(teacher(spark, sf_dir), "y", "p")


@query(f"""with {TEACHER}, r as (select row_id id, p-y e from b), m as (select avg(e) m, stddev_pop(e) sd, count(*)::double n from r),
k as (select id, e, rank() over(order by e)-1+(count(*) over(partition by e)-1)/2e0 rk from r), x as (select id, (e-m)/sd z, 2*(rk+0.5e0)/n-1 x from k, m),
l as (select *, ln(greatest(1-x*x,1e-300)) l from x), t as (select *, 2/(pi()*0.147e0)+l/2 t from l)
select id, round(z,6) z, round(sqrt(2e0)*sign(x)*sqrt(sqrt(t*t-l/0.147e0)-t),6) theory from t""")
def qq_points(spark, sf_dir):
    return rounded(report.qq_points(teacher(spark, sf_dir), "y", "p", "row_id"))


@query(f"with {TEACHER}, m as (select min(y) a, max(y) b, min(p) c, max(p) d from b) select {_bin_sql('y', 'a', 'm.b', 45)} bx, {_bin_sql('p', 'c', 'd', 45)} by_, count(*) n from b, m group by 1, 2")
def density_grid(spark, sf_dir):
    return report.density_grid(teacher(spark, sf_dir), "y", "p")


@query(f"""with {TEACHER}, {SCORED.replace('b as', 'd as', 1)}, r as (select 'price' task, count(*) n, round(avg(abs(y-p)),6) mae, round(sqrt(avg((y-p)*(y-p))),6) rmse from b),
h as (select 'quality' task, count(*) n, cast(sum(y) as bigint) n_positive, round(avg(y),6) hit_rate from d)
select task, n, mae, rmse, null::bigint n_positive, null::double hit_rate from r union all select task, n, null, null, n_positive, hit_rate from h""")
def performance_table(spark, sf_dir):
    r = metrics.regression_metrics(teacher(spark, sf_dir), "y", "p").select(F.lit("price").alias("task"), "n", "mae", "rmse")
    h = scored(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"), F.avg("y").alias("hit_rate")).select(F.lit("quality").alias("task"), "*")
    return rounded(r.unionByName(h, allowMissingColumns=True))


@query("""with n as (select lower(n_name) h, case when n_nationkey % 3 = 0 then lower(n_name) when n_nationkey % 3 = 1 then lower(n_name) || '_' || lower(r_name) else lower(n_name) || '-' || n_nationkey end s
  from nation join region on n_regionkey = r_regionkey), m as (select h.h hard, s.s soft, h.h = s.s exact, count(*) over (partition by h.h, h.h = s.s) n from n h join n s on s.s = h.h or starts_with(s.s, h.h || '_') or starts_with(s.s, h.h || '-'))
select hard, soft from m where exact or n = 1 and not exists (select 1 from n where n.s = m.hard)""")
def column_matching(spark, sf_dir):
    """The nations as label columns: teacher columns have the same name, or one with a suffix."""
    n, name = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")), F.lower("n_name")
    k = F.col("n_nationkey") % 3
    soft = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit("_"), F.lower("r_name"))).otherwise(F.concat(name, F.lit("-"), F.col("n_nationkey").cast("string")))
    rows = n.select(name.alias("hard"), soft.alias("soft")).collect()  # names of columns
    found = schema.match_columns([r["soft"] for r in rows], [r["hard"] for r in rows])
    return spark.createDataFrame(sorted(found.items()), "hard string, soft string")


@query(f"""with {TEACHER} select row_id, cast((case when y >= 50 then 1 else 0 end)+(case when y >= 150 then 1 else 0 end)+(case when y >= 250 then 1 else 0 end) as int) bin from b""")
def digitize(spark, sf_dir):
    return teacher(spark, sf_dir).select("row_id", scalars.digitize(F.col("y"), [50.0, 150.0, 250.0]).alias("bin"))


@query("""with v as (select o_orderkey row_id, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'nan'::double when o_orderkey % 5 = 2 then 'inf'::double else o_totalprice end v from orders)
select count(*) n, count(*) filter (v is not null and not isnan(v) and not isinf(v)) n_finite from v""")
def finite_filter(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    v = F.when(k == 0, None).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(v.alias("v")).agg(F.count("*").alias("n"), F.count(F.when(scalars.finite(F.col("v")), 1)).alias("n_finite"))


@query("select round(max(abs(y - cast(cast(y as float) as double))),12) worst, 0::bigint failed from (select o_totalprice / 1000e0 y from orders)")
def worst_parity(spark, sf_dir):
    """Values against themselves in single precision, which is within the tolerance."""
    from .artifact import check_parity

    rows = teacher(spark, sf_dir)
    worst = check_parity(rows.select("row_id", "y"), rows.select("row_id", F.col("y").cast("float").cast("double").alias("y")), ["y"])
    return spark.createDataFrame([(round(worst, 12), 0)], "worst double, failed long")


# models: no SQL can express them


def held(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, which is not worked out again for each use."""
    path = tables.shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fingerprints, a teacher value and a split, as a written table: texts are looked at once, and fingerprints are joined once."""
    d = features.fingerprint(table(spark, sf_dir, "documents").withColumn("y", F.log1p(F.col("n_chars").cast("double"))), "doc_id", "text", keep=["y"]).withColumnRenamed("features", "pairs")
    path = tables.shared_folder(spark, "library")
    d.write.parquet(path)
    d = spark.read.parquet(path)
    return held(d.join(split.stratified_split(d, "y", "row_id").select("row_id", "is_val"), "row_id"), "library")


@query()
def student_fit_predict(spark, sf_dir):
    rows = library(spark, sf_dir)
    return student.fit_student(rows, "y", features.WIDTH).predict(rows).select("row_id", "y", "score", "is_val")


@query()
def hard_head_predict(spark, sf_dir):
    rows = library(spark, sf_dir)
    measured = rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("label")), "row_id")
    measured = held(measured.select("row_id", "pairs", "label"), "measured")
    head = held(student.head_score(student.fit_head(measured, "label", features.WIDTH).model, rows).select("row_id", "hard", "y"), "scored")
    found = student.fit_head_map(head, "hard", "y")
    return head.select("row_id", "hard", found.apply(F.col("hard")).alias("calibrated"))


@query()
def tuned_settings(spark, sf_dir):
    """The trials of a study over the library, with the loss of each, the trees it grew, and the rung that stopped it."""
    study = tune.tune(library(spark, sf_dir), "y", features.WIDTH)
    rows = [(k, t["learning_rate"], t["min_split_gain"], t["loss"], t["rounds"], t["pruned"]) for k, t in enumerate(study["trials"])]
    return spark.createDataFrame(rows, "trial int, learning_rate double, min_split_gain double, loss double, rounds int, pruned int")


@query()
def gate_mlp(spark, sf_dir):
    rows = library(spark, sf_dir).select("row_id", "pairs")
    measured = rows.join(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("row_id")), "row_id")
    sets = [x.select(F.col("row_id").alias("id"), features.bits(F.col("pairs")).alias("bits")) for x in (rows, measured)]
    near = similarity.nearest(*sets)
    sample = split.hold_out(rows.withColumnRenamed("pairs", "features").join(near.withColumnRenamed("id", "row_id"), "row_id"), "row_id")
    gate = fit_gate(sample, "sim", features.WIDTH)
    return sample.select("row_id", "sim", gate.predict(F.col("features")).alias("estimate"))


DRAW = "('0x'||substr(md5('42|'||{}),1,8))::bigint"


def _sample_sql(most: int) -> str:
    """Of each segment its share of `most` customers, by the order of the draws."""
    return f"""with r as (select c_custkey row_id, c_mktsegment grp, {DRAW.format("c_mktsegment||'|'||c_custkey")} u from customer),
k as (select row_id, grp, row_number() over (partition by grp order by u, row_id) k, count(*) over (partition by grp) c, count(*) over () n from r)
select row_id, grp from k where n <= {most} or k <= greatest(1, round_even(c * {most}::double / n, 0))"""


def _segments(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("grp"))


@query(_sample_sql(10**9))
def sample_below_limit(spark, sf_dir):
    """A sample with a limit above the table's size is the table."""
    return split.proportional_sample(_segments(spark, sf_dir), "grp", "row_id", 10**9)


@query(_sample_sql(500))
def proportional_sample(spark, sf_dir):
    """500 customers with the segments' shares kept."""
    return split.proportional_sample(_segments(spark, sf_dir), "grp", "row_id", 500)


@query("""with a as (select ps.p_partkey id, cast(p_retailprice as double) v from part ps), q as (select quantile_cont(v,0.25) q25, quantile_cont(v,0.75) q75, quantile_cont(v,0.9) q90, quantile_cont(v,0.99) q99 from a)
select round(q25,6) q25, round(q75,6) q75, round(q90,6) q90, round(q99,6) q99 from q""")
def quantiles(spark, sf_dir):
    found = order.quantiles(table(spark, sf_dir, "part"), "p_retailprice", [0.25, 0.75, 0.9, 0.99])
    return rounded(spark.createDataFrame([tuple(found)], "q25 double, q75 double, q90 double, q99 double"))


@query("""select l_returnflag, l_linestatus, count(*) n, round(avg(abs(l_quantity - l_extendedprice/1500e0)),6) mae, round(sqrt(avg(pow(l_quantity - l_extendedprice/1500e0,2))),6) rmse from lineitem group by 1, 2""")
def bulk_errors(spark, sf_dir):
    """Order-free errors of the largest table by two columns: one partial and one final aggregate."""
    e = F.col("l_quantity") - F.col("l_extendedprice") / F.lit(1500.0)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")))


@query(f"with {SCORED}, t as (select s, y, row_number() over(order by s desc, row_id) rn, row_id from b) select row_id, round(s,9) s, y from t where rn <= 25")
def top_k_by_score(spark, sf_dir):
    """The 25 best scores; ties by row id."""
    return rounded(scored(spark, sf_dir).orderBy(F.desc("s"), "row_id").limit(25).select("row_id", "s", "y"), 9)


@query(f"with {SCORED}, q as (select lang, s, y from b) select lang, count(*) n, cast(sum(y) as bigint) positive, round(avg(s),6) mean_score from q group by cube(lang)")
def class_profile_cube(spark, sf_dir):
    return rounded(scored(spark, sf_dir).cube("lang").agg(F.count("*").alias("n"), F.sum("y").alias("positive"), F.avg("s").alias("mean_score")))


@query()
def artifact_roundtrip(spark, sf_dir):
    """Predictions of an artifact that is saved and loaded again, after they are compared with those before."""
    from .artifact import Artifact, Column, check_parity

    rows = library(spark, sf_dir)
    fitted = student.fit_student(rows, "y", features.WIDTH)
    made = Artifact([Column("chars", fitted.model, fitted.isotonic)], features.WIDTH)
    folder = tables.shared_folder(spark, "artifact")
    made.save(spark, folder)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("key"))
    loaded = Artifact.load(spark, folder)
    tables.delete(spark, folder)  # a model is held as a whole
    check_parity(made.transform(docs), loaded.transform(docs), ["chars"])
    return loaded.transform(docs).select("row_id", "chars")


@query(f"""with r as (select o_orderkey row_id, row_number() over (order by {DRAW.format('o_orderkey')}, o_orderkey) k, count(*) over () n from orders)
select row_id, k <= least(50000, greatest(1, n // 10)) is_val from r""")
def hold_out(spark, sf_dir):
    return split.hold_out(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id")), "row_id")


@query(f"with {TEACHER}, r as (select *, row_number() over (order by {DRAW.format('row_id')}, row_id) k from b) select row_id, round(y,6) y, round(p,6) p from r where k <= 1000")
def joint_sample(spark, sf_dir):
    """1000 orders, with value and prediction sampled alike."""
    return rounded(split.joint_sample(teacher(spark, sf_dir).select("row_id", "y", "p"), "row_id", 1000))


@query(f"with {TEACHER}, h as (select o_custkey row_id, avg(o_totalprice)/1000e0 g from orders group by 1) select row_id, round(g,10) g, round(y,10) y from h join b using (row_id)")
def align_scores(spark, sf_dir):
    """A score for the customers that are order ids too, paired with the teacher's value of that row."""
    scores = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg((F.avg("o_totalprice") / F.lit(1000.0)).alias("g"))
    targets = teacher(spark, sf_dir).select("row_id", "y")
    return rounded(labels.align_scores(scores.join(targets.select("row_id"), "row_id", "left_semi"), targets), 10)


@query(f"with {TEACHER}, r as (select p, p-y e from b), m as (select min(p) a, max(p) b, min(e) c, max(e) d from r) select {_bin_sql('p', 'a', 'm.b', 45)} bx, {_bin_sql('e', 'c', 'd', 45)} by_, count(*) n from r, m group by 1, 2")
def residual_density(spark, sf_dir):
    return report.residual_density(teacher(spark, sf_dir), "y", "p")


@query("select row_number() over () - 1 row_id, l_orderkey, l_linenumber from lineitem")
def positional_ids(spark, sf_dir):
    """The rows of the largest table, numbered as they stand in its files."""
    return tables.with_row_id(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query("select cast(o_orderkey as varchar) as key, case when o_orderkey % 7 <> 0 then round(o_totalprice,2) end score from orders")
def prediction_sink(spark, sf_dir):
    """Predictions written as comma-separated text, with empty cells for NaN, and read again."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").cast("string").alias("key"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.round("o_totalprice", 2)).alias("score"))
    folder = tables.shared_folder(spark, "predictions")
    tables.write_predictions(rows, folder)
    return spark.read.schema("key string, score double").csv(folder, header=True)


@query("select row_number() over () - 1 row_id, c_name as key, round(cast(c_acctbal as float)::double,2) c_acctbal from customer")
def label_scan(spark, sf_dir):
    """A label table written as tab-separated text, read by its suffix with row ids, key and values."""
    path = tables.shared_folder(spark, "labels") + ".tsv"
    rows = tables.with_row_id(table(spark, sf_dir, "customer").select(F.col("c_name").alias("smiles"), "c_acctbal", "c_mktsegment"))
    rows.repartitionByRange("row_id").sortWithinPartitions("row_id").drop("row_id").write.csv(path, header=True, sep="\t")
    return rounded(tables.read_labels(spark, path, None, ["c_acctbal"]).withColumn("c_acctbal", F.col("c_acctbal").cast("double")), 2)


@query(f"with {SHINGLES.replace('from documents', 'from (select n doc_id, text from (select row_number() over () - 1 n, text from documents where length(trim(text)) > 0))')} select n row_id, i, c from (select row_number() over () - 1 n from documents where length(trim(text)) > 0) join f on row_id = n")
def library_fingerprints(spark, sf_dir):
    """A library with the fingerprints of the documents in the order of their file, built in three blocks or more, as bins and counts."""
    n = table(spark, sf_dir, "documents").count()
    found = library_source.build(spark, f"{sf_dir}/documents.parquet", tables.shared_folder(spark, "library"), "text", block_rows=max(300, n // 3))
    return found.select("row_id", F.inline("pairs"))


@query("with t as (select p_type t, min(rn) rn from (select p_type, row_number() over () rn from part) group by 1) select row_number() over (order by rn) - 1 row_id, t as text from t")
def library_build(spark, sf_dir):
    """A library of the distinct part types in the order in which they come first."""
    return tables.build_library(spark, f"{sf_dir}/part.parquet", tables.shared_folder(spark, "parts"), "p_type", distinct=True)

