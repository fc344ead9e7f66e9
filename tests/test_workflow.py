"""Fit, predict and validate end to end on small tables."""

import csv
import glob
import random

import pytest
from pyspark.sql import functions as F

from sparkstill.functions.schema import ColumnError, key_column, match_columns, match_tasks, resolve
from sparkstill.operators import calibrate, labels, metrics, split
from sparkstill.plans import workflow
from sparkstill.plans.artifact import Artifact, ArtifactError
from sparkstill.sources import tables
from sparkstill.streaming.score import score_stream


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("flow")
    r = random.Random(1)
    parts = [f"p{k}" for k in range(12)]
    texts = [" ".join(r.choice(parts) for _ in range(8)) for _ in range(160)]
    value = [t.split().count("p1") / 4 + t.split().count("p2") / 8 for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").coalesce(1).write.parquet(f"{folder}/library.parquet")
    with open(folder / "soft.csv", "w", newline="") as f:
        csv.writer(f).writerows([["smiles", "activity_probability"], *zip(texts, value, strict=True)])
    with open(folder / "hard.tsv", "w", newline="") as f:
        csv.writer(f, delimiter="\t").writerows([["smiles", "activity"], *((t, int(v > 0.2)) for t, v in zip(texts[::3], value[::3], strict=True))])
    with open(folder / "queries.csv", "w", newline="") as f:
        csv.writer(f).writerows([["smiles"], *([t] for t in texts[:20]), ["?"]])
    artifact = workflow.fit(spark, f"{folder}/run", f"{folder}/library.parquet", f"{folder}/soft.csv", f"{folder}/hard.tsv", f"{folder}/model", rounds=4, width=128)
    return folder, artifact, texts


def test_fit_leaves_a_folder_that_explains_itself(spark, made):
    folder, artifact, _ = made
    loaded = Artifact.load(spark, f"{folder}/model")
    assert [c.name for c in loaded.columns] == ["activity_probability"] and loaded.columns[0].has_hard
    assert not (folder / "run").exists()
    (folder / "none").mkdir()
    with pytest.raises(ArtifactError):
        Artifact.load(spark, f"{folder}/none")


def test_predict_keeps_order_and_leaves_unparsed_cells_empty(spark, made):
    folder, artifact, texts = made
    with pytest.warns(UserWarning, match="1 rows"):
        workflow.predict(spark, artifact, f"{folder}/queries.csv", f"{folder}/out")
    lines = [row for p in sorted(glob.glob(f"{folder}/out/part-*")) for row in list(csv.reader(open(p)))[1:]]
    assert [x[0] for x in lines] == [*texts[:20], "?"]
    assert lines[-1][1] == "" and all(0 <= float(x[1]) <= 2 for x in lines[:-1])


def test_validate(spark, made):
    folder, artifact, _ = made
    report = workflow.validate(spark, artifact, f"{folder}/soft.csv", f"{folder}/hard.tsv", f"{folder}/library.parquet")
    assert report["soft"]["activity_probability"]["n"] == 160 and report["hard"]["activity_probability"]["auroc"] > 0.7
    assert any("in the library" in x for x in report["notes"])


def test_a_stream_scores_as_a_batch_does(spark, made, tmp_path):
    folder, artifact, _ = made
    rows = spark.read.parquet(f"{folder}/library.parquet")
    rows.where("row_id < 30").write.parquet(f"{tmp_path}/in")
    model, width = artifact.columns[0], artifact.width
    from sparkstill.functions import features

    score = lambda df: model.student.transform(features.featurized(df, "text", width)).select("row_id", "prediction")
    score_stream(spark, f"{tmp_path}/in", rows.schema, score, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.join(score(rows.where("row_id < 30")).withColumnRenamed("prediction", "p"), "row_id").where("prediction = p").count() == 30


def test_a_changed_library_is_refused(spark, made, tmp_path):
    folder, _, texts = made
    spark.createDataFrame([(k, t + "x") for k, t in enumerate(texts)], "row_id long, text string").write.parquet(f"{tmp_path}/other.parquet")
    with pytest.raises(ValueError, match="row 0"):
        workflow.prepare(spark, f"{tmp_path}/run", f"{tmp_path}/other.parquet", f"{folder}/soft.csv")


def test_columns():
    assert key_column(["a", " SMILES ", "b"]) == 1 and key_column(["a", "b"]) is None
    assert resolve(["id", "smiles", "x", "y"], None, ["y", "x"]) == ("smiles", ["y", "x"])
    for bad in ((["a"],), (["x", "smiles"],), (["smiles", *"abcdefghijk"],)):
        with pytest.raises(ColumnError):
            resolve(*bad)
    with pytest.raises(ColumnError):
        resolve(["smiles", "x"], None, ["z"])
    assert match_columns(["act_p", "sol", "sol_x"], ["act", "sol"]) == {"act": "act_p", "sol": "sol"}
    for soft, hard in ((["a_1", "a_2"], ["a"]), (["b"], ["a"]), (["a_b_c"], ["a", "a_b"])):
        with pytest.raises(ColumnError):
            match_columns(soft, hard)
    assert match_tasks(["act", "notes"], ["act_p"]) == ({"act": "act_p"}, ["notes"])


def test_readers(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    assert tables.read_table(spark, f"{tmp_path}/a.parquet").count() == 5
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/a.xyz", strict=True)
    with pytest.raises(ValueError, match="files"):
        tables.with_row_id(spark.range(100).repartition(7))
    with pytest.raises(ValueError, match="shuffle"):
        tables.with_row_id(spark.read.parquet(f"{tmp_path}/a.parquet").repartition(3))
    assert tables.json_safe({"a": float("nan"), "b": [1.5, float("inf")]}) == {"a": None, "b": [1.5, None]}


def test_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    """Files of unequal size: Spark reads large ones first and packs small ones together."""
    sizes = {"a": 3, "b": 30_000, "c": 1, "d": 5000}
    for name, n in sizes.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text("key,v\n" + "".join(f"{name}{k},{k}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = tables.with_row_id(spark.read.csv(f"{tmp_path}/in", header=True).select("key"))
        got = [r["key"] for r in rows.orderBy("row_id").collect()]
        assert sorted(r["row_id"] for r in rows.collect()) == list(range(len(got)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{name}{k}" for name, n in sizes.items() for k in range(n)]


def test_degenerate_metrics(spark):
    flat = spark.createDataFrame([(k, 1.0, float(k)) for k in range(5)], "row_id long, y double, p double")
    row = metrics.regression_metrics(flat, "y", "p").first()
    assert row["r2"] is None and row["pearson"] is None and row["spearman"] is None and row["n"] == 5
    assert metrics.ranking_metrics(flat, "y", "p").first()["auroc"] is None
    with pytest.raises(ValueError):
        split.stratified_split(flat.where("row_id = 0"), "y", "row_id")
    with pytest.raises(ValueError):
        calibrate.fit(flat.where("false"), "p", "y")
    assert split.stratified_split(flat, "p", "row_id", 0.01).where("is_val").select("y").collect()[0][0] == 0
    assert labels.detect_task(flat, "p") == "regression" and labels.detect_task(flat, "y") == "binary"


def test_ranks_share_ties(spark):
    from sparkstill.operators.order import average_ranks

    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([3, 1, 1, 2, 3, 3])], "i long, v double")
    assert [r["r"] for r in average_ranks(df, "v", "r").orderBy("i").collect()] == [4, 0.5, 0.5, 2, 4, 4]


def _file(folder, name):
    (found,) = glob.glob(f"{folder}/{name}/part-*")
    return open(found, encoding="utf-8")


def test_report_files(spark, tmp_path):
    from sparkstill.sources.reports import write_report

    write_report(spark, {"soft": {"a": {"n": 3, "mae": float("nan"), "r2": 0.5}}, "hard": {"a": {"n": 3, "auroc": 1.0, "ef_top_0.1": 2.0}}, "notes": ["<b>"], "model": {"schema": "s", "columns": [{"name": "a", "heads": ["student"], "a_max": 0.0, "trained": {"n_train": 9}}]}, "data": {"soft a": {"file": "f.csv", "n": 3}}, "internals": {"a": {"student": {"trees": 2, "nodes": 6, "depth": 1, "anchors": 4, "map": [[0.0, 1.0], [2.0, 3.0]], "losses": [1.0]}, "a_max": 0.0}}}, str(tmp_path))
    rows = list(csv.DictReader(_file(tmp_path, "performance_table.csv")))
    assert [r["labels"] for r in rows] == ["soft", "hard"] and rows[0]["mae"] == "" and rows[1]["ef_top_0.1"] == "2.0"
    text = _file(tmp_path, "report.html").read()
    assert "&lt;b&gt;" in text and all(f"<h2>{x}</h2>" in text for x in ("Configuration", "Tasks", "Data", "Teacher: soft labels", "Ranking: hard labels", "Internals"))
    write_report(spark, {}, f"{tmp_path}/empty")
    assert tables.load_json(spark, f"{tmp_path}/metrics.json")["soft"]["a"]["mae"] is None


@pytest.fixture(scope="module")
def staged(spark, made):
    """A run whose stages are started one by one, each from the folder."""
    folder, _, _ = made
    at = f"{folder}/stages"
    workflow.prepare(spark, at, f"{folder}/library.parquet", f"{folder}/soft.csv", f"{folder}/hard.tsv", width=128, task="binary")
    with pytest.raises(ValueError, match="not trained"):
        workflow.export(workflow.Run.open(spark, at), f"{folder}/early")
    with pytest.raises(ValueError, match="students"):
        workflow.learn_hard(workflow.Run.open(spark, at))
    found = workflow.tune_columns(workflow.Run.open(spark, at), 2, 2)
    workflow.learn_soft(workflow.Run.open(spark, at), 3, max_depth=3)
    run = workflow.Run.open(spark, at)
    assert run.column("c0")["settings"]["learning_rate"] == found["activity_probability"]["learning_rate"] and run.column("c0")["settings"]["max_depth"] == 3
    workflow.learn_hard(run, 3, 15)
    return folder, at


def test_stages_start_from_the_folder(spark, staged):
    folder, at = staged
    run = workflow.Run.open(spark, at)
    c = run.column("activity_probability")
    assert c["status"] == "blended" and c["n_train"] + c["n_val"] == c["n_finite"] == 160
    assert run.manifest["hard_labels"]["n_rows"] == 54 and run.manifest["hard_labels"]["n_dropped"] == 0
    assert {"r2", "rmse", "recall", "precision"} == set(c["gate"]) and "share_full" in c["similarity"]
    with pytest.raises(ColumnError):
        run.column("other")
    with pytest.raises(FileExistsError):
        workflow.prepare(spark, at, f"{folder}/library.parquet", f"{folder}/soft.csv")
    made = workflow.export(run, f"{folder}/staged-model")
    assert made.describe()["run"]["id"] == run.manifest["id"] and made.columns[0].trained["n_measured"] == 54
    again = workflow.Run.open(spark, at)
    again.manifest["id"] = "other"
    with pytest.raises(ArtifactError, match="another run"):
        workflow.export(again, f"{folder}/stale-model")
    with pytest.raises(FileNotFoundError):
        workflow.Run.open(spark, f"{folder}/nothing")


def test_artifact_tells_about_itself(spark, made):
    _, artifact, texts = made
    assert len(artifact) == 1 and artifact.tasks == ["activity_probability"]
    assert artifact.heads_for("activity_probability") == ["student", "hard"] and artifact.task_for("activity") == "activity_probability"
    with pytest.raises(KeyError):
        artifact.heads_for("x")
    c = artifact.columns[0]
    assert artifact.roles_for("activity_probability").keys() == {"student", "hard"} and artifact.n_features == artifact.width and set(artifact.versions) == {"python", "pyspark"}
    kinds = {r["curve"] for r in c.curves(spark).select("curve").distinct().collect()}
    assert kinds == {"student", "head", "share"}
    assert c.trees(spark).where("head = 'student'").count() == len(c.student.trees) >= 1
    rows = artifact.run(spark, [texts[0], "?", None]).orderBy("row_id").collect()
    assert rows[0][2] == rows[0][2] and all(r[2] != r[2] for r in rows[1:])


def test_falling_curves_are_told_by_score(spark):
    """A falling map over 0.2..1.0 is told over 0.2..1.0, and agrees with what it does to a score."""
    from sparkstill.operators import calibrate

    rows = spark.createDataFrame([(0.2 + 0.1 * k, 5.0 - k) for k in range(9)], "x double, y double")
    found = calibrate.fit(rows, "x", "y", sign="auto")
    points = found.points()
    assert found.sign == -1 and [p[0] for p in points] == sorted(p[0] for p in points) and points[0][0] == pytest.approx(0.2) and points[-1][0] == pytest.approx(1.0)
    for x, y in points:
        assert spark.range(1).select(found.apply(F.lit(x))).first()[0] == pytest.approx(y)


def test_a_featurizer_is_a_stage(spark, tmp_path):
    """Saved and loaded in a pipeline, rebuilt from its description; an unknown class gives a warning and none."""
    from pyspark.ml import PipelineModel

    from sparkstill.functions import features

    stage = features.TextPairs("text", "pairs", 64, 3)
    rows = spark.createDataFrame([("a b c d a b c", 1), (None, 2)], "text string, i int")
    PipelineModel([stage]).write().overwrite().save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p")
    want = stage.transform(rows).collect()
    assert again.transform(rows).collect() == want and sum(x["c"] for x in want[0]["pairs"]) == 5 and not want[1]["pairs"]
    rebuilt = features.from_description(stage.describe())
    assert rebuilt.copy({rebuilt.inputCol: "text"}).transform(rows).collect() == want
    assert features.made_with(stage.transform(rows)) == stage.describe()
    with pytest.warns(UserWarning, match="no featurizer"):
        assert features.from_description({"class": "Other", "width": 4}) is None


def test_an_artifact_without_a_known_featurizer_takes_pairs(spark, made, tmp_path):
    _, artifact, texts = made
    artifact.save(spark, f"{tmp_path}/m")
    meta = tables.load_json(spark, f"{tmp_path}/m/metadata")
    tables.save_json(spark, f"{tmp_path}/m/metadata", meta | {"featurizer": meta["featurizer"] | {"class": "Other"}})
    with pytest.warns(UserWarning, match="no featurizer"):
        found = Artifact.load(spark, f"{tmp_path}/m")
    rows = spark.createDataFrame(list(enumerate(texts[:5])), "row_id long, key string")
    with pytest.raises(ArtifactError, match="pairs"):
        found.transform(rows)
    assert found.transform(artifact.featurize(rows, "key")).collect() == artifact.transform(rows).collect()


def test_prediction_moves_no_rows(spark, made):
    _, artifact, texts = made
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, key string")
    plan = artifact.transform(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_artifacts_of_other_fingerprints_or_without_models_are_refused(spark, made, tmp_path):
    _, artifact, _ = made
    artifact.save(spark, f"{tmp_path}/m")
    meta = tables.load_json(spark, f"{tmp_path}/m/metadata")
    for change, match in (({"featurizer": {"kind": "other", "width": artifact.width}}, "fingerprints"), ({"featurizer": meta["featurizer"] | {"width": 64}}, "features"), ({"schema": "x"}, "schema"), ({"columns": [meta["columns"][0] | {"heads": ["student"]}]}, "heads"), ({"columns": meta["columns"] * 2}, "cannot be read")):
        tables.save_json(spark, f"{tmp_path}/m/metadata", meta | change)
        with pytest.raises(ArtifactError, match=match):
            Artifact.load(spark, f"{tmp_path}/m")


def test_a_gate_that_never_opens_is_an_error(spark, made):
    import dataclasses

    from sparkstill.plans.artifact import check_export

    _, artifact, texts = made
    shut = dataclasses.replace(artifact.columns[0], gate=dataclasses.replace(artifact.columns[0].gate, weights=[w * 0 for w in artifact.columns[0].gate.weights]), a_max=0.5)
    rows = spark.createDataFrame(list(enumerate(texts[:5])), "row_id long, key string")
    with pytest.raises(ArtifactError, match="never opens"):
        check_export(dataclasses.replace(artifact, columns=[shut]), dataclasses.replace(artifact, columns=[shut]), rows)
    with pytest.raises(ArtifactError, match="differ"):
        check_export(artifact, dataclasses.replace(artifact, columns=[dataclasses.replace(artifact.columns[0], isotonic=calibrate.IsotonicMap([0.0], [7.0]))]), rows)


def test_notes_on_what_a_table_says(spark, made, tmp_path):
    folder, artifact, texts = made
    (tmp_path / "none.csv").write_text("smiles,activity\n" + "".join(f"{t},\n" for t in texts[:4]))
    report = workflow.validate(spark, artifact, None, f"{tmp_path}/none.csv")
    assert not report["hard"] and any("no rows" in x for x in report["notes"])
    again = workflow.validate(spark, artifact, None, f"{folder}/hard.tsv")
    assert any("as many rows as" in x for x in again["notes"])
    lines = (folder / "hard.tsv").read_text().splitlines(keepends=True)
    (tmp_path / "part.tsv").write_text("".join(lines[:30]))
    part = workflow.validate(spark, artifact, None, f"{tmp_path}/part.tsv", hard_key="smiles", hard_values=["activity"])
    assert any("scored in-sample" in x for x in part["notes"]) and not any("as many rows as" in x for x in part["notes"])
    alone = workflow.validate(spark, artifact)
    assert any("internals only" in x for x in alone["notes"]) and alone["internals"]["activity_probability"]["student"]["trees"] >= 1


def test_library_is_built_and_written(spark, tmp_path):
    (tmp_path / "in.csv").write_text("smiles,x\n" + "".join(f"t{k % 700},{k}\n" for k in range(1000)) + ",1\n")
    found = tables.build_library(spark, f"{tmp_path}/in.csv", f"{tmp_path}/lib", distinct=True, limit=600)
    assert [tuple(r) for r in found.orderBy("row_id").collect()] == [(k, f"t{k}") for k in range(600)]
    assert tables.build_library(spark, f"{tmp_path}/in.csv", f"{tmp_path}/all").count() == 1000
    tables.export_library(spark, f"{tmp_path}/lib", f"{tmp_path}/out", "smiles")
    lines = [x for p in sorted(glob.glob(f"{tmp_path}/out/part-*")) for x in open(p).read().split()]
    assert lines[0] == "smiles" and [x for x in lines if x != "smiles"] == [f"t{k}" for k in range(600)]


def test_commands(spark, staged, tmp_path):
    from sparkstill import cli

    folder, _ = staged
    for line in (
        f"prepare --library {folder}/library.parquet --soft-labels {folder}/soft.csv --run-dir {tmp_path}/run --width 128 --soft-label-columns activity_probability --soft-key-column smiles",
        f"tune --run-dir {tmp_path}/run --trials 2 --rounds 2 --max-rows 100",
        f"learn-soft --run-dir {tmp_path}/run --rounds 2",
        f"export --run-dir {tmp_path}/run --model {tmp_path}/model",
        f"validate --model {tmp_path}/model --soft-labels {folder}/soft.csv --soft-label-columns activity_probability --output {tmp_path}/report",
        f"library --input {folder}/queries.csv --output {tmp_path}/lib --fingerprints --width 32",
        f"clean --run-dir {tmp_path}/run",
    ):
        cli.main(line.split())
    assert not (tmp_path / "run").exists() and (tmp_path / "report" / "metrics.json").exists()
    for bad in ("learn-soft", "unknown --run-dir x", "export --run-dir x"):
        with pytest.raises(SystemExit):
            cli.main(bad.split())


def test_isotonic_fit_against_pooled_violators(spark):
    """Ties in x, weights, and a falling map; the plain version pools neighbours until none falls."""
    r = random.Random(8)
    rows = [(float(r.randint(0, 60)), r.random() * 20, r.random() + 0.1) for _ in range(400)]
    rows = [(x, y + x * 0.2, w) for x, y, w in rows]

    def plain(points):
        pools: list[list] = []
        for x in sorted({p[0] for p in points}):
            own = [p for p in points if p[0] == x]
            pools.append([[x], sum(p[1] * p[2] for p in own), sum(p[2] for p in own)])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2]:
                xs, s, w = pools.pop()
                pools[-1] = [pools[-1][0] + xs, pools[-1][1] + s, pools[-1][2] + w]
        return {x: s / w for xs, s, w in pools for x in xs}

    df = spark.createDataFrame(rows, "x double, y double, w double")
    for sign, given in ((1, rows), (-1, [(-x, y, w) for x, y, w in rows])):
        found = calibrate.fit(df.withColumn("x", F.col("x") * sign), "x", "y", "w", sign="auto")
        assert found.sign == sign
        want = plain([(x * sign, y, w) for x, y, w in given])
        got = {q["x"]: q["f"] for q in spark.createDataFrame([(x * sign,) for x in want], "x double").select("x", found.apply(F.col("x")).alias("f")).collect()}
        assert all(abs(got[x * sign] - v) < 1e-3 for x, v in want.items())


def test_long_maps_are_looked_up_in_two_steps(spark):
    import numpy as np

    xs = [float(x) for x in np.cumsum(np.random.default_rng(1).random(3000) + 1e-3)]
    found = calibrate.IsotonicMap(xs, [x**0.5 for x in xs])
    asked = [xs[0] - 1, xs[0], xs[1], (xs[63] + xs[64]) / 2, xs[-1], xs[-1] + 1, *np.linspace(xs[0], xs[-1], 500).tolist()]
    got = [r["y"] for r in spark.createDataFrame([(k, float(x)) for k, x in enumerate(asked)], "k long, x double").select("k", found.apply(F.col("x")).alias("y")).orderBy("k").collect()]
    assert np.allclose(got, np.interp(asked, xs, found.y))


def test_row_numbers_of_tied_values(spark):
    from sparkstill.operators.order import group_quantile, row_numbers

    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 10 < 9, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = [r["id"] for r in row_numbers(df, "v", ["id"], descending=True).orderBy("rn").collect()]
    assert got == sorted(range(3000), key=lambda k: (-(1.0 if k % 10 < 9 else float(k)), k))
    q = {r["g"]: r["q"] for r in group_quantile(df.withColumn("g", F.col("id") % 3), "v", 0.93, ["g"], "q").collect()}
    want = {r["g"]: r["q"] for r in df.withColumn("g", F.col("id") % 3).groupBy("g").agg(F.percentile("v", 0.93).alias("q")).collect()}
    assert q.keys() == want.keys() and all(abs(q[k] - want[k]) < 1e-9 for k in q)


@pytest.mark.parametrize(("mode", "want"), [("off", "none"), ("kde", "kde"), ("bins", "bins"), ("on", "bins"), ("auto", "none")])
def test_weighting_modes(spark, mode, want):
    from sparkstill.operators import weights

    flat = spark.range(200).select((F.col("id") % 200).cast("double").alias("y"))
    assert weights.strategy(flat, "y", mode)["strategy"] == want
    with pytest.raises(ValueError):
        weights.strategy(flat, "y", "other")


def test_inputs_of_a_prediction(spark, tmp_path):
    from sparkstill.functions.features import featurized
    from sparkstill.functions.inputs import as_queries, assert_library

    for bad in ("CCO", b"CCO", {"a": 1}, {"a"}, 3):
        with pytest.raises(TypeError):
            as_queries(spark, bad)
    rows = as_queries(spark, (x for x in ["b", None, "a"])).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(0, "b"), (1, None), (2, "a")]
    spark.createDataFrame([("x",)], ["t"]).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert as_queries(spark, spark.read.parquet(f"{tmp_path}/t.parquet")).first()["key"] == "x"
    featurized(spark.createDataFrame([(k, "a b c") for k in range(3)], "row_id long, key string"), "key", 4).write.parquet(f"{tmp_path}/lib.parquet")
    lib = spark.read.parquet(f"{tmp_path}/lib.parquet")
    assert_library(lib, 3, 4)
    assert_library(lib.where("row_id < 2"), 3, 4, 2)
    for n, w in ((4, 4), (3, 5)):
        with pytest.raises(ValueError):
            assert_library(lib, n, w)
