"""Prepare, tune, learn, export, predict and validate over a run folder.

Each stage reads what the one before wrote and writes its own result before it notes it in
the manifest, so that every stage can be started alone, again, and from another session.
The folder is wherever Spark writes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..functions.inputs import assert_library
from ..functions.scalars import blend_ceiling, finite
from ..functions.schema import ColumnError, match_columns, match_tasks, resolve
from ..operators import labels, metrics, similarity, split, student, tune, weights
from ..operators.gate import fit_gate
from ..sources.tables import delete, exists, json_safe, load_json, read_labels, read_library, read_queries, read_table, save_json, with_row_id, write_predictions
from .artifact import Artifact, ArtifactError, Column, check_export, warn_unparsed

MANIFEST = "sparkstill.run.v1"
#: Library rows and measured rows that an export is compared on.
PROBES = 16


@dataclass
class Run:
    """A prepared run: library, targets, splits, measured labels and models in a folder, and the manifest."""

    spark: SparkSession
    folder: str
    manifest: dict

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Run:
        if not exists(spark, f"{folder}/manifest"):
            raise FileNotFoundError(f"{folder} is not a prepared run")
        found = load_json(spark, f"{folder}/manifest")
        if found.get("schema") != MANIFEST:
            raise ValueError(f"{folder}: schema {found.get('schema')!r}; this version reads {MANIFEST}")
        return cls(spark, folder, found)

    def save(self) -> None:
        save_json(self.spark, f"{self.folder}/manifest", self.manifest)

    def column(self, name: str) -> dict:
        found = [c for c in self.manifest["columns"] if name in (c["name"], c["id"])]
        if not found:
            raise ColumnError(f"no column {name!r} among {[c['name'] for c in self.manifest['columns']]}")
        return found[0]

    def model(self, c: dict) -> str:
        return f"{self.folder}/models/{c['id']}"

    def rows(self, c: dict) -> DataFrame:
        """Library rows with the column's teacher value y and is_val."""
        m = self.manifest
        library = self.spark.read.parquet(f"{self.folder}/library")
        assert_library(library, m["library"]["n_rows"], m["library"]["width"], m["split"]["limit"])
        y = self.spark.read.parquet(f"{self.folder}/targets").select("row_id", F.col(f"`{c['name']}`").cast("double").alias("y"))
        return library.join(y, "row_id").join(self.spark.read.parquet(f"{self.folder}/splits/{c['id']}"), "row_id")

    def measured(self, c: dict) -> DataFrame:
        label = F.col(f"`h_{c['hard']}`")
        return self.spark.read.parquet(f"{self.folder}/hard").where(finite(label)).withColumn("label", label)


#: Kinds of measured labels: found out from the values, or given.
TASKS = ("auto", "binary", "regression")


def _measured(spark: SparkSession, folder: str, names: list[str], path: str, key, values, width: int, task: str = "auto") -> tuple[dict[str, str], dict]:
    """Write the measured rows that have a feature; which label belongs to which column, and how many rows and drops there are.

    task: "binary" refuses other values than 0 and 1 at once; "regression" cannot be learned.
    """
    if task not in TASKS:
        raise ValueError(f"task {task!r} is none of {TASKS}")
    table = read_table(spark, path)
    hard_key, hard_names = resolve(table.columns, key, values)
    matched = {s: h for h, s in match_columns(names, hard_names).items()}
    rows = with_row_id(table).select("row_id", F.col(f"`{hard_key}`").alias("text"), *(F.col(f"`{h}`").try_cast("double").alias(f"h_{h}") for h in hard_names))
    features.featurized(rows, "text", width).where(F.size("pairs") > 0).write.mode("overwrite").parquet(f"{folder}/hard")
    kept = spark.read.parquet(f"{folder}/hard")
    n, n_kept = rows.count(), kept.count()
    for s, h in matched.items():
        found = labels.detect_task(kept, f"h_{h}")
        if task == "binary" and found != "binary":
            raise ValueError(f"{h}: labels other than 0 and 1, though the task is binary")
        if "regression" in (task, found):
            raise NotImplementedError(f"{h}: only binary labels can be learned")
        if not labels.class_balance(kept, [f"h_{h}"]).first()["enough"]:
            raise ValueError(f"{h}: too few rows or classes for {s}")
    return matched, {"path": path, "n_rows": n, "n_dropped": n - n_kept, "task": "binary", "featurizer": {"kind": features.KIND, "width": width}}


def prepare(spark: SparkSession, folder: str, library_path: str, soft_path: str, hard_path: str | None = None, *, values=None, hard_values=None, key=None, hard_key=None, task: str = "auto", val_frac: float = 0.1, max_samples: int | None = None, width: int = features.WIDTH) -> Run:
    """Align the teacher's table with the library, split each column, prepare measured labels, and write all of it.

    key, values: columns of the teacher's table; hard_key, hard_values: of the measured one (both by convention where not given).
    """
    if exists(spark, f"{folder}/manifest"):
        raise FileExistsError(f"{folder} is already prepared")
    whole = read_library(spark, library_path)
    soft = read_labels(spark, soft_path, key, values)
    names = [c for c in soft.columns if c not in ("row_id", "key")]
    labels.assert_aligned(soft.select("row_id", F.col("key").alias("text")), whole.select("row_id", "text"), "row_id", "text")
    features.featurized(split.prefix(whole, "row_id", max_samples), "text", width).write.mode("overwrite").parquet(f"{folder}/library")
    soft.drop("key").write.mode("overwrite").parquet(f"{folder}/targets")
    soft = spark.read.parquet(f"{folder}/targets")
    matched, hard = _measured(spark, folder, names, hard_path, hard_key, hard_values, width, task) if hard_path else ({}, None)
    found = {p["name"]: p for p in labels.profile(soft, names).collect()}  # a row a column
    columns = []
    for k, name in enumerate(names):
        at = f"{folder}/splits/c{k}"
        split.stratified_split(soft, name, "row_id", val_frac, max_samples).select("row_id", "is_val").write.mode("overwrite").parquet(at)
        sizes = {r["is_val"]: r["n"] for r in spark.read.parquet(at).groupBy("is_val").agg(F.count("*").alias("n")).collect()}
        p = found[name]
        columns.append({"id": f"c{k}", "name": name, "n_finite": p["n_finite"], "n_train": sizes.get(False, 0), "n_val": sizes.get(True, 0), "value_range": [p["least"], p["largest"]], "hard": matched.get(name), "status": "prepared"})
    run = Run(spark, folder, {"schema": MANIFEST, "id": uuid.uuid4().hex, "library": {"path": library_path, "n_rows": whole.count(), "width": width}, "soft_labels": soft_path, "hard_labels": hard, "split": {"val_frac": val_frac, "limit": max_samples}, "columns": columns})
    run.save()
    return run


def _weighted(rows: DataFrame, mode: str = "auto") -> tuple[DataFrame, str | None, str]:
    """rows with a weight against imbalance, its name, and the strategy."""
    chosen = weights.strategy(rows, "y", mode)["strategy"]
    if chosen == "none":
        return rows, None, chosen
    return (weights.apply_bin_weights(rows, "y") if chosen == "bins" else _with_density(rows)), "weight", chosen


def tune_columns(run: Run, n: int = 10, rounds: int = 20, max_rows: int = 100_000, weighting: str = "auto", **settings) -> dict[str, dict]:
    """The best settings found for each column, and every trial; they are noted in the manifest and used by `learn_soft`."""
    for c in run.manifest["columns"]:
        rows, weight, _ = _weighted(run.rows(c), weighting)
        c["tuned"] = json_safe(tune.tune(rows, "y", run.manifest["library"]["width"], n, rounds, max_rows, weight=weight, **settings))
        run.save()
    return {c["name"]: c["tuned"] for c in run.manifest["columns"]}


def tuned_settings(run: Run, c: dict, given: dict) -> dict:
    """Settings of a column's trees: what is given goes before what was tuned for the column; other keys are dropped."""
    found = c.get("tuned") or {}
    return {k: v for k, v in found.items() if k in tune.TUNED} | given


def learn_soft(run: Run, rounds: int = 20, weighting: str = "auto", **settings) -> None:
    """A student per column, weighted against imbalance; its validation metrics are of the raw score."""
    for c in run.manifest["columns"]:
        rows, weight, chosen = _weighted(run.rows(c), weighting)
        used = tuned_settings(run, c, settings)
        fitted = student.fit_student(rows, "y", run.manifest["library"]["width"], "is_val", weight, rounds, **used)
        raw = fitted.raw(rows.where("is_val"), "p")
        c |= {"metrics": json_safe(metrics.regression_metrics(raw, "y", "p").first().asDict()), "best_iteration": fitted.best_iteration, "weighting": chosen, "settings": used}
        trained = {"run": run.manifest["id"], "n_train": c["n_train"], "n_val": c["n_val"]}
        Column(c["name"], fitted.model, fitted.isotonic, metrics=c["metrics"], trained=trained).save(run.spark, run.model(c))
        c["status"] = "trained"
        run.save()


def _with_density(rows: DataFrame) -> DataFrame:
    lo, hi = rows.agg(F.min("y"), F.max("y")).first()
    table = weights.density_weights(rows, "y").select(F.col("cell").alias("_cell"), "weight")
    cell = F.greatest(F.lit(0), F.least(F.lit(weights.GRID - 1), F.floor((F.col("y") - F.lit(lo)) / F.lit(max((hi - lo) / weights.GRID, 1e-300))).cast("int")))
    return rows.withColumn("_cell", cell).join(F.broadcast(table), "_cell").drop("_cell")


def learn_hard(run: Run, rounds: int = 20, epochs: int = 15, **settings) -> None:
    """A head on measured labels for each column that has them, its map to the teacher's scale, a gate and the earned share.

    Students are read from the run folder, so that this stage can start on its own.
    """
    spark, wanted = run.spark, [c for c in run.manifest["columns"] if c["hard"]]
    if not wanted:
        raise ValueError("the run has no measured labels")
    if any(c["status"] == "prepared" for c in wanted):
        raise ValueError("the students come first: learn-soft")
    width = run.manifest["library"]["width"]
    for c in wanted:
        column, measured = _trained(run, c), run.measured(c)
        chosen = student.fit_head(measured, "label", width, rounds, **settings)
        column.head = chosen.model
        rows = run.rows(c).where(F.size("pairs") > 0)
        heads = student.head_score(column.head, rows.drop("y"), "g")
        scored = labels.align_scores(heads, rows.select("row_id", "y")).where(finite(F.col("g")) & finite(F.col("y"))).cache()
        column.head_map = student.fit_head_map(scored, "g", "y")
        mapped = scored.withColumn("p", column.head_map.apply(F.col("g")))
        fit = metrics.regression_metrics(mapped, "y", "p").first()
        near = similarity.nearest(*(x.select(F.col("row_id").alias("id"), features.bits(F.col("pairs")).alias("bits")) for x in (rows, measured))).cache()
        pairs = rows.select("row_id", F.col("pairs").alias("features"))
        sample = split.hold_out(pairs.join(near.withColumnRenamed("id", "row_id"), "row_id"), "row_id").cache()
        column.gate = fit_gate(sample, "sim", width, epochs=epochs)
        held = sample.where("is_val").select(F.col("sim").alias("y"), column.gate.predict(F.col("features")).alias("p"))
        quality = metrics.regression_metrics(held, "y", "p").first().asDict() | similarity.gate_quality(held, "y", "p").first().asDict()
        reached = similarity.reach(near).first().asDict()
        column.a_max = spark.range(1).select(blend_ceiling(F.lit(fit["r2"]).cast("double"), F.lit(reached["largest"]).cast("double")).alias("a")).first()["a"]
        balance = labels.class_balance(measured, ["label"]).first()
        column.trained |= {"n_measured": balance["n"], "n_positive": balance["positive"]}
        column.save(spark, run.model(c))
        explained, correlation = fit["r2"], fit["pearson"]
        shortfall = None if explained is None or correlation is None else correlation**2 - explained
        c |= {"a_max": column.a_max, "head": json_safe(chosen.report()), "head_r2": explained, "head_shortfall": shortfall, "gate": json_safe({k: quality[k] for k in ("r2", "rmse", "recall", "precision")}), "similarity": json_safe(reached), "status": "blended"}
        for x in (scored, near, sample):
            x.unpersist()
        run.save()


def _trained(run: Run, c: dict) -> Column:
    """The column's models as the run has them; a model of another run is refused."""
    found = Column.load(run.spark, run.model(c), c["name"])
    if found.trained.get("run") != run.manifest["id"]:
        raise ArtifactError(f"the model of {c['name']!r} was learned in another run; learn it again")
    return found


def export(run: Run, folder: str) -> Artifact:
    """Save the run's models as an artifact, load it again and compare both on library rows and measured rows."""
    spark, m = run.spark, run.manifest
    if any(c["status"] == "prepared" for c in m["columns"]):
        raise ValueError("some columns are not trained")
    if any(c["hard"] and c["status"] != "blended" for c in m["columns"]):
        raise ValueError("some columns have measured labels that are not learned")
    columns = [_trained(run, c) for c in m["columns"]]
    made = Artifact(columns, m["library"]["width"], library=m["library"], run_record={"id": m["id"], "split": m["split"], "soft_labels": m["soft_labels"], "hard_labels": m["hard_labels"]})
    made.save(spark, folder)
    loaded = Artifact.load(spark, folder)
    probe = read_library(spark, m["library"]["path"], PROBES).select("row_id", F.col("text").alias("key"))
    if m["hard_labels"]:
        measured = spark.read.parquet(f"{run.folder}/hard").orderBy("row_id").limit(PROBES)
        probe = probe.unionByName(measured.select((-1 - F.col("row_id")).alias("row_id"), F.col("text").alias("key")))
    check_export(made, loaded, probe)
    m["exported"] = folder
    run.save()
    return loaded


def fit(spark: SparkSession, folder: str, library: str, soft: str, hard: str | None, out: str, rounds: int = 20, tuning: int = 0, **options) -> Artifact:
    """prepare, tune if asked for, learn_soft, learn_hard where there are measured labels, export; the run folder goes at the end.

    A folder that is prepared already goes on where it was left.
    """
    run = Run.open(spark, folder) if exists(spark, f"{folder}/manifest") else prepare(spark, folder, library, soft, hard, **options)
    if tuning and not all("tuned" in c for c in run.manifest["columns"]):
        tune_columns(run, tuning, rounds)
    if any(c["status"] == "prepared" for c in run.manifest["columns"]):
        learn_soft(run, rounds)
    if any(c["hard"] and c["status"] != "blended" for c in run.manifest["columns"]):
        learn_hard(run, rounds)
    made = export(run, out)
    clean(run)
    return made


def clean(run: Run) -> int:
    """Delete the run folder; returns the bytes freed."""
    return delete(run.spark, run.folder)


def predict(spark: SparkSession, artifact: Artifact, path: str, out: str, key: str | None = None) -> DataFrame:
    rows = artifact.transform(read_queries(spark, path, key)).cache()
    warn_unparsed(rows, artifact.columns[0].name)
    write_predictions(rows, out)
    return rows


def _notes(artifact: Artifact, kind: str, task: str, n: int) -> list[str]:
    """What a table's size says: no rows, as many as a head was learned from, or another number, some of which it may know."""
    learned = artifact.column(task).trained.get("n_measured")
    if not n:
        return [f"{kind}: {task} has no rows with a value and a prediction, skipped"]
    if kind != "hard" or not learned:
        return []
    if n == learned:
        return [f"{task}: as many rows as the head was learned from ({n}); if they are the same, this is fit, not generalisation"]
    return [f"{task}: the head was learned from {learned} rows; those of them that are here are scored in-sample"]


def _internals(spark: SparkSession, artifact: Artifact) -> dict:
    """Of each task: trees, nodes and depth of its heads, the presets and losses of its fits, and the ends of its maps."""
    out = {}
    for c in artifact.columns:
        models = {"student": (c.student, c.isotonic)} | ({"hard": (c.head, c.head_map)} if c.has_hard else {})
        out[c.name] = {
            head: {"trees": len(m.trees), "nodes": sum(t.numNodes for t in m.trees), "depth": max((t.depth for t in m.trees), default=0), "losses": m.losses, "settings": m.settings, "anchors": len(f.x), "map": [f.points()[0], f.points()[-1]]}
            for head, (m, f) in models.items()
        } | {"a_max": c.a_max}
    return out


def validate(spark: SparkSession, artifact: Artifact, soft: str | None = None, hard: str | None = None, library: str | None = None, *, soft_key=None, soft_values=None, hard_key=None, hard_values=None) -> dict:
    """Metrics per task against held-out tables, with notes on what they mean; without tables, the model's own figures.

    *_key, *_values: columns of the tables, by convention where not given.
    """
    report: dict = {"model": artifact.describe(), "soft": {}, "hard": {}, "n_unparseable": {}, "notes": [], "data": {}, "internals": _internals(spark, artifact)}
    if not soft and not hard:
        report["notes"].append("no labels are given: the model's internals only")
    for kind, path, key, values in (("soft", soft, soft_key, soft_values), ("hard", hard, hard_key, hard_values)):
        if not path:
            continue
        rows = read_labels(spark, path, key, values)
        found, ignored = match_tasks([c for c in rows.columns if c not in ("row_id", "key")], artifact.tasks)
        if not found:
            raise ValueError(f"{path}: no column for the tasks {artifact.tasks}")
        if ignored:
            report["notes"].append(f"{kind}: columns {ignored} fit no task")
        renamed = rows.select("row_id", *(F.col(f"`{c}`").cast("double").alias(f"y_{t}") for c, t in found.items()))
        scored = artifact.transform(rows.select("row_id", "key")).join(renamed, "row_id").cache()
        if library:
            share = labels.library_overlap(rows.select(F.col("key").alias("text")), read_library(spark, library).select("text"), "text").first()["share"]
            if (share or 0) > 0.5:
                report["notes"].append(f"{kind}: {share:.0%} of the rows are in the library; this is fit, not generalisation")
        for t in found.values():
            y, p = F.col(f"`y_{t}`"), F.col(f"`{t}`")
            pair = scored.where(finite(y) & finite(p)).select("row_id", y.alias("y"), p.alias("p"))
            counted = pair.agg(F.count("*").alias("n"), F.min("y").alias("least"), F.max("y").alias("largest"), F.avg("y").alias("mean")).first()
            report["data"][f"{kind} {t}"] = {"file": path, **counted.asDict()}
            report["notes"] += _notes(artifact, kind, t, counted["n"])
            if not counted["n"]:
                continue
            if kind == "soft":
                report["soft"][t] = metrics.regression_metrics(pair, "y", "p").first().asDict()
            elif labels.detect_task(pair, "y") != "binary":
                report["notes"].append(f"{t}: labels other than 0 and 1, skipped")
            else:
                report["hard"][t] = metrics.binary_metrics(pair, "y", "p", "row_id").first().asDict()
            report["n_unparseable"][t] = scored.where(F.isnan(p)).count()
        scored.unpersist()
    return json_safe(report)
