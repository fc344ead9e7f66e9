"""Writers of validation results: strict JSON, a flat table, and a plain page of what was measured, on what, by which model."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import json_safe, save_json

#: Fixed column names of the table.
FIRST = ["task", "labels", "n"]
METRICS = ["mae", "rmse", "r2", "pearson", "spearman", "top_decile_rmse", "n_positive", "hit_rate", "auroc", "average_precision"]


def performance(spark: SparkSession, report: dict) -> DataFrame:
    """One row per kind of label and task; metrics that a kind lacks are null, further ones follow by name."""
    parts = []
    for kind in ("soft", "hard"):
        for task, found in json_safe(report.get(kind, {})).items():
            values = {"task": task, "labels": kind, "n": found.get("n"), **{k: None if v is None else float(v) for k, v in found.items() if k != "n"}}
            types = {"task": "string", "labels": "string", "n": "long"}
            parts.append(spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {types.get(k, 'double')}" for k in values)))
    if not parts:
        return spark.createDataFrame([], "task string, labels string, n long")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    known = [c for c in METRICS if c in every.columns]
    return every.select(*(F.col(f"`{c}`") for c in [*FIRST, *known, *sorted(set(every.columns) - {*FIRST, *known})]))


def _cell(v) -> str:
    if isinstance(v, (dict, list, tuple)):
        return "<br>".join(f"{html.escape(str(k))}: {_cell(x)}" for k, x in v.items()) if isinstance(v, dict) else ", ".join(map(_cell, v))
    return "—" if v is None else f"{v:.4g}" if isinstance(v, float) else html.escape(str(v))


def _table(names: list[str], rows: list[list]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in names)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def _section(title: str, body: str) -> str:
    return f"<section><h2>{html.escape(title)}</h2>{body}</section>" if body else ""


def _pairs(found: dict) -> str:
    return _table(["what", "value"], [[k, v] for k, v in found.items()]) if found else ""


def page(report: dict, rows: list[dict]) -> str:
    """Notes, configuration, data, how well the teacher is met, ranking of the measured labels, and the model's internals."""
    model, internals = report.get("model", {}), report.get("internals", {})

    def metrics(kind: str) -> str:
        own = [r for r in rows if r["labels"] == kind]
        names = [c for c in (own[0] if own else {}) if any(r[c] is not None for r in own) and c != "labels"]
        return _table(names, [[r[c] for c in names] for r in own]) if own else ""

    configuration = {k: model.get(k) for k in ("schema", "trained_at", "featurizer", "versions", "library", "run") if model.get(k)}
    columns = [[c.get("name"), ", ".join(c.get("heads", [])), c.get("a_max"), c.get("trained"), c.get("metrics")] for c in model.get("columns", [])]
    data = report.get("data", {})
    heads = [[task, head, f["trees"], f["nodes"], f["depth"], f["anchors"], f["map"], f["losses"][-1] if f["losses"] else None] for task, own in internals.items() for head, f in own.items() if isinstance(f, dict)]
    parts = [
        _section("Configuration", _pairs(configuration)),
        _section("Tasks", _table(["task", "heads", "largest share", "learned from", "at learning"], columns) if columns else ""),
        _section("Data", _table(["table", "file", "rows", "least", "largest", "mean", "without a prediction"], [[k, *(d.get(c) for c in ("file", "n", "least", "largest", "mean")), report.get("n_unparseable", {}).get(k.split(" ", 1)[-1])] for k, d in data.items()]) if data else ""),
        _section("Teacher: soft labels", metrics("soft")),
        _section("Ranking: hard labels", metrics("hard")),
        _section("Internals", _table(["task", "head", "trees", "nodes", "depth", "anchors", "map from and to", "last validation loss"], heads) if heads else ""),
    ]
    notes = "".join(f"<li>{html.escape(x)}</li>" for x in report.get("notes", []))
    return f"<!doctype html><meta charset=utf-8><title>Validation</title><h1>Validation</h1><ul>{notes}</ul>{''.join(parts)}"


def write_report(spark: SparkSession, report: dict, folder: str) -> None:
    """metrics.json, performance_table.csv and report.html, each a table of one file wherever Spark writes."""
    save_json(spark, f"{folder}/metrics.json", report)
    table = performance(spark, report)
    table.coalesce(1).write.mode("overwrite").csv(f"{folder}/performance_table.csv", header=True)
    text = page(json_safe(report), [r.asDict() for r in table.collect()])  # a row a task
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.html")
