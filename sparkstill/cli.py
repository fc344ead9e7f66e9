"""Command line: each stage on its own, all of them as fit, and predict, validate, library and export-library."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.features import WIDTH
from .functions.schema import parse_columns


def _selectors(c: argparse.ArgumentParser) -> None:
    """Columns of both tables, where they do not follow the convention."""
    for kind in ("soft", "hard"):
        c.add_argument(f"--{kind}-key-column")
        c.add_argument(f"--{kind}-label-columns", help="comma-separated")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkstill")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *needed: str):
        c = sub.add_parser(name, help=text)
        for x in needed:
            c.add_argument(x, required=True)
        return c

    for name, text, needed in (
        ("prepare", "align, split and write a run folder", ("--library", "--soft-labels", "--run-dir")),
        ("fit", "all stages, from a teacher's table and, perhaps, measured labels, to a model", ("--library", "--soft-labels", "--run-dir", "--model")),
    ):
        c = command(name, text, *needed)
        c.add_argument("--hard-labels")
        c.add_argument("--task", choices=("auto", "binary", "regression"), default="auto", help="kind of the hard labels")
        _selectors(c)
        c.add_argument("--max-samples", type=int)
        c.add_argument("--val-frac", type=float, default=0.1)
        c.add_argument("--width", type=int, default=WIDTH)
        if name == "fit":
            c.add_argument("--rounds", type=int, default=20)
            c.add_argument("--tune", type=int, default=0, help="settings to try for each column")
    tune = command("tune", "find settings for each column of a run", "--run-dir")
    tune.add_argument("--trials", type=int, default=10)
    tune.add_argument("--rounds", type=int, default=20)
    tune.add_argument("--max-rows", type=int, default=100_000, help="rows of the study's sample")
    tune.add_argument("--time-budget", type=float, default=900.0, help="seconds for each column")
    soft = command("learn-soft", "learn the students of a run", "--run-dir")
    soft.add_argument("--rounds", type=int, default=20)
    soft.add_argument("--weighting", default="auto")
    hard = command("learn-hard", "learn heads and gates of a run", "--run-dir")
    hard.add_argument("--rounds", type=int, default=20)
    hard.add_argument("--epochs", type=int, default=15)
    command("export", "write a run's models as one model", "--run-dir", "--model")
    command("clean", "delete a run folder", "--run-dir")
    predict = command("predict", "score a table", "--model", "--input", "--output")
    predict.add_argument("--key-column")
    check = command("validate", "metrics against held-out tables", "--model", "--output")
    for name in ("--soft-labels", "--hard-labels", "--library"):
        check.add_argument(name)
    _selectors(check)
    build = command("library", "build a library from a table of texts", "--input", "--output")
    build.add_argument("--key-column")
    build.add_argument("--distinct", action="store_true")
    build.add_argument("--limit", type=int)
    build.add_argument("--fingerprints", action="store_true", help="with fingerprints, block by block; a build that was cut off goes on")
    build.add_argument("--width", type=int, default=WIDTH)
    build.add_argument("--block-rows", type=int, default=1_000_000)
    dump = command("export-library", "write the library's texts in its order", "--library", "--output")
    dump.add_argument("--header", default="text")
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)

    from .plans import workflow
    from .plans.artifact import Artifact
    from .sources import library, tables
    from .sources.reports import write_report

    spark = SparkSession.builder.appName("sparkstill").getOrCreate()
    if a.command in ("prepare", "fit"):
        options = dict(values=parse_columns(a.soft_label_columns), hard_values=parse_columns(a.hard_label_columns), key=a.soft_key_column, hard_key=a.hard_key_column, task=a.task, max_samples=a.max_samples, val_frac=a.val_frac, width=a.width)
        if a.command == "prepare":
            workflow.prepare(spark, a.run_dir, a.library, a.soft_labels, a.hard_labels, **options)
        else:
            workflow.fit(spark, a.run_dir, a.library, a.soft_labels, a.hard_labels, a.model, a.rounds, a.tune, **options)
    elif a.command in ("tune", "learn-soft", "learn-hard", "export", "clean"):
        run = workflow.Run.open(spark, a.run_dir)
        if a.command == "tune":
            workflow.tune_columns(run, a.trials, a.rounds, a.max_rows, seconds=a.time_budget)
        elif a.command == "learn-soft":
            workflow.learn_soft(run, a.rounds, a.weighting)
        elif a.command == "learn-hard":
            workflow.learn_hard(run, a.rounds, a.epochs)
        elif a.command == "export":
            workflow.export(run, a.model)
        else:
            print(f"{workflow.clean(run)} bytes freed")
    elif a.command == "predict":
        workflow.predict(spark, Artifact.load(spark, a.model), a.input, a.output, a.key_column)
    elif a.command == "validate":
        columns = dict(soft_key=a.soft_key_column, soft_values=parse_columns(a.soft_label_columns), hard_key=a.hard_key_column, hard_values=parse_columns(a.hard_label_columns))
        write_report(spark, workflow.validate(spark, Artifact.load(spark, a.model), a.soft_labels, a.hard_labels, a.library, **columns), a.output)
    elif a.command == "library":
        if a.fingerprints:
            library.build(spark, a.input, a.output, a.key_column, a.distinct, a.limit, a.width, a.block_rows)
        else:
            tables.build_library(spark, a.input, a.output, a.key_column, a.distinct, a.limit)
    else:
        tables.export_library(spark, a.library, a.output, a.header)


if __name__ == "__main__":
    main()
