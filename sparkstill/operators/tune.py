"""Hyper-parameter search of the student: Parzen estimators that propose, rungs that stop.

Trials run WIDTH at a time, in passes that they share. After two fixed starts and a few random
trials, settings are drawn around the better finished trials and judged by the ratio of two
densities over both settings: of the better quarter and of the others (both Gaussian kernels and a
uniform one). At each rung, a share of the rounds, a trial goes on only if its loss is in the better half
of all that came to this rung. Draws depend on the seed and on losses alone.
"""

from __future__ import annotations

import math
import random
import time

from pyspark.sql import DataFrame

from . import boost
from .boost import Boosting
from .split import proportional_sample
from .student import leaf_rows, patience

#: Fixed ranges of the search; the rate is searched on a log scale.
RANGES = {"learning_rate": (0.05, 0.3), "min_split_gain": (0.0, 5.0)}
#: Settings that a search may give.
TUNED = tuple(RANGES)
STARTS = ({"learning_rate": 0.1, "min_split_gain": 0.0}, {"learning_rate": 0.3, "min_split_gain": 0.0})
#: Trials at a time, finished trials from which on densities propose, share of better ones, draws for a proposal, and shares of the rounds at the rungs.
WIDTH, RANDOM, BETTER, DRAWS, RUNGS = 4, 4, 0.25, 24, (0.25, 0.5)


def _unit(s: dict) -> tuple[float, ...]:
    """Settings as numbers from 0 to 1."""
    (a, b), (c, d) = RANGES["learning_rate"], RANGES["min_split_gain"]
    return (math.log(s["learning_rate"] / a) / math.log(b / a), (s["min_split_gain"] - c) / (d - c))


def _settings(u: tuple[float, ...]) -> dict:
    (a, b), (c, d) = RANGES["learning_rate"], RANGES["min_split_gain"]
    return {"learning_rate": a * (b / a) ** u[0], "min_split_gain": c + (d - c) * u[1]}


def _density(points: list, u: tuple, spread: float) -> float:
    """A uniform density and one Gaussian for each point, of equal shares."""
    kernel = lambda p: math.prod(math.exp(-0.5 * ((x - y) / spread) ** 2) / (spread * math.sqrt(2 * math.pi)) for x, y in zip(p, u, strict=True))
    return (1.0 + sum(map(kernel, points))) / (1 + len(points))


def propose(finished: list[tuple[dict, float]], n: int, r: random.Random) -> list[dict]:
    """n settings to try next, out of finished trials (settings, loss)."""
    out: list[dict] = []
    ranked = [_unit(s) for s, _ in sorted(finished, key=lambda x: x[1])]
    good = ranked[: max(1, math.ceil(BETTER * len(ranked)))]
    others = ranked[len(good) :]
    for _ in range(n):
        if len(finished) < RANDOM:
            out.append(_settings((r.random(), r.random())))
            continue
        spread = max(0.05, 0.5 * len(ranked) ** (-1 / 6))
        drawn = []
        for _ in range(DRAWS):
            k = r.randrange(len(good) + 1)
            near = good[k] if k < len(good) else None
            drawn.append(tuple(min(1.0, max(0.0, r.gauss(x, spread))) for x in near) if near else (r.random(), r.random()))
        best = max(drawn, key=lambda u: _density(good, u, spread) / _density(others, u, spread))
        others = [*others, best]  # the next one of this turn keeps away from it
        out.append(_settings(best))
    return out


def halved(losses: dict[int, float], before: list[float]) -> list[int]:
    """The trials of this turn that go on: those in the better half of all that have come to the rung."""
    every = sorted([*before, *losses.values()])
    most = every[(len(every) - 1) // 2]
    return [k for k, x in losses.items() if x <= most]


def search(fits: Boosting, n: int, rounds: int, stop_after: int = 12, seconds: float = 900.0, seed: int = 42, fixed: dict | None = None, proposals=propose, rungs=RUNGS) -> dict:
    """The study of n trials over given blocks: the best settings, every trial, and how many trees were grown."""
    r, fixed = random.Random(seed), fixed or {}
    trials: list[dict] = []
    finished: list[tuple[dict, float]] = []
    at_rung: dict[int, list[float]] = {}
    best, waited, grown, began = None, 0, 0, time.monotonic()
    queue = [dict(s) for s in STARTS][:n]
    while len(trials) < n and waited < stop_after and time.monotonic() - began <= seconds:
        turn = queue[:WIDTH]
        queue = queue[WIDTH:]
        turn += proposals(finished, min(WIDTH, n - len(trials)) - len(turn), r)
        fits.start([fixed | s for s in turn])
        marks = {max(1, round(q * rounds)) for q in rungs}
        for done in range(rounds):
            if done in marks:
                losses = fits.losses_now()
                stay = halved(losses, at_rung.get(done, []))
                at_rung.setdefault(done, []).extend(losses.values())
                for k in losses:
                    if k not in stay:
                        fits.stop(k)
                        fits.fits[k]["pruned"] = done
            grown += len(fits.active)
            fits.grow()
            for k in fits.active:
                losses_k = fits.fits[k]["losses"]
                if len(losses_k) - 1 - boost.best_round(losses_k) >= patience(rounds):
                    fits.stop(k)
            if not fits.active:
                break
        fits.measure()
        for k, s in enumerate(turn):
            f = fits.fits[k]
            at = boost.best_round(f["losses"])
            trial = {**{c: round(v, 6) for c, v in s.items()}, "loss": f["losses"][at], "rounds": at, "pruned": f.get("pruned")}
            trials.append(trial)
            if trial["pruned"] is None:
                finished.append((s, trial["loss"]))
            if trial["pruned"] is None and (best is None or trial["loss"] < best["loss"] - 1e-12):
                best, waited = trial, 0
            else:
                waited += 1
    return {"best": best, "trials": trials, "trees": grown}


def tune(df: DataFrame, y: str, width: int, n: int = 10, rounds: int = 20, most_rows: int = 100_000, seconds: float = 900.0, stop_after: int = 12, weight: str | None = None, seed: int = 42, **settings) -> dict:
    """The best settings on a sample that keeps the share of validation rows exactly, with `rmse`, and the study's trials.

    The least weight of a leaf is that of a table of the sample's size.
    """
    rows = proportional_sample(df, "is_val", "row_id", most_rows)
    fits = Boosting(rows, y, width, [settings], weight=weight)
    try:
        fixed = {"min_child_weight": leaf_rows(fits.n_train)} | settings
        study = search(fits, n, rounds, stop_after, seconds, seed, fixed)
    finally:
        fits.close()
    best = study["best"]
    if best is None:
        return {"trials": study["trials"], "trees": study["trees"]}
    return {k: best[k] for k in TUNED} | {"rmse": math.sqrt(best["loss"]) if best["loss"] >= 0 else None, "rounds": best["rounds"], "trials": study["trials"], "trees": study["trees"]}
