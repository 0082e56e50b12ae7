"""Runs the stages that lead from raw tables to the report: python -m growthlens.plans.run STAGE --data DIR --out DIR [--force].

A stage is made from the tables of the stages before it, once: what is there already is
read, unless --force says to make the asked stage anew.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from growthlens.operators import hierarchical as H
from growthlens.plans import aggregates, curves, history, models
from growthlens.plans.base import Tables
from growthlens.sources import files


def _history(t: Tables, read: Callable[[str], DataFrame]) -> DataFrame:
    return history.active_history_daily(t)


def _fits(t: Tables, read: Callable[[str], DataFrame]) -> DataFrame:
    return curves.fitted_choice(t)


def _shares(t: Tables, read: Callable[[str], DataFrame]) -> DataFrame:
    return aggregates.sample_shares(t).join(aggregates.bootstrapped_shares(t), "iso", "left")


def _draws(t: Tables, read: Callable[[str], DataFrame]) -> DataFrame:
    return models.sampled_model(t)


def _coefficients(t: Tables, read: Callable[[str], DataFrame]) -> DataFrame:
    return H.coefficient_table(read("draws"))


def _cells(t: Tables, read: Callable[[str], DataFrame]) -> DataFrame:
    return H.score_cells(models.cells(t), read("draws"))


def _units(t: Tables, read: Callable[[str], DataFrame]) -> DataFrame:
    return H.roll_up(read("cells"), "id0")


def _report(t: Tables, read: Callable[[str], DataFrame]) -> DataFrame:
    """Units with what the sample and the model say of them, and the fits, side by side."""
    fits = read("fits").select("grp", "curve", "asymptote", "share_fit")
    sample = read("shares").selectExpr("cast(iso as string) as grp", "share", "p5 as sample_p5", "p95 as sample_p95")
    model = read("units").selectExpr("cast(id0 as string) as grp", "share_mean as model_share", "share_p5 as model_p5", "share_p95 as model_p95")
    return fits.join(sample, "grp", "full").join(model, "grp", "full")


#: By name: the stages that must be there, in the order in which they are made, and the work.
STAGES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "history": ((), _history),
    "fits": (("history",), _fits),
    "shares": ((), _shares),
    "draws": ((), _draws),
    "coefficients": (("draws",), _coefficients),
    "cells": (("draws",), _cells),
    "units": (("draws", "cells"), _units),
    "report": (("history", "fits", "shares", "draws", "cells", "units"), _report),
}


def run(spark: SparkSession, data: str, out: str, stage: str, force: bool = False) -> list[str]:
    """Makes a stage and those it needs; returns the names of those that were made."""
    made: list[str] = []
    for name in (*STAGES[stage][0], stage):
        work = STAGES[name][1]

        def make(name: str = name, work: Callable = work) -> DataFrame:
            made.append(name)
            return work(Tables(spark, data), lambda s: spark.read.parquet(f"{out}/{s}"))

        files.made_once(spark, f"{out}/{name}", make, force=force and name == stage)
    return made


if __name__ == "__main__":
    from growthlens.session import build, ship

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=list(STAGES))
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args()
    print(run(ship(build()), args.data, args.out, args.stage, args.force))
