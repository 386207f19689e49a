"""Grouped statistics in pandas: one block of tests, cluster or pair at a time, never the whole table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.functions import statistics as stats


def token_clusters(names: DataFrame, cut: float = 0.60) -> DataFrame:
    """names(block, test, tokens array) -> block, test, cluster: average linkage on the Jaccard distance of token sets within a block.

    A block whose tests have no tokens at all is one cluster; otherwise two tests without tokens are as far apart as can be.
    Distances come from products of the incidence matrix. Memory grows with the square of a block, which is a digit group of tests.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("test", kind="stable", ignore_index=True)
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part["tokens"]])
        if not len(owner):
            return pd.DataFrame({"block": part["block"], "test": part["test"], "cluster": 0})
        _, token = np.unique(np.concatenate([np.asarray(x, object) for x in part["tokens"]]), return_inverse=True)
        held = np.zeros((len(part), token.max() + 1), np.float32)
        held[owner, token] = 1
        both, sizes = held @ held.T, held.sum(axis=1)
        either = sizes[:, None] + sizes[None, :] - both
        d = 1 - np.divide(both, either, out=np.zeros_like(both), where=either > 0)
        return pd.DataFrame({"block": part["block"], "test": part["test"], "cluster": stats.average_linkage(d.astype(float), cut)})

    return names.groupBy("block").applyInPandas(run, "block string, test string, cluster long")


def cohesion(cells: DataFrame) -> DataFrame:
    """cells(cluster, report, test, margin) -> cluster, cohesion: mean absolute correlation of its tests over complete reports."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="report", columns="test", values="margin", aggfunc="mean").to_numpy(float)
        return pd.DataFrame({"cluster": [part["cluster"].iloc[0]], "cohesion": [stats.mean_abs_correlation(wide)]})

    return cells.groupBy("cluster").applyInPandas(run, "cluster long, cohesion double").withColumn("cohesion", F.nanvl("cohesion", F.lit(None)))


def explained(cells: DataFrame) -> DataFrame:
    """cells(cluster, report, test, margin) -> cluster, test, r2: how well a test is predicted by its cluster."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="report", columns="test", values="margin", aggfunc="mean")
        x = wide.to_numpy(float)
        r2 = [stats.predict_r2(x, i) if x.shape[1] > 1 else np.nan for i in range(x.shape[1])]
        return pd.DataFrame({"cluster": part["cluster"].iloc[0], "test": wide.columns, "r2": r2})

    return cells.groupBy("cluster").applyInPandas(run, "cluster long, test string, r2 double").withColumn("r2", F.nanvl("r2", F.lit(None)))


def tail_risk(margins: DataFrame) -> DataFrame:
    """margins(dut, test, margin) -> dut, test, risk: the greatest of the normal, empirical and tail estimates of a negative margin."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = part["margin"].to_numpy(float)
        m = m[~np.isnan(m)]
        sd = m.std(ddof=1) if len(m) > 1 else 0.0
        normal = stats.normal_below(-m.mean() / sd) if sd > 0 else 0.0
        tail = stats.tail_probability(m)
        return pd.DataFrame({"dut": [part["dut"].iloc[0]], "test": [part["test"].iloc[0]], "risk": [max(normal, float((m < 0).mean()) if len(m) else 0.0, 0.0 if np.isnan(tail) else tail)]})

    return margins.groupBy("dut", "test").applyInPandas(run, "dut string, test string, risk double")


def cycle_reports(rows: DataFrame) -> DataFrame:
    """rows(dut, test, seq) -> with report_no: within a dut a new report opens when a test repeats in the open one."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", kind="stable")
        number, seen, out = 1, set(), []
        for test in part["test"]:
            if test in seen:
                number, seen = number + 1, set()
            seen.add(test)
            out.append(number)
        return part.assign(report_no=out)[["dut", "test", "seq", "report_no"]]

    kinds = dict(rows.dtypes)
    return rows.select("dut", "test", "seq").groupBy("dut").applyInPandas(run, f"dut {kinds['dut']}, test {kinds['test']}, seq {kinds['seq']}, report_no long")
