"""Ranks and rank correlation beside plain versions, with ties, nulls and groups that don't vary."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cistron.operators import validate


def table(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(rng.integers(0, 9)) if g != "same" else 1.0, float(rng.integers(0, 3))) for i, g in enumerate(rng.choice(["a", "b", "same"], n))]
    rows += [(None, n + k, float(k % 4), float(k % 5)) for k in range(40)] + [("a", 1000, None, 1.0), ("a", 1001, 1.0, None), ("few", 1002, 1.0, 1.0)]
    return spark.createDataFrame(rows, "g string, id long, x double, y double").repartition(5), pd.DataFrame(rows, columns=["g", "id", "x", "y"]).dropna(subset=["x", "y"])


def test_average_ranks(spark):
    df, plain = table(spark)
    got = {(r.g, r.x): r["rank"] for r in validate.average_ranks(df.where("y is not null"), "g", "x").collect()}
    plain["rank"] = plain.groupby("g", dropna=False)["x"].rank()
    assert got == {(None if pd.isna(g) else g, x): r for g, x, r in plain[["g", "x", "rank"]].itertuples(index=False)}


def test_rank_correlation(spark):
    df, plain = table(spark)
    got = {r.g: r for r in validate.rank_correlation(df, "g", "id", "x", "y").collect()}
    for g, part in plain.groupby("g", dropna=False):
        r = got.pop(None if pd.isna(g) else g)
        assert r.n == len(part)
        if g in ("same", "few"):
            assert r.spearman is None and r.low is None and r.high is None
        else:
            assert r.spearman == pytest.approx(part["x"].rank().corr(part["y"].rank())) and r.low < r.spearman < r.high
    assert not got
    assert validate.rank_correlation(df.limit(0), "g", "id", "x", "y").collect() == []


def test_poisson_draws(spark):
    """Mean and variance of how often a row counts are about 1."""
    n = spark.range(20000).select(validate._poisson(F.col("id"), F.lit(7)).alias("n"))
    mean, var, most = n.agg(F.avg("n"), F.var_pop("n"), F.max("n")).first()
    assert mean == pytest.approx(1, abs=0.03) and var == pytest.approx(1, abs=0.05) and most <= validate.MOST
