"""Exact binomial tails as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convseries.functions.prng import let


def binom_sf(k: Column, n: Column, p: Column | float) -> Column:
    """P(X >= k) for X binomial(n, p), 0 < p < 1: a sum of terms, each from the one before by its ratio, in logarithms."""
    p = F.lit(float(p)) if isinstance(p, (int, float)) else p.cast("double")

    def tail(v: Column) -> Column:
        n_, p_, k_ = v["n"], v["p"], v["k"]
        start = F.struct(F.lit(0.0).alias("total"), (n_ * F.log1p(-p_)).alias("term"))
        odds = F.log(p_) - F.log1p(-p_)

        def step(acc: Column, i: Column) -> Column:
            term = F.when(i == 0, acc["term"]).otherwise(acc["term"] + F.log((n_ - i + 1).cast("double") / F.greatest(i, F.lit(1)).cast("double")) + odds)
            return F.struct((acc["total"] + F.when(i >= k_, F.exp(term)).otherwise(0.0)).alias("total"), term.alias("term"))

        return F.aggregate(F.sequence(F.lit(0).cast("long"), n_), start, step, lambda acc: F.least(F.lit(1.0), acc["total"]))

    args = F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), p.alias("p"))
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(let(args, tail))


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test without ties; 1 for no pairs."""
    n = wins + losses
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binom_sf(F.greatest(wins, losses), n, 0.5)))
