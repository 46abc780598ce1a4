"""Power laws fitted and tested as they should be: x_min by the KS distance, bootstrap goodness of fit, Vuong's test.

Frequencies of one stream or draw are a small group (a count for each distinct frequency), so each draw is fitted in a
task of its own; bootstrap replicates are rows too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMS, SUPPORT, TAIL = 10_000, 100_000, 50


def zeta(alpha: float, x_min: int, terms: int = TERMS) -> float:
    """Sum of k^-alpha from x_min over ``terms`` terms."""
    return float((np.arange(x_min, x_min + terms, dtype=np.float64) ** -alpha).sum())


def _alpha(x: np.ndarray, c: np.ndarray, x_min: int) -> float:
    return 1 + c.sum() / float((c * np.log(x / (x_min - 0.5))).sum())


def _ks(x: np.ndarray, c: np.ndarray, x_min: int, alpha: float) -> float:
    """Largest distance of the empirical and the fitted distribution at observed values."""
    norm = zeta(alpha, x_min)
    top = int(x.max())
    pmf = np.arange(x_min, min(top, x_min + TERMS - 1) + 1, dtype=np.float64) ** -alpha / norm
    model = np.minimum(np.cumsum(pmf), 1.0)
    fitted = model[np.minimum(x - x_min, len(model) - 1)]
    return float(np.abs(np.cumsum(c) / c.sum() - fitted).max())


def fit(values: np.ndarray, counts: np.ndarray, tail: int = TAIL) -> tuple[int, float, float, int] | None:
    """(x_min, alpha, ks, tail size) of the best of all values from 2 on; the first minimum wins.

    Candidates end where fewer than ``tail`` observations remain; None if the first already has too few.
    """
    order = np.argsort(values)
    x, c = values[order], counts[order]
    best = None
    for x_min in x[x >= 2].tolist():
        on = x >= x_min
        if c[on].sum() < tail:
            break
        alpha = _alpha(x[on], c[on], x_min)
        ks = _ks(x[on], c[on], x_min, alpha)
        if best is None or ks < best[2]:
            best = (int(x_min), float(alpha), ks, int(c[on].sum()))
    return best


def vuong(values: np.ndarray, counts: np.ndarray, x_min: int, alpha: float) -> tuple[float, float]:
    """Normalised log-likelihood ratio of power law over lognormal on the tail, and its two-sided p."""
    on = values >= x_min
    x, c = values[on].astype(np.float64), counts[on].astype(np.float64)
    n, logs = c.sum(), np.log(x)
    mu = (c * logs).sum() / n
    sigma = max(math.sqrt((c * (logs - mu) ** 2).sum() / n), 1e-9)
    survival = max(0.5 * math.erfc((math.log(x_min - 0.5) - mu) / (sigma * math.sqrt(2))), 1e-12)
    power = -alpha * logs - math.log(zeta(alpha, x_min))
    normal = -logs - math.log(sigma * math.sqrt(2 * math.pi)) - (logs - mu) ** 2 / (2 * sigma**2) - math.log(survival)
    d = power - normal
    mean = (c * d).sum() / n
    sd = math.sqrt(max((c * (d - mean) ** 2).sum() / n, 0.0))
    if sd == 0:
        return 0.0, 1.0
    ratio = mean * math.sqrt(n) / sd
    return ratio, math.erfc(abs(ratio) / math.sqrt(2))


def fits(frequencies: DataFrame, by: Sequence[str] = ("genre",)) -> DataFrame:
    """(…, x_min, alpha, ks, tail, vuong, vuong_p) for each group of (value, count) rows; nulls where nothing can be fitted."""
    types = {c: frequencies.schema[c].dataType.simpleString() for c in by}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")  # sums do not depend on the order of rows
        x, c = pdf["value"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64)
        found = fit(x, c)
        row = [None] * 6 if found is None else [found[0], found[1], found[2], found[3], *vuong(x, c, found[0], found[1])]
        return pd.DataFrame([[*(pdf[b].iloc[0] for b in by), *row]], columns=[*by, "x_min", "alpha", "ks", "tail", "vuong", "vuong_p"])

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", x_min long, alpha double, ks double, tail long, vuong double, vuong_p double"
    return frequencies.groupBy(*by).applyInPandas(lambda p: run(p), schema)


def frequency_counts(ranked: DataFrame, by: Sequence[str] = ("genre",)) -> DataFrame:
    """(…, value, count): how many tokens have each frequency."""
    return ranked.groupBy(*by, F.col("freq").alias("value")).agg(F.count("*").alias("count"))


def goodness(frequencies: DataFrame, reps: int, by: Sequence[str] = ("genre",), seed: int = 42) -> DataFrame:
    """(…, ks, reps, p): the share of synthetic tails that lie at least as far from their own fit; a p below 0.1 rules the law out.

    Each tail is drawn from the fitted law over values up to ``SUPPORT``, or ``TERMS`` of them where the tail starts close to that or above, as large as the observed one; x_min is kept and
    the exponent estimated anew. A large p means the law is not ruled out, not that it holds.
    """
    fitted = fits(frequencies, by).where("ks IS NOT NULL").select(*by, "x_min", "alpha", "ks", "tail")
    types = {c: frequencies.schema[c].dataType.simpleString() for c in by}
    drawn = fitted.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition("rep")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            farther = []
            for x_min, alpha, ks, tail, rep in batch[["x_min", "alpha", "ks", "tail", "rep"]].itertuples(index=False):
                support = np.arange(int(x_min), max(SUPPORT, int(x_min) + TERMS))
                weight = support.astype(np.float64) ** -alpha
                counts = np.random.default_rng([seed, int(rep)]).multinomial(int(tail), weight / weight.sum())
                on = counts > 0
                x, c = support[on], counts[on]
                again = _alpha(x, c, int(x_min))
                farther.append(bool(np.isfinite(again) and again > 1 and _ks(x, c, int(x_min), again) >= ks))
            yield batch[[*by, "ks"]].assign(farther=farther)

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", ks double, farther boolean"
    out = drawn.mapInPandas(run, schema)
    return out.groupBy(*by).agg(F.round(F.first("ks"), 6).alias("ks"), F.count("*").alias("reps"), F.round(F.avg(F.col("farther").cast("int")), 6).alias("p"))
