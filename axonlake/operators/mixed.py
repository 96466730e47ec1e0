"""Linear mixed models: value ~ x (+ group, x by group) with a random intercept, and a random slope, for every subject.

Rows are reduced natively twice. A subject's rows become sums of products of the columns (1, x, groups, x by groups, value). Subjects whose random
part has the same cross products (number of rows, sum of x, sum of its squares) then share one row: the sums over them of products of their
sums. The likelihood needs nothing else, so what reaches a fit is bounded by the distinct designs of subjects, not by subjects or rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import incomplete_beta


def nelder_mead(f, start: np.ndarray, step: float = 0.5, tolerance: float = 1e-10, most: int = 2000) -> tuple[float, np.ndarray]:
    """(least value, place) of f by the simplex method of reflection, expansion, contraction and shrinking."""
    simplex = [np.array(start, float)] + [np.array(start, float) + step * e for e in np.eye(len(start))]
    values = [f(x) for x in simplex]
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (1 + abs(values[0])) and max(np.abs(x - simplex[0]).max() for x in simplex) < 1e-7:
            break
        middle = np.mean(simplex[:-1], axis=0)
        away = middle - simplex[-1]
        at = middle + away
        got = f(at)
        if got < values[0]:
            far = middle + 2 * away
            further = f(far)
            simplex[-1], values[-1] = (far, further) if further < got else (at, got)
        elif got < values[-2]:
            simplex[-1], values[-1] = at, got
        else:
            near = middle + 0.5 * away if got < values[-1] else middle - 0.5 * away
            closer = f(near)
            if closer < min(got, values[-1]):
                simplex[-1], values[-1] = near, closer
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (x - simplex[0]) for x in simplex[1:]]
                values = [values[0]] + [f(x) for x in simplex[1:]]
    best = int(np.argmin(values))
    return values[best], simplex[best]


class Likelihood:
    """Profiled likelihood from sums: total (p+1 x p+1) of products of all columns, and per design its number of subjects, its cross products
    (q x q) and the sums over its subjects of the products of their sums ((q * (p+1)) squared)."""

    def __init__(self, total: np.ndarray, counts: np.ndarray, designs: np.ndarray, outer: np.ndarray, n: float, restricted: bool):
        self.total, self.counts, self.designs, self.n, self.restricted = total, counts, designs, n, restricted
        self.p, self.q = len(total) - 1, designs.shape[1]
        self.outer = outer.reshape(len(counts), self.q, self.p + 1, self.q, self.p + 1)
        self.rank = int(np.linalg.matrix_rank(total[: self.p, : self.p], tol=1e-9 * max(1.0, np.abs(total).max())))
        self.freedom = n - self.rank if restricted else n

    def relative(self, theta: np.ndarray) -> np.ndarray:
        """The random part's covariance relative to the residual variance, from its Cholesky factor (logarithms on the diagonal)."""
        low = np.zeros((self.q, self.q))
        low[np.diag_indices(self.q)] = np.exp(np.clip(theta[: self.q], -15, 15))
        low[np.tril_indices(self.q, -1)] = theta[self.q :]
        return low @ low.T

    def solve(self, theta: np.ndarray):
        """(-2 log likelihood, coefficients, their covariance, residual variance, relative covariance)."""
        g = self.relative(theta)
        inside = np.eye(self.q) + self.designs @ g
        shrink = g @ np.linalg.inv(inside)
        m = self.total - np.einsum("sjk,sjakb->ab", shrink, self.outer)
        a, b = m[: self.p, : self.p], m[: self.p, self.p]
        inverse = np.linalg.pinv(a, rcond=1e-10, hermitian=True)
        beta = inverse @ b
        rss = max(float(m[self.p, self.p] - b @ beta), 1e-300)
        variance = rss / self.freedom
        loss = self.freedom * (math.log(2 * math.pi * variance) + 1) + float((self.counts * np.linalg.slogdet(inside)[1]).sum())
        if self.restricted:
            eigen = np.linalg.eigvalsh(a)
            loss += float(np.log(eigen[eigen > 1e-10 * eigen.max()]).sum())
        return loss, beta, inverse * variance, variance, g

    def fit(self):
        starts = [[s] + ([t, 0.0] if self.q == 2 else []) for s in (-2.0, 0.5) for t in ((-2.0, 0.5) if self.q == 2 else (0.0,))]
        theta = min((nelder_mead(lambda t: self.solve(t)[0], np.array(s)) for s in starts), key=lambda r: r[0])[1]
        return self.solve(theta)


def mixed_effects(rows: DataFrame, keys: list[str], subject: str = "subject", x: str = "age", value: str = "value", group: str | None = None, interaction: bool = False, slope: bool = False, restricted: bool = True) -> DataFrame:
    """(keys, term, estimate, se, t, df, p, variance, var_intercept, var_slope, cov, minus2_log_likelihood) for each fixed effect.

    Terms are intercept, x, `group=level` for every level but the least, and with `interaction` `x:group=level`. Random: an intercept of each
    subject, with `slope` a slope on x too, correlated. Restricted likelihood by default, else full (to compare models of different
    terms). t has n minus rank degrees of freedom. Rows with a null in any used column go; terms that other terms determine share their effect
    (least-squares of least norm); a model without residual freedom or spread of the values has no row. Group levels are few.
    """
    used = [subject, x, value] + ([group] if group else [])
    rows = rows.dropna(subset=[*keys, *used])
    levels = sorted(r[0] for r in rows.select(group).distinct().limit(101).collect()) if group else []
    if len(levels) > 100:
        raise ValueError("a group has at most 100 levels")
    ours = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    rows = rows.select(*ours, F.col(subject).alias("__s"), F.col(x).cast("double").alias("__x"), F.col(value).cast("double").alias("__y"), *([F.col(group).alias("__g")] if group else []))
    facts = rows.groupBy(*names).agg(F.avg("__x").alias("__m"), F.coalesce(F.nullif(F.stddev_pop("__x"), F.lit(0.0)), F.lit(1.0)).alias("__d"), F.avg("__y").alias("__c"))
    z = rows.join(facts, names) if names else rows.crossJoin(facts)  # facts has one row here
    z = z.withColumns({"__z": (F.col("__x") - F.col("__m")) / F.col("__d"), "__v": F.col("__y") - F.col("__c")})
    dummies = [(F.col("__g") == level).cast("double") for level in levels[1:]]
    columns = [F.lit(1.0), F.col("__z"), *dummies, *([d * F.col("__z") for d in dummies] if interaction else []), F.col("__v")]
    random = [F.lit(1.0)] + ([F.col("__z")] if slope else [])
    p, q = len(columns) - 1, len(random)
    by_subject = z.groupBy(*names, "__s").agg(
        F.first("__m").alias("__m"), F.first("__d").alias("__d"), F.first("__c").alias("__c"), F.count(F.lit(1)).alias("__n"),
        F.array(*(F.sum(columns[i] * columns[j]) for i in range(p + 1) for j in range(i, p + 1))).alias("__all"),
        F.array(*(F.sum(r * c) for r in random for c in columns)).alias("__own"), F.array(*(F.round(F.sum(a * b), 9) for a in random for b in random)).alias("__design"),
    )
    size, half = q * (p + 1), (p + 1) * (p + 2) // 2
    designs = by_subject.groupBy(*names, "__design").agg(
        F.first("__m").alias("__m"), F.first("__d").alias("__d"), F.first("__c").alias("__c"), F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__subjects"),
        F.array(*(F.sum(F.col("__all")[i]) for i in range(half))).alias("__all"), F.array(*(F.sum(F.col("__own")[i] * F.col("__own")[j]) for i in range(size) for j in range(size))).alias("__outer"),
    )
    terms = ["intercept", x, *(f"{group}={level}" for level in levels[1:]), *((f"{x}:{group}={level}" for level in levels[1:]) if interaction else ())]
    columns_out = ["estimate", "se", "t", "df", "p", "variance", "var_intercept", "var_slope", "cov", "minus2_log_likelihood"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((p + 1, p + 1))
        total[np.triu_indices(p + 1)] = np.stack(pdf["__all"]).sum(axis=0)
        total = np.triu(total) + np.triu(total, 1).T
        n, mean, sd, centre = float(pdf["__n"].sum()), float(pdf["__m"].iloc[0]), float(pdf["__d"].iloc[0]), float(pdf["__c"].iloc[0])
        model = Likelihood(total, pdf["__subjects"].to_numpy(float), np.stack(pdf["__design"]).reshape(-1, q, q), np.stack(pdf["__outer"]), n, restricted)
        if n <= model.rank or total[p, p] <= 1e-12 * n:
            return pd.DataFrame(columns=[*names, "term", *columns_out])
        loss, beta, cov, variance, g = model.fit()
        # back to x as given: z = (x - mean) / sd, value = v + centre
        back = np.eye(p)
        k = len(levels) - 1 if levels else 0
        back[1, 1], back[0, 1] = 1 / sd, -mean / sd
        for i in range(k if interaction else 0):
            back[2 + k + i, 2 + k + i], back[2 + i, 2 + k + i] = 1 / sd, -mean / sd
        beta, cov = back @ beta, back @ cov @ back.T
        beta[0] += centre
        turn = np.array([[1, -mean / sd], [0, 1 / sd]])[:q, :q] if q == 2 else np.eye(1)
        g = turn @ g @ turn.T * variance
        loss += 2 * math.log(sd) * (1 + (k if interaction else 0)) if restricted else 0.0
        out = []
        for term, b, v in zip(terms, beta, np.diag(cov)):
            se, df = math.sqrt(max(v, 0.0)), n - model.rank
            t = b / se if se > 0 else None
            tail = None if t is None else incomplete_beta(df / 2, 0.5, df / (df + t * t))
            out.append([*(pdf[c].iloc[0] for c in names), term, b, se, t, df, tail, variance, g[0, 0], g[1, 1] if q == 2 else None, g[0, 1] if q == 2 else None, loss])
        return pd.DataFrame(out, columns=[*names, "term", *columns_out])

    kinds = "".join(f"{a} {rows.schema[a].dataType.simpleString()}, " for a in names)
    got = designs.groupBy(*names).applyInPandas(fit, kinds + "term string, " + ", ".join(f"{c} double" for c in columns_out))
    return got.select(*(F.col(a).alias(k) for a, k in zip(names, keys)), "term", *columns_out)


def compare_models(small: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, statistic, df, p): likelihood-ratio test of two models of full likelihood, the terms of `small` being among those of `large`."""
    of = lambda df, name: df.groupBy(*keys).agg(F.first("minus2_log_likelihood").alias(f"l_{name}"), F.count(F.lit(1)).alias(f"n_{name}"))
    j = of(small, "small").join(of(large, "large"), keys)

    @F.pandas_udf("double")
    def tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(max(s, 0.0), d) for s, d in zip(statistic, df)])

    j = j.select(*keys, (F.col("l_small") - F.col("l_large")).alias("statistic"), (F.col("n_large") - F.col("n_small")).cast("double").alias("df"))
    return j.withColumn("p", tail("statistic", "df"))


def chi_square_tail(x: float, df: float) -> float:
    """P(chi-square of df > x), by the series of the lower incomplete gamma function or the continued fraction of the upper one."""
    a, x = df / 2, x / 2
    if x <= 0 or a <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > 1e-16 * total:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * out
