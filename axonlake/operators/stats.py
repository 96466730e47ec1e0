"""Group statistics and learning on long metric tables (keys, subject, grp, age, value). Sums of squares are native; p-values come from one
vectorised function on the small result."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import correlation, group_d_prime


def _beta_cf(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def run(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or y <= 0 or z <= 0 else incomplete_beta(z / 2, y / 2, z / (z + y * x)) for x, y, z in zip(f, a, b)], dtype="float64")

    return run(f, d1.cast("double"), d2.cast("double"))


def t_p_value(t: Column, df: Column) -> Column:
    return f_p_value(t * t, F.lit(1.0), df)


def anova(rows: DataFrame, keys: list[str], group: str = "grp", value: str = "value") -> DataFrame:
    """(keys, f, df1, df2) of a one-way analysis of variance."""
    g = rows.filter(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    a = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    ssb, d1, d2 = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n"), F.col("k") - 1, F.col("n") - F.col("k")
    return a.select(*keys, F.when((d1 > 0) & (d2 > 0) & (F.col("ssw") > 0), ssb / d1 / (F.col("ssw") / d2)).alias("f"), d1.alias("df1"), d2.alias("df2"))


def pairwise_tests(rows: DataFrame, keys: list[str], group: str = "grp", value: str = "value") -> DataFrame:
    """(keys, group_a, group_b, t, df, d_prime) for every pair of groups, equal variances."""
    g = rows.filter(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    a = g.select(*keys, F.col(group).alias("group_a"), *(F.col(c).alias(f"{c}a") for c in "nms"))
    b = g.select(*keys, F.col(group).alias("group_b"), *(F.col(c).alias(f"{c}b") for c in "nms"))
    on = a.join(b, keys) if keys else a.join(b, F.col("group_a") < F.col("group_b"))
    p = on.filter("group_a < group_b")
    df = F.col("na") + F.col("nb") - 2
    pooled = F.try_divide((F.col("na") - 1) * F.col("sa") ** 2 + (F.col("nb") - 1) * F.col("sb") ** 2, df)
    return p.select(*keys, "group_a", "group_b", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))).alias("t"), df.alias("df"), group_d_prime(F.col("ma"), F.col("mb"), F.col("sa"), F.col("sb")).alias("d_prime"))


def paired_tests(rows: DataFrame, keys: list[str], subject: str = "subject", age: str = "age", value: str = "value") -> DataFrame:
    """(keys, age_a, age_b, t, df): paired t over subjects present at both ages."""
    a = rows.select(*keys, subject, F.col(age).alias("age_a"), F.col(value).alias("x"))
    b = rows.select(*keys, subject, F.col(age).alias("age_b"), F.col(value).alias("y"))
    d = a.join(b, [*keys, subject]).filter("age_a < age_b").withColumn("d", F.col("y") - F.col("x"))
    g = d.groupBy(*keys, "age_a", "age_b").agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return g.filter("n > 1").select(*keys, "age_a", "age_b", F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def repeated_anova(rows: DataFrame, keys: list[str], subject: str = "subject", level: str = "age", value: str = "value") -> DataFrame:
    """(keys, f, df1, df2): one-way repeated measures over complete subjects."""
    levels = rows.groupBy(*keys).agg(F.count_distinct(level).alias("k"))
    per = rows.groupBy(*keys, subject, level).agg(F.avg(value).alias("x"))
    full = per.groupBy(*keys, subject).agg(F.count(F.lit(1)).alias("c"), F.avg("x").alias("ms")).join(levels, keys).filter("c = k").select(*keys, subject, "ms", "k")
    x = per.join(full, [*keys, subject])
    tot = x.groupBy(*keys, "k").agg(F.avg("x").alias("g"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("c"))
    sub = full.groupBy(*keys).agg((F.var_pop("ms") * F.count(F.lit(1)) * F.first("k")).alias("ss_s"), F.count(F.lit(1)).alias("n"))
    lev = x.groupBy(*keys, level).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).groupBy(*keys).agg((F.var_pop("m") * F.count(F.lit(1)) * F.first("n")).alias("ss_a"))
    j = tot.join(sub, keys).join(lev, keys)
    d1 = F.col("k") - 1
    d2 = d1 * (F.col("n") - 1)
    sse = F.col("v") * F.col("c") - F.col("ss_s") - F.col("ss_a")
    return j.select(*keys, F.when((d1 > 0) & (d2 > 0) & (sse > 0), F.col("ss_a") / d1 / (sse / d2)).alias("f"), d1.alias("df1"), d2.alias("df2"))


def mixed_model(rows: DataFrame, keys: list[str], subject: str = "subject", x: str = "age", value: str = "value") -> DataFrame:
    """(keys, intercept, slope, ratio): value ~ x with a random intercept per subject. Subjects are reduced natively to their sums; the variance
    ratio is found by profiled restricted likelihood on those sums."""
    s = rows.groupBy(*keys, subject).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).cast("double").alias("sx"), F.sum(value).alias("sy"), F.sum(F.col(x) * F.col(x)).cast("double").alias("sxx"), F.sum(F.col(x) * F.col(value)).alias("sxy"), F.sum(F.col(value) * F.col(value)).alias("syy"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, sx, sy, sxx, sxy, syy = (pdf[c].to_numpy(float) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))

        def parts(lam):
            k = lam / (1 + lam * n)
            a = np.array([[(n - k * n * n).sum(), (sx - k * n * sx).sum()], [(sx - k * n * sx).sum(), (sxx - k * sx * sx).sum()]])
            b = np.array([(sy - k * n * sy).sum(), (sxy - k * sx * sy).sum()])
            beta = np.linalg.lstsq(a, b, rcond=None)[0]
            rss = (syy - k * sy * sy).sum() - beta @ b
            return a, beta, max(rss, 1e-300)

        def loss(log_lam):
            lam = math.exp(log_lam)
            a, _, rss = parts(lam)
            return (n.sum() - 2) * math.log(rss) + np.log1p(lam * n).sum() + np.linalg.slogdet(a)[1]

        grid = np.linspace(-12, 8, 81)
        lo = grid[int(np.argmin([loss(g) for g in grid]))]
        fine = np.linspace(lo - 0.25, lo + 0.25, 101)
        lam = math.exp(fine[int(np.argmin([loss(g) for g in fine]))])
        beta = parts(lam)[1]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "intercept": [beta[0]], "slope": [beta[1]], "ratio": [lam]})

    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return s.groupBy(*keys).applyInPandas(fit, f"{kinds}intercept double, slope double, ratio double")


def feature_correlations(wide: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, a, b, r) over complete rows."""
    full = wide.dropna(subset=features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    g = full.groupBy(*keys).agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return g.select(*keys, F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")).select(*keys, "x.a", "x.b", "x.r")


def discriminant(wide: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, axis_1.. projections of class means, n): linear discriminant axes from native scatter sums, solved on the p x p matrices."""
    z = wide.dropna(subset=features)
    facts = z.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    used = [f for f in features if facts[f"s_{f}"]]
    z = z.select(F.col(label).alias("label"), F.array(*((F.col(f) - facts[f"m_{f}"]) / facts[f"s_{f}"] for f in used)).alias("x"))
    p = len(used)

    def scatter(frames):
        """Per task and class: rows, sums and sums of products, as (label, position, value)."""
        held: dict = {}
        for pdf in frames:
            for name, part in pdf.groupby("label"):
                x = np.stack(part["x"])
                got = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                held[name] = held[name] + got if name in held else got
        for name, got in held.items():
            yield pd.DataFrame({"label": name, "k": np.arange(len(got)), "v": got})

    parts = z.mapInPandas(scatter, f"label {wide.schema[label].dataType.simpleString()}, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).toPandas()  # 1 + p + p * p numbers for each class
    sw, sb, sums = np.zeros((p, p)), np.zeros((p, p)), []
    for name, part in sorted(parts.groupby("label"), key=lambda x: x[0]):
        v = part.sort_values("k")["v"].to_numpy()
        n, mean = v[0], v[1 : p + 1] / v[0]
        sums.append((name, int(n), mean))
        sb += n * np.outer(mean, mean)
        sw += v[p + 1 :].reshape(p, p) - n * np.outer(mean, mean)
    val, vec = np.linalg.eigh(sw + 1e-9 * np.eye(p))
    white = vec / np.sqrt(np.maximum(val, 1e-12))
    axes = white @ np.linalg.eigh(white.T @ sb @ white)[1][:, ::-1][:, : max(1, min(len(sums) - 1, p))]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    spark = wide.sparkSession
    rows = [(name.item() if hasattr(name, "item") else name, n, *(float(x) for x in mean @ axes)) for name, n, mean in sums]
    return spark.createDataFrame(rows, f"{label} {wide.schema[label].dataType.simpleString()}, n long, " + ", ".join(f"axis_{i + 1} double" for i in range(axes.shape[1])))


def classifier_losses(wide: DataFrame, label: str, features: list[str], folds: int = 2, seed: int = 1) -> DataFrame:
    """(model, loss): cross-validated error of a one-against-rest linear SVM, a decision tree, a perceptron network and a logistic regression."""
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    z = VectorAssembler(inputCols=features, outputCol="features").transform(wide.dropna(subset=[label, *features]))
    z = StringIndexer(inputCol=label, outputCol="y").fit(z).transform(z).select("y", "features", F.pmod(F.xxhash64("features", F.lit(seed)), F.lit(folds)).alias("fold")).cache()
    classes = z.select("y").distinct().count()
    models = {
        "svm": OneVsRest(classifier=LinearSVC(maxIter=20), labelCol="y"), "tree": DecisionTreeClassifier(labelCol="y", maxDepth=5),
        "logistic": LogisticRegression(labelCol="y", maxIter=30), "mlp": MultilayerPerceptronClassifier(labelCol="y", layers=[len(features), 16, max(2, classes)], maxIter=40, seed=seed),
    }
    out = None
    for name, model in models.items():
        for k in range(folds):
            part = model.fit(z.filter(F.col("fold") != k)).transform(z.filter(F.col("fold") == k)).select(F.lit(name).alias("model"), (F.col("prediction") != F.col("y")).cast("double").alias("miss"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("model").agg(F.avg("miss").alias("loss"))


def kernel_density(rows: DataFrame, keys: list[str], value: str, points: int = 100) -> DataFrame:
    """(keys, x, density): Gaussian kernels with Silverman's width, at least a tenth of the range. Equal values are counted first."""
    g = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    g = g.withColumn("h", F.greatest(1.06 * F.coalesce("s", F.lit(0.0)) * F.pow("n", F.lit(-0.2)), 0.1 * (F.col("hi") - F.col("lo")), F.lit(1e-9)))
    grid = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    v = rows.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    e = F.exp(-0.5 * F.pow((F.col("x") - F.col("__v")) / F.col("h"), F.lit(2.0)))
    return grid.join(v, keys).groupBy(*keys, "i", "x").agg((F.sum(F.col("__c") * e) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))


def summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, mean, sem)."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def best_split(rows: DataFrame, value: str) -> DataFrame:
    """One row (boundary): midpoint of the two-group split of the values with the least sum of squares, by prefix sums over distinct values; null if
    all are equal. Global, on pre-counted distinct values."""
    from pyspark.sql import Window

    v = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("v")
    to = w.rowsBetween(Window.unboundedPreceding, 0)
    a = v.select("v", F.sum("c").over(to).alias("n1"), F.sum(F.col("c") * F.col("v")).over(to).alias("s1"), F.lead("v").over(w).alias("nxt"))
    t = v.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("s"))
    gain = F.col("s1") ** 2 / F.col("n1") + (F.col("s") - F.col("s1")) ** 2 / (F.col("n") - F.col("n1"))
    return a.filter("nxt is not null").join(F.broadcast(t)).agg(F.max_by((F.col("v") + F.col("nxt")) / 2, F.struct(gain, -F.col("v"))).alias("boundary"))  # t is one row


def two_way_repeated_anova(rows: DataFrame, keys: list[str], subject: str, a: str, b: str, value: str = "value") -> DataFrame:
    """(keys, effect, f, df1, df2) for both factors and their interaction, each tested against its own interaction with subjects. Repeated cells are
    averaged; subjects without every cell, and rows with a null, are left out. f is null where its error is 0 or has no degree of freedom."""
    x = rows.dropna(subset=[*keys, subject, a, b, value]).groupBy(*keys, F.col(subject).alias("__s"), F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.avg(value).alias("__x"))
    levels = x.groupBy(*keys).agg(F.count_distinct("__a").alias("__p"), F.count_distinct("__b").alias("__q"))
    full = x.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__c")).join(levels, keys).filter("__c = __p * __q").select(*keys, "__s", "__p", "__q")
    x = x.join(full, [*keys, "__s"])
    x = x.join(x.groupBy(*keys).agg(F.avg("__x").alias("__g"), F.count_distinct("__s").alias("__n")), keys).withColumn("__x", F.col("__x") - F.col("__g"))
    size = ["__n", "__p", "__q"]
    x = x.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(7))))  # which of subject (4), a (2) and b (1) a sum is taken over the levels of
    of = [F.when(F.col("__m").bitwiseAND(bit) > 0, F.col(c)).alias(c) for bit, c in ((4, "__s"), (2, "__a"), (1, "__b"))]
    sums = x.groupBy(*keys, *size, "__m", *of).agg((F.sum("__x") * F.sum("__x") / F.count(F.lit(1))).alias("__t"))
    t = sums.groupBy(*keys, *size).agg(*(F.sum(F.when(F.col("__m") == m, F.col("__t"))).alias(f"__t{m}") for m in range(8)))
    t0, tb, ta, tab, ts, tsb, tsa, tsab = (F.col(f"__t{m}") for m in range(8))
    n, p, q = (F.col(c) - 1 for c in size)
    tests = [(a, ta - t0, p, tsa - ts - ta + t0), (b, tb - t0, q, tsb - ts - tb + t0), (f"{a}:{b}", tab - ta - tb + t0, p * q, tsab - tsa - tsb - tab + ts + ta + tb - t0)]
    f = lambda ss, df, err: F.when((df > 0) & (n > 0) & (err > 0), (ss / df) / (err / (df * n)))
    effects = F.array(*(F.struct(F.lit(name).alias("effect"), f(ss, df, err).alias("f"), df.alias("df1"), (df * n).alias("df2")) for name, ss, df, err in tests))
    return t.select(*keys, F.explode(effects).alias("__e")).select(*keys, "__e.*")


def t_quantile(level: float, df: float) -> float:
    """t with two-sided tail `level`, by bisection of the incomplete beta function in df / (df + t * t)."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(df / 2, 0.5, mid) < level else (low, mid)
    return math.sqrt(df * (1 - high) / high) if high > 0 else math.inf


def t_interval(rows: DataFrame, keys: list[str], value: str = "value", level: float = 0.05) -> DataFrame:
    """(keys, n, mean, sem, half): half the width of the two-sided 1 - level interval of the mean; null for fewer than two values."""

    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        of = {d: t_quantile(level, d) for d in df.dropna().unique() if d > 0}
        return df.map(lambda d: of.get(d)).astype("float64")

    s = summary(rows, keys, value)
    return s.withColumn("half", F.when(F.col("n") > 1, F.col("sem") * quantile((F.col("n") - 1).cast("double"))))
