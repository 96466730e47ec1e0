"""Learning on responses and features with pyspark.ml: decoding, permutation importance and regression."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decoding_features(rates: DataFrame, channels: list[int], bins: tuple[int, int]) -> DataFrame:
    """(rec, pattern, trial, c0.. ) mean rate of each channel over bins [first, last); missing bins count 0."""
    n = bins[1] - bins[0]
    r = rates.filter(F.col("bin").between(bins[0], bins[1] - 1)).groupBy("rec", "pattern", "trial").pivot("ch", channels).agg(F.sum("rate") / n)
    return r.select("rec", "pattern", "trial", *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"c{c}") for c in channels))


def _vectors(wide: DataFrame, label: str, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    z = VectorAssembler(inputCols=features, outputCol="features").transform(wide.dropna(subset=[label, *features]))
    return StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(z.withColumn(label, F.col(label).cast("string"))).transform(z.withColumn(label, F.col(label).cast("string")))


def decode_patterns(wide: DataFrame, features: list[str], label: str = "pattern", sizes=(2, 4), repeats: int = 3, folds: int = 5, seed: int = 1) -> DataFrame:
    """(size, repeat, accuracy): one-vs-one linear SVMs on random subsets of the features, cross-validated by a hash of the row. Fewer than two
    labels give a null accuracy. The subsets are a stated parameter of the analysis."""
    import random

    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    spark, rng = wide.sparkSession, random.Random(seed)
    labels = sorted(r[0] for r in wide.select(label).distinct().collect())  # stimulus patterns, a handful
    rows = wide.withColumn("__fold", F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(folds))).coalesce(2).cache()  # one row per trial
    out = []
    for size in sizes:
        for rep in range(repeats):
            if len(labels) < 2:
                out.append((size, rep, None))
                continue
            part = rng.sample(features, min(size, len(features)))
            z = VectorAssembler(inputCols=part, outputCol="features").transform(rows)
            right = total = 0
            for a, b in combinations(labels, 2):
                two = z.filter(F.col(label).isin(a, b)).withColumn("y", (F.col(label) == b).cast("double"))
                for k in range(folds):
                    train = two.filter(F.col("__fold") != k)
                    if train.select("y").distinct().count() < 2:
                        continue
                    got = LinearSVC(labelCol="y", maxIter=5).fit(train).transform(two.filter(F.col("__fold") == k)).agg(F.sum((F.col("prediction") == F.col("y")).cast("long")), F.count(F.lit(1))).first()
                    right, total = right + (got[0] or 0), total + got[1]
            out.append((size, rep, right / total if total else None))
    return spark.createDataFrame(out, "size int, repeat int, accuracy double")


def permutation_importance(wide: DataFrame, label: str, features: list[str], seed: int = 1, bucket_rows: int = 100_000) -> DataFrame:
    """(feature, importance): rise of a tree's error when one feature is shuffled between rows. Rows trade values within buckets of about
    bucket_rows rows, dealt by a hash, so that no order over the whole table is needed; a row has one partner for all features."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import Window

    z = _vectors(wide, label, features)
    model = DecisionTreeClassifier(labelCol="y", maxDepth=5, seed=seed).fit(z)
    error = F.avg((F.col("prediction") != F.col("y")).cast("double"))
    total, base = model.transform(z).agg(F.count(F.lit(1)), error).first()
    rows = z.select("y", vector_to_array("features").alias("a")).withColumn("b", F.pmod(F.xxhash64("a"), F.lit(1 + (total or 0) // bucket_rows)))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "y"), "y")))
    donors = rows.select("b", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "y", F.lit(seed)), "y")).alias("i"), F.col("a").alias("other"))
    moved = rows.join(donors, ["b", "i"]).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))  # the shuffle comes before a row meets its features
    moved = moved.select("f", "y", array_to_vector(F.transform("a", lambda x, k: F.when(k == F.col("f"), F.element_at("other", k + 1)).otherwise(x))).alias("features"))
    names = F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1)
    return model.transform(moved).groupBy("f").agg(error.alias("e")).select(names.alias("feature"), (F.col("e") - F.lit(base)).alias("importance"))


def regression_errors(wide: DataFrame, target: str, features: list[str], folds: int = 2, seed: int = 1) -> DataFrame:
    """(model, rmse): cross-validated error of least squares, a tree and the mean."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    z = VectorAssembler(inputCols=features, outputCol="features").transform(wide.dropna(subset=[target, *features])).withColumn("y", F.col(target).cast("double"))
    z = z.select("y", "features", F.pmod(F.xxhash64("features", F.lit(seed)), F.lit(folds)).alias("fold")).cache()
    out = None
    for k in range(folds):
        train, test = z.filter(F.col("fold") != k), z.filter(F.col("fold") == k)
        mean = train.agg(F.avg("y")).first()[0]
        parts = [("mean", test.withColumn("prediction", F.lit(mean)))] + [(n, m.fit(train).transform(test)) for n, m in (("linear", LinearRegression(labelCol="y")), ("tree", DecisionTreeRegressor(labelCol="y", maxDepth=5)))]
        for name, p in parts:
            e = p.select(F.lit(name).alias("model"), F.pow(F.col("prediction") - F.col("y"), F.lit(2.0)).alias("e"))
            out = e if out is None else out.unionByName(e)
    return out.groupBy("model").agg(F.sqrt(F.avg("e")).alias("rmse"))


def shuffled_label_losses(wide: DataFrame, label: str, features: list[str], reps: int = 100, folds: int = 2, seed: int = 1, bucket_rows: int = 10_000) -> DataFrame:
    """(rep, loss, n): cross-validated error of a linear discriminant classifier with the labels as they are (rep 0) and with shuffled labels (reps
    1 to `reps`), the null that it is held against. Classes weigh as often as they occur.

    Labels trade places within buckets of about bucket_rows rows; a bucket shuffles for all replicates at once and a row carries its label of each.
    Sums over the rows of a fold, class and replicate and one cross-product matrix of a fold are all that the fits need; predictions of all
    replicates are one matrix product for each batch of rows. Rows with a null label or feature go; there are at most 1,000 classes.
    """
    from ..functions.iterate import cut

    rows = wide.dropna(subset=[label, *features])
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).limit(1001).collect()]
    if len(classes) > 1000:
        raise ValueError("there are at most 1,000 classes")
    y = F.create_map(*(F.lit(v) for i, c in enumerate(classes) for v in (c, i)))[F.col(label)] if classes else F.lit(0)
    at = cut(rows.select(F.monotonically_increasing_id().alias("uid"), y.cast("int").alias("y"), F.array(*(F.col(f).cast("double") for f in features)).alias("x")))
    buckets = 1 + at.count() // bucket_rows
    dealt = at.withColumns({"b": F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(buckets)), "fold": F.pmod(F.xxhash64("uid", F.lit(seed + 1)), F.lit(folds)).cast("int")})
    p, k = len(features), len(classes)

    def shuffle(pdf):
        pdf = pdf.sort_values("uid", ignore_index=True)
        rng, real = np.random.RandomState((seed * 1_000_003 + int(pdf["b"].iloc[0])) % 2**32), pdf["y"].to_numpy()
        labels = np.stack([real, *(rng.permutation(real) for _ in range(reps))], axis=1)
        return pd.DataFrame({"fold": pdf["fold"], "x": pdf["x"], "labels": list(labels.astype("int32"))})

    z = cut(dealt.groupBy("b").applyInPandas(shuffle, "fold int, x array<double>, labels array<int>"))

    def sums(batches):
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x, labels = np.stack(part["x"]), np.stack(part["labels"])
                for rep in range(reps + 1):
                    n, s = np.zeros(k), np.zeros((k, p))
                    np.add.at(n, labels[:, rep], 1)
                    np.add.at(s, labels[:, rep], x)
                    yield pd.DataFrame({"fold": fold, "rep": rep, "v": [np.concatenate([n, s.ravel()])]})
                yield pd.DataFrame({"fold": fold, "rep": -1, "v": [(x.T @ x).ravel()]})

    parts = z.mapInPandas(sums, "fold int, rep int, v array<double>").select("fold", "rep", F.posexplode("v").alias("i", "v"))
    got: dict = {}  # one vector of fixed length for each fold and replicate
    for r in parts.groupBy("fold", "rep", "i").agg(F.sum("v").alias("v")).groupBy("fold", "rep").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).getField("v").alias("v")).collect():
        got[r["fold"], r["rep"]] = np.array(r["v"])
    models = np.zeros((folds, reps + 1, p + 1, k))
    for fold in range(folds):
        cross = sum((v for (f, rep), v in got.items() if rep < 0 and f != fold), np.zeros(p * p)).reshape(p, p)
        for rep in range(reps + 1):
            v = sum((v for (f, r), v in got.items() if r == rep and f != fold), np.zeros(k + k * p))
            n, s = v[:k], v[k:].reshape(k, p)
            mean = s / np.maximum(n, 1)[:, None]
            within = (cross - (mean.T * n) @ mean) / max(1.0, n.sum() - k)
            slope = np.linalg.pinv(within, hermitian=True) @ mean.T
            with np.errstate(divide="ignore"):
                models[fold, rep] = np.vstack([slope, np.log(n / max(1.0, n.sum())) - 0.5 * (mean.T * slope).sum(axis=0)])
    shared = wide.sparkSession.sparkContext.broadcast(models)  # folds x replicates x features x classes

    def judge(batches):
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x, labels = np.column_stack([np.stack(part["x"]), np.ones(len(part))]), np.stack(part["labels"])
                wrong = [int((np.nan_to_num(x @ m, nan=-np.inf).argmax(axis=1) != labels[:, rep]).sum()) for rep, m in enumerate(shared.value[fold])]
                yield pd.DataFrame({"rep": range(reps + 1), "wrong": wrong, "n": len(part)})

    out = z.mapInPandas(judge, "rep int, wrong long, n long").groupBy("rep").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n"))
    return out.select("rep", (F.col("wrong") / F.col("n")).alias("loss"), "n")


def shuffled_label_test(losses: DataFrame) -> DataFrame:
    """(loss, null_mean, null_sd, p) of the losses by replicate: p is the share of shuffled replicates, the real one counted with them, that do as well."""
    null = F.when(F.col("rep") > 0, F.col("loss"))
    one = losses.agg(F.max(F.when(F.col("rep") == 0, F.col("loss"))).alias("loss"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), F.collect_list(null).alias("all"))  # one number for each replicate
    return one.select("loss", "null_mean", "null_sd", ((F.size(F.filter("all", lambda x: x <= F.col("loss"))) + 1) / (F.size("all") + 1)).alias("p"))
