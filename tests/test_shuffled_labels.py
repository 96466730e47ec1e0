"""The label-shuffle null: a plain discriminant gives the same losses, and chance is what shuffled labels reach."""

import numpy as np
import pytest

from axonlake.operators import learning


def table(spark, apart, n=300, seed=3):
    r = np.random.RandomState(seed)
    y = r.randint(0, 3, n)
    x = r.normal(0, 1, (n, 4)) + apart * np.eye(4)[y]
    rows = [("uvw"[c], *map(float, v)) for c, v in zip(y, x)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0), ("u", None, 1.0, 1.0, 1.0)], "y string, a double, b double, c double, d double"), x, y


def test_separable_classes_stand_out_and_noise_does_not(spark):
    for apart, low, high in ((4.0, 0.0, 0.05), (0.0, 0.55, 0.8)):
        df, _, y = table(spark, apart)
        losses = learning.shuffled_label_losses(df, "y", list("abcd"), 40, bucket_rows=100)
        rows = {r.rep: r for r in losses.collect()}
        assert set(rows) == set(range(41)) and all(r.n == 300 for r in rows.values())
        null = [rows[k].loss for k in range(1, 41)]
        assert low <= rows[0].loss <= high and 0.58 < np.mean(null) < 0.75 and min(null) > 0.5
        t = learning.shuffled_label_test(losses).first()
        assert t.p == pytest.approx((sum(x <= rows[0].loss for x in null) + 1) / 41) and (t.p < 0.03) == (apart > 0)
        again = {r.rep: r.loss for r in learning.shuffled_label_losses(df, "y", list("abcd"), 40, bucket_rows=100).collect()}
        assert again == {k: r.loss for k, r in rows.items()}  # seeded


def test_losses_equal_a_plain_discriminant(spark):
    df, x, y = table(spark, 1.0)
    got = learning.shuffled_label_losses(df, "y", list("abcd"), 0, folds=5).first().loss
    r, plain = np.random.RandomState(1), []
    for _ in range(20):  # other folds, the same method
        fold, wrong = r.randint(0, 5, len(y)), 0
        for f in range(5):
            train, n = fold != f, np.bincount(y[fold != f], minlength=3)
            mean = np.stack([x[train & (y == c)].mean(axis=0) for c in range(3)])
            e = x[train] - mean[y[train]]
            inverse = np.linalg.inv(e.T @ e / (train.sum() - 3))
            scores = [x[~train] @ inverse @ m - 0.5 * m @ inverse @ m + np.log(k / n.sum()) for m, k in zip(mean, n)]
            wrong += (np.argmax(scores, axis=0) != y[~train]).sum()
        plain.append(wrong / len(y))
    assert min(plain) - 0.02 <= got <= max(plain) + 0.02


def test_nothing_and_one_class(spark):
    df, _, _ = table(spark, 1.0, 20)
    assert learning.shuffled_label_losses(df.limit(0), "y", list("abcd"), 2).count() == 0
    assert {r.loss for r in learning.shuffled_label_losses(df.filter("y = 'u'"), "y", list("abcd"), 2).collect()} == {0.0}
