import random

import numpy as np
import zlib

from shiftlens.llm import quality


def corpus(n):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w.upper() + "!!" if bad and rng.random() < 0.5 else w for w in words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy_and_labels_that_must_not_be_seen(spark):
    rows, labels = corpus(500)
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    truth = np.array([labels[i][1] for i in got.index])
    assert (got.held_out == [out(i) for i in got.index]).all()
    held = got.held_out.to_numpy()
    assert ((got.predicted == truth)[held]).mean() > 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    # flipping held-out labels changes nothing, and so does dealing the rows otherwise
    flipped = [(i, 1 - q if out(i) else q, t) for i, q, t in labels]
    again = quality.score_documents(docs.repartition(7), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    assert (again.score.sort_index() == got.score.sort_index()).all()


def test_keep_good_keeps_what_is_predicted(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {r.doc_id for r in quality.score_documents(docs, lab).where("predicted = 1").collect()}
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_features_approximate_the_gaussian_kernel():
    z = np.random.default_rng(1).normal(size=(60, quality.SIZE))
    phi = quality.fourier(z)[:, :-1]
    apart = ((z[:, None] - z[None]) ** 2).sum(2)
    kernel = np.exp(-0.5 * 0.8**2 * apart / quality.SIZE)
    assert np.abs(phi @ phi.T / quality.FEATURES - kernel).max() < 0.3
    assert np.abs(phi @ phi.T / quality.FEATURES - kernel).mean() < 0.06  # by chance 1 / sqrt(256)


def plain_isotonic(x, y):
    """By the min-max formula: the greatest least mean of the intervals that hold a place."""
    n = len(x)
    mean = lambda a, b: sum(y[a:b]) / (b - a)
    return [max(min(mean(a, b) for b in range(k + 1, n + 1)) for a in range(k + 1)) for k in range(n)]


def test_isotonic_equals_the_min_max_formula():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 14)
        x, y = sorted(rng.sample(range(100), n)), [rng.randint(0, 1) for _ in range(n)]
        knots = quality.isotonic(x, y, [1] * n)
        want = plain_isotonic(x, y)
        blocks = [[k for k in range(n) if want[k] == v] for v in sorted(set(want))]
        assert np.allclose(knots[1], sorted(set(want))) and np.allclose(knots[0], [sum(x[k] for k in b) / len(b) for b in blocks])


def test_scores_equal_a_plain_fit_of_the_whole_table(spark):
    """Brute force: the statistics of all rows in one matrix, ridge solved directly, calibration by the formula."""
    rows, labels = corpus(400)
    x = np.array([quality.statistics(t) for _, t in rows], np.float32).astype(np.float64)
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i, _ in rows])
    y, use = np.array([q for _, q, _ in labels], float), fold != 2
    on_grid = np.round(x * 1024) / 1024
    mean, sd = on_grid[use].mean(0), np.maximum(on_grid[use].var(0), 1e-4) ** 0.5
    z = quality.fourier(np.round(np.clip((on_grid - mean) / sd, -4, 4) * 1024) / 1024)

    def ridge(mine):
        penalty = np.append(np.full(quality.FEATURES, quality.RIDGE * mine.sum() + 1), 1e-9)
        # the same minimum by least squares on stacked rows, without normal equations
        a, b = np.vstack([z[mine], np.diag(np.sqrt(penalty))]), np.append(y[mine], np.zeros(len(penalty)))
        return np.linalg.lstsq(a, b, rcond=None)[0]

    raw = np.zeros(len(rows))
    for f in (0, 1, 3):
        raw[fold == f] = z[fold == f] @ ridge(use & (fold != f))
    at = np.clip(np.round(raw * 512), -512, 1024)[use]
    bins = sorted(set(at))
    level = plain_isotonic_weighted([y[use][at == b].sum() for b in bins], [(at == b).sum() for b in bins])
    knots = {}
    for b, v in zip(bins, level, strict=True):
        knots.setdefault(round(v, 12), []).append(b)
    heavy = lambda bs: sum(b * (at == b).sum() for b in bs) / sum((at == b).sum() for b in bs) / 512
    want = np.interp(z @ ridge(use), [heavy(bs) for bs in knots.values()], list(knots))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id").score
    assert np.abs(got.loc[range(len(rows))].to_numpy() - want).max() < 1e-6


def plain_isotonic_weighted(ones, n):
    mean = lambda a, b: sum(ones[a:b]) / sum(n[a:b])
    return [max(min(mean(a, b) for b in range(k + 1, len(n) + 1)) for a in range(k + 1)) for k in range(len(n))]


def test_no_more_labels_than_the_bound(spark):
    rows, labels = corpus(200)
    lab = spark.createDataFrame([*labels, *labels[:50]], "doc_id long, quality int, toxic int")
    some = quality.known_labels(lab, 40)
    assert some.count() == 40 and sorted(some.collect()) == sorted(quality.known_labels(lab.repartition(3), 40).collect())
    assert quality.known_labels(lab).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows)


def test_isotonic_pools():
    x, y = quality.isotonic([0, 1, 2, 3], [0, 1, 0, 1], [1, 1, 1, 1])
    assert list(y) == [0, 0.5, 1] and list(x) == [0, 1.5, 3]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b"), (3, "x" * 200_000)], "doc_id long, text string")
    for rows in ([], [(1, 1, 0)], [(1, None, 0), (None, 0, 1)]):
        got = quality.score_documents(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 5 and {r.score for r in got} == {1.0 if rows == [(1, 1, 0)] and zlib.crc32(b"1") % 4 != 2 else 0.5}
    assert quality.score_documents(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
