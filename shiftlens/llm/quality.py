"""A quality classifier: random Fourier features, ridge scores, isotonic calibration.

Every whole text gives a vector of document statistics. Random Fourier features of the
standardised vector approximate a Gaussian kernel. Each partition sums its share of
the normal equations, by fold; the sums are added up row by row of the matrix, and the
driver gets one matrix of fixed size. Statistics, their projections and the features
lie on fixed grids, so sums are exact and a fit does not depend on how rows are dealt. Each fold is scored by the fit of the
other folds; pooled adjacent violators over those scores, binned on a grid, give the
calibration curve from score to the chance of label 1.

Labels are used of rows whose crc32 of the doc_id (as text) modulo 4 is not 2 only, of
at most ``MOST_LABELS`` ids (those with the smallest hashes), which bounds what is
broadcast to the texts; every row of those ids teaches.

Defined results: null text counts as empty; an empty text is scored like any other; of
several labels of a doc_id the largest counts; null labels and ids teach nothing;
repeated rows are scored each; without labels of both classes every score is the mean
label, or 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log1p, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows, materialize, slices

FEATURES = 256
SEED = 20_240_229
FOLDS = (0, 1, 3)
HELD_OUT = 2
ACCEPT = 0.7
#: So many labelled ids at most are learned from; a row of them is under 50 bytes.
MOST_LABELS = 200_000
RIDGE = 3e-4
BINS = 512
#: Grids of the statistics, of the features, and of the draw; on them products and their sums are exact doubles.
GRID_X, GRID_Z, GRID_W = 1024.0, 4096.0, 2.0**20

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = b"0123456789"
STOPS = ".,;:?"
SIGNS = "|!*#$%&@<>{}[]()=/\\_-+~^\"'"


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text, each roughly within 0 to 4."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n, nb = max(1, len(text)), max(1, len(raw))
    words = text.split()
    nw = max(1, len(words))
    lines = text.split("\n")
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    lens = list(map(len, words))
    mean = sum(lens) / nw
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / nb
    signs = [text.count(c) for c in SIGNS]
    return [
        log1p(len(text)) / 4,
        log1p(len(words)) / 3,
        log1p(len(lines)) / 2,
        log1p(nw / len(lines)),
        mean / 4,
        sqrt(sum((x - mean) ** 2 for x in lens) / nw) / 2,
        max(lens, default=0) ** 0.5 / 4,
        share(UPPER) * 3,
        share(LOWER) * 3,
        sqrt(share(DIGITS)) * 3,
        (nb - n) / n * 4,
        len(counts) / nw * 3,
        sqrt(max(counts.values(), default=0) / nw) * 3,
        len(pairs) / max(1, nw - 1) * 3,
        sqrt(1 - len(set(lines)) / len(lines)) * 3,
        sum(map(str.isupper, words)) / nw * 3,
        sum(map(str.istitle, words)) / nw * 3,
        sum(map(str.isalpha, words)) / nw * 3,
        sqrt(sum(x >= 14 for x in lens) / nw) * 3,
        sum(x <= 3 for x in lens) / nw * 3,
        *(sqrt(text.count(c) / nw) * 3 for c in STOPS),
        sqrt(sum(signs) / nw) * 3,
        *(sqrt(min(1.0, c / nw)) * 3 for c in signs[:7]),
        sqrt(sum(signs[7:]) / nw) * 3,
    ]


SIZE = len(statistics(""))


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features, and a constant, of standardised rows, on the grid."""
    draw = np.random.default_rng(SEED)
    w = np.round(draw.normal(size=(z.shape[1], FEATURES)) / sqrt(z.shape[1]) * 0.8 * GRID_W) / GRID_W
    b = draw.uniform(0, 2 * np.pi, FEATURES)
    x = np.sqrt(2.0) * np.cos(z @ w + b)
    return np.round(np.hstack([x, np.ones((len(z), 1))]) * GRID_Z) / GRID_Z


def weigh(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's weighted sum, in an order that doesn't depend on how many rows there are."""
    return np.concatenate([np.empty(0), *((z[k : k + 4096] * weights).sum(axis=1) for k in range(0, len(z), 4096))])


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0]), np.array([0.5])))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip((np.round(x * GRID_X) / GRID_X - self.mean) / self.sd, -4, 4) * GRID_X) / GRID_X

    def raw(self, x: np.ndarray) -> np.ndarray:
        return weigh(fourier(self.standard(x)), self.weights) if self.weights is not None else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots) if len(x) else np.empty(0)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x (the statistics), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


def rows_of(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, SIZE)


def known_labels(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, y and fold of the labels to learn from, at most so many."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    known = known.withColumn("fold", remainder(F.col("doc_id")).cast("int")).where(F.col("fold") != HELD_OUT)
    return materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "quality-labels")


def fit(feats: DataFrame, known: DataFrame) -> Model:
    """Fit on all rows (doc_id, x) that have a label."""
    train = materialize(feats.join(F.broadcast(known), "doc_id").select("x", "y", "fold"), "quality-train")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SIZE + 2)
        for batch in batches:
            x = np.round(rows_of(batch.column(0)) * GRID_X) / GRID_X
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x), batch.column(1).to_numpy().sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["cell", "v"])

    cells = np.zeros(2 * SIZE + 2)
    for cell, v in train.mapInArrow(moments, "cell int, v double").groupBy("cell").agg(F.sum("v")).collect():
        cells[cell] = v
    n, ones = cells[-2], cells[-1]
    mean = cells[:SIZE] / max(n, 1)
    sd = np.sqrt(np.maximum(cells[SIZE : 2 * SIZE] / max(n, 1) - mean**2, 1e-4))
    model = Model(mean, sd, None)
    if not 0 < ones < n:
        model.knots = (np.array([0.0]), np.array([ones / n if n else 0.5]))
        return model

    size = FEATURES + 1
    normal = np.zeros((size, len(FOLDS), size + 2))  # by row of the matrix: fold, the row and the right-hand side, and the row count
    for i, row in train.mapInArrow(lambda b: partial_normal(b, model), "i int, row binary").groupBy("i").applyInPandas(add_rows, "i int, row binary").collect():
        normal[i] = np.frombuffer(row).reshape(len(FOLDS), size + 2)
    a, b = normal[:, :, :size].transpose(1, 0, 2), normal[:, :, size].T
    counts = normal[-1, :, size + 1]

    def solve(use: list[int]) -> np.ndarray:
        m = counts[use].sum()
        penalty = np.full(size, RIDGE * m + 1.0)
        penalty[-1] = 1e-9
        return np.linalg.solve(a[use].sum(0) + np.diag(penalty), b[use].sum(0))

    every = list(range(len(FOLDS)))
    weights = {f: solve([k for k in every if k != j]) if counts[[k for k in every if k != j]].sum() else None for j, f in enumerate(FOLDS)}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, y, fold = fourier(model.standard(rows_of(batch.column(0)))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raw = np.zeros(len(z))
            for f, w in weights.items():
                if w is not None:
                    raw[fold == f] = weigh(z[fold == f], w)
            at = np.clip(np.round(raw * BINS), -BINS, 2 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y.astype(np.int64))], names=["bin", "y"])

    bins = train.mapInArrow(binned, "bin int, y long").groupBy("bin").agg(F.sum("y"), F.count("y")).orderBy("bin").collect()  # at most 3 * BINS + 1 rows
    model.weights = solve(every)
    model.knots = isotonic([r[0] / BINS for r in bins], [r[1] for r in bins], [r[2] for r in bins])
    return model


def partial_normal(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """This partition's share of the normal equations, a packed row for each row of the matrix."""
    size = FEATURES + 1
    total = np.zeros((size, len(FOLDS), size + 2))
    some = False
    for batch in batches:
        x, y, fold = rows_of(batch.column(0)), batch.column(1).to_numpy().astype(np.float64), batch.column(2).to_numpy()
        for k in range(0, len(x), 4096):
            z = fourier(model.standard(x[k : k + 4096]))
            for j, f in enumerate(FOLDS):
                mine = fold[k : k + 4096] == f
                zf = z[mine]
                total[:, j, :size] += zf.T @ zf
                total[:, j, size] += zf.T @ y[k : k + 4096][mine]
                total[:, j, size + 1] += len(zf)
                some = True
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])


def add_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0)
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [total.tobytes()]})


def isotonic(x: list[float], ones: list[float], n: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function by pooled adjacent violators, joined by lines between block means."""
    blocks: list[list[float]] = []  # weight, sum of labels, weighted sum of x
    for a, s, w in zip(x, ones, n, strict=True):
        blocks.append([w, s, w * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def score_documents(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted, a row per document."""
    feats = materialize(features(docs), "quality-features")
    model = fit(feats, known_labels(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(rows_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= accept).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = feats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that the classifier accepts; the input's columns.

    Texts are not shuffled; for the fit, only those with a label are worked on.
    """
    known = known_labels(labels)
    labelled = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    model = fit(features(labelled), known)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t.as_py()) for t in batch.column(at)], dtype=np.float32).reshape(-1, SIZE).astype(np.float64)
            yield batch.filter(pa.array(model.score(x) >= accept, pa.bool_()))

    return map_rows(docs, run, docs.schema)
