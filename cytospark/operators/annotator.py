"""The labeller: robust scaling, weighted nearest neighbours and a class-weighted logistic model, blended."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import merged, quantiles, removed, written

#: Labelled rows that j17's model is fitted on at most, those first by a hash of their id.
MOST_LABELLED = 20_000
#: Rows to be scored, and rows that they are compared with, of one task of a cross-validation's nearest neighbours.
SCORED, COMPARED = 8192, 32768


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    train: np.ndarray
    y: np.ndarray
    weights: np.ndarray
    bias: float
    k: int
    blend: float
    threshold: float


def _scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -12, 12)


def logistic(z: np.ndarray, y: np.ndarray, l2: float = 0.03, steps: int = 2200, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """Gradient descent on the class-weighted, regularised log loss; the bias isn't regularised."""
    n = len(y)
    each = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum()))) / n
    w, b = np.zeros(z.shape[1]), 0.0
    for _ in range(steps):
        rest = each * (1 / (1 + np.exp(-np.clip(z @ w + b, -35, 35))) - y)
        g, gb = z.T @ rest + l2 * w, rest.sum()
        shorten = min(1.0, 20 / max(np.hypot(np.linalg.norm(g), gb), 1e-12))
        w, b = np.clip(w - rate * shorten * g, -50, 50), float(np.clip(b - rate * shorten * gb, -50, 50))
    return w, b


def scaling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians and interquartile ranges (else deviations, else 1)."""
    scale = np.subtract(*np.percentile(x, [75, 25], axis=0))
    scale = np.where(scale > 1e-12, scale, x.std(0))
    return np.median(x, 0), np.where(scale > 1e-12, scale, 1.0)


def fit(x: np.ndarray, y: np.ndarray, k: int = 15, l2: float = 0.03, blend: float = 0.55, threshold: float = 0.445, steps: int = 2200, rate: float = 0.03) -> Model:
    centre, scale = scaling(x)
    z = _scaled(x, centre, scale)
    return Model(centre, scale, z, y.astype(float), *logistic(z, y, l2, steps, rate), min(k, len(y)), blend, threshold)


def nearest(z: np.ndarray, train: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and labels of the ``most`` nearest of train, nearest first."""
    most, size = min(most, len(train)), (train**2).sum(1)
    far, labels = np.empty((len(z), most)), np.empty((len(z), most))
    step = max(1, (1 << 20) // max(1, len(train)))  # distances in 8 MB
    for lo in range(0, len(z), step):
        q = z[lo : lo + step]
        d = (q**2).sum(1)[:, None] - 2 * q @ train.T + size
        at = np.argpartition(d, most - 1, axis=1)[:, :most]
        near = np.sqrt(((q[:, None, :] - train[at]) ** 2).sum(2))  # exact for those that count
        order = np.argsort(near, axis=1, kind="stable")
        far[lo : lo + step], labels[lo : lo + step] = np.take_along_axis(near, order, 1), y[np.take_along_axis(at, order, 1)]
    return far, labels


def neighbours(z: np.ndarray, train: np.ndarray, y: np.ndarray, ks: list[int]) -> list[np.ndarray]:
    """For each k the share of label 1 among the k nearest, by the inverse of distance."""
    near, label = nearest(z, train, y, max(ks))
    w = 1 / (near + 1e-6)
    return [(w * label)[:, :k].sum(1) / w[:, :k].sum(1) for k in ks]


def probability(m: Model, x: np.ndarray) -> np.ndarray:
    z = _scaled(x, m.centre, m.scale)
    line = 1 / (1 + np.exp(-np.clip(z @ m.weights + m.bias, -35, 35)))
    return m.blend * neighbours(z, m.train, m.y, [m.k])[0] + (1 - m.blend) * line


def _sample(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows by a hash of the id; a share of about that many first, so that tasks together send little more."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    return df.where(place < int(min(1, 1.2 * most / max(1, df.count())) * (1 << 40))).orderBy(place, "id").limit(most)


def fit_annotator(df: DataFrame, most: int = MOST_LABELLED, **settings) -> Model:
    """df: id, features, y. The sample's bound is ``most``."""
    rows = _sample(df.where("y is not null"), most).select("features", "y").toPandas()
    return fit(np.stack(rows["features"].to_numpy()).astype(float), rows["y"].to_numpy(float), **settings)


def predict_annotator(df: DataFrame, model: Model) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(pdfs):
        for pdf in pdfs:
            if len(pdf):
                p = probability(shared.value, np.stack(pdf["features"].to_numpy()).astype(float))
                yield pd.DataFrame({"id": pdf["id"], "p": p, "call": (p >= shared.value.threshold).astype("int32")})

    return df.select("id", "features").mapInPandas(run, "id long, p double, call int")


def folds(df: DataFrame, n: int = 5) -> DataFrame:
    """Stratified folds: places within a label, dealt out by hash of the id."""
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy("y", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")) + F.pmod(F.xxhash64("id"), F.lit(64))) % n)


#: The settings that are tried.
SETTINGS = [
    {"k": 7, "l2": 0.03, "blend": 1.0}, {"k": 15, "l2": 0.03, "blend": 1.0}, {"k": 21, "l2": 0.03, "blend": 1.0}, {"k": 15, "l2": 0.03, "blend": 0.0}, {"k": 15, "l2": 0.1, "blend": 0.0},
    {"k": 7, "l2": 0.03, "blend": 0.5}, {"k": 15, "l2": 0.03, "blend": 0.55}, {"k": 15, "l2": 0.1, "blend": 0.55}, {"k": 21, "l2": 0.03, "blend": 0.6},
]


def fold_scales(train: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """`scaling` of the rows outside of each fold, by quantiles over all of them; a row a fold and feature comes to the driver."""
    others = F.array(*(F.lit(f) for f in range(n)))
    values = train.select(F.explode(F.filter(others, lambda f: f != F.col("fold"))).alias("of"), "features").select("of", F.posexplode("features").alias("k", "v"))
    rows = quantiles(values, "v", ["of", "k"], {"q1": 0.25, "median": 0.5, "q3": 0.75}).join(values.groupBy("of", "k").agg(F.stddev_pop("v").alias("sd")), ["of", "k"])
    got = rows.toPandas().sort_values(["of", "k"])
    out = []
    for f in range(n):
        own = got[got["of"] == f]
        scale = (own["q3"] - own["q1"]).to_numpy()
        scale = np.where(scale > 1e-12, scale, own["sd"].to_numpy())
        out.append((own["median"].to_numpy(), np.where(scale > 1e-12, scale, 1.0)))
    return out


def fold_lines(train: DataFrame, scales: list[tuple[np.ndarray, np.ndarray]], l2s: list[float], steps: int) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """`logistic` on all rows outside of each fold, for each l2: weights and bias by (fold, place of the l2).

    A task has a model's rows. It takes them as a stream, and holds them scaled in an unlinked file that is mapped into memory, so of a
    row it holds only the label and the step's error.
    """
    n = len(scales)
    models = F.explode(F.array(*(F.struct(F.lit(f).alias("of"), F.lit(k).alias("at")) for f in range(n) for k in range(len(l2s)))))
    dealt = train.select("features", "y", "fold", models.alias("m")).select("m.of", "m.at", "features", "y", "fold").where("of <> fold").repartitionByRange(n * len(l2s), "of", "at")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple] = {}
        for pdf in pdfs:
            for key, part in pdf.groupby(["of", "at"]):
                file, ys = held.setdefault(key, (tempfile.TemporaryFile(), []))
                file.write(np.ascontiguousarray(_scaled(np.stack(part["features"].to_numpy()).astype(float), *scales[key[0]])).tobytes())
                ys.append(part["y"].to_numpy(float))
        for (f, k), (file, ys) in held.items():
            file.flush()
            y = np.concatenate(ys)
            w, b = logistic(np.memmap(file, float, "r", shape=(len(y), len(scales[f][0]))), y, l2s[k], steps)
            file.close()
            yield pd.DataFrame({"of": [f], "at": [k], "w": [w], "b": [b]})

    return {(r["of"], r["at"]): (np.array(r["w"]), r["b"]) for r in dealt.mapInPandas(run, "of int, at int, w array<double>, b double").collect()}


def fold_neighbours(rows: DataFrame, train: DataFrame, scales: list[tuple[np.ndarray, np.ndarray]], ks: list[int]) -> DataFrame:
    """row and near: for each of ks the share of label 1 among the row's k nearest of all of train outside of its fold, by the inverse of distance.

    Rows of a fold and those that they are compared with are cut into blocks, and a task has one of each; a row keeps its nearest of each block.
    """
    n, most = len(scales), max(ks)
    of_fold = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    cut = [max(1, -(-of_fold.get(f, 0) // SCORED)) for f in range(n)]
    parts = max(1, -(-train.count() // COMPARED))
    blocks_of: Column = F.array(*(F.lit(c) for c in cut))
    every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    part = lambda c: F.pmod(F.xxhash64("row"), c.cast("long")).cast("int")
    queries = rows.select("row", "features", F.col("fold").alias("of")).withColumn("qb", part(F.get(blocks_of, F.col("of")))).withColumn("tb", every(F.lit(parts)))
    points = train.select("row", "features", "y", "fold", F.explode(F.array(*(F.lit(f) for f in range(n)))).alias("of")).where("of <> fold").withColumn("tb", part(F.lit(parts))).withColumn("qb", every(F.get(blocks_of, F.col("of"))))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"row": [], "found": []})
        q, t = (_scaled(np.stack(x["features"].to_numpy()).astype(float), *scales[key[0]]) for x in (a, b))
        near, label = nearest(q, t, b["y"].to_numpy(float), most)
        return pd.DataFrame({"row": a["row"], "found": [[{"d": d, "y": y} for d, y in zip(ds, ys)] for ds, ys in zip(near.tolist(), label.tolist())]})

    met = queries.groupBy("of", "qb", "tb").cogroup(points.groupBy("of", "qb", "tb")).applyInPandas(run, "row long, found array<struct<d: double, y: double>>")
    found = met.groupBy("row").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, most).alias("found"))  # most rows a block of train
    total = lambda k, of: F.aggregate(F.slice("found", 1, k), F.lit(0.0), lambda s, x: s + of(x) / (x["d"] + 1e-6))
    return found.select("row", F.array(*(total(k, lambda x: x["y"]) / total(k, lambda x: F.lit(1.0)) for k in ks)).alias("near"))


def cross_validate(df: DataFrame, settings: list[dict] = SETTINGS, n: int = 5, most: int | None = None, steps: int = 2200) -> DataFrame:
    """A row for each setting: its best cut-off and the metrics there over all labelled rows, each scored by the fold it isn't in; the best setting first.

    Each fold's scales, logistic models and neighbours come from all labelled rows outside of it (only a caller who names ``most`` has
    them from a sample of so many). No rows come to the driver, and the cut-offs are searched by counts.
    """
    from .aggregate import threshold_search

    labelled = folds(df.where("y is not null"), n).select("id", F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"))
    rows = written(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled")
    if rows.isEmpty():
        raise ValueError("there is no labelled row")
    train = rows if most is None else written(_sample(rows, most), "sample")
    l2s, ks = sorted({s["l2"] for s in settings}), sorted({s["k"] for s in settings})
    scales = fold_scales(train, n)
    models = fold_lines(train, scales, l2s, steps)

    def lines(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                x, fold, line = np.stack(pdf["features"].to_numpy()).astype(float), pdf["fold"].to_numpy(), np.empty((len(pdf), len(l2s)))
                for f in np.unique(fold).tolist():
                    for k in range(len(l2s)):
                        w, b = models[f, k]
                        line[fold == f, k] = 1 / (1 + np.exp(-np.clip(_scaled(x[fold == f], *scales[f]) @ w + b, -35, 35)))
                yield pd.DataFrame({"row": pdf["row"], "y": pdf["y"].astype("int32"), "line": list(line)})

    near = fold_neighbours(rows, train, scales, ks)
    both = rows.select("row", "features", "y", "fold").mapInPandas(lines, "row long, y int, line array<double>").join(merged(near), "row")
    each = [F.struct(F.lit(k).alias("setting"), (s["blend"] * F.get("near", F.lit(ks.index(s["k"]))) + (1 - s["blend"]) * F.get("line", F.lit(l2s.index(s["l2"])))).alias("score")) for k, s in enumerate(settings)]
    scored = both.select("y", F.explode(F.array(*each)).alias("s")).select("s.setting", "y", "s.score")
    out = written(threshold_search(scored, ["setting"]), "cross-validated")
    removed(*{t.scratch: t for t in (rows, train)}.values())
    return out.orderBy(F.desc("f1"), F.desc("balanced_accuracy"), F.desc("accuracy"), "fp", "setting")
