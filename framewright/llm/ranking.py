"""Bradley-Terry quality scores: utilities learned from preference pairs, calibrated at a score quantile.

Features are a text's own counts and histogram distances (language, source and id are no inputs).  Each
pair of a preferred and a rejected labelled document asks that the preferred one's utility be larger; the
logistic loss of utility differences is minimised over the feature weights.  A quantile of the labelled
utilities, the one that separates the labels best, becomes the threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .shared import let, scratch, stage_out

FEATURES = ["class_distance", "word_distance", "word_excess", "repeat_share", "symbol_share", "dup_share", "log_words", "word_length", "class_sq", "word_sq", "short"]
#: At most about so many labelled rows are fitted on, and so many pairs are formed of them.
SAMPLE_ROWS = 20_000
PAIRS = 200_000
#: The score at the threshold.
CUT = 0.7


@dataclass(frozen=True)
class Model:
    """Everything a score needs: references of the histograms, scaling, weights, and the calibration."""

    references: dict
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    quantile: float
    threshold: float
    spread: float


def features(measures: Column, references: dict) -> Column:
    """The features of a text, from its measures, as an array in the order of FEATURES."""

    def made(v: Column) -> Column:
        n = F.greatest(v["n_words"], F.lit(1)).cast("double")
        c, d = v["class_distance"], v["word_distance"]
        return F.array(
            c,
            d,
            d - 2.2 / F.sqrt(n + 20),  # chance alone gives a short text some distance
            v["n_repeat_words"] / n,
            F.least(v["n_symbols"] / n, F.lit(3.0)),
            F.least(v["n_dup_lines"] / F.sqrt(n), F.lit(3.0)),
            F.log1p(n),
            F.least(v["word_chars"] / n, F.lit(20.0)),
            c * c,
            d * d,
            F.when(v["n_words"] < 10, 1.0).otherwise(0.0),
        )

    return let(rules.verdict(measures, references, rules.Limits()), made)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights that minimise the mean logistic loss of preferred minus rejected feature rows, plus a ridge (Newton)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    rng = np.random.Generator(np.random.PCG64(seed))
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # how far each pair is from settled
        gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def best_quantile(u: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the utilities at which cutting gives the best mean of both labels' accuracy."""
    if not len(u):
        return 0.0
    order = np.argsort(u, kind="stable")
    su, sy = u[order], y[order]
    n1, n0 = max(1, int((sy == 1).sum())), max(1, int((sy == 0).sum()))
    below0, below1 = np.concatenate(([0], np.cumsum(sy == 0))), np.concatenate(([0], np.cumsum(sy == 1)))
    balanced = below0 / n0 + (n1 - below1) / n1
    ties = np.concatenate(([True], su[1:] > su[:-1], [True]))
    return int(np.argmax(np.where(ties, balanced, -1))) / len(su)


def at_quantile(u: np.ndarray, quantile: float) -> float:
    """The utility that has the share ``quantile`` of all below it: midway between neighbours, just outside at the ends."""
    if not len(u):
        return 0.0
    su, k = np.sort(u), round(quantile * len(u))
    if k == 0:
        return float(su[0]) - 1e-9
    if k == len(su):
        return float(su[-1]) + 1e-9
    return float((su[k - 1] + su[k]) / 2)


#: Columns of a table of measures.
ID, MEASURES = "id", "measures"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures) of each row; the language is guessed from the text, whatever its column says.

    Only the id and the text are read, so other columns may have any names.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias(ID), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rules.measured(slim, [ID], MEASURES, "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """As :func:`fit_measured`, on texts that are measured for it."""
    with scratch(docs.sparkSession):
        return fit_measured(stage_out(measure(docs, id_col, text_col), "rank-measures"), labels, id_col, label_col, sample_rows)


def fit_measured(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows that are not held out.

    Labels are sampled by a hash of the id, about ``sample_rows`` of them whatever their number; a
    document with contradicting labels or none, or a null id, is left out; of documents that share an id
    one counts, the one whose measures hash least, so ``sample_rows`` bounds what reaches the driver.  The
    references of the histograms come from all documents and no label.  Empty tables, or one label only,
    give a model without preferences.
    """
    references = rules.fit_references(table, MEASURES)
    labels = labels.select(F.col(f"`{id_col}`").alias(ID), F.col(f"`{label_col}`").alias("label"))
    usable = labels.where(F.col(ID).isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col(ID)))
    n = usable.count()
    share = min(1.0, sample_rows / max(1, n))
    chosen = usable.where(F.pmod(F.xxhash64(ID, F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else usable
    settled = chosen.groupBy(ID).agg(F.min("label").alias("y"), F.max("label").alias("z")).where("y = z").select(F.col(ID).alias("__id"), "y")
    # about sample_rows small rows, so their size is bounded by the parameter
    sample = table.join(F.broadcast(settled), table[ID] == F.col("__id"))
    sample = sample.select("__id", "y", F.xxhash64(MEASURES).alias("h"), features(F.col(MEASURES), references).alias("x")).groupBy("__id", "y").agg(F.min_by("x", "h").alias("x"))
    rows = sorted((r["__id"], r["y"], r["x"]) for r in sample.collect())
    x, y = np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows])
    if not len(rows):
        return Model(references, *[(0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * len(FEATURES)], 0.0, -1.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    w = fit_pairs(z, y)
    u = z @ w
    quantile = best_quantile(u, y)
    return Model(references, tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), quantile, at_quantile(u, quantile), float(max(u.std(), 1e-6)))


def score_measured(table: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """As :func:`score_documents`, from measures."""
    terms = [(F.col("x")[k] - m) / s * w for k, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights))]
    utility = sum(terms[1:], terms[0])
    shift = math.log(CUT / (1 - CUT))
    score = 1 / (1 + F.exp(-((F.col("u") - model.threshold) / model.spread + shift)))
    scored = table.select(ID, features(F.col(MEASURES), model.references).alias("x")).select(ID, utility.alias("u")).select(ID, score.alias("score"))
    return scored.select(F.col(ID).alias(id_col), held_out(F.col(ID)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score (0 to 1, ``CUT`` at the threshold) and predicted, one row per row of ``docs``.

    Null texts are scored as empty; repeated rows score alike; a null id is not held out; an empty table
    gives no rows; very long texts are scored whole; other columns are not read, whatever their names, and
    the id column may have any name but a result column's.  Expressions only, and no shuffle.
    """
    return score_measured(measure(docs, id_col, text_col), model, id_col)


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """:func:`fit` and :func:`score_documents` on the same documents, each measured once."""
    with scratch(docs.sparkSession) as result:
        table = result(measure(docs, id_col, text_col), "rank-measures")
        return score_measured(table, fit_measured(table, labels, id_col, label_col, sample_rows), id_col)
