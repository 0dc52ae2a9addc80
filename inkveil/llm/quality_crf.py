"""Operator 10: document quality from a linear-chain CRF over lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled documents, at most, that the model is fitted on; which ones, a hash of the id decides.
SAMPLE_DOCS = 4000
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
N_OWN = 12


def lines_of(text: str | None) -> list[str]:
    """Lines with a word; a text without any is one empty line."""
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


def line_features(lines: list[str]) -> np.ndarray:
    """A row for each line: what the line looks like, in shares from 0 to 1."""
    seen: set[str] = set()
    out = []
    for line in lines:
        words = line.split()
        n, size = len(words), max(1, len(line))
        if not n:
            out.append((0.0,) * N_OWN)
            continue
        grams = len(set(zip(words, words[1:], words[2:])))
        out.append((
            math.log1p(n) / 10,
            min(1.0, size / n / 20),
            sum(map(str.isupper, words)) / n,
            min(1.0, (len(line) - len(line.translate(SYMBOLS))) / n),
            min(1.0, line.count("!") / n),
            sum(map(line.count, "0123456789")) / size,
            len(set(words)) / n,
            sum(map(str.__eq__, words, words[1:])) / n,
            float(line.rstrip()[-1:] in ".!?"),
            float(line in seen),
            1 - grams / (n - 2) if n > 2 else 0.0,
            float(n < 4),
        ))
        seen.add(line)
    return np.array(out)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, the previous and the next line's (zeros at the ends), whether there are such lines, and 1."""
    n = len(x)
    out = np.zeros((n, 3 * N_OWN + 3))
    out[:, :N_OWN] = x
    out[1:, N_OWN : 2 * N_OWN] = x[:-1]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = x[1:]
    out[1:, -3] = out[:-1, -2] = out[:, -1] = 1
    return out


@dataclass
class Model:
    weights: np.ndarray  # for the good label; the bad label's are zero
    moves: np.ndarray  # 2 x 2, from label to label
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good label of each line, by forward and backward messages in log odds."""
        (a, b), (c, d) = np.exp(self.moves).tolist()
        u = np.clip(with_neighbours(x) @ self.weights, -50, 50).tolist()
        n = len(u)
        ahead, back = [0.0] * n, [0.0] * n
        f = ahead[0] = u[0]
        for i in range(1, n):
            e = math.exp(f)
            f = ahead[i] = u[i] + math.log((b + e * d) / (a + e * c))
            f = max(-60.0, min(60.0, f))
        s = 0.0
        for i in range(n - 2, -1, -1):
            e = math.exp(max(-60.0, min(60.0, u[i + 1] + s)))
            s = back[i] = math.log((c + e * d) / (a + e * b))
        return 1 / (1 + np.exp(-np.clip(np.add(ahead, back), -60, 60)))

    def score(self, text: str | None) -> float:
        """Length-weighted mean of the lines' marginals, calibrated to the probability of label 1."""
        lines = lines_of(text)
        weights = np.array([len(x) + 1 for x in lines], float)
        share = float(weights @ self.marginals(line_features(lines)) / weights.sum())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * share + self.shift))))


def _gradient(u: np.ndarray, y: np.ndarray, on: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of labels y (documents x lines), by unary log odds and by moves. on: where there is a line."""
    (a, b), (c, d) = np.exp(moves)
    n, t = u.shape
    ahead, back = np.zeros((n, t)), np.zeros((n, t))
    ahead[:, 0] = u[:, 0]
    for i in range(1, t):
        e = np.exp(np.clip(ahead[:, i - 1], -60, 60))
        ahead[:, i] = u[:, i] + np.log((b + e * d) / (a + e * c))
    for i in range(t - 2, -1, -1):
        e = np.exp(np.clip(u[:, i + 1] + back[:, i + 1], -60, 60))
        back[:, i] = np.where(on[:, i + 1], np.log((c + e * d) / (a + e * b)), 0)
    p = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
    both = on[:, 1:]
    first, second = np.clip(ahead[:, :-1], -60, 60), np.clip(u[:, 1:] + back[:, 1:], -60, 60)
    pairs = np.exp(np.stack([np.stack([moves[i, j] + i * first + j * second for j in (0, 1)]) for i in (0, 1)]))
    pairs /= pairs.sum((0, 1))
    seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)])
    return (y - p) * on, seen - (pairs * both).sum((2, 3))


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 3, epochs: int = 12, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """A model from documents' line features, line lengths and labels (1 good, 0 bad).

    Every line of a good document counts as good. In the first round every line of a bad one counts as bad, later those that
    the last round finds bad, and its worst line. The calibration is a logistic regression on the documents' shares.
    """
    model = Model(np.zeros(3 * N_OWN + 3), np.zeros((2, 2)))
    order = np.argsort([len(x) for x in features], kind="stable")
    wide = [with_neighbours(x) for x in features]
    good = max(1e-9, labels.mean())
    lines = [np.full(len(x), y) for x, y in zip(features, labels)]
    for turn in range(rounds):
        if turn:
            for k in np.nonzero(labels == 0)[0]:
                p = model.marginals(features[k])
                lines[k] = (p >= 0.5).astype(int)
                lines[k][np.argmin(p)] = 0
        theta, m, v, step = np.concatenate([model.weights, model.moves.ravel()]), 0.0, 0.0, 0
        for _ in range(epochs):
            for at in range(0, len(order), 256):
                part = order[at : at + 256]
                t = max(len(features[k]) for k in part)
                x, y, on = np.zeros((len(part), t, wide[0].shape[1])), np.zeros((len(part), t)), np.zeros((len(part), t), bool)
                weight = np.where(labels[part] == 1, 0.5 / good, 0.5 / max(1e-9, 1 - good))
                for r, k in enumerate(part):
                    x[r, : len(wide[k])], y[r, : len(wide[k])], on[r, : len(wide[k])] = wide[k], lines[k], True
                gu, gm = _gradient(np.clip(x @ theta[:-4], -50, 50), y, on, theta[-4:].reshape(2, 2))
                total = max(1, on.sum())
                g = np.concatenate([np.einsum("nt,ntf->f", gu * weight[:, None], x), gm.ravel()]) / total - decay * theta
                step += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model = Model(theta[:-4], theta[-4:].reshape(2, 2))
    share = np.array([w @ model.marginals(x) / w.sum() for x, w in zip(features, lengths)])
    z, ridge = np.stack([share, np.ones_like(share)], 1), np.diag([1e-3, 1e-3])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        beta = beta + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (labels - p) - ridge @ beta)
    return Model(model.weights, model.moves, float(beta[0]), float(beta[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most `sample_docs` labelled documents, chosen by a hash of their ids. Null labels and ids are left out; of texts with one id, the one with the least hash is learned."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(chosen, "_id").groupBy("_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [lines_of(t) for t in pdf["_t"]]
            yield pd.DataFrame({"id": pdf["_id"], "x": [line_features(x).ravel() for x in lines], "w": [[len(y) + 1.0 for y in x] for x in lines], "y": pdf["_y"]})

    got = rows.mapInPandas(run, "id long, x array<double>, w array<double>, y int").toPandas().sort_values("id")
    if got.empty or got["y"].nunique() < 2:
        return Model(np.zeros(3 * N_OWN + 3), np.zeros((2, 2)), 0.0, 0.0 if got.empty or got["y"].iloc[0] else -1.0)
    return fit([np.asarray(x).reshape(-1, N_OWN) for x in got["x"]], [np.asarray(w) for w in got["w"]], got["y"].to_numpy(int))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """`docs` with the score (0 to 1) appended as `into`, replacing a column of that name. Null and empty texts are scored as one empty line."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(into, of(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def quality_model(spark: SparkSession, sf_dir: str) -> Model:
    """The model of labels.quality, learned from rows that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return train(table(spark, sf_dir, "documents"), labels)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_model(spark, sf_dir)
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
