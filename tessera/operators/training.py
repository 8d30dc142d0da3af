"""Supervised training of prototypes: the gradient of the loss in closed form, one job an epoch.

The loss is the mean cross-entropy of the twice soft-maxed cosines (see ``objectives``) plus the separation of the
prototypes. With unit rows x, unit prototypes u, cosines s = x.u, p = softmax(s), e = softmax(p) - onehot(label) and
g = p (e - p.e), the gradient for prototype q is ``(sum_i g_iq x_i - u_q sum_i g_iq s_iq) / (n |c_q|)``, so each task
adds up one k x dim buffer, k sums, the loss and the number of rows. The separation's part needs the prototypes only.
Prototypes and optimiser state are k x dim on the driver.
"""
from __future__ import annotations

from typing import Iterator, NamedTuple, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import COS_EPS
from tessera.operators.kmeans import vector_rows, written

# fixed values: Adam's defaults
BETA_1, BETA_2, ADAM_EPS = 0.9, 0.999, 1e-8


class Epoch(NamedTuple):
    epoch: int
    loss: float             # before the step of this epoch
    cross_entropy: float
    separation: float
    accuracy: float         # share of rows whose nearest prototype is that of their label


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.maximum(np.sqrt((x * x).sum(axis=1)), COS_EPS)
    return x / norm[:, None], norm


def separation(c: np.ndarray) -> tuple[float, np.ndarray]:
    """(sum of cosines over pairs + T) / T with T pairs, and its gradient; 0 for a single prototype."""
    u, norm = _unit(c)
    pairs = len(c) * (len(c) - 1) / 2
    if not pairs:
        return 0.0, np.zeros_like(c)
    cos = u @ u.T
    total = (cos.sum() - np.trace(cos)) / 2
    others = u.sum(axis=0) - u - (cos.sum(axis=1) - np.diag(cos))[:, None] * u
    return float((total + pairs) / pairs), others / norm[:, None] / pairs


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def row_parts(x: np.ndarray, target: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums over rows: g x (k x dim), g s (k), cross-entropy, hits."""
    unit, _ = _unit(x)
    s = unit @ u.T
    p = _softmax(s)
    again = _softmax(p)
    at = np.arange(len(x))
    loss = float(-np.log(again[at, target]).sum())
    e = again
    e[at, target] -= 1.0
    g = p * (e - (p * e).sum(axis=1, keepdims=True))
    return g.T @ unit, (g * s).sum(axis=0), loss, int((s.argmax(axis=1) == target).sum())


def gradient(rows: DataFrame, qs: Sequence[int], c: np.ndarray, vec: str = "x", label: str = "label"):
    """(gradient k x dim, cross-entropy, separation, accuracy) over the rows whose label has a prototype; one job.

    A task's sums are one row for each prototype: its part of the gradient, and (with the first) loss, rows and hits.
    """
    u, norm = _unit(c)
    number = {q: i for i, q in enumerate(qs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gx, gs, loss, hits, n = np.zeros_like(u), np.zeros(len(u)), 0.0, 0, 0
        for batch in batches:
            target = np.array([number.get(v, -1) for v in batch.column(1).to_pylist()], np.int64)
            x = vector_rows(batch.column(0))[target >= 0]
            if len(x):
                parts = row_parts(x, target[target >= 0], u)
                gx, gs, loss, hits, n = gx + parts[0], gs + parts[1], loss + parts[2], hits + parts[3], n + len(x)
        first = np.arange(len(u)) == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(u)), pa.int32()), pa.array(gx.tolist(), pa.list_(pa.float64())), pa.array(gs),
             pa.array(np.where(first, loss, 0.0)), pa.array(np.where(first, n, 0)), pa.array(np.where(first, hits, 0))],
            ["i", "gx", "gs", "loss", "n", "hits"])

    parts = rows.select(vec, label).mapInArrow(run, "i int, gx array<double>, gs double, loss double, n long, hits long")
    sums = parts.groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("gx"))).alias("gx"), F.sum("gs").alias("gs"), F.sum("loss").alias("loss"),
        F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    n = sum(r["n"] for r in sums)
    out = np.zeros_like(u)
    for r in sums:
        if n:
            out[r["i"]] = (np.array(r["gx"]) - r["gs"] * u[r["i"]]) / (n * norm[r["i"]])
    apart, push = separation(c)
    return (out + push, sum(r["loss"] for r in sums) / n if n else 0.0, apart, sum(r["hits"] for r in sums) / n if n else 0.0)


class Adam:
    """State of Adam for one k x dim parameter."""

    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, 0.0, 0.0, 0

    def step(self, c: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = BETA_1 * self.m + (1 - BETA_1) * g
        self.v = BETA_2 * self.v + (1 - BETA_2) * g * g
        return c - self.rate * (self.m / (1 - BETA_1 ** self.t)) / (np.sqrt(self.v / (1 - BETA_2 ** self.t)) + ADAM_EPS)


def train(df: DataFrame, start: list[tuple[int, Sequence[float]]], epochs: int, rate: float, vec: str = "x",
          label: str = "label") -> tuple[list[tuple[int, list[float]]], list[Epoch]]:
    """Prototypes (q, c) after ``epochs`` full-batch Adam steps from ``start``, and the figures before each step and
    after the last. An epoch that raises the loss is taken back and the rate halved, so the loss never rises."""
    rows = written(df, [vec, label], vec)
    qs, c = [q for q, _ in start], np.array([list(v) for _, v in start], np.float64)
    adam, log = Adam(rate), []
    kept, g = c, None
    for epoch in range(epochs + 1):
        grad, entropy, apart, accuracy = gradient(rows, qs, c, vec, label)
        if log and entropy + apart > log[-1].loss:
            adam = Adam(adam.rate / 2)
            c = adam.step(kept, g)
            continue
        kept, g = c, grad
        log.append(Epoch(epoch, entropy + apart, entropy, apart, accuracy))
        c = adam.step(kept, g)
    return list(zip(qs, kept.tolist())), log
