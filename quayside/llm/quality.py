"""Quality classifier: byte n-gram indicators scaled by naive Bayes log-count ratios, under a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.frames import with_columns_in_arrow
from quayside.llm.spans import U64, chunks, distinct, mix64
from quayside.llm.store import bound_batches

BUCKETS = 1 << 18


def features_of(column: pa.Array, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct hashed byte n-grams, ascending, and the texts' offsets among them. Case counts."""
    for chunk in chunks(column):
        begin, end = chunk.offsets[:-1], chunk.offsets[1:]
        codes, per = [], []
        for size in sizes:
            code = np.zeros(max(0, len(chunk.data) - size + 1), dtype=U64)
            for k in range(size):
                code = (code << U64(8)) | chunk.data[k : k + len(code)]
            valid = np.zeros(len(code) + 1, dtype=np.int64)
            np.add.at(valid, np.minimum(begin, len(code)), 1)
            np.add.at(valid, np.clip(end - size + 1, np.minimum(begin, len(code)), len(code)), -1)
            inside = np.cumsum(valid[:-1]) > 0
            codes.append((mix64(code[inside] + (U64(size) << U64(56))) >> U64(46)).astype(np.int64))
            per.append(np.maximum(end - begin - size + 1, 0))
        total = np.concatenate([[0], np.cumsum(np.sum(per, axis=0))])
        values = np.empty(total[-1], dtype=np.int64)
        shift = np.zeros(len(chunk), dtype=np.int64)
        for code, n in zip(codes, per, strict=True):
            own = np.concatenate([[0], np.cumsum(n)])
            values[np.repeat(total[:-1] + shift - own[:-1], n) + np.arange(own[-1])] = code
            shift += n
        yield distinct(values, total)


@dataclass
class NaiveBayesSvm:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = sum over features of weights / length, plus bias."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    sizes: tuple[int, ...]

    def margins(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        pad = np.concatenate([self.weights[values], [0.0]])
        square = np.concatenate([(self.ratios[values]) ** 2, [0.0]])
        empty = at[1:] == at[:-1]
        total, norm = (np.where(empty, 0.0, np.add.reduceat(x, at[:-1])) for x in (pad, square))
        return np.where(empty, 0.0, total / np.sqrt(np.maximum(norm, 1e-12))) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        found = [self.margins(v, at) for v, at in features_of(column, self.sizes)]
        margin = np.concatenate(found) if found else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def _pieces(at: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some ``limit`` features together."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def _scaled(flat: np.ndarray, at: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The features' ratios, each row brought to length one."""
    out = np.empty(len(flat), dtype=np.float32)
    for i, j in _pieces(at):
        own, x = at[i : j + 1] - at[i], ratios[flat[at[i] : at[j]]]
        square = np.concatenate([[0.0], np.cumsum(x**2)])[own]
        out[at[i] : at[j]] = x / np.repeat(np.sqrt(np.maximum(np.diff(square), 1e-12)), np.diff(own))
    return out


def _hinge(flat: np.ndarray, at: np.ndarray, use: np.ndarray, y: np.ndarray, scaled: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model by dual coordinate descent.

    min |w|^2/2 + sum cost_i max(0, 1 - y_i w.x_i): each step solves one dual variable, 0 <= alpha_i <= cost_i, and moves
    w along its row. Rows have length one, and a constant feature of value one for the bias, so every row's Q_ii is 2.
    """
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(y))
    begin, end = at[:-1].tolist(), at[1:].tolist()
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(use).tolist():
            r, x = flat[begin[i] : end[i]], scaled[begin[i] : end[i]]
            gradient = y[i] * (w[r] @ x + bias) - 1
            new = min(cost[i], max(0.0, alpha[i] - gradient / (2.0 if len(r) else 1.0)))
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                alpha[i] = new
                w[r] += step * x
                bias += step
        if most < 1e-3:
            break
    return w, bias


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins (Newton's method; smoothed targets)."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-6 * b)
        b += step
        if abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 6000, sizes: tuple[int, ...] = (1, 2, 3), cost: float = 10.0, rounds: int = 30, seed: int = 3) -> NaiveBayesSvm:
    """The model of ``labels`` (doc_id, label 0/1) over ``docs`` (doc_id, text).

    Fitted on at most ``max_rows`` labelled documents, the first by a hash of the id: a bound on what the driver gets,
    which is their distinct hashed n-grams of whole texts. Rows with null id or label don't count; of an id's labels
    the least counts, and of its documents the first by text. Class costs are balanced. Every fifth row is held back to turn margins into probabilities.
    With one class or no rows, every score is that class's share (one half without rows).
    """
    bound_batches(docs.sparkSession)
    own = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("label").cast("int")).alias("label"))
    own = own.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = own.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(max_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features_of(batch.column(2), sizes))
            lengths = np.concatenate([np.diff(at) for _, at in found]) if found else np.zeros(0, dtype=np.int64)
            values = np.concatenate([v for v, _ in found]).astype(np.int32) if found else np.zeros(0, dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["doc_id", "label", "features"])

    ids, y, rows = [], [], []
    for batch in labelled.mapInArrow(run, "doc_id long, label int, features array<int>").toArrow().to_batches():
        ids.append(batch.column(0).to_numpy())
        y.append(np.where(batch.column(1).to_numpy() > 0, 1.0, -1.0))
        lists = batch.column(2)
        own = lists.offsets.to_numpy()
        rows += [lists.values.to_numpy()[a:b] for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
    y = np.concatenate(y) if y else np.zeros(0)
    if len(set(y.tolist())) < 2:
        share = (1 + (y > 0).sum()) / (2 + len(y)) if len(y) else 0.5
        return NaiveBayesSvm(np.ones(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))), sizes)
    order = np.argsort(np.concatenate(ids), kind="stable")  # the same model however the rows came
    y, rows = y[order], [rows[k] for k in order.tolist()]
    flat, at = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    del rows, lists, batch
    counts = {k: np.ones(BUCKETS) for k in (True, False)}
    for i, j in _pieces(at):
        of_up = np.repeat(y[i:j] > 0, np.diff(at[i : j + 1]))
        for k in (True, False):
            counts[k] += np.bincount(flat[at[i] : at[j]][of_up == k], minlength=BUCKETS)
    ratios = np.log(counts[True] / counts[True].sum()) - np.log(counts[False] / counts[False].sum())
    scaled = _scaled(flat, at, ratios)
    each = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    back = np.arange(len(y)) % 5 == 4

    def model(train: np.ndarray) -> tuple[np.ndarray, float]:
        return _hinge(flat, at, np.flatnonzero(train), y, scaled, each, rounds, seed)

    slope, shift = 1.0, 0.0
    if len(set(y[back].tolist())) == 2 and len(set(y[~back].tolist())) == 2:
        w, bias = model(~back)
        held = NaiveBayesSvm(ratios, w * ratios, bias, 1.0, 0.0, sizes)
        margins = np.concatenate([held.margins(flat[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]])) for i in np.flatnonzero(back)])
        slope, shift = _calibrated(margins, y[back])
    w, bias = model(np.ones(len(y), dtype=bool))
    return NaiveBayesSvm(ratios, w * ratios, bias, slope, shift, sizes)


def score(docs: DataFrame, model: NaiveBayesSvm, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` (text, any more) with score (0 to 1) and predicted (1 if score >= threshold). Replaces such columns.

    A null text scores as the empty text. The model (two vectors of fixed size) goes to all tasks; no shuffle.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    where = [f.name for f in docs.schema.fields].index("text")

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = sent.value.scores(batch.column(where))
        return {"score": pa.array(found, pa.float64()), "predicted": pa.array((found >= threshold).astype(np.int32))}

    return with_columns_in_arrow(docs, {"score": T.DoubleType(), "predicted": T.IntegerType()}, make)


def fold(doc_id: str = "doc_id", of: int = 5):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, labels.where(fold() != 0))
    out = score(docs, model, threshold=0.3)
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
