"""Classification head on embeddings, and the tensors a pluggable encoder gets.

The encoder itself is an input: any function from tensors to embeddings.  What it makes
of a chip is a column of embeddings; the head's weights are a small fixed-size table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON, SIDE, BATCH = 1e-6, 224, 16
_ERF = np.vectorize(math.erf, otypes=[float])


def linear_softmax(embedding: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Class probabilities of a linear head, in the JVM."""
    scores = [F.aggregate(F.zip_with(embedding, F.array(*map(F.lit, w)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) + F.lit(b) for w, b in zip(weights, bias)]
    return softmax(F.array(*scores))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def argmax(scores: Column) -> Column:
    """Index of the largest score; of equal ones the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def resized(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Bands resized by bilinear interpolation between pixel centres, edges repeated."""
    out = image.astype(np.float32)
    for axis in (1, 2):
        n = out.shape[axis]
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, n - 1)
        t = (at - lo).astype(np.float32).reshape([-1 if a == axis else 1 for a in range(3)])
        out = np.take(out, lo, axis) * (1 - t) + np.take(out, hi, axis) * t
    return out


def tensor(image: np.ndarray, mean=None, std=None, side: int = SIDE) -> np.ndarray:
    """A chip (bands, height, width) of bytes over 255, resized and normalised."""
    t = resized(image / 255.0, side)
    if mean is not None:
        shape = (-1, 1, 1)
        t = (t - np.reshape(mean, shape)) / (np.reshape(std, shape) + EPSILON)
    return t.astype(np.float32)


def augmented(t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A tensor flipped either way half the time, turned by quarter turns, bands scaled by 0.8 to 1.2."""
    if rng.random() < 0.5:
        t = t[:, :, ::-1]
    if rng.random() < 0.5:
        t = t[:, ::-1]
    t = np.rot90(t, rng.integers(4), axes=(1, 2))
    return t * rng.uniform(0.8, 1.2, (t.shape[0], 1, 1)).astype(t.dtype)


def encode(chips: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], mean=None, std=None, batch: int = BATCH, variants: int = 0, seed: int = 42) -> DataFrame:
    """chips (keys, bands, h, w, data) as keys, variant and ``embedding``: the encoder's output of batches of tensors.

    The encoder gets (n, 6, 3, side, side): three bands in six slots, one frame three times.  Variant 0 is
    the chip; for training, ``variants`` more are augmented, by draws that depend on seed, chip and variant only.
    """
    keys = [f for f in chips.schema.fields if f.name not in ("bands", "h", "w", "data")]
    schema = T.StructType([*keys, T.StructField("variant", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    names = [f.name for f in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            todo = [(i, v) for i in range(len(b)) for v in range(variants + 1)]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                x = []
                for i, variant in part:
                    bands, h, w, data = (b[c].iloc[i] for c in ("bands", "h", "w", "data"))
                    t = tensor(np.frombuffer(data, np.uint8).reshape(bands, h, w), mean, std)
                    if variant:
                        t = augmented(t, np.random.default_rng([seed, variant, zlib.crc32(data)]))
                    six = np.zeros((6, *t.shape[1:]), np.float32)
                    six[1], six[2], six[3] = t[2], t[1], t[0]
                    x.append(np.repeat(six[:, None], 3, 1))
                out = b[names].iloc[[i for i, _ in part]]
                yield out.assign(variant=np.array([v for _, v in part], np.int32), embedding=[e.astype(np.float32).tolist() for e in encoder(np.stack(x))])

    return chips.select(*names, "bands", "h", "w", "data").mapInPandas(run, schema)


def forward(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Class probabilities of rows of embeddings: layer norm, linear, GELU, linear, softmax."""
    x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * w["scale"] + w["shift"]
    h = x @ w["w1"] + w["b1"]
    h = h * 0.5 * (1 + _ERF(h / math.sqrt(2)))
    s = h @ w["w2"] + w["b2"]
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int = 2, hidden: int = 256, epochs: int = 30, rate: float = 1e-3, decay: float = 1e-4, dropout: float = 0.3, val_share: float = 0.2, seed: int = 42) -> tuple[dict[str, np.ndarray], list[dict]]:
    """The head's weights at the best epoch, and each epoch's loss and accuracy.

    Full-width Adam with decoupled decay and a cosine rate over a sample of labelled rows
    that the caller bounds; of epochs with equal validation accuracy the last counts.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    order = rng.permutation(n)
    n_val = max(1, int(n * val_share)) if n > 1 else 0
    val, train = order[:n_val], order[n_val:]
    w = {"scale": np.ones(d), "shift": np.zeros(d), "w1": rng.normal(0, 1 / math.sqrt(d), (d, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / math.sqrt(hidden), (hidden, classes)), "b2": np.zeros(classes)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    log, best, step = [], None, 0
    for epoch in range(epochs):
        lr = rate / 2 * (1 + math.cos(math.pi * epoch / epochs))
        loss = 0.0
        # each row once an epoch, in an order of its own
        order = rng.permutation(train)
        for at in range(0, len(train), BATCH * 4):
            i = order[at : at + BATCH * 4]
            g, part = _gradient(x[i], y[i], w, dropout, rng)
            loss += part * len(i)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] * (1 - lr * decay) - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        acc = float((forward(x[val], w).argmax(1) == y[val]).mean()) if n_val else 0.0
        log.append({"epoch": epoch, "train_loss": loss / max(1, len(train)), "val_acc": acc})
        if best is None or acc >= best[0]:
            best = (acc, {k: a.copy() for k, a in w.items()})
    return best[1], log


def _gradient(x, y, w, dropout, rng):
    mu, var = x.mean(1, keepdims=True), x.var(1, keepdims=True)
    z = (x - mu) / np.sqrt(var + 1e-5)
    a = z * w["scale"] + w["shift"]
    h = a @ w["w1"] + w["b1"]
    cdf = 0.5 * (1 + _ERF(h / math.sqrt(2)))
    keep = (rng.random(h.shape) >= dropout) / (1 - dropout)
    u = h * cdf * keep
    s = u @ w["w2"] + w["b2"]
    e = np.exp(s - s.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    n = len(y)
    loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-12)).mean())
    ds = p.copy()
    ds[np.arange(n), y] -= 1
    ds /= n
    du = ds @ w["w2"].T * keep
    dh = du * (cdf + h * np.exp(-h * h / 2) / math.sqrt(2 * math.pi))
    da = dh @ w["w1"].T
    return {"scale": (da * z).sum(0), "shift": da.sum(0), "w1": a.T @ dh, "b1": dh.sum(0), "w2": u.T @ ds, "b2": ds.sum(0)}, loss


def predict(rows: DataFrame, weights: dict[str, np.ndarray], embedding: str = "embedding") -> DataFrame:
    """rows with predicted and confidence of the head, in Arrow batches."""
    schema = T.StructType([*rows.schema.fields, T.StructField("predicted", T.IntegerType()), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = forward(np.stack(b[embedding].to_numpy()).astype(float), weights)
                yield b.assign(predicted=p.argmax(1).astype(np.int32), confidence=p.max(1))

    return rows.filter(F.col(embedding).isNotNull()).mapInPandas(run, schema)
