"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `WORDS` words. Each passage is described by shares of its bytes and by statistics
of its words, and encoded by a layer with tanh; gated attention (a tanh gate times a sigmoid gate) weighs the
passages, and a logistic layer scores the weighted sum. Labels belong to documents only. Training is plain Adam in
numpy on the driver, on a sample of whole labelled documents with bounds on their number and bytes; scoring runs over
whole texts on the executors.

Rows: a null text counts as empty; an empty text is one passage without words and gets a score like any other.
Labels that are null or not 0 or 1, and labels without a document, are left out of training; without any label, or
with one class only, every score is the share of label 1 (0.5 if there is no label). Repeated rows get equal scores;
an empty table gives an empty table. Scores use no column but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.shared import bounded, lean, small_batches, trim

WORDS = 64
#: Bytes of text that are described at once.
STEP = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WIDTH = 256 + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the text each belongs to; every text has a passage at least."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~SPACE[data]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stops = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
    text_of = np.searchsorted(ends, begins, "right")
    first_word = np.searchsorted(text_of, np.arange(len(texts)))
    nth = np.arange(len(begins)) - first_word[text_of]
    words = np.bincount(text_of, minlength=len(texts))
    per = np.maximum(1, -(-words // WORDS))
    first_passage = np.cumsum(per) - per
    passage_of = first_passage[text_of] + nth // WORDS
    n, owner = int(per.sum()), np.repeat(np.arange(len(texts)), per)

    starts = np.zeros(n, np.int64)  # a passage's bytes reach to the next one's first word
    starts[first_passage] = np.concatenate([[0], ends[:-1]])
    later = np.flatnonzero((nth % WORDS == 0) & (nth > 0))
    starts[passage_of[later]] = begins[later]
    sizes = np.diff(np.append(starts, len(data)))
    counts = np.bincount(np.repeat(np.arange(n) << 8, sizes) + data, minlength=n << 8).reshape(n, 256).astype(np.float32)
    shares = np.sqrt(counts / np.maximum(1, sizes)[:, None]).astype(np.float32)

    in_passage = np.bincount(passage_of, minlength=n).astype(np.float32)
    some = np.maximum(1, in_passage)
    length = (stops - begins).astype(np.float64)
    power = np.cumprod(np.full(len(data), 0x9E3779B97F4A7C15, np.uint64)) if len(data) else np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.cumprod(np.full(len(data), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)) if len(data) else power
    word = (total[stops] - total[begins]) * back[begins] if len(begins) else np.zeros(0, np.uint64)
    word ^= word >> np.uint64(29)
    order = np.lexsort((word, passage_of))
    w, p = word[order], passage_of[order]
    fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] != p[:-1])])[: len(w)]
    distinct = np.bincount(p[fresh], minlength=n)
    same_as_next = np.bincount(passage_of[:-1][(word[1:] == word[:-1]) & (passage_of[1:] == passage_of[:-1])], minlength=n) if len(word) > 1 else np.zeros(n)
    mean = np.bincount(passage_of, length, n) / some
    square = np.bincount(passage_of, length**2, n) / some
    short = np.bincount(passage_of, length <= 2, n) / some
    last = data[np.maximum(stops - 1, 0)] if len(stops) else data[:0]
    marked = np.bincount(passage_of, (last < 128) & ~np.isin(last, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?\"')", np.uint8)), n) / some
    rest = np.stack([distinct / some, same_as_next / some, mean / 10, np.sqrt(np.maximum(0, square - mean**2)) / 10, short, marked, np.log1p(in_passage) / 4, (per == 1)[owner]], axis=1)
    return np.concatenate([shares, rest.astype(np.float32)], axis=1), owner


@dataclass
class Model:
    """x -> h = tanh((x - mean) * scale @ w + b); attention from h; score from the weighted sum."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    share: float = 0.5

    @staticmethod
    def forward(weights: list[np.ndarray], x: np.ndarray, owner: np.ndarray, bags: int) -> tuple:
        w, b, v, u, a, c, d = weights
        h = np.tanh(x @ w + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ a
        # Attention within each bag, against the bag's largest logit.
        first = np.searchsorted(owner, np.arange(bags))
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        e /= np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(h * e[:, None], first, axis=0)
        logit = z @ c + d[0]
        return h, t, s, e, z, 1 / (1 + np.exp(-logit))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.weights:
            return np.full(len(texts), self.share)
        x, owner = passages(texts)
        return self.forward(self.weights, (x - self.mean) * self.scale, owner, len(texts))[-1].astype(np.float64)


def train(x: np.ndarray, owner: np.ndarray, label: np.ndarray, hidden: int = 32, gates: int = 16, epochs: int = 24, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """x: passages sorted by owner; label: of each owner, 0 or 1."""
    share = float(label.mean()) if len(label) else 0.5
    total, square = np.zeros((2, x.shape[1]))
    for at in range(0, len(x), 8192):  # the passages stay as they are, in half precision; only steps of them grow
        step = x[at : at + 8192].astype(np.float64)
        total, square = total + step.sum(0), square + (step * step).sum(0)
    mean = (total / max(1, len(x))).astype(np.float32)
    spread = np.sqrt(np.maximum(0, square / max(1, len(x)) - mean.astype(np.float64) ** 2))
    scale = (1 / np.maximum(spread, 0.02)).astype(np.float32)
    if len(np.unique(label)) < 2:
        return Model(mean, scale, [], share)
    r = np.random.default_rng(seed)
    make = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = [make(x.shape[1], hidden), np.zeros(hidden, np.float32), make(hidden, gates), make(hidden, gates), make(gates), make(hidden), np.array([np.log(share / (1 - share))], np.float32)]
    m, q, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    bounds = np.searchsorted(owner, np.arange(len(label) + 1))
    total = epochs * -(-len(label) // batch)
    for _ in range(epochs):
        shuffled = r.permutation(len(label))
        for at in range(0, len(label), batch):
            bags = shuffled[at : at + batch]
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in bags])
            own = np.repeat(np.arange(len(bags)), [bounds[i + 1] - bounds[i] for i in bags])
            xb = (x[rows].astype(np.float32) - mean) * scale
            w, b, v, u, a, c, d = weights
            h, t, s, e, z, y = Model.forward(weights, xb, own, len(bags))
            g = ((y - label[bags]) / len(bags)).astype(np.float32)
            dz = g[:, None] * c
            de_raw = (h * dz[own]).sum(1)
            first = np.searchsorted(own, np.arange(len(bags)))
            de = e * (de_raw - np.add.reduceat(e * de_raw, first)[own])
            dts = de[:, None] * a
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh = (e[:, None] * dz[own] + dt @ v.T + ds @ u.T) * (1 - h * h)
            grads = [xb.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ g, np.array([g.sum()])]
            step += 1
            now = rate * (1 - step / total) + 1e-4
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                q[i] = 0.999 * q[i] + 0.001 * grad * grad
                weights[i] = (weights[i] * (1 - now * decay) - now * (m[i] / (1 - 0.9**step)) / (np.sqrt(q[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, weights, share)


def held_out(key: Column) -> Column:
    """A quarter of the rows, by the checksum of the key as text; labels of these are never learned."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def fit(documents: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", sample: int = 8000, most_bytes: int = 48 << 20) -> Model:
    """A model of the labels of documents that are not held out.

    The sample is bounded by `sample` documents and by `most_bytes` of text together: documents in the order of their
    keys' hashes, up to the first that passes a bound (that one still counts). Of each all passages are learned from.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).select(F.col(key).alias("_k"), F.col(label).alias("_y"))
    known = known.groupBy("_k").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(sample)
    texts = documents.select(F.col(key).alias("_d"), F.col(text).alias("_text"))
    sizes = texts.join(F.broadcast(known), F.col("_d") == F.col("_k")).select("_k", F.xxhash64("_k").alias("_h"), F.coalesce(F.octet_length("_text"), F.lit(0)).alias("_n")).toArrow()
    order = np.lexsort((sizes["_k"].to_numpy(), sizes["_h"].to_numpy()))
    total = np.cumsum(sizes["_n"].to_numpy()[order], dtype=np.int64)
    last = sizes["_h"].to_numpy()[order[: int(np.searchsorted(total, most_bytes)) + 1][-1:]].tolist()
    known = known.where(F.xxhash64("_k") <= last[0]) if last else known

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, stop in bounded(b.column(2), STEP):
                part = b.slice(at, stop - at)
                x, owner = passages([(t or "").encode("utf-8", "replace") for t in part.column(2).to_pylist()])
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                made = [x[i:j].astype(np.float16).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.int32()), pa.array(made, pa.binary())], ["k", "y", "x"])

    rows = texts.join(F.broadcast(known), F.col("_d") == F.col("_k")).select("_k", "_y", "_text").mapInArrow(lean(described), "k long, y int, x binary").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), [])
    order = np.argsort(rows["k"].to_numpy(), kind="stable")
    label_of, xs = rows["y"].to_numpy()[order].astype(np.float32), rows["x"].to_pylist()
    bags = [np.frombuffer(xs[i], np.float16).reshape(-1, WIDTH) for i in order]
    owner, x = np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate(bags)
    del rows, xs, bags
    model = train(x, owner, label_of)
    del x
    trim()
    return model


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """df with the score of its texts, between 0 and 1; a column of that name is replaced."""
    small_batches(df.sparkSession)
    kept = [f.name for f in df.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            made, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= STEP):
                    size += len(texts[end])
                    end += 1
                made.append(model.scores(texts[at:end]))
                at = end
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in kept), pa.array(np.concatenate(made) if made else np.zeros(0))], [*kept, name])

    return df.mapInArrow(lean(run), T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.DoubleType())]))
