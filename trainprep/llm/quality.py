"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is described by how its bytes fall into
character classes, by class pairs and by word repetition, and encoded by a small dense
layer. Gated attention (a tanh branch times a sigmoid branch) gives each passage a
weight; the weighted mean of the encodings is scored by a logistic layer. Only document
labels are used for training; the attention weights are learned with the rest.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainprep.llm.common import slices, without, worker_cache

#: Words in a passage.
PASSAGE_WORDS = 80
#: Labelled documents used for training, at most; the lowest by seeded hash.
MAX_TRAIN = 3000
#: Default bound on the passages of one training document (80,000 words), which keeps the
#: driver's memory bounded; evenly spaced beyond it. Scoring takes every passage.
MAX_TRAIN_PASSAGES = 1000

# Character classes of a byte: space, line end, a-z, A-Z, digit, full stop, comma, ! ? ; :,
# quotes and brackets, symbols, other ASCII, UTF-8 lead, UTF-8 tail.
N_CLASSES = 13
_CLASS = np.full(256, 10, np.uint8)
for _i, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",",
                             b"!?;:", b"'\"()[]{}", b"#*$%&|<>")):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _i
_CLASS[0x80:0xC0] = 12
_CLASS[0xC0:] = 11
#: Class counts, class pairs, and word length, repeated words in the passage, repeated
#: words in the document, log words of the document.
N_FEATURES = N_CLASSES + N_CLASSES ** 2 + 4


def _first_seen(values: np.ndarray) -> np.ndarray:
    """True where a value occurs for the first time."""
    _, at = np.unique(values, return_index=True)
    out = np.zeros(len(values), bool)
    out[at] = True
    return out


def passages(text: str | None, words: int = PASSAGE_WORDS) -> np.ndarray:
    """Features of every passage (passages x N_FEATURES); one row of zeros without words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8)
    kind = _CLASS[data].astype(np.int64)
    gap = kind <= 1
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    n = len(start)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    end = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    k = -(-n // words)
    word = np.arange(n) // words
    # a byte belongs to the passage of the last word that has begun
    of = word[np.maximum(np.cumsum(np.bincount(start, minlength=len(data))) - 1, 0)]
    single = np.bincount(of * N_CLASSES + kind, minlength=k * N_CLASSES).reshape(k, -1)
    pair = np.bincount((of[1:] * N_CLASSES + kind[:-1]) * N_CLASSES + kind[1:], minlength=k * N_CLASSES ** 2).reshape(k, -1)
    size = np.maximum(single.sum(axis=1, keepdims=True), 1)
    # a word's fingerprint: its bytes summed with position weights, enough to spot repeats
    place = np.arange(len(data)) - np.r_[0, start][np.cumsum(np.bincount(start, minlength=len(data)))]
    weight = place.astype(np.uint64)
    code = (data.astype(np.uint64) + np.uint64(1)) * (weight * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9))
    run = np.r_[np.uint64(0), np.cumsum(code ^ (code >> np.uint64(29)))]
    mark = run[end] - run[start]
    per = np.bincount(word, minlength=k)
    first_here = np.bincount(word, _first_seen(mark + word.astype(np.uint64) * np.uint64(0x94D049BB133111EB)), k)
    first_ever = np.bincount(word, _first_seen(mark), k)
    out = np.empty((k, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = single / size
    out[:, N_CLASSES:-4] = pair / size
    out[:, -4] = np.bincount(word, end - start, k) / per / 10
    out[:, -3] = 1 - first_here / per
    out[:, -2] = 1 - first_ever / per
    out[:, -1] = np.log1p(n) / 10
    return out


def _moments(x: np.ndarray, block: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each column in double precision, without a second copy
    of ``x``."""
    mean, total = x.mean(axis=0, dtype=float), np.zeros((1, x.shape[1]))
    for i in range(0, len(x), block):
        total = np.concatenate([total, np.square(x[i:i + block] - mean)]).sum(axis=0, keepdims=True)
    return mean, np.sqrt(total[0] / len(x))


class MilModel:
    """Gated-attention model over bags of passages."""

    SHAPES = {"W": (N_FEATURES, 24), "bw": (24,), "V": (24, 12), "bv": (12,), "U": (24, 12), "bu": (12,),
              "a": (12,), "c": (24,), "b": ()}

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, s[0] ** -0.5, s) if len(s) and k[0] != "b" else np.zeros(s)) for k, s in self.SHAPES.items()}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, sizes: np.ndarray):
        """Scores of bags laid end to end, and what the gradient needs."""
        p, at = self.p, np.cumsum(sizes) - sizes
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["bw"])
        t, g = np.tanh(h @ p["V"] + p["bv"]), 1 / (1 + np.exp(-(h @ p["U"] + p["bu"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
        attention = e / np.repeat(np.add.reduceat(e, at), sizes)
        z = np.add.reduceat(attention[:, None] * h, at, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return score, (x, h, t, g, attention, z, at)

    def gradient(self, y, sizes, score, kept):
        p, (x, h, t, g, att, z, at) = self.p, kept
        d = (score - y) / len(y)
        out = {"c": z.T @ d, "b": d.sum()}
        dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
        datt = (dz * h).sum(axis=1)
        de = att * (datt - np.repeat(np.add.reduceat(att * datt, at), sizes))
        out["a"] = (t * g).T @ de
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        out |= {"V": h.T @ dt, "bv": dt.sum(axis=0), "U": h.T @ dg, "bu": dg.sum(axis=0)}
        dh = (att[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return out | {"W": x.T @ dh, "bw": dh.sum(axis=0)}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128,
            rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> "MilModel":
        """Adam on the log loss, in shuffled batches of bags."""
        self.mean, self.scale = _moments(x)
        self.scale += 1e-3
        rng, at = np.random.default_rng(seed), np.cumsum(sizes) - sizes
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                bags = order[i:i + batch]
                n = sizes[bags]
                rows = np.repeat(at[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                score, kept = self.forward(x[rows], n)
                step += 1
                lr = rate * (1 - epoch / epochs)
                for k, g in self.gradient(y[bags], n, score, kept).items():
                    g = g + decay * self.p[k] * (k[0] != "b")
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                label_key: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN,
                seed: int = 5, max_passages: int = MAX_TRAIN_PASSAGES) -> MilModel:
    """Train on at most ``max_train`` labelled documents, the lowest by a seeded hash of the
    key.

    Labels other than 0 and 1, null keys and labels without a document are skipped; a key
    with several labels counts as 0 if one is 0. Without any usable label the model scores
    every document alike, with one class only that class. The sample's passages, at most
    ``max_train`` times ``max_passages`` rows, are the only data that reach the driver.
    """
    known = (labels.select(F.col(label_key).alias("__key"), F.col(label).cast("int").alias("__y"))
             .where(F.col("__key").isNotNull() & F.col("__y").isin(0, 1))
             .groupBy("__key").agg(F.min("__y").alias("__y")))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "__key"), "__key").limit(max_train)
    # at most max_train rows
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__t")).join(F.broadcast(chosen), "__key")
    rows = rows.select("__key", "__t", "__y")

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1):
                x = passages(t.as_py())
                if len(x) > max_passages:
                    x = x[np.linspace(0, len(x) - 1, max_passages).astype(int)]
                out.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["k", "y", "x"])

    kind = rows.schema["__key"].dataType.simpleString()
    # repeated rows of a key could exceed the bound: one text per key
    one = rows.mapInArrow(run, f"k {kind}, y int, x binary").groupBy("k").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    found = sorted(one.collect(), key=lambda r: r["k"])
    model = MilModel(seed)
    y = np.array([r["y"] for r in found], float)
    if len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.p["b"] = np.log(share / (1 - share))
        if 0 < y.sum() < len(y):
            bags = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in found]
            sizes, x = np.array([len(b) for b in bags]), np.concatenate(bags)
            del found, bags  # the driver holds the sample once, in single precision
            model.fit(x, sizes, y, seed=seed)
        else:
            model.p["c"] = np.zeros_like(model.p["c"])
    else:
        model.p["c"] = np.zeros_like(model.p["c"])
    return model


RESULT = ("score", "predicted", "attention")


def score_quality(docs: DataFrame, model: MilModel, text: str = "text", with_attention: bool = False,
                  prefix: str = "") -> DataFrame:
    """``docs`` with score (0 to 1, higher is better) and predicted (1 if score >= 0.5), and
    with ``with_attention`` the weight of each passage.

    Every passage of the whole text counts. Null and empty texts are one passage without
    words. Equal texts get equal scores. Input columns named like the results (which begin
    with ``prefix``) are replaced.
    """
    names = [prefix + n for n in RESULT[:2 + with_attention]]
    base = without(docs, *names)
    col = base.columns.index(text)
    # some 7000 numbers, as plain arrays: executors need no copy of this package
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        worker_cache("quality")
        own = MilModel()
        vars(own).update(shared.value)
        for batch in chain.from_iterable(map(slices, batches)):
            scores, weights = [], []
            texts = batch.column(col).to_pylist()
            for i in range(0, len(texts), 100):
                bags = [passages(t) for t in texts[i:i + 100]]
                sizes = np.array([len(b) for b in bags])
                score, kept = own.forward(np.concatenate(bags), sizes)
                scores += score.tolist()
                if with_attention:
                    weights += [w.tolist() for w in np.split(kept[4], np.cumsum(sizes)[:-1])]
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            cols += [pa.array(weights, pa.list_(pa.float64()))] * with_attention
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols],
                                             names=[*batch.schema.names, *names])

    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]
                     + [f"`{n}` {t}" for n, t in zip(names, ("double", "int", "array<double>"))])
    return base.mapInArrow(run, kind)
