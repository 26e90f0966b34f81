"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of about PASSAGE_WORDS words. Each passage is encoded to a vector of byte-class shares,
word statistics and a hashed histogram of byte pairs; a hidden layer h, gated attention weights
a = softmax(w . (tanh(V h) * sigmoid(U h))) and the weighted sum z of h give the document's score sigmoid(c . z + d).
Only document labels are learned from.

The model is fitted in numpy on a sample of labelled rows with all their passages: at most SAMPLE rows in the order of a
hash of their id, without those that would bring the sample above SAMPLE_PASSAGES. Scoring encodes every passage of
every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from . import store

PASSAGE_WORDS, PAIRS = 64, 256
#: Bounds on the rows that are fitted, and on the passages of all of them.
SAMPLE, SAMPLE_PASSAGES = 4000, 60_000
HIDDEN, GATES = 32, 16
BATCH_BYTES = 1 << 21
THRESHOLD = 0.7

_classes = np.full(256, 11)
for _kind, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\v\f", ".,", "!?", ";:'\"()-", "*#$%&@^~|<>=+_/\\`[]{}"]):
    _classes[[ord(x) for x in _chars]] = _kind
_classes[128:] = 10
CLASSES = 12
FEATURES = CLASSES + 6 + PAIRS


def n_passages(n_words):
    """Passages of texts of so many words."""
    return np.maximum(1, (n_words + PASSAGE_WORDS // 2) // PASSAGE_WORDS)


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, for each row the number of passages before it); every row has a passage at least.

    A passage's features come from its own bytes: a byte pair counts if both bytes lie in the passage."""
    start, end, hashes, rows = bt.words(data, bounds, bt.SPACED, bt.EXACT_SYMBOLS)
    n_words = np.diff(rows)
    many = n_passages(n_words)
    first = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(many)), many)
    turn = np.arange(len(row)) - first[row]
    word = rows[row] + turn * n_words[row] // many[row]
    at = np.where(turn > 0, np.append(start, 0)[np.minimum(word, len(start))], bounds[row])
    bytes_in = np.diff(np.append(at, len(data)))
    count = len(row)
    classes, pairs = np.zeros((count, CLASSES)), np.zeros((count, PAIRS))
    for low in range(0, len(data), bt.PIECE):
        part = data[low : low + bt.PIECE]
        lo, hi = int(np.searchsorted(at, low, side="right")) - 1, int(np.searchsorted(at, low + len(part), side="left"))
        cuts = np.clip(np.append(at[lo:hi], low + len(part)) - low, 0, len(part))
        own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        classes[lo:hi] += np.bincount(own * CLASSES + _classes[part], minlength=(hi - lo) * CLASSES).reshape(-1, CLASSES)
        # pairs that end in this piece; the first may start in the piece before
        before = np.concatenate((data[low - 1 : low] if low else part[:1], part[:-1]))
        code = ((before.astype(np.uint32) * np.uint32(0x9E37) + part * np.uint32(0x79B9)) >> np.uint32(5)) & np.uint32(PAIRS - 1)
        inside = np.ones(len(part), bool)
        firsts = at[lo:hi] - low
        inside[firsts[(firsts >= 0) & (firsts < len(part))]] = False
        pairs[lo:hi] += np.bincount(own[inside] * PAIRS + code[inside], minlength=(hi - lo) * PAIRS).reshape(-1, PAIRS)
    words_in = np.diff(np.append(word, len(start)))
    word_owner = np.repeat(np.arange(count), words_in)
    lens = (end - start).astype(np.float64)
    apart = np.unique(bt.mix(hashes ^ (word_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    n = np.maximum(words_in, 1)
    per = lambda x: np.bincount(word_owner, x, minlength=count) / n
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    stats = np.column_stack(
        [
            np.bincount(word_owner[apart], minlength=count) / n,
            per(lens) / 10,
            per(lens <= 2),
            per(lens >= 12),
            per((_classes[last] >= 6) & (_classes[last] <= 9)),
            np.minimum(words_in, PASSAGE_WORDS) / PASSAGE_WORDS,
        ]
    )
    whole = np.maximum(bytes_in, 1)[:, None]
    return np.hstack([classes / whole, stats, 4 * np.sqrt(pairs / whole)]).astype(np.float32), first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """To six decimals: how a product of matrices rounds depends on their size, and equal texts must score equally."""
        return (1 / (1 + np.exp(-_forward(self.parts, (x.astype(np.float64) - self.mean) * self.scale, first)["logit"]))).round(6)


def _forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[row])
    a = e / np.add.reduceat(e, first[:-1])[row]
    z = np.add.reduceat(h * a[:, None], first[:-1])
    return {"row": row, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0]}


def _gradients(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = _forward(p, x, first)
    row, h, t, s, a = f["row"], f["h"], f["t"], f["s"], f["a"]
    g = (1 / (1 + np.exp(-f["logit"])) - y) * weight / len(y)
    dz = g[:, None] * p["c"]
    da = (h * dz[row]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[row])
    dts = de[:, None] * p["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = a[:, None] * dz[row] + dt @ p["V"].T + ds @ p["U"].T
    du = dh * (1 - h * h)
    return {"W": x.T @ du, "b": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0) -> Model:
    """Adam on the weighted logistic loss; both labels weigh the same. Without both labels the score is 0.5 everywhere."""
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATES)), "U": rng.normal(0, 0.2, (HIDDEN, GATES)), "w": rng.normal(0, 0.2, GATES), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), p)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), 1 / np.maximum(every.std(axis=0), 0.02)
    bags = [(x - mean) * scale for x in bags]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            first = np.concatenate(([0], np.cumsum([len(bags[k]) for k in some])))
            grads = _gradients(p, np.concatenate([bags[k] for k in some]), first, labels[some], weight[some])
            step += 1
            for k, g in grads.items():
                g = g + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """Fits on labelled rows of df: those with the smallest hash of the id, at most `sample` of them; null labels are left out.

    Of these, in that order, each is taken with all its passages unless that brings them above `sample_passages`.
    An id with several labels or rows counts as so many examples, up to the sample's size. Labels without a document
    take no part."""
    store.bound_batches(df.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(label_col).cast("double").alias("label_"))
    known = known.join(df.select(F.col(id_col).alias("id_")), "id_", "left_semi")
    chosen = known.orderBy(F.xxhash64("id_"), "id_", "label_").limit(sample)
    # The sample has at most `sample` rows of two numbers, whatever the tables.
    text = F.col(text_col).cast("string")
    rows = df.join(F.broadcast(chosen), F.col(id_col) == F.col("id_")).select(text.alias("text"), F.col("label_").alias("label"), F.xxhash64("id_").alias("key"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"))
    sizes = rows.select("key", "label", "text_key", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).alias("n")).orderBy("key", "label", "text_key").limit(sample).collect()
    taken, total = [], 0
    for r in sizes:
        many = int(n_passages(r["n"]))
        if total + many <= sample_passages:
            total += many
            taken.append((r["key"], r["label"], r["text_key"]))
    wanted = df.sparkSession.createDataFrame(list(dict.fromkeys(taken)), "key bigint, label double, text_key bigint")

    def encode(batches):
        for batch in batches:
            data, bounds = bt.buffers(batch.column(3))
            out = []
            for low, high in bt.groups(bounds, BATCH_BYTES):
                x, first = passages(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                out += [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["key", "label", "text_key", "bag"])

    bags = rows.join(F.broadcast(wanted), ["key", "label", "text_key"]).select("key", "label", "text_key", "text").mapInArrow(encode, "key bigint, label double, text_key bigint, bag binary")
    found = sorted((r["key"], r["label"], r["text_key"], bytes(r["bag"])) for r in bags.toLocalIterator())[: len(taken)]
    return fit([np.frombuffer(x, "<f4").reshape(-1, FEATURES) for *_, x in found], np.array([r[1] for r in found]))


def predict(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= threshold); only text_col is looked at.

    Null and empty texts are one empty passage and get its score. Each row is scored by itself; columns of df named as the
    new ones are replaced."""
    store.bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    where = kept.index(text_col)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + ["score double", "predicted int"])

    def run(batches):
        for batch in batches:
            data, bounds = bt.buffers(batch.column(where))
            out = np.zeros(batch.num_rows)
            for low, high in bt.groups(bounds, BATCH_BYTES):
                out[low:high] = held.value.score(*passages(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return df.select(*kept).mapInArrow(run, schema)
