"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts per language on the executors, over every labelled text; what reaches the driver is at
most one count per language and hash bucket. The log-probability matrix is broadcast: its size is languages times
BUCKETS numbers, whatever the corpus. Scoring is a sparse product in numpy: the rows of the matrix that a batch's
n-grams name, summed by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from . import store

#: Hash buckets for n-grams of SIZES letters.
BUCKETS, SIZES = 1 << 15, (1, 2, 3)
BATCH_BYTES = 1 << 20
#: Added to every count.
SMOOTHING = 0.5
#: A text's evidence weighs as that of so many n-grams at most, so that the score tells close calls in long texts too.
EVIDENCE = 60.0

UNKNOWN = "und"

_letters = np.array([chr(k).isalpha() for k in range(65536)])
_lower = np.array([ord(x) if len(x := chr(k).lower()) == 1 else k for k in range(65536)], dtype=np.uint32)


def letters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all rows with one 0 for each run of other characters and at each row's start; where rows start; letters of each row."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    firsts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=firsts[1:])
    rows = firsts[bounds]
    low = np.minimum(points, 65535)
    is_letter = _letters[low] & (points < 65536)
    for k in np.unique(points[points >= 65536]).tolist():
        is_letter |= (points == k) & chr(k).isalpha()
    symbols = np.where(points < 65536, _lower[low], points)
    symbols[~is_letter] = 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    kept = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    counts = bt.sums(is_letter.astype(np.int8), rows)
    packed = symbols[keep]
    starts = kept[rows[:-1]]
    packed = np.insert(packed, starts, 0)
    return packed, np.append(starts + np.arange(len(starts)), len(packed)), counts


def grams(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that hold a letter and stay in one row, and the row of each."""
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    out, owners = [], []
    h = np.zeros(len(symbols), np.uint32)
    some = np.zeros(len(symbols), bool)
    for size in range(1, max(SIZES) + 1):
        if len(symbols) < size:
            break
        h = (h[: len(symbols) - size + 1] * np.uint32(0x01000193)) ^ symbols[size - 1 :]
        some = some[: len(h)] | (symbols[size - 1 :] != 0)
        if size in SIZES:
            good = some & (row[: len(h)] == row[size - 1 :])
            x = h[good] * np.uint32(2 * size + 1)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1))
            owners.append(row[: len(h)][good])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(owners)


@dataclass
class Model:
    """labels in code-point order; weights[bucket, label] and prior[label] are natural logarithms."""

    labels: list[str]
    weights: np.ndarray
    prior: np.ndarray


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams of every row whose text and language are not null. Without such rows the model knows no language."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            data, bounds = bt.buffers(batch.column(0))
            names = batch.column(1).to_pylist()
            for low, high in bt.groups(bounds, BATCH_BYTES):
                symbols, rows, _ = letters(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                buckets, owner = grams(symbols, rows)
                kinds = sorted(set(names[low:high]))
                where = {x: k for k, x in enumerate(kinds)}
                code = np.array([where[x] for x in names[low:high]], np.int64)
                table = np.bincount(code[owner] * BUCKETS + buckets, minlength=len(kinds) * BUCKETS).reshape(-1, BUCKETS)
                for x in names[low:high]:
                    docs[x] = docs.get(x, 0) + 1
                for k, x in enumerate(kinds):
                    held[x] = held[x] + table[k] if x in held else table[k]
        for x, table in held.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * (len(some) + 1)), "bucket": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(table[some], docs[x]), pa.int64())})

    store.bound_batches(df.sparkSession)
    labelled = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = labelled.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(labels)))
    docs = np.zeros(len(labels))
    column = rows["lang"].map({x: k for k, x in enumerate(labels)}).to_numpy(dtype=np.int64)
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    docs[column[bucket < 0]] = n[bucket < 0]
    counts += SMOOTHING
    return Model(labels, np.log(counts / counts.sum(axis=0)), np.log((docs + 1) / (docs.sum() + len(docs))) if labels else docs)


def predict(df: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with `pred` and `score`; only text_col is looked at.

    `pred` is the likeliest label, the first in code-point order if several tie; `und` with score 0 where the text
    is null or has no letter, or the model knows no language. `score` is the label's posterior probability with the
    text's evidence weighed as that of EVIDENCE n-grams at most. Rows, repeated or not, are scored one by one; columns
    of df named as the new ones are replaced.
    """
    spark = df.sparkSession
    store.bound_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (pred, score)]
    where = kept.index(text_col)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{pred}` string", f"`{score}` double"])

    def run(batches):
        model = held.value
        for batch in batches:
            data, bounds = bt.buffers(batch.column(where))
            best, sure = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for low, high in bt.groups(bounds, BATCH_BYTES) if model.labels else []:
                symbols, rows, found = letters(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                buckets, owner = grams(symbols, rows)
                n = np.bincount(owner, minlength=high - low)
                total = np.stack([np.bincount(owner, model.weights[buckets, k], minlength=high - low) for k in range(len(model.labels))], axis=1)
                full = total + model.prior
                some = np.flatnonzero(found > 0)
                best[low + some] = full[some].argmax(axis=1)
                soft = total[some] * np.minimum(1.0, EVIDENCE / np.maximum(n[some], 1))[:, None] + model.prior
                soft = np.exp(soft - soft.max(axis=1, keepdims=True))
                sure[low + some] = soft[np.arange(len(some)), best[low + some]] / soft.sum(axis=1)
            names = np.array([*model.labels, UNKNOWN], dtype=object)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(sure)], names=[*kept, pred, score])

    return df.select(*kept).mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the crc32 of the id's decimal text leaves `fold` when divided by `folds`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def accept(df: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """The rows of df whose text is in a known language with at least min_score, with df's columns."""
    marked = predict(df, model, text_col, "lang_pred_", "lang_score_")
    return marked.where(f"lang_pred_ <> '{UNKNOWN}' AND lang_score_ >= {min_score}").select(*df.columns)
