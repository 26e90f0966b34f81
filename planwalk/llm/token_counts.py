"""Token counts: texts go to Arrow functions in batches of equal bytes, and only lengths come back.

No shuffle and no driver step; a worker holds one group of texts and the piece table of `encoder`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from . import store

#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 20


def _piece_lengths(path: str):
    """A .model file's tokenizer: whole texts, one thread."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)

    def groups(data: np.ndarray, bounds: np.ndarray, limit: int):
        raw = data.tobytes()
        for low, high in bt.groups(bounds, limit):
            texts = [raw[bounds[k] : bounds[k + 1]].decode() for k in range(low, high)]
            yield low, high, np.array([len(x) for x in coder.encode(texts, num_threads=1)], np.int64), None

    return groups


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row (id_col, n_bytes, n_tokens, over_limit) for each row of df.

    tokenizer: a .json file for tokenizers, a .model file for sentencepiece, on every machine. Nothing is
    added, cut off or padded; special strings inside texts are handled as the library does by default.

    Null and empty text: 0 bytes, 0 tokens. Repeated rows and ids each give a row; a null id stays null. An empty
    table gives an empty result. Other columns are not carried, so their names may clash with the result's.
    A text above twice `batch_bytes` is encoded in slices that end where the tokenizer always cuts; a tokenizer
    for which that isn't known gets whole texts.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def lengths(batches):
        if tokenizer.endswith(".model"):
            groups = _piece_lengths(tokenizer)
        else:
            from .encoder import encoder

            groups = encoder(tokenizer, False).encode_groups
        for batch in batches:
            data, bounds = bt.buffers(batch.column(1))
            n = np.zeros(batch.num_rows, np.int64)
            for low, high, lens, _ in groups(data, bounds, batch_bytes):
                n[low:high] = lens
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    store.bound_batches(df.sparkSession)
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col + "_")).mapInArrow(lengths, schema)
