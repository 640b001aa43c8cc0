"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and long texts are split where the vocabulary cannot merge across: before
a single blank between two non-blanks. No piece of the model holds a word mark after another character,
so the part after the blank is encoded as a text of its own and the counts add up to those of the whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import by_bytes, table

#: Text bytes that are encoded in one call, and the length from which a text is split.
BATCH_BYTES = 1 << 20
SPLIT_CHARS = 1 << 15
#: A single blank between characters that are neither blanks nor word marks.
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_models: dict = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def split_safely(text: str, limit: int = SPLIT_CHARS) -> list[str]:
    """Parts of about limit characters whose token counts sum to that of text. A text without a safe boundary stays whole."""
    parts, start = [], 0
    while len(text) - start > limit:
        m = _SAFE.search(text, max(start + limit - 1, start + 1))
        if not m:
            break
        parts.append(text[start : m.start()])
        start = m.end()
    return [*parts, text[start:]]


def count_batches(texts, model, batch_bytes: int = BATCH_BYTES, split_chars: int = SPLIT_CHARS):
    """Token counts of texts, in order. A call of the model gets parts of at most batch_bytes, or one longer part."""
    counts = [0] * len(texts)
    held, owner, size = [], [], 0

    def flush():
        for i, ids in zip(owner, model.encode(held, num_threads=1), strict=True):
            counts[i] += len(ids)
        held.clear(), owner.clear()

    for i, text in enumerate(texts):
        for part in split_safely(text, split_chars) if text else ():
            n = len(part) if part.isascii() else len(part.encode())
            if held and size + n > batch_bytes:
                flush()
                size = 0
            held.append(part)
            owner.append(i)
            size += n
    if held:
        flush()
    return counts


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty (0 bytes, 0 tokens); repeated rows each get their row; an empty table gives
    an empty result; other columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches):
        model = _model(model_path)
        for b in by_bytes(batches, 1):
            raw = b.column(1)
            sizes = pa.compute.binary_length(raw.cast(pa.large_binary()) if pa.types.is_large_string(raw.type) else raw.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), sizes.cast(pa.int64()), pa.array(count_batches(raw.to_pylist(), model), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    from pyspark.sql import types as T

    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return narrow.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
