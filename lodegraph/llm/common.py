"""What the operators of this subpackage share: tables, shared scratch space, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word, over text whose A-Z is in lower case: a run of digits, a-z and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_word_byte = np.zeros(256, dtype=bool)
_word_byte[48:58] = _word_byte[97:123] = _word_byte[128:] = True
#: bytes.translate table: A-Z to lower case, every byte that is in no word to a blank.
WORD_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if _word_byte[b] or 65 <= b <= 90 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local; a cluster without the setting is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, and lost executors take nothing with them. files: at most so many, for tables known to be small."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodegraph_path = path
    return out


#: Bytes of text that an operator looks at together.
SLICE_BYTES = 4 << 20


def by_bytes(batches, column: int, limit: int = SLICE_BYTES):
    """The rows of Arrow batches in slices, without copying: at most limit bytes of the texts in a column, or one row. Whatever an operator builds for a slice is bounded by it, not by the batch."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def release(*tables: DataFrame) -> None:
    """Deletes durable tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._lodegraph_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_TABLE).split()


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of raw start and end."""
    inside = np.frombuffer(raw.translate(WORD_TABLE), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def char_offsets(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Code points before each byte offset."""
    first = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(first)))[at]


WORD_RE = re.compile(WORD)
