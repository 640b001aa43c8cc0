"""Document quality from its lines: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of character classes, word statistics and repetition, its own and those of
the lines before and after. Forward-backward gives every line's probability of being good; their mean,
weighted by line length, is calibrated to the document's score. Line labels for training are the labels
of their documents. Scores depend on the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import by_bytes, table
from lodegraph.llm.crf import CRF, train_crf
from lodegraph.llm.word_hashes import chunks, hash_words, words_at

#: Bounds of the training sample: documents, and bytes of one of them. Score from which a document is good.
SAMPLE_DOCS, SAMPLE_BYTES, GOOD = 3000, 1 << 16, 0.7


def _class(chars: str) -> np.ndarray:
    a = np.zeros(256, dtype=np.uint8)
    a[list(chars.encode())] = 1
    return a


_LOWER, _UPPER, _DIGIT = _class("abcdefghijklmnopqrstuvwxyz"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_MARKS, _SHOUT, _BAR, _STOP = _class("*#$%&@^~=+_<>{}[]\\/`"), _class("!?"), _class("|"), _class(".,;:")
_SPACE = _class(" \t\r\n\x0b\x0c")
LINE_FEATURES = ("upper", "digit", "marks", "shout", "bar", "stop", "blank", "log_length", "log_words", "word_length", "echo", "distinct", "same_as_before", "marked_words")


@dataclass(frozen=True)
class QualityModel:
    field: CRF
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    bias: float


def line_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features by line, lines by text, length of each line. Lines without a character beyond white space are passed over."""
    flat0 = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(flat0 == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    at = np.concatenate(([0], np.cumsum(1 - _SPACE[flat0], dtype=np.int64)))
    real = at[ends] > at[starts]
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return np.zeros((0, len(LINE_FEATURES))), np.zeros(len(raws), dtype=np.int64), np.zeros(0)
    text = np.searchsorted(offsets, starts, side="right") - 1

    def share(of: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(of[flat0], dtype=np.int64)))
        return (c[ends] - c[starts]).astype(np.float64)

    size = (ends - starts).astype(np.float64)
    upper, lower = share(_UPPER), share(_LOWER)
    flat, ws, we, _, _ = words_at(raws)
    line_of = np.searchsorted(starts, ws, side="right") - 1
    h = hash_words(flat, ws, we)
    words = np.bincount(line_of, minlength=len(starts)).astype(np.float64) if len(ws) else np.zeros(len(starts))
    some = np.maximum(words, 1)
    echo, marked, distinct, line_hash = np.zeros(len(starts)), np.zeros(len(starts)), np.ones(len(starts)), np.zeros(len(starts), dtype=np.uint64)
    if len(ws):
        inside = line_of[1:] == line_of[:-1]
        echo = np.bincount(line_of[1:][inside & (h[1:] == h[:-1])], minlength=len(starts)) / some
        marked = np.bincount(line_of, weights=((_MARKS | _SHOUT | _BAR)[flat0[np.minimum(we, len(flat0) - 1)]]).astype(np.float64), minlength=len(starts)) / some
        by = np.lexsort((h, line_of))
        new = np.concatenate(([True], (h[by][1:] != h[by][:-1]) | (line_of[by][1:] != line_of[by][:-1])))
        distinct = np.where(words > 0, np.bincount(line_of[by][new], minlength=len(starts)) / some, 1)
        first = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1])))
        line_hash[line_of[first]] = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(first, np.diff(np.concatenate((first, [len(h)])))).astype(np.uint64) * np.uint64(1) + np.uint64(1)), first)
    before = np.concatenate(([False], (line_hash[1:] == line_hash[:-1]) & (text[1:] == text[:-1])))
    x = np.stack(
        [upper / np.maximum(1, upper + lower), share(_DIGIT) / size, share(_MARKS) / size, share(_SHOUT) / size, share(_BAR) / size, share(_STOP) / size, share(_SPACE) / size,
         np.log(size) / 6, np.log1p(words) / 4, np.minimum(40, size / some) / 8, echo, distinct, before, marked], axis=1,
    )
    return x, np.bincount(text, minlength=len(raws)), size


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Features of each line, the one before and the one after (nothing beyond a text's ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    some = lines[lines > 0]
    last = np.cumsum(some) - 1
    before[last - some + 1] = 0
    after[last] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def good_shares(raws: list[bytes], model: QualityModel) -> np.ndarray:
    """The length-weighted mean probability that a text's lines are good; 0 for texts without lines."""
    x, lines, size = line_features(raws)
    out = np.zeros(len(raws))
    if len(x):
        p = model.field.marginals(with_neighbours((x - model.mean) / model.scale, lines), lines[lines > 0])
        text = np.repeat(np.arange(len(raws)), lines)
        out = np.bincount(text, weights=p * size, minlength=len(raws)) / np.maximum(1, np.bincount(text, weights=size, minlength=len(raws)))
    return out


def scores(raws: list[bytes], model: QualityModel) -> np.ndarray:
    out = [1 / (1 + np.exp(-(model.slope * good_shares(raws[part], model) + model.bias))) for part in chunks(raws)]
    return np.concatenate(out) if out else np.zeros(0)


def fit_quality(raws: list[bytes], labels: np.ndarray, rounds: int = 150) -> QualityModel:
    parts = [line_features(raws[part])[:2] for part in chunks(raws)] or [line_features([])[:2]]
    x, lines = (np.concatenate(a) for a in zip(*parts, strict=True))
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(LINE_FEATURES)), np.ones(len(LINE_FEATURES)))
    if not len(x) or len(set(labels.tolist())) < 2:  # nothing to tell apart: every text is as likely as the labels say
        p = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(CRF(np.zeros(3 * len(LINE_FEATURES) + 1), np.zeros((2, 2)), np.zeros(2)), mean, scale, 0.0, float(np.log(p / (1 - p))))
    full = with_neighbours((x - mean) / scale, lines)
    cut = np.cumsum(lines)[:-1]
    chains = [(a, np.full(n, y)) for a, n, y in zip(np.split(full, cut), lines, labels, strict=True) if n]
    model = QualityModel(train_crf([c[0] for c in chains], [c[1] for c in chains], rounds), mean, scale, 0.0, 0.0)
    share = np.concatenate([good_shares(raws[part], model) for part in chunks(raws)])
    slope, bias = 4.0, -2.0
    for _ in range(50):  # Newton's method, drawn to the start by a small ridge
        p = 1 / (1 + np.exp(-(slope * share + bias)))
        g = np.array([((p - labels) * share).sum() + 0.05 * (slope - 4), (p - labels).sum() + 0.05 * (bias + 2)])
        w = p * (1 - p)
        h = np.array([[(w * share * share).sum() + 0.05, (w * share).sum()], [(w * share).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        slope, bias = slope - step[0], bias - step[1]
    return QualityModel(model.field, mean, scale, float(slope), float(bias))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fits on at most sample_docs labelled documents that are not held out, least hash first, of at most sample_bytes each. Of texts that share an id the one of least hash counts, so the sample is the same however rows lie."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("__label"))
    some = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)
    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("__raw")).where(F.octet_length("__raw") <= sample_bytes).join(F.broadcast(some), id_col)
    one = rows.groupBy(id_col).agg(F.min(F.struct(F.xxhash64("__raw").alias("h"), "__raw")).alias("t"), F.first("__label").alias("__label"))
    found = sorted(((r[0], bytes(r[1]), int(r[2])) for r in one.select(id_col, "t.__raw", "__label").toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
    return fit_quality([r[1] for r in found], np.array([r[2] for r in found], dtype=np.float64))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None, good: float = GOOD) -> DataFrame:
    """The columns of keep (all by default), score and predicted (1 from good on, else 0), one row per row of docs.

    Null texts count as empty; texts without a visible character get the score of a text all of whose lines are
    bad. Columns of docs by the names of the new ones give way to them. Repeated rows each get their row.
    """
    names = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    out = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in by_bytes(batches, len(names)):
            s = scores([x or b"" for x in b.column(len(names)).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(s, pa.float64())], names=[*names, "score"])

    return docs.select(*names, F.col(text_col).cast("binary").alias("__raw")).mapInArrow(run, out).withColumn("predicted", (F.col("score") >= good).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
