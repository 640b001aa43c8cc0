"""Best-fit packing into bins of several permitted sequence lengths.

Texts are read as tokens of a byte-level vocabulary and cut, where they are longer than the largest
sequence, at token bounds between two characters. Pieces are placed longest first, each in the open bin that
it leaves with the least room. Where none has room, a bin opens whose size costs least for each unit that it
can still expect to hold, judged over all sizes together and over the pieces yet to come. At the end every
bin shrinks to the smallest size that holds its contents.

Pieces are numbered when they are written and dealt to blocks by a hash of that number, whatever their ids,
texts and lengths are, so that a block holds a bounded number of lengths and no text; blocks pack
independently. A block loses at most its last bins' room.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import durable, by_bytes, table

#: Permitted sequence lengths, in tokens, and the cost of a bin besides its length.
CAPACITIES, BIN_COST = (2048, 4096, 8192, 16384), 64
#: Pieces in a block, about; characters that are encoded at once.
BLOCK_ROWS, PART_CHARS = 16384, 1 << 15
#: A single blank between visible characters: no token reaches over the place before it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_encodings: dict = {}


@dataclass(frozen=True)
class RankTokens:
    """Tokens of a byte-level vocabulary file of base64 tokens and ranks. A text is encoded in parts of about PART_CHARS characters, cut before a single blank; where there is none, after that many."""

    path: str
    pattern: str

    def _encoding(self):
        if self.path not in _encodings:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, i in ranks.items():
                size[i] = len(token)
            _encodings[self.path] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), size
        return _encodings[self.path]

    def ids(self, text: str) -> list[int]:
        encode = self._encoding()[0].encode_ordinary
        if len(text) <= PART_CHARS:
            return encode(text)
        out: list[int] = []
        at = 0
        while at < len(text):
            to = at + PART_CHARS
            if to < len(text) and (m := _SAFE.search(text, max(at + 1, to - 1), to + PART_CHARS)):
                to = m.start()
            out += encode(text[at:to])
            at = to
        return out

    def sizes(self, ids: list[int]) -> np.ndarray:
        """Bytes of each token."""
        return self._encoding()[1][np.array(ids, dtype=np.int64)]


@dataclass(frozen=True)
class ByteTokens:
    """Every byte is a token."""

    def ids(self, text: str) -> bytes:
        return text.encode()

    def sizes(self, ids: bytes) -> np.ndarray:
        return np.ones(len(ids), dtype=np.int64)


def pieces_of(text: str, tokens, top: int) -> list[tuple[int, int, int]]:
    """(start, end, length) of the pieces of a text: code points, and tokens with one end mark after the last. A piece is at most top long; it ends at the last token bound that is also a character's."""
    if not text:
        return []
    ids = tokens.ids(text)
    n = len(ids)
    if n < top:
        return [(0, len(text), n + 1)]
    first = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
    chars = np.concatenate((np.cumsum(first) - first, [len(text)]))  # characters before each byte
    bounds = np.concatenate(([0], np.cumsum(tokens.sizes(ids))))
    good = np.flatnonzero(np.concatenate((first, [True]))[bounds])  # token bounds between characters
    out, at = [], 0
    while at < n:
        k = int(np.searchsorted(good, at + top, side="right")) - 1
        to = int(good[k]) if good[k] > at else min(n, at + top)
        to = to if to < n or to - at < top else int(good[max(0, k - 1)]) if good[max(0, k - 1)] > at else at + top - 1
        out.append((int(chars[bounds[at]]), int(chars[bounds[to]]), to - at + (to == n)))
        at = to
    return out


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each piece; capacity and contents of each bin. Every length is at most the largest capacity; ties keep their order."""
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    sorted_up = lengths[order][::-1]
    below = np.concatenate(([0], np.cumsum(sorted_up)))
    n = len(lengths)
    which, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins: dict[int, list[int]] = {}
    used, room_of = [], []
    for done, i in enumerate(order):
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
        else:
            left = n - done - 1  # pieces yet to come are the first so many of sorted_up
            best = None
            for c in sizes:
                if c >= size:
                    to_come = below[min(left, int(np.searchsorted(sorted_up, c - size, side="right")))]
                    price = (c + bin_cost) / max(1, min(c, size + to_come))
                    if best is None or price < best[0]:
                        best = (price, c)
            b, room = len(used), best[1]
            used.append(0)
            room_of.append(room)
        which[i], offset[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append(b)
    contents = np.array(used, dtype=np.int64)
    return which, offset, np.array(sizes, dtype=np.int64)[np.searchsorted(sizes, contents)] if len(used) else contents, contents


def cut(docs: DataFrame, tokens, id_col: str, text_col: str, top: int) -> DataFrame:
    """key, id, piece, start, end, length, text: a row for each piece, written, so that its number stays."""
    kind = docs.schema[id_col].dataType
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("length", T.LongType()), ("text", T.StringType())]
    out = T.StructType([T.StructField("id", kind), *(T.StructField(k, t) for k, t in fields)])

    def run(batches):
        for b in by_bytes(batches, 1):
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = pieces_of(text or "", tokens, top)
                at += [i] * max(1, len(found))
                rows += [(p, s, e, n, text[s:e] if len(found) > 1 else text) for p, (s, e, n) in enumerate(found)] or [(0, 0, 0, 0, text)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays], names=out.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)
    return durable(rows.withColumn("key", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, tokens, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per piece: id, piece, start, end (code points of the text), text (the piece's), length (tokens, one end mark after each document), bin, bin_offset, bin_capacity, bin_used.

    A document longer than the largest capacity is cut at token bounds that are characters' bounds too;
    every other document is one piece. Null and empty texts hold nothing to pack and get a row with bin null
    and length 0. Ids of any kind stay as they are, null ones too; repeated rows are packed each on their
    own; an empty table gives an empty result. Columns but the id and the text are not read, whatever their
    names. bin is unique over the result.
    """
    top = max(capacities)
    pieces = cut(docs, tokens, id_col, text_col, top)
    real = pieces.where("length > 0").select("key", "length")
    blocks = max(1, -(-real.count() // block_rows))
    dealt = real.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))

    def run(t: pa.Table) -> pa.Table:
        key, lengths = t.column("key").to_numpy(), t.column("length").to_numpy()
        by = np.argsort(key)  # rows of a block come in any order
        which, offset, capacity, contents = pack(lengths[by], capacities, bin_cost)
        block = t.column("block")[0].as_py()
        return pa.table({"key": key[by], "bin": [f"{block}-{b}" for b in which], "bin_offset": offset, "bin_capacity": capacity[which], "bin_used": contents[which]})

    placed = dealt.groupBy("block").applyInArrow(run, "key bigint, bin string, bin_offset bigint, bin_capacity bigint, bin_used bigint")
    found = pieces.join(placed, "key", "left")
    return found.select(F.col("id").alias(id_col), "piece", "start", "end", "text", "length", "bin", "bin_offset", "bin_capacity", "bin_used")


def sequences(packed: DataFrame) -> DataFrame:
    """bin, bin_capacity, bin_used, texts: the contents of every bin in order, an end mark due after each text that is its document's last. A bin holds at most bin_capacity tokens, so a row is bounded."""
    rows = packed.where(F.col("bin").isNotNull()).groupBy("bin", "bin_capacity", "bin_used").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "text"))).alias("t"))
    return rows.select("bin", "bin_capacity", "bin_used", F.transform("t", lambda x: x["text"]).alias("texts"))


def public_tokens(name: str = "byte_bpe_50k.tiktoken") -> RankTokens:
    import public_tokenizers

    return RankTokens(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokens())
    return packed.select("doc_id", "piece", "start", "end", "length", F.sha2("text", 256).alias("text_sha256"), "bin", "bin_offset", "bin_capacity", "bin_used")


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
