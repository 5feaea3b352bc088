"""Token ids as patched frame-of-reference blocks, and the tables of shards that hold them.

A segment is a run of whole documents' ids, cut into blocks of 128 values. From each block its minimum is
subtracted; what remains is packed at the width, in bits, that some percentile of the block's values needs, of
PERCENTS the one with which the block is smallest. Wider values
are exceptions: their place and their whole remainder stand in lists behind. All numbers are little-endian::

    "PFR1" | n_values u32 | n_blocks u32 | n_exceptions u32
    minimum u32 x n_blocks | width u8 x n_blocks | exceptions u8 x n_blocks | block start u32 x n_blocks
    packed words u32 ... | exception place in its block u8 ... | exception remainder u32 ...

A block start counts packed words before the block, so any block can be read alone. Inside a block value
4 * k + lane lies at bit k * width of its lane, and word j of the four lanes is stored side by side.
The last block is filled up with its last value.

The container is a Parquet table with one row a segment: Spark's commit protocol then makes the writing safe
against lost tasks, on any file system that Spark writes. part and seg order the rows as the documents are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table_at, bounded_batches, scratch
from .wordcache import grouped, opened

BLOCK = 128
PERCENTS = (50, 75, 90, 95, 100)
#: A segment is closed after the document that brings it to so many ids.
SEGMENT = 1 << 17
SHARDS = "part int, seg int, n_values long, doc_ids array<long>, lengths array<long>, payload binary"


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits each value needs; frexp is exact below 2**53."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(x: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values below 2**width -> (blocks, 4 * width) words."""
    v = x.reshape(-1, BLOCK // 4, 4).astype(np.uint64)
    out = np.zeros((len(v), width + 1, 4), np.uint64)
    for k in range(BLOCK // 4):
        word, bit = divmod(k * width, 32)
        moved = v[:, k] << np.uint64(bit)
        out[:, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= moved >> np.uint64(32)
    return out[:, :width].astype(np.uint32).reshape(len(v), 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.zeros((len(words), width + 1, 4), np.uint64)
    w[:, :width] = words.reshape(-1, width, 4)
    out = np.empty((len(words), BLOCK // 4, 4), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(BLOCK // 4):
        word, bit = divmod(k * width, 32)
        out[:, k] = ((w[:, word] | (w[:, word + 1] << np.uint64(32))) >> np.uint64(bit)) & mask
    return out.reshape(-1, BLOCK)


def pack(ids: np.ndarray, percents: tuple[int, ...] = PERCENTS) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty((blocks, BLOCK), np.uint32)
    if n:
        full.reshape(-1)[:n] = ids
        full.reshape(-1)[n:] = ids[-1]
    low = full.min(1) if n else np.empty(0, np.uint32)
    rest = full - low[:, None]
    need = _bits(rest)
    widths = np.sort(need, 1)[:, [BLOCK * p // 100 - 1 for p in percents]]
    cost = np.stack([BLOCK * widths[:, k].astype(np.int64) + 40 * (need > widths[:, [k]]).sum(1) for k in range(len(percents))], 1)
    width = widths[np.arange(blocks), cost.argmin(1)]
    over = need > width[:, None]
    patched = over.sum(1).astype(np.uint8)  # fewer than 128, as some values fit
    sizes = width.astype(np.int64) * 4
    starts = np.cumsum(sizes) - sizes
    words = np.empty(int(sizes.sum()), np.uint32)
    fits = np.where(over, np.uint32(0), rest)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        words[starts[rows, None] + np.arange(4 * w)] = _pack(fits[rows], w)
    place = np.nonzero(over)[1].astype(np.uint8)
    head = np.array([n, blocks, len(place)], "<u4")
    return b"".join([b"PFR1", *(x.tobytes() for x in (head, low, width, patched, starts.astype("<u4"), words, place, rest[over]))])


def unpack(data: bytes) -> np.ndarray:
    if data[:4] != b"PFR1":
        raise ValueError("not a segment of patched frame-of-reference blocks")
    n, blocks, patches = np.frombuffer(data, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, width, patched, starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u4", blocks)
    words, place, over = take("<u4", 4 * int(width.sum(dtype=np.int64))), take("u1", patches), take("<u4", patches)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        out[rows] = _unpack(words[starts[rows, None].astype(np.int64) + np.arange(4 * w)], w)
    out[np.repeat(np.arange(blocks), patched), place] = over
    out += low[:, None]
    return out.reshape(-1)[:n]


def block(data: bytes, k: int) -> np.ndarray:
    """Block k of a segment by its start alone (the last one filled up to 128 values)."""
    n, blocks, patches = np.frombuffer(data, "<u4", 3, 4).tolist()
    low = np.frombuffer(data, "<u4", blocks, 16)
    width, patched = np.frombuffer(data, "u1", blocks, 16 + 4 * blocks), np.frombuffer(data, "u1", blocks, 16 + 5 * blocks)
    start = int(np.frombuffer(data, "<u4", 1, 16 + 6 * blocks + 4 * k)[0])
    words_at, w = 16 + 10 * blocks, int(width[k])
    out = _unpack(np.frombuffer(data, "<u4", 4 * w, words_at + 4 * start)[None], w)[0].astype(np.uint32) if w else np.zeros(BLOCK, np.uint32)
    place_at = words_at + 16 * int(width.sum(dtype=np.int64))
    before, m = int(patched[:k].sum(dtype=np.int64)), int(patched[k])
    out[np.frombuffer(data, "u1", m, place_at + before)] = np.frombuffer(data, "<u4", m, place_at + patches + 4 * before)
    return out + low[k]


def write_shards(
    docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode the texts, end_id after each document, and write them in ascending id order; gives the written table (SHARDS).

    Null texts are empty and leave their end_id alone; equal ids stand in the order of their texts; a null id comes
    first; other columns aren't read; no rows give a table without rows. One shuffle deals the texts out by
    ranges of the id and the text's first characters, so rows that share an id, or have none, are spread too.
    A segment ends with a document: memory is bounded by SEGMENT ids and one document. The table lies at ``path``, or if none is
    given in the shared folder until the application ends.
    """
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = opened(tokenizer_file), np.array([end_id], "<u4")
        part, seg = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def segment() -> pa.RecordBatch:
            lists = pa.list_(pa.int64())
            kinds = {"part": pa.int32(), "seg": pa.int32(), "n_values": pa.int64(), "doc_ids": lists, "lengths": lists, "payload": pa.binary()}
            row = [part, seg, size, ids, lengths, pack(np.concatenate(parts))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds.values(), strict=True)], list(kinds))

        for b in grouped(batches, 1):
            got, ends = tokens.encode(b.column(1))
            for doc, at, upto in zip(b.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                ids.append(doc)
                parts += (got[at:upto], end)
                lengths.append(upto - at + 1)
                size += lengths[-1]
                if size >= SEGMENT:
                    yield segment()
                    ids, parts, lengths, size, seg = [], [], [], 0, seg + 1
        if ids:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id", F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    return table_at(dealt.mapInArrow(encode, SHARDS), path or scratch(docs.sparkSession, "shards"))


def read_shards(shards: DataFrame) -> DataFrame:
    """Each document of a table of shards, from its packed ids: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it: those of the parts before, of which a small table has one row
    a part, of the segments before in its part, and of the documents before in its segment.
    """
    bounded_batches(shards.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seg, docs, lengths, payload in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                raw = memoryview(unpack(payload).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[a * 4 : e * 4]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                where = [pa.array([x] * len(docs), pa.int32()) for x in (part, seg)]
                told = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, crc)]
                yield pa.RecordBatch.from_arrays([*where, *told], ["part", "seg", "doc_id", "inside", "n_tokens", "ids_crc32"])

    columns = "part int, seg int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    read = shards.select("part", "seg", "doc_ids", "lengths", "payload").mapInArrow(decode, columns)
    return read.join(_before(shards), ["part", "seg"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def _before(shards: DataFrame) -> DataFrame:
    """For each segment the ids before it. Twice a running sum: over the parts, of which a cluster has some thousands, and inside each."""
    by_part = shards.groupBy("part").agg(F.sum("n_values").alias("n"))
    parts = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts"))
    inside = shards.select("part", "seg", (F.sum("n_values").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_values")).alias("segs"))
    return inside.join(F.broadcast(parts), "part").select("part", "seg", (F.col("parts") + F.col("segs")).alias("before"))
