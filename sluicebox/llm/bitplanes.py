"""Token-ID output by bit-plane shuffling.

Documents are put in order of their id and their token ids, each ended by an end
id, joined to one stream for each partition.  The stream is cut into blocks of a
fixed number of ids; a block's ids are transposed to byte planes (the first byte
of all ids, then the second, ...) or bit planes, and each plane is compressed
with zstandard alone: the high planes of a small vocabulary are nearly empty.
Each block row also holds its part of the chunk index: where it begins in its
partition's stream and which documents start in it, where and with how many ids.

The file format is a Parquet table of block rows, so any store that Spark can
write to will hold it; blocks can be read in any order and by any task.

Defined results: null and empty texts hold the end id alone; rows of one id
follow each other by their text's digest; a null id comes first; an empty table
gives files without blocks; other columns are never looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import vectext as V
from .common import joined_binary, map_batches, shuffle_cleanup
from .segments import SEGMENT_SLICE_BYTES, SegmentMemo, byte_level_memo

BLOCK_IDS = 1 << 16
END_ID = 0
ZSTD_LEVEL = 3
#: Segments a worker remembers: this job holds no other model, so more than the common number fit.
REMEMBERED = 400_000


@lru_cache(maxsize=4)
def memo(path: str) -> SegmentMemo:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return byte_level_memo(tok, REMEMBERED)


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The ids' planes, each compressed."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(rows.T)
    pack = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress
    return [pack(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The n ids whose planes these are."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n), axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


BLOCK_SCHEMA = "part int, block int, first_id long, n_ids int, kind string, planes array<binary>, open_doc long, docs array<struct<doc_id: long, start: long, n_tokens: long>>"


class _Stream:
    """Cuts one partition's ids into blocks. Documents are told apart by where they start."""

    def __init__(self, part: int, kind: str, block_ids: int):
        self.part, self.kind, self.size = part, kind, block_ids
        self.ids, self.held, self.begin, self.block = [], 0, 0, 0
        self.docs: list[tuple] = []  # (doc_id, start, n_tokens) of those that start in no written block
        self.last = (-1, 0)  # start and end of the last document that starts in a written block

    def add(self, ids: np.ndarray, doc_ids: list, offsets: np.ndarray) -> Iterator[dict]:
        base = self.begin + self.held
        self.docs += [(d, base + int(a), int(b - a)) for d, a, b in zip(doc_ids, offsets[:-1], offsets[1:], strict=True)]
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            joined, at = np.concatenate(self.ids), 0
            while self.held - at >= self.size:
                yield self._row(joined[at : at + self.size])
                at += self.size
            self.ids, self.held = [joined[at:]], self.held - at

    def end(self) -> Iterator[dict]:
        if self.held:
            yield self._row(np.concatenate(self.ids))

    def _row(self, ids: np.ndarray) -> dict:
        stop = self.begin + len(ids)
        n = next((i for i, d in enumerate(self.docs) if d[1] >= stop), len(self.docs))
        here, self.docs = self.docs[:n], self.docs[n:]
        docs = [{"doc_id": d, "start": a, "n_tokens": k} for d, a, k in here]
        row = {"part": self.part, "block": self.block, "first_id": self.begin, "n_ids": len(ids), "kind": self.kind, "planes": to_planes(ids, self.kind), "open_doc": self.last[0] if self.last[1] > self.begin else -1, "docs": docs}
        if here:
            self.last = (here[-1][1], here[-1][1] + here[-1][2])
        self.begin, self.block = stop, self.block + 1
        return row


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, text: str = "text", kind: str = "byte", block_ids: int = BLOCK_IDS) -> None:
    """Encode docs and write their ids to path in ascending order of doc_id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = to_arrow_schema(_parse_datatype_string(BLOCK_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stream = memo(tokenizer_path), _Stream(TaskContext.get().partitionId(), kind, block_ids)
        for batch in batches:
            for part in V.slices(batch, "text", SEGMENT_SLICE_BYTES):
                ids, offsets = coder.encode(part.column("text"))
                ended = np.insert(ids, offsets[1:], END_ID)
                rows = list(stream.add(ended, part.column("doc_id").to_pylist(), offsets + np.arange(len(offsets))))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=names)
        if rows := list(stream.end()):
            yield pa.RecordBatch.from_pylist(rows, schema=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The row's number lets Spark part even equal rows of one id over several tasks.
    numbered = rows.withColumns({"sb_tie": F.xxhash64("text"), "sb_row": F.monotonically_increasing_id()})
    order = ["doc_id", "sb_tie", "sb_row"]
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with shuffle_cleanup(docs.sparkSession):
        ordered.transform(map_batches, run, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


PIECE_SCHEMA = "part int, start long, doc_id long, n_tokens long, block int, crc long, raw binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that lie in one block with their checksum; pieces of the others as they are."""
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            (r,) = batch.slice(i, 1).to_pylist()
            raw = from_planes(r["planes"], r["n_ids"], r["kind"]).tobytes()
            begin = r["first_id"]
            stop = begin + r["n_ids"]
            if r["open_doc"] >= 0:
                to = min([stop, *(d["start"] for d in r["docs"][:1])])
                out.append((r["part"], r["open_doc"], None, None, r["block"], None, raw[: 4 * (to - begin)]))
            for d in r["docs"]:
                mine = raw[4 * (d["start"] - begin) : 4 * (d["start"] + d["n_tokens"] - begin)]
                whole = d["start"] + d["n_tokens"] <= stop
                out.append((r["part"], d["start"], d["doc_id"], d["n_tokens"], r["block"], zlib.crc32(mine) if whole else None, None if whole else mine))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files at path."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # As many rows as partitions were written.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    pieces = blocks.transform(map_batches, _pieces, PIECE_SCHEMA)
    # Only documents over several blocks come in pieces with bytes.
    joined = pieces.groupBy("part", "start").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("crc").alias("crc"), joined_binary("block", "raw").alias("raw"))
    return joined.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).cast("long").alias("start"), "n_tokens", F.coalesce("crc", F.crc32("raw")).alias("ids_crc32"))
