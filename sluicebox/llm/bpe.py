"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks that overlap.  A chunk is pre-tokenised from its
own first character; the boundaries found there may be wrong near its start, and
near its end where a pre-token's extent hangs on what follows.  The
pre-tokenising pattern looks only forward, so two chunks that have one boundary
in common agree on all that follows: the first common boundary in the overlap is
where they are stitched.  Where an overlap holds none (a long run of one kind of
character), the failed stretch alone is cut again, twice as long, until it
resynchronises.  The pre-tokens of the pieces between stitches are encoded one
by one, and their ids joined; a text of one chunk is encoded as it is.

A text of up to BLOCK_CHARS is chunked and stitched by the task that holds it.
Longer texts are cut into blocks of that size first, which overlap likewise and
are dealt out over the tasks; their stitches are found by Spark over the blocks'
boundaries, and blocks that fail are merged two by two and dealt out again.  A
block is split anew between its stitches, so these may not follow white space,
whose extent hangs on what comes after it.

Defined results: null and empty texts have no ids; repeated rows are encoded
each for itself; other columns are kept and never looked at, but for those that
have an output's name, which the output replaces; an empty table gives an empty
table.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import joined_binary, map_batches, materialize

CHUNK_CHARS = 2048
OVERLAP_CHARS = 192
#: Longer texts are dealt out in blocks.
BLOCK_CHARS = 64 << 10
BLOCK_OVERLAP_CHARS = 2 << 10
#: How many of a chunk's last pre-tokens may hang on what follows the chunk.
OPEN_TOKENS = 8
SLICE_BYTES = 1 << 20
#: Ids of pre-tokens up to MEMO_CHARS long that a worker remembers.
MEMO_TOKENS = 200_000
MEMO_CHARS = 40
#: The Unicode white space that the tokenizer's \s stands for (fixed values).
WHITE_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(ranks_path: str) -> list[bytes]:
    """Bytes of each token by its id."""
    with open(ranks_path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def _ranges(chars: set[str]) -> str:
    """A set of characters as the inside of a character class."""
    points = np.array(sorted(map(ord, chars)))
    begin = np.flatnonzero(np.diff(points, prepend=-2) > 1)
    stop = np.append(begin[1:], len(points)) - 1
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[begin], points[stop], strict=True))


@lru_cache(maxsize=4)
def newer_characters() -> tuple[str, str]:
    """Letters and numbers, as insides of classes, that ``regex`` knows and the tokenizer's older Unicode tables don't."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        own = regex.findall(kind, every)
        table = tiktoken.Encoding("table", pat_str=kind, mergeable_ranks=single, special_tokens={})
        out.append(_ranges(set(own) - set(bytes(table.encode_ordinary("".join(own))).decode())))
    return out[0], out[1]


class PreTokenizer:
    """Pre-tokens of a text by the tokenizer's pattern, with the tokenizer's own tables of characters."""

    def __init__(self, pattern: str, newer: tuple[str, str]):
        spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
        self.usual = regex.compile(spelled).findall
        known = any(newer)
        self.doubtful = regex.compile(f"[{newer[0]}{newer[1]}]").search if known else None
        if known:
            for kind, ranges in zip((r"\p{L}", r"\p{N}"), newer, strict=True):
                spelled = spelled.replace(kind, f"[{kind}--[{ranges}]]" if ranges else kind)
            self.exact = regex.compile(f"(?V1){spelled}").findall

    def __call__(self, text: str) -> list[str]:
        if self.doubtful is not None and not text.isascii() and self.doubtful(text):
            return self.exact(text)
        return self.usual(text)


@lru_cache(maxsize=4)
def pre_tokenizer(pattern: str, newer: tuple[str, str]) -> PreTokenizer:
    return PreTokenizer(pattern, newer)


def sure_ends(tokens: list[str], end: int, least: int) -> list[tuple[int, int]]:
    """(end, how many pre-tokens end there or before), from the last, of those that what follows the chunk cannot change.

    The tokens stand up to ``end``; of the ends below ``least`` only the last one may be given.
    """
    out = []
    for i in range(len(tokens) - 1, 0, -1):
        end -= len(tokens[i])
        if len(tokens) - i >= OPEN_TOKENS:
            if end < least and out:
                break
            out.append((end, i))
    return out


def stitches(text: str, split: Callable[[str], list[str]], size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """The text as pieces (begin, end, pre-tokens) from chunks of ``size`` characters and an overlap, cut where they are stitched."""
    begin, stop = 0, min(len(text), size + overlap)
    tokens = split(text[:stop])
    while stop < len(text):
        at = stop - overlap
        more_stop = min(len(text), stop + size)
        more = split(text[at:more_stop])
        ends = sure_ends(tokens, stop, at)
        sure = dict(ends)
        common, j, head = None, 0, at
        for j, token in enumerate(more, 1):
            head += len(token)
            if head >= stop:
                break
            if head in sure:
                common = head
                break
        if common is not None:
            yield begin, common, tokens[: sure[common]]
            begin, tokens = common, more[j:]
        else:
            # Only what follows the last sure boundary is cut again, and twice as far.
            last, i = ends[0] if ends else (begin, 0)
            if i:
                yield begin, last, tokens[:i]
            more_stop = min(len(text), max(more_stop, 2 * stop - last))
            begin, tokens = last, split(text[last:more_stop])
        stop = more_stop
    yield begin, stop, tokens


def stitched(text: str, split: Callable[[str], list[str]], size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """The pre-tokens of a text."""
    return [token for _, _, tokens in stitches(text, split, size, overlap) for token in tokens]


class Coder:
    """Encodes texts: those of several chunks by the pre-tokens of the pieces between stitches."""

    def __init__(self, ranks_path: str, pattern: str, newer: tuple[str, str], size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.ids = encoding(ranks_path, pattern).encode_ordinary
        self.split, self.size, self.overlap = pre_tokenizer(pattern, newer), size, overlap
        self.known: dict[str, bytes] = {}

    def _token(self, token: str) -> bytes:
        """Ids of a pre-token; split by itself it stays one."""
        if len(token) > MEMO_CHARS:
            return np.array(self.ids(token), "<u4").tobytes()
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MEMO_TOKENS:
                self.known.clear()
            found = self.known[token] = np.array(self.ids(token), "<u4").tobytes()
        return found

    def one(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        if len(text) <= self.size + self.overlap:
            return np.array(self.ids(text), "<u4").tobytes()
        return b"".join([self._token(t) for _, _, tokens in stitches(text, self.split, self.size, self.overlap) for t in tokens])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them); null is the empty text."""
        raw = [self.one(t) if t else b"" for t in texts.to_pylist()]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        return np.frombuffer(b"".join(raw), "<u4"), np.concatenate([[0], np.cumsum(lengths)])


@lru_cache(maxsize=4)
def memo(ranks_path: str, pattern: str, newer: tuple[str, str] | None = None, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Coder:
    return Coder(ranks_path, pattern, newer or newer_characters(), size, overlap)


def _binary_rows(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(ids, dtype="<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(raw)])


def _decoded(ids: pa.Array, ranks_path: str) -> pa.Array:
    """The joined bytes of each value's ids; null ids have none."""
    of = token_bytes(ranks_path).__getitem__
    return pa.array([b"".join(map(of, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else b"" for x in ids], pa.binary())


def _encode_column(df: DataFrame, text: str, out: str, ranks_path: str, pattern: str, size: int, overlap: int, decoded: str | None = None) -> DataFrame:
    """df with its text column replaced by the ids as little-endian unsigned 32-bit integers (and what they decode to)."""
    keep = [f for f in df.schema.fields if f.name not in (text, out, decoded)]
    schema = T.StructType([*keep, *(T.StructField(n, T.BinaryType()) for n in (out, decoded) if n)])
    newer = newer_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = memo(ranks_path, pattern, newer, size, overlap)
        for batch in batches:
            for part in V.slices(batch, text, SLICE_BYTES):
                ids, offsets = coder.encode(part.column(text))
                cols = [part.column(f.name) for f in keep] + [_binary_rows(ids, offsets).cast(pa.binary())]
                if decoded:
                    cols.append(_decoded(cols[-1], ranks_path))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return df.transform(map_batches, run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, block_chars: int = BLOCK_CHARS, block_overlap: int = BLOCK_OVERLAP_CHARS, decoded: str | None = None) -> DataFrame:
    """docs with the column ``out`` (ids as little-endian unsigned 32-bit integers) in place of ``text``.

    With ``decoded``, a column of that name holds what decode() makes of the ids;
    the task that encodes a text decodes it too, so that a stage needs one Python
    worker for each core and not two.
    """
    keep = [c for c in docs.columns if c not in (text, out, decoded)]
    size = F.coalesce(F.length(text), F.lit(0))
    how = (ranks_path, pattern, chunk_chars, overlap_chars)
    short = _encode_column(docs.where(size <= block_chars), text, out, *how, decoded=decoded)
    long = docs.where(size > block_chars)
    if long.select(F.lit(1)).isEmpty():
        return short
    joined = _encode_long(long, keep, text, out, block_chars, block_overlap, *how)
    return short.unionByName(decode(joined, ranks_path, out, decoded) if decoded else joined)


def _blocks(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """sb_row, sb_k, sb_block (with the overlap at its end) and sb_size (characters before the overlap) of each block."""
    begins = F.sequence(F.lit(0), F.length("sb_text") - 1, F.lit(size))
    cut = F.transform(begins, lambda a: F.struct((a / size).cast("int").alias("sb_k"), F.substring("sb_text", a + 1, F.lit(size + overlap)).alias("sb_block"), F.lit(size).alias("sb_size")))
    return rows.select("sb_row", F.explode(cut).alias("b")).select("sb_row", "b.*")


def _bounded(blocks: DataFrame, pattern: str, overlap: int, chunk: int, chunk_overlap: int) -> DataFrame:
    """blocks with the boundaries in the overlaps: sb_head from a block's start, sb_tail from where the next one starts."""
    schema = T.StructType([*blocks.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("sb_head", "sb_tail"))])
    newer = newer_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizer(pattern, newer)
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                block, size = one.column("sb_block")[0].as_py(), one.column("sb_size")[0].as_py()
                tokens = stitched(block, split, chunk, chunk_overlap)
                ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
                closed = np.fromiter((not t[-1].isspace() for t in tokens), bool, len(tokens))
                sure = ends[: max(0, len(ends) - OPEN_TOKENS)]
                found = (ends[closed & (ends <= overlap)], sure[closed[: len(sure)] & (sure >= size)] - size)
                yield pa.RecordBatch.from_arrays([*one.columns, *(pa.array([x.tolist()], pa.list_(pa.int32())) for x in found)], names=schema.names)

    # The blocks of one long text are dealt out before the slow part.
    return blocks.repartition("sb_row", "sb_k").transform(map_batches, run, schema)


def _stitched_blocks(rows: DataFrame, pattern: str, size: int, overlap: int, chunk: int, chunk_overlap: int) -> DataFrame:
    """Blocks with sb_cut, where each is stitched to the one before; those without a common boundary are merged and cut again."""
    text_order = Window.partitionBy("sb_row").orderBy("sb_k")
    done = materialize(_bounded(_blocks(rows, size, overlap), pattern, overlap, chunk, chunk_overlap), "blocks")
    while True:
        common = F.array_min(F.array_intersect(F.lag("sb_tail").over(text_order), "sb_head"))
        cuts = done.withColumn("sb_cut", F.when(F.row_number().over(text_order) == 1, F.lit(0)).otherwise(common))
        if cuts.where("sb_cut is null").isEmpty():
            return cuts
        # Blocks that follow each other without a stitch, two by two.
        run = F.sum(F.col("sb_cut").isNotNull().cast("int")).over(text_order)
        cuts = cuts.withColumn("sb_run", run)
        pair = F.floor((F.row_number().over(Window.partitionBy("sb_row", "sb_run").orderBy("sb_k")) - 1) / 2)
        cuts = cuts.withColumn("sb_pair", pair).withColumn("sb_n", F.count(F.lit(1)).over(Window.partitionBy("sb_row", "sb_run", "sb_pair")))
        cuts = materialize(cuts, "pairs")
        parts = F.array_sort(F.collect_list(F.struct("sb_k", "sb_block", "sb_size")))
        pairs = cuts.where("sb_n = 2").groupBy("sb_row", "sb_run", "sb_pair").agg(parts.alias("p"))
        first, last = F.col("p")[0], F.col("p")[1]
        merged = pairs.select("sb_row", first["sb_k"].alias("sb_k"), F.concat(F.substring(first["sb_block"], F.lit(1), first["sb_size"]), last["sb_block"]).alias("sb_block"), (first["sb_size"] + last["sb_size"]).alias("sb_size"))
        done = materialize(cuts.where("sb_n = 1").select(*done.columns).unionByName(_bounded(merged, pattern, overlap, chunk, chunk_overlap)), "blocks")


def _encode_long(docs: DataFrame, keep: list[str], text: str, out: str, size: int, overlap: int, ranks_path: str, pattern: str, chunk: int, chunk_overlap: int) -> DataFrame:
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("sb_none"))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("sb_row"), kept.alias("sb_keep"), F.col(text).alias("sb_text")), "long")
    cuts = _stitched_blocks(rows.select("sb_row", "sb_text"), pattern, size, overlap, chunk, chunk_overlap)
    end = F.lead("sb_cut").over(Window.partitionBy("sb_row").orderBy("sb_k"))
    start = F.col("sb_cut") + 1
    piece = F.when(end.isNull(), F.substring("sb_block", start, F.length("sb_block"))).otherwise(F.substring("sb_block", start, end + F.col("sb_size") - F.col("sb_cut")))
    pieces = cuts.select("sb_row", "sb_k", piece.alias("sb_piece")).repartition("sb_row", "sb_k")
    ids = _encode_column(pieces, "sb_piece", "sb_ids", ranks_path, pattern, chunk, chunk_overlap)
    joined = ids.groupBy("sb_row").agg(joined_binary("sb_k", "sb_ids").alias("sb_all"))
    return rows.select("sb_row", "sb_keep").join(joined, "sb_row").select(*[F.col("sb_keep")[c].alias(c) for c in keep], F.col("sb_all").alias(out))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column ``out``: the joined bytes of each row's ids (null ids: no bytes)."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, ids, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), _decoded(part.column(ids), ranks_path)], names=schema.names)

    return df.transform(map_batches, run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return df.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
