"""Fill-in-middle transformation in Arrow: units as list arrays, roles by ordinal, pieces joined per batch.

Spark derives two cut points and a form for each row from a digest of its id.
A task then turns a batch of texts into list arrays of their units (code
points), flattens them with the index of the text that each stems from, and
numbers the units of a text.  Units before the first cut point are prefix, those
from the second on suffix, the rest middle: each role is filtered, its lists are
built again and joined, and the pieces of a row are joined around the marks in
the order of its form.

Memory: texts are taken in slices of bounded bytes; a longer text is cut in
blocks of that size, whose pieces are joined last.

Defined results: a null text is an empty one, and plain; a null id counts as the
text "null"; rows are independent, so repeated rows give equal results; a text
that holds a mark stays plain, so that restore() is exact; other columns are
kept, but for the text and those that have an output's name; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import map_batches

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT = 10
#: Of the rows that aren't plain, the share with the suffix first.
SUFFIX_FIRST_PERCENT = 20
SEED = 1
#: Bytes of text that a task flattens at once; a unit takes some sixty bytes more than its own.
SLICE_BYTES = 1 << 17
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def cut_points(text: Column, key: Column, seed: int = SEED, marks: tuple[str, str, str] = MARKS) -> list[Column]:
    """n, form, prefix_chars and middle_chars of each row (the last two null where the form is plain)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    n = F.length(text).cast("long")
    marked = F.lit(False)
    for mark in marks:
        marked = marked | text.contains(mark)
    form = F.when((n == 0) | marked | (h3 % 100 >= 100 - PLAIN_PERCENT), "plain").when(h4 % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    first, second = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))
    cut = form != "plain"
    return [n.alias("n"), form.alias("form"), F.when(cut, first).alias("prefix_chars"), F.when(cut, second - first).alias("middle_chars")]


def units(text: pa.Array) -> pa.LargeListArray:
    """Each text as the list of its code points; these share the text's bytes."""
    raw, offsets = V.flat(text)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    points = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, offsets)), points)


def pieces(text: pa.Array, first: pa.Array, second: pa.Array, before: int = 0) -> list[pa.Array]:
    """Prefix, middle and suffix of each text; ``before`` units of it stand before what is given."""
    lists = units(text)
    parent, unit = pc.list_parent_indices(lists), pc.list_flatten(lists)
    begins = pc.subtract(lists.offsets.slice(0, len(text)), before)
    ordinal = pc.subtract(pa.array(np.arange(len(unit))), pc.take(begins, parent))
    prefix = pc.less(ordinal, pc.take(first, parent))
    suffix = pc.greater_equal(ordinal, pc.take(second, parent))
    out = []
    for role in (prefix, pc.invert(pc.or_(prefix, suffix)), suffix):
        sizes = np.bincount(pc.filter(parent, role).to_numpy(), minlength=len(text))
        again = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pc.filter(unit, role))
        out.append(pc.binary_join(again, pa.scalar("", pa.large_string())))
    return out


def _blocks(text: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The one text in blocks, each with the number of units before it."""
    raw, _ = V.flat(text)
    at = before = 0
    while at < len(raw):
        stop = min(len(raw), at + SLICE_BYTES)
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop += 1
        yield before, pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([at, stop])), pa.py_buffer(raw))
        before += int(((raw[at:stop] & 0xC0) != 0x80).sum())
        at = stop


def rearranged(text: pa.Array, form: pa.Array, first: pa.Array, second: pa.Array, marks: tuple[str, str, str] = MARKS) -> pa.Array:
    """The output of each row: the text itself where the form is plain."""
    text = V.as_text(text)
    first, second = pc.fill_null(first, 0), pc.fill_null(second, 0)
    if len(text) == 1 and pc.binary_length(text)[0].as_py() > SLICE_BYTES:
        parts = zip(*(pieces(block, first, second, before) for before, block in _blocks(text)), strict=True)
        joined = (pa.LargeListArray.from_arrays(pa.array([0, len(p)]), pa.concat_arrays(p)) for p in parts)
        prefix, middle, suffix = (pc.binary_join(p, pa.scalar("", pa.large_string())) for p in joined)
    else:
        prefix, middle, suffix = pieces(text, first, second)
    p, s, m, nothing = (pa.scalar(x, pa.large_string()) for x in (*marks, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    return pc.case_when(pc.make_struct(pc.equal(form, "plain"), pc.equal(form, "psm")), text, psm, spm)


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs without text, with n (units), form, prefix_chars, middle_chars and output."""
    kept = [c for c in docs.columns if c not in (text, *OUTPUTS) or c == key != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    own = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0).alias("sb_none"))
    rows = docs.select(own.alias("own"), whole.alias("text"), *cut_points(whole, F.col(key), seed, marks))
    schema = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text", SLICE_BYTES):
                own, text, n, form, first, middle = part.columns
                output = rearranged(text, form, first, pc.add(first, middle), marks)
                yield pa.RecordBatch.from_arrays([own, n, form, first, middle, output.cast(pa.string())], names=schema.names)

    done = rows.transform(map_batches, run, schema)
    return done.select(*[F.col("own")[c].alias(c) for c in kept], *[c for c in OUTPUTS if c not in kept])


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of the given form was made of."""
    part = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """What transform() gives, with digests of the output and of the text restored from it in the output's place."""
    restored = restore(F.col("output"), F.col("form"))
    return rows.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))
