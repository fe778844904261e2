"""Token ids of whole texts, with each distinct segment encoded once per worker.

A segment is what stands between single spaces; the space goes to the segment
that it precedes.  A space between two characters that are no white space always
begins a new pre-token of the byte-level tokenizers, and no piece of the word
piece model spans it, so a text's ids are the ids of its segments, joined.
Texts in which a space touches other white space (or stands at an end) are
encoded as a whole instead.  Words repeat far more often than texts do: the
memo turns most of the encoding into array look-ups.

New segments go to the tokenizer many at a time, as one text; the bytes that
each id stands for tell where one segment's ids end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import vectext as V

#: Segments a worker remembers before it drops those that have not come up again.
MEMO_SEGMENTS = 150_000
#: Bytes of text that are looked up together.
SEGMENT_SLICE_BYTES = 1 << 20
#: Segments that are encoded as one text.
JOINED = 256
#: The mark that stands for a space in word pieces.
MARK = "▁"


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start .. start + count - 1 of each pair, one after the other."""
    total = int(counts.sum())
    shift = np.cumsum(counts) - counts
    return np.repeat(starts - shift, counts) + np.arange(total)


class SegmentMemo:
    """Encodes texts through a memo of segments.

    encode_many: texts to id sequences; id_bytes: how many bytes of text each id
    stands for; own_space: the tokenizer itself puts a space before a text;
    remember: segments kept before those that have not come up again are dropped.
    """

    def __init__(self, encode_many: Callable[[list[str]], Sequence[Sequence[int]]], id_bytes: np.ndarray, own_space: bool = False, remember: int = MEMO_SEGMENTS):
        self.encode_many, self.id_bytes, self.own_space, self.remember = encode_many, id_bytes, own_space, remember
        self.known: dict[str, int] = {}
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _forget(self) -> None:
        """Keep the segments that came up in several slices since the last time."""
        kept = [(s, r) for s, r in self.known.items() if self.uses[r] > 1]
        if len(kept) > self.remember // 2:
            kept = []
        rows = np.fromiter((r for _, r in kept), np.int64, len(kept))
        counts = self.count[rows]
        ids = self.ids[ragged(self.start[rows], counts)]
        n = len(kept)
        self.known = {s: i for i, (s, _) in enumerate(kept)}
        self.count[:n], self.start[:n] = counts, np.cumsum(counts) - counts
        self.uses[:] = 0
        self.ids[: len(ids)] = ids
        self.used = len(ids)

    def _encode(self, segments: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, how many each has)."""
        if not joined:
            each = [np.asarray(e, np.uint32) for e in self.encode_many(segments)]
            return np.concatenate(each), np.array([len(e) for e in each], np.int64)
        groups = [segments[a : a + JOINED] for a in range(0, len(segments), JOINED)]
        glue = " " if self.own_space else ""
        ids, counts = [], []
        for group, got in zip(groups, self.encode_many([glue.join(g) for g in groups]), strict=True):
            got = np.asarray(got, np.uint32)
            ends = np.cumsum(np.array([len(s.encode()) for s in group], np.int64) + self.own_space)
            done = np.cumsum(self.id_bytes[got])
            last = np.searchsorted(done, ends)
            if last[-1] + 1 == len(got) and np.array_equal(done[last], ends):
                ids.append(got)
                counts.append(np.diff(last, prepend=-1))
            else:
                alone = self._encode(group, False)
                ids.append(alone[0])
                counts.append(alone[1])
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, segments: list[str], joined: bool) -> None:
        ids, counts = self._encode(segments, joined)
        n, total = len(self.known), len(ids)
        while n + len(segments) > len(self.start):
            self.start, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.uses))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.count[n : n + len(segments)] = counts
        self.start[n : n + len(segments)] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + total] = ids
        self.used += total
        self.known.update(zip(segments, range(n, n + len(segments)), strict=True))

    def _rows(self, segments: list[str], joined: bool) -> np.ndarray:
        known = self.known
        miss = [s for s in segments if s not in known]
        if miss:
            self._learn(miss, joined)
        rows = np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))
        self.uses[rows] += 1
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them); null is the empty text."""
        if len(self.known) > self.remember:
            self._forget()
        arr = V.as_text(texts)
        parts = pc.split_pattern(arr, " ")
        first = np.asarray(parts.offsets, dtype=np.int64)
        first = first - first[0]
        coded = pc.dictionary_encode(parts.flatten())
        words, code = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        lengths = pc.binary_length(arr).to_numpy(zero_copy_only=False)
        own = pc.binary_length(words)
        touched = pc.or_(pc.not_equal(own, pc.binary_length(pc.utf8_trim_whitespace(words))), pc.or_(pc.equal(own, 0), pc.match_substring(words, MARK)))
        bad_word = touched.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(arr)), np.diff(first))
        bad = np.zeros(len(arr), bool)
        if bad_word.any():
            bad[doc[bad_word[code]]] = True
        bad &= lengths > 0
        live = (~bad & (lengths > 0))[doc]
        at = np.zeros(len(code), np.int64)
        opens = np.zeros(len(code), bool)
        opens[first[:-1]] = True
        for before, where in ((" ", live & ~opens), ("", live & opens)) if not self.own_space else (("", live),):
            needed = np.flatnonzero(np.bincount(code[where], minlength=len(words)))
            if len(needed):
                some = words.take(pa.array(needed)).to_pylist()
                row = np.empty(len(words), np.int64)
                row[needed] = self._rows([before + w for w in some] if before else some, bool(before) or self.own_space)
                at[where] = row[code[where]]
        at = at[live]
        counts = self.count[at]
        per_doc = np.bincount(doc[live], weights=counts, minlength=len(arr)).astype(np.int64)
        ids = self.ids[ragged(self.start[at], counts)]
        if bad.any():
            which = np.flatnonzero(bad)
            whole = [np.asarray(e, np.uint32) for e in self.encode_many([arr[int(i)].as_py() for i in which])]
            ends = np.cumsum(per_doc)
            pieces, last = [], 0
            for i, e in zip(which, whole, strict=True):
                pieces += [ids[last : ends[i]], e]
                last = ends[i]
                per_doc[i] = len(e)
            ids = np.concatenate([*pieces, ids[last:]])
        return ids, np.concatenate([[0], np.cumsum(per_doc)])


def byte_level_memo(tokenizer, remember: int = MEMO_SEGMENTS) -> SegmentMemo:
    """Memo over a tokenizer of the tokenizers library: a byte-level token has a character for each of its bytes."""
    size = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        size[i] = len(token)
    return SegmentMemo(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], size, remember=remember)


def word_piece_memo(model) -> SegmentMemo:
    """Memo over a sentencepiece model with byte fallback, which itself puts the mark of a space before a text."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    size = np.array([1 if model.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)], np.int64)
    return SegmentMemo(lambda texts: model.encode(texts, num_threads=1), size, own_space=True)
