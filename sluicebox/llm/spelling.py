"""Spelling variants by composing finite-state machines: vocabulary, one edit, vocabulary.

Words that differ by one inserted, deleted or replaced code point are the pairs
that the composition V . E . V accepts, where V is the minimised acceptor of the
vocabulary and E the transducer of one edit.  Up to the edit both words read the
same symbols, so the composition's states before it are pairs of equal states,
and after it both must read the same rest.

Partitions.  The first place where two words differ is the edit's place, of
which the shorter word (m code points) has m + 1.  Each word is posted for the
edits in a zone of places: what stands before the zone and after it, which the
edit leaves alone, is the partition's key; a partition's machines start in the
state that has read what stands before.  First each half of the places is a zone
(four postings for each word, as it may be the shorter word of a pair or the
longer one).  A partition whose zones hold more than PARTITION_CHARS is posted
again by each half of its zone, until it is small: a zone of one place leaves
two symbols at most for each word, so its words are bounded by the square of the
alphabet.  So no partition grows with the corpus, and each pair is accepted in
the one partition that has its place.

Defined results: a null text has no words; a null id counts as the text "null";
each of repeated rows counts; words of equal count tie by code points; other
columns are never looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

WORD = r"[A-Za-zÀ-ÿ]"
MIN_CHARS = 5
MIN_COUNT = 3
#: A form occurs at least so many times as often as the word.
FORM_FACTOR = 2
#: Characters that the zones of a partition hold together at most.
PARTITION_CHARS = 100_000
#: States that a task shares between partitions before it begins anew.
REGISTER_STATES = 300_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["m", "lo", "hi", "head", "tail"]


def typos(run: Column, key: Column, every: int = 97) -> Column:
    """The run without one code point where ``every`` divides the digest of id and run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of all words with ``min_chars`` code points and ``min_count`` occurrences at least.

    A run is shortened by one code point at most, so shorter runs are left out
    before they are exploded; counts are summed in the tasks first.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"{WORD}{{{min_chars},}}"), F.lit(0))
    runs = docs.select(F.col(key).alias("key"), F.explode(found).alias("run"))
    words = runs.select(typos(F.translate("run", _UPPER, _LOWER), F.col("key")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _posted(rows: DataFrame, zones: Column) -> DataFrame:
    """rows (word, n) under each of their zones (structs of m, lo and hi): key, zone and whether the word is the shorter one."""
    at = rows.select("word", "n", F.explode(zones).alias("z")).select("word", "n", "z.m", "z.lo", "z.hi")
    after = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    size = F.length("word")
    head, tail = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", size - after + 1, after)
    zone = F.substring("word", F.col("lo") + 1, size - F.col("lo") - after)
    return at.select("m", "lo", "hi", head.alias("head"), tail.alias("tail"), zone.alias("zone"), (size == F.col("m")).alias("short"), "n", "word")


def _halves(m: Column, lo: Column, hi: Column) -> list[Column]:
    middle = F.floor((lo + hi) / 2).cast("int")
    return [F.struct(m.alias("m"), a.alias("lo"), b.alias("hi")) for a, b in ((lo, middle), (middle, hi))]


class Acceptors:
    """Minimised acceptors that share equal states: (whether a word ends here, symbols with the state that each leads to)."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.ends: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.meeting: dict[tuple[int, int], bool] = {}

    def _state(self, end: bool, arcs: dict[str, int]) -> int:
        state = self.register.setdefault((end, *arcs.items()), len(self.ends))
        if state == len(self.ends):
            self.ends.append(end)
            self.arcs.append(arcs)
        return state

    def build(self, words: list[str]) -> int:
        """The initial state of the acceptor of sorted words; a state is minimised once no later word can pass it."""
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""

        def settle(depth: int) -> None:
            for at in range(len(path) - 1, depth, -1):
                state = self._state(*path.pop())
                path[-1][1][last[at - 1]] = state

        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            settle(common)
            path.extend((False, {}) for _ in range(len(word) - common))
            path[-1] = (True, path[-1][1])
            last = word
        settle(0)
        return self._state(*path[0])

    def meet(self, p: int, q: int) -> bool:
        """Whether both states accept a common rest."""
        todo = [(p, q)]
        while todo:
            at = todo[-1]
            if at in self.meeting:
                todo.pop()
                continue
            a, b = at
            if a == b or self.ends[a] and self.ends[b]:
                self.meeting[at] = True
                continue
            nexts = [(s, self.arcs[b][c]) for c, s in self.arcs[a].items() if c in self.arcs[b]]
            unknown = [x for x in nexts if x not in self.meeting]
            if unknown and not any(self.meeting.get(x) for x in nexts):
                todo.append(unknown[0])
            else:
                self.meeting[at] = any(self.meeting.get(x) for x in nexts)
        return self.meeting[p, q]

    def rests(self, p: int, q: int) -> Iterator[str]:
        """What both states accept."""
        todo = [(p, q, "")]
        while todo:
            a, b, rest = todo.pop()
            if not self.meet(a, b):
                continue
            if self.ends[a] and self.ends[b]:
                yield rest
            todo += [(s, self.arcs[b][c], rest + c) for c, s in self.arcs[a].items() if c in self.arcs[b]]

    def replaced(self, start: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs whose words differ in one symbol, each once."""
        todo = [(start, "")]
        while todo:
            state, read = todo.pop()
            arcs = list(self.arcs[state].items())
            for i, (a, p) in enumerate(arcs):
                todo.append((p, read + a))
                for b, q in arcs[i + 1 :]:
                    for rest in self.rests(p, q):
                        yield read + a + rest, read + b + rest

    def deleted(self, long: int, short: int, places: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs (longer, shorter) where one symbol is deleted in the first ``places``, at the first place where they differ."""
        todo = [(long, short, "")]
        while todo:
            p, q, read = todo.pop()
            if len(read) >= places:
                continue
            for a, s in self.arcs[p].items():
                if self.ends[s] and self.ends[q]:
                    yield read + a, read
                for c, t in self.arcs[s].items():
                    if c != a and c in self.arcs[q]:
                        for rest in self.rests(t, self.arcs[q][c]):
                            yield read + a + c + rest, read + c + rest
                if a in self.arcs[q]:
                    todo.append((s, self.arcs[q][a], read + a))


def _compose(partitions: DataFrame) -> DataFrame:
    """word, near and near_n for each accepted pair, in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Acceptors()
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in ("lo", "hi", "head", "tail", "members")}
                if len(machine.ends) > REGISTER_STATES:
                    machine = Acceptors()
                n = {True: {}, False: {}}
                for x in one["members"]:
                    n[x["short"]][x["zone"]] = x["n"]
                short = machine.build(sorted(n[True]))
                found = [(a, b, n[True][a], n[True][b]) for a, b in machine.replaced(short)]
                if n[False]:
                    long = machine.build(sorted(n[False]))
                    found += [(a, b, n[False][a], n[True][b]) for a, b in machine.deleted(long, short, one["hi"] - one["lo"])]
                if found:
                    whole = [(one["head"] + a + one["tail"], one["head"] + b + one["tail"], x, y) for a, b, x, y in found]
                    columns = zip(*whole, *((b, a, y, x) for a, b, x, y in whole))
                    words, near, _, near_n = (list(c) for c in columns)
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(near), pa.array(near_n, pa.int64())], names=["word", "near", "near_n"])

    return partitions.transform(map_batches, run, "word string, near string, near_n long")


def pairs(words: DataFrame, partition_chars: int = PARTITION_CHARS) -> DataFrame:
    """word, near and near_n for all words (word, n; each word once) that are one edit apart, in both directions."""
    size = F.length("word")
    zero = F.lit(0)
    zones = F.array(*[z for m in (size, size - 1) for z in _halves(m, zero, m + 1)])
    posted = materialize(_posted(words, zones), "postings")
    found = None
    while True:
        sizes = posted.groupBy(*_KEY).agg(F.sum(F.length("zone")).alias("chars"), F.count(F.lit(1)).alias("members"), F.count_if("short").alias("shorts"))
        sizes = sizes.where("members > 1 and shorts > 0").select(*_KEY, ((F.col("chars") > partition_chars) & (F.col("hi") - F.col("lo") > 1)).alias("large"))
        rows = posted.join(sizes, _KEY)
        lists = rows.where("not large").groupBy(*_KEY).agg(F.collect_list(F.struct("zone", "short", "n")).alias("members"))
        more = materialize(_compose(lists), "pairs")
        found = more if found is None else found.unionByName(more)
        large = materialize(rows.where("large").select("word", "n", F.array(*_halves(F.col("m"), F.col("lo"), F.col("hi"))).alias("zones")), "large")
        if large.isEmpty():
            return found
        posted = materialize(_posted(large, F.col("zones")), "postings")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for forms (word, form): the last word that following forms leads to, by pointer doubling."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("at"), F.col("root").alias("up"))
        joined = reached.join(further, reached["root"] == further["at"], "left")
        reached = materialize(joined.select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def variants(words: DataFrame, factor: int = FORM_FACTOR, partition_chars: int = PARTITION_CHARS) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words (word, n; each word once)."""
    words = materialize(words, "words")
    # The least of (-n, word): the largest count, and of equal ones the first word.
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = pairs(words, partition_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    often = -F.col("best.n") >= factor * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.n")).alias("form_n"))
    known = materialize(joined, "forms")
    rooted = known.join(roots(known.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
