"""Ranges of the commit graph: ``a..b`` and ``a...b`` from a table of commits with their parents.

Commits lie on paths: one commit goes on with its first parent's path, of several
children of one parent the greatest; ``chains`` gives each its place on its path.  What is
reached of a path is all from some place on, so a set of reached commits is one
place a path, and a round joins the parents that lead to other paths with the
places that are new.  Rounds are as many as a way has to change paths to get to
commits that no earlier round has reached, not the depth of the history.
``name~n`` goes by jumps: the n-th power of two ancestors come from joining the
jumps of half the length with themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept, written
from .chains import ranked

#: Characters of a hash that name it at least.
SHORT = 4


class RangeError(ValueError):
    """A revision that is not there or not clear."""


class Graph:
    """Commits (hash, parents: the first one first) and names for some of them (name, hash)."""

    def __init__(self, commits: DataFrame, refs: DataFrame | None = None):
        self.commits, self.refs = commits, refs
        self.rounds = 0
        self._jumps: list[DataFrame] | None = None
        self._places: DataFrame | None = None
        self._ways: DataFrame | None = None

    def jumps(self) -> list[DataFrame]:
        """(hash, to) for the 1st, 2nd, 4th ... first-parent ancestor, each table shorter than the one before."""
        if self._jumps is None:
            self._jumps = []
            jump = kept(self.commits.where(F.size("parents") > 0).select("hash", F.get("parents", F.lit(0)).alias("to")))
            while not jump.isEmpty():
                self._jumps.append(jump)
                half = jump.select(F.col("hash").alias("to"), F.col("to").alias("further"))
                jump = kept(jump.join(half, "to").select("hash", F.col("further").alias("to")))
        return self._jumps

    def places(self) -> DataFrame:
        """hash, path and place (from the path's youngest commit on) of all commits and parents."""
        if self._places is None:
            parents = self.commits.select("hash", F.posexplode("parents").alias("n", "parent")).where("parent IS NOT NULL")
            names = self.commits.select("hash").unionByName(parents.select(F.col("parent").alias("hash"))).where("hash IS NOT NULL").distinct()
            ids = written(names.withColumn("id", F.monotonically_increasing_id()))
            parents = parents.join(ids.withColumnRenamed("id", "c"), "hash").select("c", "n", F.col("parent").alias("hash")).join(ids.withColumnRenamed("id", "p"), "hash").where("c <> p").groupBy("c", "p").agg(F.min("n").alias("n"))
            parents = written(parents)
            firsts = parents.where("n = 0").groupBy("c").agg(F.min("p").alias("id")).groupBy("id").agg(F.max("c").alias("before"))
            # A commit that is its own ancestor can't be; it would be a path of its own.
            placed = ranked(ids.select("id").join(firsts, "id", "left")).select("id", F.coalesce("head", "id").alias("path"), F.coalesce("place", F.lit(0)).alias("place"))
            self._places = written(ids.join(placed, "id"))
            of = lambda name, path, place: self._places.select(F.col("id").alias(name), F.col("path").alias(path), F.col("place").alias(place))
            ways = parents.select("c", "p").join(of("c", "path", "place"), "c").join(of("p", "to_path", "to_place"), "p")
            self._ways = written(ways.where("path <> to_path OR to_place < place").select("path", "place", "to_path", "to_place"))
        return self._places

    def reached(self, tips: dict[str, str]) -> DataFrame:
        """side, path and the place from which on it is reached (at), for each side's tip."""
        sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(tip).alias("tip")) for side, tip in tips.items()]))
        places = self.places().where(F.col("hash").isin(*tips.values()))
        new = places.select("hash", "path", "place", sides.alias("s")).where("hash = s.tip").select("s.side", "path", F.col("place").alias("at"), F.lit(None).cast("long").alias("was"))
        new, self.rounds = written(new), 0
        found = new.drop("was")
        while True:
            self.rounds += 1
            to = new.join(self._ways, "path").where("place >= at AND (was IS NULL OR place < was)").groupBy("side", F.col("to_path").alias("path")).agg(F.min("to_place").alias("at"))
            known = found.withColumnRenamed("at", "was")
            new = written(to.join(known, ["side", "path"], "left").where("was IS NULL OR at < was"))
            if new.isEmpty():
                return found
            found = written(found.unionByName(new.drop("was")).groupBy("side", "path").agg(F.min("at").alias("at")))

    def resolve(self, revision: str) -> str:
        """The hash that a name, a hash or the unique start of one stands for, with ``~n`` and ``^n`` after it."""
        base, steps = re.fullmatch(r"(.*?)((?:[~^]\d*)*)", revision, re.S).groups()
        if not base or base.startswith("-"):
            raise RangeError(f"unknown revision {revision!r}")
        found = [] if self.refs is None else self.refs.where(F.col("name") == base).select("hash").limit(2).collect()
        if not found and len(base) >= SHORT:
            found = self.commits.where(F.col("hash").startswith(base)).select("hash").distinct().limit(2).collect()
        if len(found) != 1:
            raise RangeError(f"{'ambiguous' if found else 'unknown'} revision {revision!r}")
        at = found[0]["hash"]
        for kind, count in re.findall(r"([~^])(\d*)", steps):
            at = self._ancestor(at, int(count or 1)) if kind == "~" else self._parent(at, int(count or 1))
            if at is None:
                raise RangeError(f"unknown revision {revision!r}")
        return at

    def _ancestor(self, at: str | None, n: int) -> str | None:
        jumps = self.jumps()
        if n >> len(jumps):
            return None
        for k, jump in enumerate(jumps):
            if at is not None and n >> k & 1:
                row = jump.where(F.col("hash") == at).first()
                at = row and row["to"]
        return at

    def _parent(self, at: str, n: int) -> str | None:
        if n == 0:
            return at
        row = self.commits.where(F.col("hash") == at).select(F.get("parents", F.lit(n - 1)).alias("p")).first()
        return row and row["p"]

    def within(self, text: str, head: str = "HEAD") -> DataFrame:
        """hash of the commits that a range means: ``a..b``, ``a...b`` (in just one of them) or all up to ``b``; a missing side is head."""
        left, dots, right = re.fullmatch(r"(.*?)(?:(\.{2,3})(?!\.)(.*))?", text.strip(), re.S).groups()
        if not dots:
            return self._marked({"b": self.resolve(left or head)}).where("b").select("hash")
        marked = self._marked({"a": self.resolve(left or head), "b": self.resolve(right or head)})
        return marked.where("b AND NOT a" if dots == ".." else "a <> b").select("hash")

    def _marked(self, tips: dict[str, str]) -> DataFrame:
        """hash and, for each side, whether it is reached from its tip."""
        found, rows = self.reached(tips), self.places()
        for side in tips:
            rows = rows.join(found.where(F.col("side") == side).select("path", F.col("at").alias(f"{side}_at")), "path", "left")
        rows = rows.select("hash", *[F.coalesce(F.col("place") >= F.col(f"{side}_at"), F.lit(False)).alias(side) for side in tips])
        # A tip that the table lacks is reached all the same.
        spark = self.commits.sparkSession
        lone = spark.createDataFrame([(tip, *[tip == t for t in tips.values()]) for tip in set(tips.values())], rows.schema)
        return rows.unionByName(lone.join(rows.select("hash"), "hash", "left_anti"))


def in_range(log: DataFrame, graph: Graph, text: str, head: str = "HEAD") -> DataFrame:
    """Rows of the log whose commits are in the range."""
    return log.join(graph.within(text, head), "hash", "left_semi")
