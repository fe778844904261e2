"""Named queries over review_log: a read-only gate, built-in and user queries, arguments, and running them."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources import history

#: Built-in queries in Spark SQL; ties are ordered, so that results are the same each time.
BUILT_IN = {
    "stats": "SELECT action AS Action, count(*) AS Commits, round(avg(iterations), 1) AS AvgIter, round(avg(coverage), 1) AS AvgCoveragePct FROM review_log GROUP BY action ORDER BY Commits DESC, Action",
    "by-author": "SELECT author AS Author, count(*) AS Commits, count_if(action = 'reviewed') AS Reviewed FROM review_log GROUP BY author ORDER BY Commits DESC, Author",
    "recent": "SELECT short_hash AS Hash, date AS Date, action AS Action, subject AS Subject FROM review_log ORDER BY date DESC, hash LIMIT 20",
}


class QueryError(ValueError):
    """A query, name or argument that is not accepted."""


def check_read_only(sql: str) -> str:
    """The query without its end mark, if it is one SELECT or WITH statement.

    Any other semicolon is refused, one inside a literal too.
    """
    text = sql.strip()
    text = text.removesuffix(";").strip()
    if not text:
        raise QueryError("empty query")
    if ";" in text:
        raise QueryError("only one statement is allowed")
    if not text.upper().startswith(("SELECT", "WITH")):
        raise QueryError("only SELECT and WITH queries are allowed")
    return text


#: Functions of Spark that call into the JVM.
CALLS = {"reflect", "java_method", "try_reflect"}
#: The nodes of Spark's parsed plans that a query may have; all others are refused.
NODES = set(
    """Aggregate CTERelationDef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit
    LocalRelation NamedParametersQuery Offset OneRowRelation Pivot Project Repartition RepartitionByExpression ResolvedInlineTable Sample
    Sort SubqueryAlias Tail Union UnionLoop UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot Window WithCTE
    WithWindowDefinition""".split()
)


def _all(top, *inner: str) -> Iterator:
    """A tree of the JVM's, node by node, with what the named methods give of each."""
    todo = [top]
    while todo:
        node = todo.pop()
        yield node
        for name in inner:
            part = getattr(node, name)()
            todo += [part.apply(i) for i in range(part.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _names(parts) -> list[str]:
    return [parts.apply(i) for i in range(parts.size())]


def _check_function(parts: list[str], known: set[str]) -> None:
    names = [p.lower() for p in parts]
    if len(names) > 1 or names[0] in CALLS or names[0] not in known:
        raise QueryError(f"the function {'.'.join(names)} is not allowed")


def built_in_functions(spark: SparkSession) -> set[str]:
    return {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} | {"if", "coalesce"}


def check_plan(spark: SparkSession, sql: str) -> int:
    """How often the query's plan, as Spark parses it, names review_log; refuses plans that write or reach out.

    The plan may have the nodes of NODES alone, so commands, inserts and scripts
    are refused wherever they stand.  Functions are Spark's own, without those
    that call into the JVM; tables have one name (no paths, no catalogs).
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise QueryError(str(e).splitlines()[0]) from e
    found, known = 0, built_in_functions(spark)
    for node in _all(plan, "children", "innerChildren", "subqueries"):
        kind = _kind(node)
        if kind not in NODES:
            raise QueryError(f"only SELECT and WITH queries are allowed (found {kind})")
        if kind == "UnresolvedRelation":
            names = _names(node.multipartIdentifier())
            if len(names) > 1:
                raise QueryError("only review_log and the query's own tables are allowed")
            found += names[0].lower() == "review_log"
        elif kind == "UnresolvedTableValuedFunction":
            _check_function(_names(node.name()), known)
        for i in range(node.expressions().size()):
            for part in _all(node.expressions().apply(i), "children"):
                if _kind(part) == "UnresolvedFunction":
                    _check_function(_names(part.nameParts()), known)
                elif _kind(part) == "UnresolvedGenerator":
                    _check_function(part.name().unquotedString().split("."), known)
    return found


@dataclass
class Arguments:
    """What a command line says: words, bounds and the output's form."""

    words: list[str] = field(default_factory=list)
    start: str = ""
    end: str = ""
    range: str = ""
    json: bool = False

    @classmethod
    def parse(cls, args: list[str]) -> Arguments:
        out, names = cls(), {"--from": "start", "--to": "end", "--range": "range"}
        rest = iter(args)
        for a in rest:
            name, equals, value = a.partition("=")
            if a in ("--json", "-j"):
                out.json = True
            elif name in names and equals:
                setattr(out, names[name], value)
            elif a in names:
                value = next(rest, None)
                if value is None:
                    raise QueryError(f"{a} requires a value")
                setattr(out, names[a], value)
            else:
                out.words.append(a)
        return out


class Catalog:
    """Built-in queries and a user's own, which go before them, in a TOML file with the table ``queries``."""

    def __init__(self, path: str | None = None):
        self.path = path

    def user(self) -> dict[str, str]:
        if not self.path or not os.path.exists(self.path):
            return {}
        with open(self.path, "rb") as f:
            data = tomllib.load(f)
        if data and not isinstance(data.get("queries"), dict):
            raise QueryError("the file has no table named queries")
        return {k: str(v) for k, v in data.get("queries", {}).items()}

    def resolve(self, name: str) -> str | None:
        return self.user().get(name, BUILT_IN.get(name))

    def listing(self) -> list[tuple[str, str, str]]:
        """(name, SQL, built-in or user), by name."""
        own = self.user()
        return sorted((n, s, "user" if n in own else "built-in") for n, s in (BUILT_IN | own).items())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.listing(), "name string, sql string, source string")

    def add(self, name: str, sql: str) -> None:
        name = name.strip()
        if not name or any(c in name for c in ". \t"):
            raise QueryError("a name has no dots and no white space")
        self._write(self.user() | {name: check_read_only(sql)})

    def delete(self, name: str) -> None:
        own = self.user()
        if name not in own:
            raise QueryError("built-in queries cannot be deleted" if name in BUILT_IN else "there is no such query")
        self._write({k: v for k, v in own.items() if k != name})

    def _write(self, own: dict[str, str]) -> None:
        import json

        if not self.path:
            raise QueryError("the catalog has no file")
        with open(f"{self.path}.new", "w") as f:
            f.write("[queries]\n" + "".join(f"{json.dumps(k)} = {json.dumps(own[k])}\n" for k in sorted(own)))
        os.replace(f"{self.path}.new", self.path)


def run(log: DataFrame, query: str, catalog: Catalog | None = None) -> DataFrame:
    """The result of a named query or of SQL text over review_log. The gate comes before the scan.

    The log is a temporary view under the name ``review_log``; to parse it once
    for a query that names it often, pass a log that is written or cached.
    """
    sql = check_read_only((catalog or Catalog()).resolve(query.strip()) or query)
    check_plan(log.sparkSession, sql)
    log.createOrReplaceTempView("review_log")
    return log.sparkSession.sql(sql)


def command(spark: SparkSession, dump: str, args: list[str], tool: str, catalog: Catalog | None = None) -> tuple[DataFrame, Arguments]:
    """Run a query command over the dumps at a path, with the trailers of a tool; one word may be a name, other words are SQL."""
    found = Arguments.parse(args)
    if not found.words:
        raise QueryError("a query or the name of one is needed")
    text = found.words[0] if len(found.words) == 1 else " ".join(found.words)
    log = history.bounded(history.parse(history.read_dump(spark, dump), tool), found.start or None, found.end or None)
    return run(log, text, catalog), found


