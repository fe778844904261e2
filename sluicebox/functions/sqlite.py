"""Columns with the semantics that SQLite's expressions have, for queries moved to Spark."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like(c: Column, pattern: str) -> Column:
    """LIKE, which ignores case."""
    return c.ilike(pattern)


def glob(c: Column, pattern: str) -> Column:
    """GLOB: case-sensitive, ``*``, ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "[\\s\\S]*"
        elif ch == "?":
            out += "[\\s\\S]"
        elif ch == "[" and (end := pattern.find("]", i + 2)) > 0:
            out += pattern[i : end + 1]
            i = end
        else:
            out += f"\\x{{{ord(ch):x}}}"
        i += 1
    return c.rlike(f"^{out}$")


def divide(a: Column, b: Column) -> Column:
    """Whole-number division that truncates toward zero; null for a divisor of 0."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def substr(c: Column, start: int, length: int) -> Column:
    """substr() in which position 0 stands before the first character."""
    return F.substring(c, 1, max(0, length - 1)) if start == 0 else F.substring(c, start, length)


def greatest(*cs: Column) -> Column:
    """max() of several values: null if any is null."""
    return F.when(~_any_null(cs), F.greatest(*cs))


def least(*cs: Column) -> Column:
    """min() of several values: null if any is null."""
    return F.when(~_any_null(cs), F.least(*cs))


def _any_null(cs) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | c.isNull()
    return out


def iif(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond, a).otherwise(b)


def truth(c: Column) -> Column:
    """A condition as 0 or 1."""
    return c.cast("long")


def total(c: Column) -> Column:
    """total(): a sum that is 0.0 where there is nothing to add."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def group_concat(c: Column, separator: str, order: Column) -> Column:
    """group_concat() in a stated order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.cast("string").alias("v")))), lambda x: x["v"]), separator)


def number(c: Column) -> Column:
    """The number that a text begins with, 0 if none (what arithmetic takes a text for)."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def strip_chars(c: Column, chars: str, side: str = "both") -> Column:
    """trim(x, chars), ltrim(x, chars) and rtrim(x, chars)."""
    return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side](c, F.lit(chars))


def ascii_upper(c: Column) -> Column:
    """upper(), which changes a-z alone."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def ascii_lower(c: Column) -> Column:
    """lower(), which changes A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A time value: a date, a time or both, a fraction of a second, and Z or an offset.
_TIME = r"^(?:(\d{4}-\d\d-\d\d)(?:[ T]+(?=\d))?)?(?:(\d\d:\d\d)(?::(\d\d(?:\.\d+)?))?)?\s*(?:(Z|z)|([+-])(\d\d):(\d\d))?\s*$"
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*$"
_EPOCH_DAY = 2440587.5
_DAY_US = 86_400_000_000


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _plus(t: Column, us: Column) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / F.lit(1e6)).cast("decimal(18,6)"))


def _days(t: Column, days: Column) -> Column:
    return _plus(t, F.round(days * _DAY_US / 1000) * 1000)


def _known(t: Column) -> Column:
    return F.when((F.year(t) >= 0) & (F.year(t) <= 9999), t)


def time_value(c: Column) -> Column:
    """The time (without zone, to the millisecond) that a text stands for, a number being a Julian day; null where it is none or outside the years 0 to 9999, and for a day that its month lacks (which SQLite lets pass)."""

    def of(c: Column) -> Column:
        part = lambda i: F.regexp_extract(c, _TIME, i)
        or_else = lambda i, text: F.coalesce(F.nullif(part(i), F.lit("")), F.lit(text))
        at = F.concat(or_else(1, "2000-01-01"), F.lit(" "), or_else(2, "00:00"), F.lit(":"), or_else(3, "00")).try_cast("timestamp_ntz")
        minutes = (part(6).try_cast("int") * 60 + part(7).try_cast("int")) * F.when(part(5) == "-", -1).otherwise(1)
        zoned = _plus(at, -F.coalesce(minutes, F.lit(0)).cast("long") * 60_000_000)
        number = _days(F.lit("1970-01-01").cast("timestamp_ntz"), c.try_cast("double") - _EPOCH_DAY)
        t = F.when(c.rlike(_NUMBER), number).when(c.rlike(_TIME) & (F.concat(part(1), part(2)) != ""), zoned)
        return F.date_trunc("millisecond", _plus(t, F.lit(500))).cast("timestamp_ntz")

    return _let(_let(c, of), _known)


def _months(t: Column, n: int) -> Column:
    """So many months on; a day that the month lacks runs over into the next one."""
    number = F.year(t) * 12 + F.month(t) - 1 + F.lit(n)
    first = F.make_date(F.floor(number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    return first + (t - F.date_trunc("month", t).cast("timestamp_ntz"))


def _step(modifier: str) -> Callable[[Column], Column] | None:
    """What a modifier makes of a time; None for one that there isn't."""
    words = modifier.strip().lower()
    if found := re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+)) *(second|minute|hour|day|month|year)s?", words):
        n, unit = float(found[1]), found[2]
        if unit in ("month", "year"):
            # Whole months by the calendar, what is left of one as a share of 30 days (of a year, of 365).
            whole, rest = int(n), n - int(n)
            return lambda t: _days(_months(t, whole * (12 if unit == "year" else 1)), F.lit(rest * (365.0 if unit == "year" else 30.0)))
        return lambda t: _days(t, F.lit(n / {"second": 86400, "minute": 1440, "hour": 24, "day": 1}[unit]))
    if found := re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?", words):
        ms = round((int(found[2]) * 3600 + int(found[3]) * 60 + float(found[4] or 0)) * 1000) * (-1 if found[1] == "-" else 1)
        return lambda t: _plus(t, F.lit(ms * 1000))
    if found := re.fullmatch(r"start of (day|month|year)", words):
        return lambda t: F.date_trunc(found[1], t).cast("timestamp_ntz")
    if found := re.fullmatch(r"weekday ([0-6])", words):
        return lambda t: _days(t, F.pmod(F.lit(int(found[1])) - F.dayofweek(t) + 1, F.lit(7)).cast("double"))
    return (lambda t: t) if words in ("utc", "localtime", "auto") else None  # the zone is UTC


def modified(t: Column, *modifiers: str) -> Column:
    """A time after modifiers such as ``+1 month``, ``-1.5 days``, ``+02:30``, ``start of year``, ``weekday 1`` in turn; null for an unknown one and outside the years 0 to 9999."""
    for step in map(_step, modifiers):
        if step is None:
            return F.lit(None).cast("timestamp_ntz")
        t = _let(_let(t, step), _known)
    return t


def _micros(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)


def date(c: Column, *modifiers: str) -> Column:
    return strftime("%Y-%m-%d", c, *modifiers)


def time(c: Column, *modifiers: str) -> Column:
    return strftime("%H:%M:%S", c, *modifiers)


def datetime(c: Column, *modifiers: str) -> Column:
    return strftime("%Y-%m-%d %H:%M:%S", c, *modifiers)


def _when(c: Column, modifiers: tuple[str, ...]) -> Column:
    return modified(time_value(c.cast("string")), *modifiers)


def unixepoch(c: Column, *modifiers: str) -> Column:
    return F.floor(_micros(_when(c, modifiers)) / 1_000_000)


def julianday(c: Column, *modifiers: str) -> Column:
    """Days since noon of 24 November 4714 BC."""
    return _micros(_when(c, modifiers)) / F.lit(float(_DAY_US)) + F.lit(_EPOCH_DAY)


def _two(n: Column, size: int = 2, fill: str = "0") -> Column:
    return F.lpad(n.cast("int").cast("string"), size, fill)


#: What each format letter gives of a time.
_CODES = {
    "d": lambda t: _two(F.dayofmonth(t)),
    "e": lambda t: _two(F.dayofmonth(t), fill=" "),
    "f": lambda t: F.date_format(t, "ss.SSS"),
    "F": lambda t: F.concat(_two(F.year(t), 4), F.lit("-"), _two(F.month(t)), F.lit("-"), _two(F.dayofmonth(t))),
    "H": lambda t: _two(F.hour(t)),
    "I": lambda t: _two(F.pmod(F.hour(t) + 11, F.lit(12)) + 1),
    "j": lambda t: _two(F.dayofyear(t), 3),
    "J": lambda t: (_micros(t) / F.lit(float(_DAY_US)) + F.lit(_EPOCH_DAY)).cast("string"),
    "k": lambda t: _two(F.hour(t), fill=" "),
    "l": lambda t: _two(F.pmod(F.hour(t) + 11, F.lit(12)) + 1, fill=" "),
    "m": lambda t: _two(F.month(t)),
    "M": lambda t: _two(F.minute(t)),
    "p": lambda t: F.when(F.hour(t) < 12, "AM").otherwise("PM"),
    "P": lambda t: F.when(F.hour(t) < 12, "am").otherwise("pm"),
    "R": lambda t: F.concat(_two(F.hour(t)), F.lit(":"), _two(F.minute(t))),
    "s": lambda t: F.floor(_micros(t) / 1_000_000).cast("string"),
    "S": lambda t: _two(F.second(t)),
    "T": lambda t: F.concat(_two(F.hour(t)), F.lit(":"), _two(F.minute(t)), F.lit(":"), _two(F.second(t))),
    "u": lambda t: (F.pmod(F.dayofweek(t) + 5, F.lit(7)) + 1).cast("string"),
    "w": lambda t: (F.dayofweek(t) - 1).cast("string"),
    "W": lambda t: _two(F.floor((F.dayofyear(t) + 6 - F.pmod(F.dayofweek(t) + 5, F.lit(7))) / 7)),
    "Y": lambda t: _two(F.year(t), 4),
    "%": lambda t: F.lit("%"),
}


def strftime(pattern: str, c: Column, *modifiers: str) -> Column:
    """The time as text; null for an unknown format letter."""
    parts = []
    for text, letter in re.findall(r"([^%]*)(?:%(.?))?", pattern, re.S):
        if text:
            parts.append(lambda t, text=text: F.lit(text))
        if letter:
            if letter not in _CODES:
                return F.lit(None).cast("string")
            parts.append(_CODES[letter])
    return _let(_when(c, modifiers), lambda t: F.when(t.isNotNull(), F.concat(F.lit(""), *[p(t) for p in parts])))


def _variant(c: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(c), path, "variant")


def json_path(label: str | int) -> str:
    """The path that the right side of ``->`` means: a path, a key or the place of an element."""
    if isinstance(label, int):
        return f"$[{label}]"
    return label if label.startswith("$") else f"$['{label}']"


def _json_kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _sql_text(v: Column) -> Column:
    """A JSON value as SQL has it: text as it is, true and false as 1 and 0, null as null, others as JSON."""

    def of(v: Column) -> Column:
        kind = _json_kind(v)
        return F.when(kind == "VOID", F.lit(None)).when(kind == "BOOLEAN", v.try_cast("boolean").cast("int").cast("string")).otherwise(v.cast("string"))

    return _let(v, of)


def json_extract(c: Column, path: str) -> Column:
    """json_extract() and ``->>``, as text; null where the JSON is malformed or has nothing there."""
    return _sql_text(_variant(c, json_path(path)))


def json_arrow(c: Column, label: str | int) -> Column:
    """``->``: the JSON text of what is there."""
    return F.to_json(_variant(c, json_path(label)))


def json_valid(c: Column) -> Column:
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull().cast("long"))


#: Kinds of JSON values by the first word of their type.
_JSON_TYPES = {"VOID": "null", "STRING": "text", "BIGINT": "integer", "DECIMAL": "real", "DOUBLE": "real", "FLOAT": "real", "ARRAY": "array", "OBJECT": "object"}


def _json_type(v: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in _JSON_TYPES.items() for x in pair])

    def of(v: Column) -> Column:
        kind = _json_kind(v)
        integral = (kind == "DECIMAL") & F.schema_of_variant(v).rlike(r",\s*0\)$")
        return F.when(kind == "BOOLEAN", v.try_cast("string")).when(integral, "integer").otherwise(names[kind])

    return _let(v, of)


def json_type(c: Column, path: str = "$") -> Column:
    return _json_type(_variant(c, path))


def json_object(**fields: Column) -> Column:
    """json_object(): null fields stay."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def json_array(*values: Column) -> Column:
    return F.to_json(F.array(*[F.coalesce(v.cast("variant"), F.parse_json(F.lit("null"))) for v in values]))


def json_each(df: DataFrame, column: str, path: str = "$") -> DataFrame:
    """df with key, value (as SQL text) and type of each element of the array or object in a column of JSON; rows without any go."""
    named = df.withColumn("json_each_value", _variant(F.col(column), path))
    each = df.sparkSession.tvf.variant_explode(F.col("json_each_value").outer())
    rows = named.lateralJoin(each).select(*df.columns, F.coalesce("key", F.col("pos").cast("string")).alias("key"), _sql_text(F.col("value")).alias("sql_value"), _json_type(F.col("value")).alias("type"))
    return rows.withColumnRenamed("sql_value", "value")


#: Spark's collation that compares as SQLite's NOCASE does for letters A-Z (and folds others too).
NOCASE = "UTF8_LCASE"


def nocase(c: Column) -> Column:
    """COLLATE NOCASE, for comparisons, grouping, joins and order."""
    return F.collate(c, NOCASE)


def bare(df: DataFrame, keys: list[str], extreme: str, columns: list[str], largest: bool = True) -> DataFrame:
    """GROUP BY with a lone max() or min() and bare columns: these are of the row that has the extreme, of several rows the one whose columns come first."""
    others = F.struct(*[F.col(c) for c in columns])
    best = (F.max if largest else F.min)(extreme)
    tops = df.groupBy(*keys).agg(best.alias(extreme))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col(f"d.{extreme}") == F.col(f"t.{extreme}")]
    rows = df.alias("d").join(tops.alias("t"), same, "left_semi").groupBy(*keys, extreme).agg(F.min(others).alias("row"))
    return rows.select(*keys, extreme, *[F.col("row")[c].alias(c) for c in columns])
