"""Issue facets: filters that take values away, counts under all other filters, category trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

FACETS = ["severity", "confidence", "type", "category", "subcategory"]
SEVERITIES = ["critical", "warning", "info"]
CONFIDENCES = ["high", "medium", "low"]


def norm_severity(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(s.isin(SEVERITIES), s).otherwise("info")


def norm(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def shaped(comments: DataFrame) -> DataFrame:
    """comments with trimmed facets and, as <facet>_n, their normal form."""
    for f in FACETS:
        comments = comments.withColumn(f, norm_severity(F.col(f)) if f == "severity" else strip(F.coalesce(F.col(f), F.lit(""))))
    return comments.withColumns({f"{f}_n": norm(F.col(f)) for f in FACETS})


def passes(disabled: dict[str, list[str]], but: tuple[str, ...] = ()) -> Column:
    """Whether no facet (other than those in ``but``) has a value that is disabled; blank values pass."""
    out = F.lit(True)
    for f in FACETS:
        off = [x.strip().lower() for x in disabled.get(f, [])]
        if f not in but and off:
            out = out & ((F.col(f"{f}_n") == "") | ~F.col(f"{f}_n").isin(off))
    return out


def visibility_key() -> Column:
    """path::line::severity::confidence::type::category::subcategory::content, white space collapsed."""
    parts = [F.col("file_path"), F.col("line").cast("string"), *[F.col(f"{f}_n") for f in FACETS], F.regexp_replace(strip("content"), r"\s+", " ")]
    return F.concat_ws("::", *parts)


def visible(comments: DataFrame, hidden: DataFrame | None) -> DataFrame:
    """Shaped comments without those whose key is hidden (hidden: key)."""
    rows = shaped(comments)
    return rows if hidden is None else rows.withColumn("key", visibility_key()).join(hidden, "key", "left_anti")


def facet_counts(comments: DataFrame, disabled: dict[str, list[str]], hidden: DataFrame | None = None) -> DataFrame:
    """facet, value, label, count and active: each facet's values under all other facets' filters.

    The label is the first raw value in document order (ord); all severities are listed.
    """
    rows = visible(comments, hidden)
    each = [F.struct(F.lit(f).alias("facet"), F.col(f"{f}_n").alias("value"), F.col(f).alias("raw"), passes(disabled, (f,)).alias("ok")) for f in FACETS]
    long = rows.select("ord", F.explode(F.array(*each)).alias("x")).select("ord", "x.*").where("ok and value <> ''")
    counts = long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"), F.min_by("raw", "ord").alias("raw"))
    listed = rows.sparkSession.createDataFrame([("severity", s) for s in SEVERITIES], "facet string, value string")
    counts = counts.join(F.broadcast(listed), ["facet", "value"], "full")
    label = F.when(F.col("facet") == "severity", F.initcap("value")).otherwise(F.col("raw"))
    return counts.select("facet", "value", label.alias("label"), F.coalesce("count", F.lit(0)).cast("long").alias("count"), _active(disabled).alias("active"))


def _active(disabled: dict[str, list[str]]) -> Column:
    out = F.lit(True)
    for f, values in disabled.items():
        if values:
            out = out & ~((F.col("facet") == f) & F.col("value").isin([v.strip().lower() for v in values]))
    return out


def scoped_subcategories(comments: DataFrame, disabled: dict[str, list[str]], hidden: DataFrame | None = None) -> DataFrame:
    """The subcategory facet where categories are disabled: those of enabled categories, 0 where filters leave none."""
    rows = visible(comments, hidden)
    off = [x.strip().lower() for x in disabled.get("category", [])]
    inside = rows.where(((F.col("category_n") == "") | ~F.col("category_n").isin(off)) & (F.col("subcategory_n") != ""))
    scope = inside.groupBy(F.col("subcategory_n").alias("value")).agg(F.min_by("subcategory", "ord").alias("first_label"))
    counts = facet_counts(comments, disabled, hidden).where("facet = 'subcategory'")
    return scope.join(counts, "value", "left").select("value", F.coalesce("label", "first_label").alias("label"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def category_tree(comments: DataFrame, disabled: dict[str, list[str]], hidden: DataFrame | None = None) -> DataFrame:
    """value, label, count, active and subcategories (sorted structs) of each category, whatever is disabled among the two."""
    off = {f: [x.strip().lower() for x in disabled.get(f, [])] for f in ("category", "subcategory")}
    rows = visible(comments, hidden).where(passes(disabled, ("category", "subcategory")) & (F.col("category_n") != ""))
    sub = rows.groupBy("category_n", "subcategory_n").agg(F.count(F.lit(1)).alias("n"), F.min_by("subcategory", "ord").alias("label"), F.min(F.struct("ord", "category")).alias("first"))
    active = ~F.col("category_n").isin(off["category"]) if off["category"] else F.lit(True)
    sub_active = active & ~F.col("subcategory_n").isin(off["subcategory"]) if off["subcategory"] else active
    child = F.when(F.col("subcategory_n") != "", F.struct(F.col("subcategory_n").alias("value"), "label", F.col("n").alias("count"), sub_active.alias("active")))
    return sub.groupBy("category_n").agg(F.min("first").alias("first"), F.sum("n").alias("count"), F.array_sort(F.collect_list(child)).alias("subcategories")).select(F.col("category_n").alias("value"), F.col("first.category").alias("label"), "count", active.alias("active"), "subcategories")


def issue_counts(comments: DataFrame, disabled: dict[str, list[str]], hidden: DataFrame | None = None) -> DataFrame:
    """total, visible and the count of each severity; totals count hidden comments too."""
    rows = _marked(comments, hidden)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("hidden") & passes(disabled)).alias("visible"), *[F.count_if(F.col("severity_n") == s).alias(s) for s in SEVERITIES])


def file_counts(comments: DataFrame, disabled: dict[str, list[str]], hidden: DataFrame | None = None) -> DataFrame:
    return _marked(comments, hidden).groupBy("file_path").agg(F.count_if(~F.col("hidden") & passes(disabled)).alias("visible"))


def filter_stats(comments: DataFrame, disabled: dict[str, list[str]], hidden: DataFrame | None = None) -> DataFrame:
    """category (as written), its count, and whether its comments' subcategories are on offer."""
    rows = _marked(comments, hidden).where("not hidden and category <> ''")
    off = [x.strip().lower() for x in disabled.get("category", [])]
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.count_distinct(F.when((F.col("subcategory") != "") & ~F.lower("category").isin(off), F.col("subcategory"))).alias("subcategories"))


def universe(comments: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """facet and its distinct values, in order."""
    each = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f"{f}_n").alias("value")) for f in FACETS[1:]])
    return visible(comments, hidden).select(F.explode(each).alias("x")).select("x.*").where("value <> ''").groupBy("facet").agg(F.array_sort(F.collect_set("value")).alias("items"))


def summary(universe_rows: DataFrame, disabled: dict[str, list[str]]) -> DataFrame:
    """For each facet with disabled values, how many are left."""
    off = F.create_map(*[x for f, v in disabled.items() if v for x in (F.lit(f), F.array(*[F.lit(y.strip().lower()) for y in v]))])
    return universe_rows.where(F.map_contains_key(off, F.col("facet"))).select("facet", F.size(F.array_except("items", off[F.col("facet")])).alias("enabled"))


def _marked(comments: DataFrame, hidden: DataFrame | None) -> DataFrame:
    rows = shaped(comments)
    if hidden is None:
        return rows.withColumn("hidden", F.lit(False))
    return rows.withColumn("key", visibility_key()).join(hidden.select("key", F.lit(True).alias("h")).distinct(), "key", "left").withColumn("hidden", F.coalesce("h", F.lit(False)))


def preferred(values: list[str], c: Column) -> list[Column]:
    """Sort keys: values listed first by their place, others after them by name."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return [F.when(place == 0, F.lit(len(values) + 1)).otherwise(place), c]


def impact(comments: DataFrame) -> DataFrame:
    """Issues by severity and by type, most frequent first."""
    rows = shaped(comments)
    both = rows.select(F.explode(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity_n").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("type").alias("value")))).alias("x")).select("x.*").where("value <> ''")
    return both.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("count"))


def keep_visible(files: DataFrame, disabled: dict[str, list[str]]) -> DataFrame:
    """Files with their visible comments nested; files without any are dropped."""
    rows = shaped(files).where(passes(disabled))
    return rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("ord", "line", "severity", "content"))).alias("comments"))


def toggle_category(categories: Column, subcategories: Column, value: Column, children: Column) -> Column:
    """Both sets after a category is toggled: its subcategories (children) are disabled and enabled with it."""
    on = F.array_contains(categories, value)
    below = F.filter(F.transform(children, norm), lambda x: x != "")
    return F.struct(toggle(categories, value).alias("categories"), F.when(on, F.array_except(subcategories, below)).otherwise(F.array_union(subcategories, below)).alias("subcategories"))


def toggle(disabled: Column, value: Column) -> Column:
    """The set without the value if it is in, with it if not."""
    return F.when(F.array_contains(disabled, value), F.array_remove(disabled, value)).otherwise(F.array_append(disabled, value))
