"""Commentary facts of comparisons and the comments made of them.

A fact without reference, change or score has a comment that leaves it out. Ties are settled by label, group and value text;
repeated rows stay. No comparisons give no facts, and a section summary that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.operators.compare import priority, size_of
from tidewatch.operators.definitions import with_definitions


def commentary_facts(cmp: DataFrame) -> DataFrame:
    """One fact per comparison: label, group, value, reference and change texts, status, direction and caveats."""
    rows = with_definitions(cmp, "label", "unit")
    unit = F.coalesce("unit", F.lit(""))
    bucket = labels.bucket_label(F.col("time_bucket"))
    # a bucket given by its display label stays as it is
    group = F.when(bucket.isNotNull() & ~F.map_contains_key("group", "time_bucket"), F.map_concat("group", F.create_map(F.lit("time_bucket"), bucket))).otherwise(F.col("group"))
    change = F.col("change_abs")
    known = labels.settled(change)
    word = F.when(known > 0, "higher").when(known < 0, "lower").when(known == 0, "unchanged").otherwise("changed")
    return rows.select(
        F.lit("comparison").alias("fact_type"), F.coalesce("label", "metric_name").alias("metric_label"), F.coalesce(labels.group_label(group), F.lit("the selected universe")).alias("group_label"),
        labels.value_text(F.col("value"), unit).alias("value_text"),
        F.when(F.col("reference_value").isNotNull(), labels.value_text(F.col("reference_value"), unit)).alias("reference_text"),
        labels.change_text(change, F.col("change_pct"), unit).alias("change_text"), F.col("z_score"), "status", word.alias("direction_word"),
        labels.caveats(F.col("reference_sample_size"), F.col("comparison_confidence"), F.col("z_score"), F.lit("trading day")).alias("caveats"))


def order_facts(facts: DataFrame, n: int | None = 5) -> DataFrame:
    """Section summaries first, then by status, size of z, label and group; the first n."""
    rows = facts.orderBy((F.col("fact_type") != "section_summary").cast("int"), priority(), F.desc(size_of("z_score")), "metric_label", "group_label", "value_text")
    return rows if n is None else rows.limit(n)


def _plural(n: Column, word: str) -> Column:
    many = f"{word[:-1]}ies" if word.endswith("y") else f"{word}s"
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {many}"))


def section_summary(cmp: DataFrame, title: str, scope: str = "all comparisons") -> DataFrame:
    """One fact on how many comparisons have which status."""
    if not title.strip() or not scope.strip():
        raise ValueError("title and scope must not be empty")
    known = ("alert", "watch", "comparison_only", "normal")
    counts = cmp.agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in known])
    other = F.col("n") - sum((F.col(s) for s in known), F.lit(0))
    words = [_plural(F.col("alert"), "alert"), _plural(F.col("watch"), "watch item"), _plural(F.col("comparison_only"), "comparison-only item"), _plural(F.col("normal"), "normal item")]
    plain = F.concat(words[0], F.lit(", "), words[1], F.lit(", "), words[2], F.lit(", and "), words[3])
    longer = F.concat(words[0], F.lit(", "), words[1], F.lit(", "), words[2], F.lit(", "), words[3], F.lit(", and "), _plural(other, "other item"))
    text = F.concat(F.when(other > 0, longer).otherwise(plain), F.lit(" across "), _plural(F.col("n"), "comparison"), F.lit(f" in {scope.strip()}"))
    worst = F.when(F.col("alert") > 0, "alert").when(F.col("watch") > 0, "watch").when(F.col("comparison_only") > 0, "comparison_only").otherwise("normal")
    none = F.lit(None).cast("string")
    return counts.select(
        F.lit("section_summary").alias("fact_type"), F.lit(title.strip()).alias("metric_label"), F.lit("the selected universe").alias("group_label"),
        F.when(F.col("n") == 0, f"no comparison rows were available across {scope.strip()}").otherwise(text).alias("value_text"), none.alias("reference_text"),
        none.alias("change_text"), F.lit(None).cast("double").alias("z_score"), worst.alias("status"), F.lit("summary").alias("direction_word"),
        F.array().cast("array<string>").alias("caveats"))


def commentary_text(facts: DataFrame) -> DataFrame:
    """facts with the comment on each."""
    name, group, value = F.col("metric_label"), F.col("group_label"), F.col("value_text")
    caveat = F.when(F.size("caveats") > 0, F.concat(F.lit(" Caveats: "), F.array_join("caveats", " "))).otherwise("")
    reference = F.coalesce(F.concat(F.lit(" versus reference "), "reference_text"), F.lit(""))
    change = F.coalesce(F.concat(F.lit(" ("), "change_text", F.lit(")")), F.lit(""))
    z = F.coalesce(F.concat(F.lit(" with z-score "), F.replace(labels.grouped(F.col("z_score"), 1), F.lit(","), F.lit(""))), F.lit(""))
    text = (
        F.when(F.col("fact_type") == "section_summary", F.concat(name, F.lit(" headline: "), value, F.lit("."), caveat))
        .when(F.col("status") == "normal", F.concat(name, F.lit(" was within the normal range for "), group, F.lit("."), caveat))
        .when(F.col("status") == "comparison_only", F.concat(
            name, F.lit(" comparison for "), group, F.lit(": current "), value, reference, change, F.lit("; statistical score not shown."), caveat))
        .otherwise(F.concat(name, F.lit(" was "), F.col("direction_word"), F.lit(" for "), group, F.lit(": current "), value, reference, change, z, F.lit("."), caveat)))
    return facts.withColumn("comment", text)


def dominant_method(cmp: DataFrame) -> DataFrame:
    """The most frequent comparison method; of equal ones the first by name, without any the default."""
    found = cmp.where(F.coalesce("comparison_method", F.lit("")) != "").groupBy("comparison_method").agg(F.count("*").alias("n"))
    best = found.agg(F.min_by("comparison_method", F.struct(-F.col("n"), F.col("comparison_method"))).alias("m"))
    return best.select(F.coalesce("m", F.lit("same_intraday_bucket")).alias("comparison_method"))
