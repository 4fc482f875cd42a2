"""Frequent itemsets and association rules over attribute values."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute_items(attributes: dict[str, str]) -> Column:
    """`name=value` items of a row, unknown values left out. Keys are item names, values columns."""
    items = [F.concat(F.lit(f"{name}="), F.col(c).cast("string")) for name, c in attributes.items()]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def baskets(df: DataFrame, attributes: dict[str, str], complete: bool = True) -> DataFrame:
    """One basket per row; with `complete`, rows lacking an attribute are dropped."""
    rows = df.dropna(subset=list(attributes.values())) if complete else df
    return rows.select(attribute_items(attributes).alias("items"))


def drop_rare(df: DataFrame, columns: list[str], min_rows: int) -> DataFrame:
    """Values with fewer rows become null.

    The values kept have at least `min_rows` rows each; their table is joined per column and Spark
    decides from its size whether to broadcast it.
    """
    for c in columns:
        common = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        common = common.filter(F.col("_n") >= min_rows).select(c, F.lit(True).alias("_common"))
        df = df.join(common, c, "left").withColumn(c, F.when(F.col("_common"), F.col(c))).drop("_common")
    return df


def frequent_itemsets(rows: DataFrame, min_support: float) -> DataFrame:
    """(items, freq, size), items sorted."""
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(rows)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq", F.size("items").alias("size"))


def association_rules(itemsets: DataFrame, total: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """Rules with any split of an itemset into antecedent and consequent, by lift.

    `total` is one row with the number of baskets. With baskets of k items and support s there are
    at most 2^k / s itemsets, whatever the data size. Parts are found by equality joins.
    """
    n = total.scalar().cast("double")
    whole = itemsets.filter("size >= 2").select("items", "freq", "size")
    split = whole.selectExpr("items", "freq", "explode(sequence(1, cast(pow(2, size) as int) - 2)) as mask")
    pick = "transform(filter(transform(items, (x, i) -> struct(x, (mask div cast(pow(2, i) as int)) % 2 as bit)), s -> s.bit = {0}), s -> s.x)"
    parts = split.selectExpr("freq", f"{pick.format(1)} as antecedent", f"{pick.format(0)} as consequent")
    left = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("n_antecedent"))
    right = itemsets.select(F.col("items").alias("consequent"), F.col("freq").alias("n_consequent"))
    joined = parts.join(left, "antecedent").join(right, "consequent").withColumn("_n", n)
    support = F.col("freq") / F.col("_n")
    confidence = F.col("freq") / F.col("n_antecedent")
    lift = confidence / (F.col("n_consequent") / F.col("_n"))
    rules = joined.select(
        "antecedent",
        "consequent",
        F.col("freq").alias("n"),
        (F.col("n_antecedent") / F.col("_n")).alias("antecedent_support"),
        (F.col("n_consequent") / F.col("_n")).alias("consequent_support"),
        support.alias("support"),
        confidence.alias("confidence"),
        lift.alias("lift"),
        (support - F.col("n_antecedent") / F.col("_n") * F.col("n_consequent") / F.col("_n")).alias("leverage"),
    )
    return rules.filter(F.col("lift") >= min_lift)


def outcome_rules(rules: DataFrame, outcome: str) -> DataFrame:
    """Rules whose consequent is exactly one item of the outcome attribute, as text."""
    only = (F.size("consequent") == 1) & F.get("consequent", F.lit(0)).startswith(f"{outcome}=")
    rule = F.concat(F.array_join("antecedent", " + "), F.lit(" → "), F.get("consequent", F.lit(0)))
    return rules.filter(only).select(rule.alias("rule"), F.col("n").alias("departures"), "support", "confidence", "lift")
