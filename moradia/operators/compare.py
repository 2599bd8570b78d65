"""Two runs of a pipeline compared: discovered addresses, extracted fields, status counts, winner, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame, key: str = "url_anuncio") -> DataFrame:
    """Sizes of both sets of addresses, of their intersection, and the Jaccard index to three decimals (1 if both are empty)."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    na, nb, both = F.count("_a"), F.count("_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return x.join(y, key, "full_outer").agg(na.alias("n_a"), nb.alias("n_b"), both.alias("comuns"), F.coalesce(F.round(F.try_divide(both, F.count("*")), 3), F.lit(1.0)).alias("jaccard"))


def exclusive(a: DataFrame, b: DataFrame, key: str = "url_anuncio", most: int = 50) -> DataFrame:
    """The first addresses, in order, that only ``a`` has."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").orderBy(key).limit(most)


def differences(a: DataFrame, b: DataFrame, fields: tuple[str, ...], key: str = "url_anuncio") -> DataFrame:
    """``key, campos``: the fields that differ, null-safe; a missing side counts as nulls. Keys without differences are left out."""
    diff = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields)))
    out = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return out.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.concat_ws(",", diff).alias("campos")).filter("campos <> ''")


def winner(counts: DataFrame, scope: str = "discovery") -> DataFrame:
    """``counts`` (``n_a, n_b``) with ``vencedor``: more wins, a tie is inconclusive, a full comparison is split."""
    if scope == "full":
        return counts.withColumn("vencedor", F.lit("split decision"))
    return counts.withColumn("vencedor", F.when(F.col("n_a") > F.col("n_b"), "legacy").when(F.col("n_a") < F.col("n_b"), "candidate").otherwise("inconclusive"))


def report(counts: DataFrame) -> str:
    """Markdown of one row of ``overlap`` with ``winner``."""
    r = counts.first().asDict()
    return "\n".join(["# Comparison", "", "| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in r.items())])
