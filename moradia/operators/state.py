"""Stateful control in batch form: circuit breaker, cooldowns, staleness, stalls, rings, modes learned by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the message of a network failure holds.
NETWORK = ("timed out", "timeout", "connection refused", "connection reset", "could not resolve", "name or service not known", "no route to host")


def is_network(message: Column) -> Column:
    out = F.lit(False)
    for w in NETWORK:
        out = out | F.lower(message).contains(w)
    return F.coalesce(out, F.lit(False))


def chunked(events: DataFrame, ts: str, chunk: str) -> DataFrame:
    return events.withColumn("_c", F.date_trunc(chunk, F.col(ts)))


def breaker(events: DataFrame, key: str, ts: str, seq: str, ok: Column, failed: Column, most: int = 8, pause: int = 300, chunk: str = "day") -> DataFrame:
    """``events`` with ``seguidas`` (failures in a row) and ``aberto_ate``: from the ``most``-th failure on, each one closes the domain for ``pause`` seconds.

    A success resets the count; other events neither count nor reset; the count outlives the pause. A domain's events are counted by
    ``chunk`` of time, each in a task of its own, and what each chunk hands on (failures since its last success) is added up over the
    chunks alone, so a domain with most of the events is no bottleneck. Events without a time come first, in one chunk.
    """
    rows = chunked(events, ts, chunk)
    w = Window.partitionBy(key, "_c").orderBy(ts, seq)
    rows = rows.withColumn("_run", F.sum(F.when(ok, 1).otherwise(0)).over(w))
    own = Window.partitionBy(key, "_c", "_run").orderBy(ts, seq)
    rows = rows.withColumn("_n", F.sum(F.when(failed, 1).otherwise(0)).over(own))
    last = rows.groupBy(key, "_c").agg(F.max("_run").alias("_runs"), F.max_by("_n", F.struct("_run", "_n")).alias("_tail"))
    over = Window.partitionBy(key).orderBy(F.asc_nulls_first("_c"))
    last = last.withColumn("_isle", F.sum(F.when(F.col("_runs") > 0, 1).otherwise(0)).over(over))
    last = last.withColumn("_sum", F.sum("_tail").over(Window.partitionBy(key, "_isle").orderBy(F.asc_nulls_first("_c"))))
    carried = last.select(F.col(key).alias("_k"), F.col("_c").alias("_d"), F.coalesce(F.lag("_sum").over(over), F.lit(0)).alias("_in"))
    out = rows.join(carried, rows[key].eqNullSafe(F.col("_k")) & rows["_c"].eqNullSafe(F.col("_d")))
    out = out.withColumn("seguidas", (F.col("_n") + F.when(F.col("_run") == 0, F.col("_in")).otherwise(0)).cast("bigint"))
    until = F.when(failed & (F.col("seguidas") >= most), F.col(ts) + F.make_interval(secs=F.lit(pause)))
    return out.withColumn("aberto_ate", until).select(*events.columns, "seguidas", "aberto_ate")


def cooldown(events: DataFrame, key: str, ts: str, seq: str, seconds: Column, chunk: str = "day") -> DataFrame:
    """``events`` with ``ate``: the latest end of any pause so far; explicit pauses never shorten one (60 s if not given, 3600 s at most).

    By chunks of time as in ``breaker``: the latest end of earlier chunks is added to that within the own one.
    """
    rows = chunked(events, ts, chunk).withColumn("_end", F.col(ts) + F.make_interval(secs=F.least(F.coalesce(seconds, F.lit(60.0)), F.lit(3600.0))))
    rows = rows.withColumn("_own", F.max("_end").over(Window.partitionBy(key, "_c").orderBy(ts, seq)))
    over = Window.partitionBy(key).orderBy(F.asc_nulls_first("_c"))
    best = rows.groupBy(key, "_c").agg(F.max("_end").alias("_m")).withColumn("_in", F.max("_m").over(over.rowsBetween(Window.unboundedPreceding, -1)))
    carried = best.select(F.col(key).alias("_k"), F.col("_c").alias("_d"), "_in")
    out = rows.join(carried, rows[key].eqNullSafe(F.col("_k")) & rows["_c"].eqNullSafe(F.col("_d")))
    return out.withColumn("ate", F.greatest("_own", "_in")).select(*events.columns, "ate")


def stale(sources: DataFrame, now: Column, beat: str = "heartbeat", limit: int = 180) -> DataFrame:
    """Sources in ``crawling`` whose heartbeat is missing or older than ``limit`` seconds are in error."""
    age = F.unix_timestamp(now) - F.unix_timestamp(beat)
    dead = (F.col("status") == "crawling") & (F.col(beat).isNull() | (age > limit))
    return sources.withColumn("status", F.when(dead, "erro").otherwise(F.col("status")))


def stalls(progress: DataFrame, key: str, ts: str, seq: str, done: str, limit: int = 120) -> DataFrame:
    """Steps after which ``done`` did not change for more than ``limit`` seconds."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    moved = progress.withColumn("_antes", F.lag(done).over(w)).filter(F.col("_antes").isNull() | (F.col("_antes") != F.col(done)))
    return moved.withColumn("parado", F.unix_timestamp(F.lead(ts).over(w)) - F.unix_timestamp(ts)).filter(F.col("parado") > limit).drop("_antes")


def ring(history: DataFrame, key: str, ts: str, seq: str, size: int = 50) -> DataFrame:
    """The last ``size`` entries of each key, newest first."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(ts), F.desc(seq))
    return history.withColumn("posicao", F.row_number().over(w)).filter(F.col("posicao") <= size)


def modes(samples: DataFrame, least: int = 5) -> DataFrame:
    """Samples (``dominio, seq, precisa_navegador``): the way to fetch a domain once its first ``least`` samples agree, else null."""
    w = Window.partitionBy("dominio").orderBy("seq")
    first = samples.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= least)
    n, yes = F.count("*"), F.count_if("precisa_navegador")
    return first.groupBy("dominio").agg(F.when((n == least) & (yes == least), "navegador").when((n == least) & (yes == 0), "http").alias("modo"))


def progress_log(entries: DataFrame, key: str, seq: str, text: str, last: int = 8) -> DataFrame:
    """The last messages of each key as one array."""
    return ring(entries, key, seq, seq, last).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(seq, text))), lambda x: x[text]).alias("log"))
