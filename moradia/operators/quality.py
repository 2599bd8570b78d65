"""Dashboards and data-quality profiles: each is one aggregate over all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds in which people live.
RESIDENTIAL = ("apartamento", "casa", "sobrado", "cobertura", "kitnet")


def dashboard(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts of listings (all, available) and sources (all, active, in error): one pass over each table."""
    a = listings.agg(F.count("*").alias("imoveis"), F.count_if("disponivel").alias("disponiveis"))
    b = sources.agg(F.count("*").alias("fontes"), F.count_if("ativa").alias("ativas"), F.count_if(F.col("status") == "erro").alias("com_erro"))
    return a.crossJoin(b)  # one row each


def has_images() -> Column:
    return F.coalesce(F.size("imagens") > 0, F.lit(False))


def profile(listings: DataFrame, by: str = "fonte_id") -> DataFrame:
    """Coverage, ranges and anomalies of every source in one aggregate."""
    has = [F.count(c).alias(f"com_{c}") for c in ("titulo", "tipo", "transacao", "cidade", "bairro", "preco", "area_m2", "quartos")]
    return listings.groupBy(by).agg(
        F.count("*").alias("total"), *has,
        F.count_if(F.length("descricao") > 10).alias("com_descricao"), F.count_if(has_images()).alias("com_imagens"),
        F.round(F.avg(F.col("preco").cast("double")), 0).alias("preco_medio"), F.min("preco").alias("preco_min"), F.max("preco").alias("preco_max"),
        F.round(F.avg(F.col("quartos").cast("double")), 1).alias("quartos_medio"), F.max("quartos").alias("quartos_max"),
        F.round(F.avg(F.col("area_m2").cast("double")), 0).alias("area_media"), F.max("area_m2").alias("area_max"),
        F.count_if((F.col("preco") > 0) & (F.col("preco") < 500)).alias("preco_baixo"), F.count_if(F.col("preco") > 50_000_000).alias("preco_alto"),
        F.count_if(F.col("tipo").isin(*RESIDENTIAL) & F.col("quartos").isNull()).alias("sem_quartos"),
    )


def score(p: DataFrame) -> DataFrame:
    """Quality score 0..100 of a profile with its band; thresholds are on unrounded shares."""
    share = lambda c: F.col(c) / F.col("total")
    off = (
        F.when(share("com_preco") < 0.5, 20).when(share("com_preco") < 0.75, 10).otherwise(0)
        + F.when(share("com_bairro") < 0.8, 15).otherwise(0)
        + F.when(share("com_tipo") < 0.8, 15).otherwise(0)
        + F.when(F.col("sem_quartos") > 5, F.when(share("sem_quartos") > 0.2, 15).when(share("sem_quartos") > 0.05, 5).otherwise(0)).otherwise(0)
        + F.when(share("com_descricao") < 0.3, 10).otherwise(0)
        + F.when(share("com_imagens") < 0.3, 5).otherwise(0)
    )
    s = F.when(F.col("total") == 0, 0).otherwise(F.greatest(F.lit(0), 100 - off)).cast("int")
    out = p.withColumn("nota", s)
    return out.withColumn("faixa", F.when(F.col("nota") >= 90, "otimo").when(F.col("nota") >= 70, "bom").when(F.col("nota") >= 50, "regular").otherwise("ruim"))


def top_kinds(listings: DataFrame, k: int = 12, by: str = "fonte_id") -> DataFrame:
    """The ``k`` most frequent kinds of each source; counted first, so the window sees a few rows a source."""
    n = listings.filter("tipo is not null").groupBy(by, "tipo").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), F.col("tipo"))
    return n.withColumn("posicao", F.row_number().over(w)).filter(F.col("posicao") <= k)


def transactions(listings: DataFrame, by: str = "fonte_id") -> DataFrame:
    """Listings by transaction, null as a group of its own called NULL."""
    return listings.groupBy(by, F.coalesce("transacao", F.lit("NULL")).alias("transacao")).agg(F.count("*").alias("n"))


def transaction_maps(listings: DataFrame, by: str = "fonte_id") -> DataFrame:
    """The same as one map a source."""
    entry = F.sort_array(F.collect_list(F.struct("transacao", "n")))
    return transactions(listings, by).groupBy(by).agg(F.map_from_entries(entry).alias("por_transacao"))


def missing_by_kind(listings: DataFrame, field: str) -> DataFrame:
    return listings.filter(F.col(field).isNull()).groupBy("tipo").agg(F.count("*").alias("faltam"))


def completeness(listings: DataFrame) -> DataFrame:
    """Complete listings (a price, a kind and a place) and how often each label is missing."""
    labels = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("preco") > 0, F.lit(False)), "preco"),
            F.when(F.coalesce("tipo", F.lit("")) == "", "tipo"),
            F.when((F.coalesce("bairro", F.lit("")) == "") & (F.coalesce("cidade", F.lit("")) == ""), "local"),
        )
    )
    return listings.select(F.concat_ws("+", labels).alias("faltam")).groupBy("faltam").agg(F.count("*").alias("n"))


def filled_fields(listings: DataFrame) -> DataFrame:
    """How many listings have how many of seven fields filled; numbers count if positive."""
    number = [F.when(F.col(c) > 0, 1).otherwise(0) for c in ("preco", "area_m2", "quartos", "banheiros")]
    text = [F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in ("titulo", "tipo", "bairro")]
    return listings.select(sum(number + text, F.lit(0)).alias("preenchidos")).groupBy("preenchidos").agg(F.count("*").alias("n"))


def contaminated(listings: DataFrame, by: str = "fonte_id") -> DataFrame:
    """Where rooms equal bathrooms, which hints at one number read twice; with the share of the source's rows."""
    n = F.count_if(F.col("quartos") == F.col("banheiros"))
    return listings.groupBy(by).agg(n.alias("iguais"), F.round(n * 100.0 / F.count("*"), 1).alias("pct"))


def samples(listings: DataFrame, k: int = 5, seed: int = 7, by: str = "fonte_id") -> DataFrame:
    """``k`` rows of each source, chosen by a hash of key and seed: the same rows however the data are partitioned."""
    h = F.xxhash64("id", F.lit(seed))
    w = Window.partitionBy(by).orderBy(h, "id")
    return listings.select("id", by).withColumn("posicao", F.row_number().over(w)).filter(F.col("posicao") <= k)


def crawl_summary(history: DataFrame) -> DataFrame:
    """Crawls of each source: status counts, sums, truncated mean of addresses, success rate, seconds of ``elapsed_s`` in both units."""
    seconds = elapsed_seconds(F.col("elapsed_s"))
    found, enriched = F.coalesce(F.sum("urls_found"), F.lit(0)), F.coalesce(F.sum("enriched"), F.lit(0))
    return history.groupBy("fonte_id").agg(
        F.count("*").alias("execucoes"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "erro").alias("erro"),
        found.alias("urls"), enriched.alias("enriquecidos"), F.floor(found / F.count("*")).cast("bigint").alias("urls_media"),
        F.round(enriched * 100.0 / F.greatest(found, F.lit(1)), 1).alias("pct"), F.round(F.sum(seconds), 1).alias("segundos"),
    )


def elapsed_seconds(c: Column) -> Column:
    """Seconds of a duration written as ``12.3s`` or ``4.5min``; null for anything else."""
    n = F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:s|min)\s*$", 1)
    return F.when(c.rlike(r"min\s*$"), n.try_cast("double") * 60).otherwise(n.try_cast("double"))


def phase_times(history: DataFrame) -> DataFrame:
    """Time of each phase summed over all crawls of a source."""
    return history.select("fonte_id", F.explode("phase_times").alias("fase", "ms")).groupBy("fonte_id", "fase").agg(F.sum("ms").alias("ms"))
