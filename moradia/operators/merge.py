"""Writes as DataFrame transformations: upserts, snapshot sync, toggles, JSON merge, cascades. The caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "url_anuncio"
COALESCED = ("titulo", "tipo", "transacao", "cidade", "bairro", "estado", "preco", "area_m2", "descricao")
OVERWRITTEN = ("quartos", "banheiros", "vagas")
UNTOUCHED = ("fonte_id", "created_at")


def folded(batch: DataFrame, seq: str) -> DataFrame:
    """Duplicates of a key inside a batch folded in order: the last non-null value of coalesced fields, the last value of overwritten ones."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))
    fields = [last(c).alias(c) for c in COALESCED] + [F.max_by(c, seq).alias(c) for c in OVERWRITTEN]
    images = F.max_by("imagens", F.when(F.size("imagens") > 0, F.col(seq))).alias("imagens")
    return batch.groupBy(KEY).agg(*fields, images, *(F.min_by(c, seq).alias(c) for c in UNTOUCHED))


def upsert(stored: DataFrame, batch: DataFrame, policy: str = "coalesce") -> DataFrame:
    """``stored`` merged with ``batch`` (unique keys) on the address.

    ``coalesce``: a null does not replace a value, but counts are always replaced; images are replaced by non-empty ones.
    ``overwrite``: nulls replace values too, and ``transacao`` and ``status`` are left as they were.
    """
    s, b = stored.alias("s"), batch.alias("b")
    new, old = F.col(f"b.{KEY}").isNotNull(), F.col(f"s.{KEY}").isNotNull()

    def field(c: str) -> Column:
        if policy == "overwrite" and c == "transacao":
            return F.col("s.transacao")
        if c in OVERWRITTEN or policy == "overwrite":
            return F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}"))
        if c == "imagens":
            return F.when(new & (F.size("b.imagens") > 0), F.col("b.imagens")).otherwise(F.col("s.imagens"))
        return F.coalesce(f"b.{c}", f"s.{c}")

    status = F.when(new & F.lit(policy == "coalesce"), F.lit("ativo")).otherwise(F.col("s.status"))
    return s.join(b, F.col(f"s.{KEY}") == F.col(f"b.{KEY}"), "full_outer").select(
        F.coalesce(f"s.{KEY}", f"b.{KEY}").alias(KEY), *(field(c).alias(c) for c in (*COALESCED, *OVERWRITTEN, "imagens")),
        F.when(new, True).otherwise(F.col("s.disponivel")).alias("disponivel"), status.alias("status"),
        *(F.when(old, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in UNTOUCHED),
    )


def synced(stored: DataFrame, seen: DataFrame, key: str = KEY) -> DataFrame:
    """Availability after a full crawl: what is gone is possibly sold, what returned is active. ``reativado``, ``vendido`` mark the rows."""
    marks = seen.select(key).distinct().withColumn("_visto", F.lit(True))
    out = stored.join(marks, key, "left").withColumn("_visto", F.coalesce("_visto", F.lit(False)))
    back = F.col("_visto") & F.coalesce(F.col("status") != "ativo", F.lit(False))
    out = out.withColumns({"reativado": back, "vendido": ~F.col("_visto")})
    return out.withColumns(
        {
            "status": F.when(F.col("vendido"), "possivelmente_vendido").when(F.col("reativado"), "ativo").otherwise(F.col("status")),
            "disponivel": F.when(F.col("vendido"), False).when(F.col("reativado"), True).otherwise(F.col("disponivel")),
        }
    ).drop("_visto")


def disabled_missing(stored: DataFrame, seen: DataFrame, key: str = KEY) -> DataFrame:
    """Rows that a reset disables: stored and available, but not seen. Nothing if nothing was seen, as that is a failed crawl."""
    gone = stored.filter("disponivel").join(seen.select(key).distinct(), key, "left_anti")
    return gone.join(seen.limit(1).select(F.lit(1).alias("_um")), how="cross").drop("_um")  # one row or none


def delta_counts(stored: DataFrame, seen: DataFrame, key: str = KEY) -> DataFrame:
    """How many addresses are new, kept and gone against the enriched stored rows."""
    a = stored.filter("titulo is not null").select(key).distinct().withColumn("_s", F.lit(1))
    b = seen.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_s").isNull()).alias("novos"), F.count_if(F.col("_s").isNotNull() & F.col("_b").isNotNull()).alias("mantidos"), F.count_if(F.col("_b").isNull()).alias("sumidos")
    )


def merged_json(config: Column, patch: Column) -> Column:
    """Shallow merge of two flat JSON objects, the right one wins; null sides count as empty. Keys come out sorted."""
    a = F.coalesce(F.from_json(config, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    b = F.coalesce(F.from_json(patch, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))))


def cascaded(parents: DataFrame, children: DataFrame, parent_key: str, foreign_key: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents without the doomed ones, and children without those of doomed parents."""
    gone = doomed.select(parent_key).distinct()
    left = parents.join(gone, parent_key, "left_anti")
    return left, children.join(gone.withColumnRenamed(parent_key, foreign_key), foreign_key, "left_anti")


def touched(sources: DataFrame, status: str, now: Column, policy: str = "only_ok") -> DataFrame:
    """Sources after a status update; ``last_crawl`` moves always, or only with ``ok``."""
    moves = F.lit(policy == "always" or status == "ok")
    return sources.withColumn("status", F.lit(status)).withColumn("last_crawl", F.when(moves, now).otherwise(F.col("last_crawl")))


def unstuck(sources: DataFrame) -> DataFrame:
    """Sources left in ``crawling`` back to ``pendente``, with ``solta`` marking them."""
    stuck = F.coalesce(F.col("status") == "crawling", F.lit(False))
    return sources.withColumn("solta", stuck).withColumn("status", F.when(F.col("solta"), "pendente").otherwise(F.col("status")))


def first_by(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key, the first by ``seq``; an aggregate, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def last_by(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key, the last by ``seq``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")
