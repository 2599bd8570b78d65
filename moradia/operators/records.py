"""Small operators on stored records: lookups, patches, defaults, last states, totals, admission, reports."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moradia.session import sized, small_rows


# lookups and projections
def with_keys(rows: DataFrame, keys: DataFrame | Iterable, key: str = "id", most: int = 1000) -> DataFrame:
    """Rows whose key is in a list, or in the column of that name of a table of any size (semi-join)."""
    if isinstance(keys, DataFrame):
        return rows.join(keys.select(key).distinct(), key, "left_semi")
    wanted = list(keys)
    if len(wanted) > most:
        keys = rows.sparkSession.createDataFrame([(k,) for k in wanted], rows.select(key).schema)
        return rows.join(keys, key, "left_semi")
    return rows.filter(F.col(key).isin(wanted))


def like(rows: DataFrame, field: str, pattern: str, anycase: bool = False) -> DataFrame:
    """Rows whose field has a form with ``%`` and ``_``; null fits nothing."""
    return rows.filter(F.col(field).ilike(pattern) if anycase else F.col(field).like(pattern))


def one(rows: DataFrame, value: object, key: str = "id") -> Row | None:
    """The row of a key, None if there is none."""
    return next(iter(rows.filter(F.col(key) == value).limit(1).collect()), None)


def sizes(rows: DataFrame) -> DataFrame:
    """``id, letras, fotos``: length of the description and number of images, null where there are none."""
    return rows.select("id", F.length("descricao").alias("letras"), F.when(F.size("imagens") > 0, F.size("imagens")).alias("fotos"))


def flat(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """The listing as one JSON object of its fields, nulls left out."""
    return F.to_json(F.struct(*(F.col(f) for f in fields)))


# changes
def patched(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the fields that the patch of their key gives; a field that is null in the patch, or not in it, stays."""
    fields = [c for c in patch.columns if c != key]
    both = old.alias("o").join(patch.alias("p"), key, "left")
    return both.select(*(F.coalesce(f"p.{c}", f"o.{c}").alias(c) if c in fields else (F.col(c) if c == key else F.col(f"o.{c}").alias(c)) for c in old.columns))


def with_defaults(rows: DataFrame, **defaults: Column) -> DataFrame:
    """New rows as they are stored: columns that are missing or null take their default."""
    return rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})


def with_state(rows: DataFrame, flag: str = "disponivel", column: str = "status") -> DataFrame:
    """A state column filled from a flag where it is missing or null: ``ativo`` or ``possivelmente_vendido``."""
    told = F.when(F.coalesce(F.col(flag), F.lit(False)), "ativo").otherwise("possivelmente_vendido")
    return rows.withColumn(column, F.coalesce(F.col(column), told) if column in rows.columns else told)


def nulled_by_bare_upsert(stored: DataFrame, batch: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """The hazard of overwriting with addresses alone: ``key`` and ``perdidos``, the filled fields that a batch without values would empty."""
    both = stored.alias("s").join(batch.dropDuplicates([key]).alias("b"), key)
    have = [c for c in fields if c in batch.columns]
    lost = [F.when(F.col(f"s.{f}").isNotNull() & (F.col(f"b.{f}").isNull() if f in have else F.lit(True)), f) for f in fields]
    return both.select(key, F.array_compact(F.array(*lost)).alias("perdidos")).filter(F.size("perdidos") > 0)


def last_states(events: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """The last row of each key of an append-only log; an aggregate with map-side combine."""
    order = list(order)
    rest = [c for c in events.columns if c != key and c not in order]
    m = F.max(F.struct(*order, *rest)).alias("m")
    return events.groupBy(key).agg(m).select(key, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def source_states(log: DataFrame, policy: str = "always") -> DataFrame:
    """Status of each source after its last event, and ``last_crawl``: when any event (``always``) or the last ``ok`` (``ok``) ended.

    Expects ``fonte_id, status, finished_at, execucao_id``.
    """
    at = F.col("finished_at") if policy == "always" else F.when(F.col("status") == "ok", F.col("finished_at"))
    return log.groupBy("fonte_id").agg(F.max_by("status", F.struct("finished_at", "execucao_id")).alias("status"), F.max(at).alias("last_crawl"))


# totals
def nav_counts(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: available listings and failed sources."""
    return listings.agg(F.count_if("disponivel").alias("ativos")).crossJoin(sources.agg(F.count_if(F.col("status") == "erro").alias("erros")))


def cleanup_counts(sources: DataFrame) -> DataFrame:
    """One row: sources that failed, that are idle without listings, and that are either. Expects ``status, total``."""
    failed, empty = F.col("status") == "erro", (F.col("status") != "crawling") & (F.col("total") == 0)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return sources.agg(count(failed).alias("com_erro"), count(empty).alias("vazias"), count(F.coalesce(failed, F.lit(False)) | F.coalesce(empty, F.lit(False))).alias("candidatas"))


def fleet_totals(history: DataFrame, counts: tuple[str, ...] = ("urls_found", "enriched", "failed", "complete", "new_urls", "kept_urls", "sold_urls", "reactivated_urls")) -> DataFrame:
    """One row over all crawls: their number, those that ended well, the sum of every count, and enriched pages for each address found."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts]
    total = history.agg(F.count("*").alias("execucoes"), F.count_if(F.col("status") == "ok").alias("ok"), *sums)
    return total.withColumn("taxa", F.col("enriched") / F.greatest("urls_found", F.lit(1)))


def run_summary(history: DataFrame) -> DataFrame:
    """One row over all runs: number, by status, whole mean of found addresses, and ``tempos``: the sum of each phase, by phase."""
    one_row = history.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "erro").alias("erro"), F.floor(F.coalesce(F.sum("urls_found"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).cast("bigint").alias("media"))
    phases = history.select(F.explode("phase_times").alias("fase", "t")).groupBy("fase").agg(F.sum("t").cast("bigint").alias("t"))
    times = phases.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fase", "t")))).alias("tempos"))
    return one_row.crossJoin(times)


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with counters that are known once they have been written, at no cost of a pass of their own."""
    seen = Observation(name)
    return rows.observe(seen, *(c.alias(k) for k, c in counts.items())), seen


# order and sets
def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of an order that has no ties."""
    return rows.orderBy(*order).limit(k)


def problems(scored: DataFrame, least: float = 70.0) -> DataFrame:
    """Sources of a quality report below ``least`` or without rows, the best first. Expects ``fonte_id, total, nota``."""
    return scored.filter((F.col("nota") < least) | (F.col("total") == 0)).orderBy(F.desc_nulls_last("nota"), "fonte_id")


def union_of(*parts: DataFrame, key: str | None = None) -> DataFrame:
    """All rows of the parts, which may lack columns; with ``key`` only its distinct values."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(key).distinct() if key else out


# state
def admitted(requests: DataFrame, evict_s: int = 1800, chunk: str = "day") -> DataFrame:
    """Requests with ``aceito``: a source takes a request unless one it took is still running; a running one is given up after ``evict_s`` seconds.

    Expects ``fonte_id, pedido_id, em, termino`` (null: not ended). The rule is a fold in the order of ``em, pedido_id``: a request's fate depends on all
    those before. Each source is sorted in one task and read in that order, batch by batch; all that is kept is when the running request ends.
    """
    start = F.unix_timestamp("em")
    end = F.least(F.coalesce(F.unix_timestamp("termino"), start + evict_s), start + evict_s)
    rows = requests.select("fonte_id", "pedido_id", start.alias("a"), end.alias("b"))
    ordered = rows.repartition("fonte_id").sortWithinPartitions(F.asc("fonte_id"), F.asc_nulls_last("a"), F.asc_nulls_last("pedido_id"), F.asc_nulls_last("b"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("aceito", T.BooleanType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, until = object(), None
        for batch in batches:
            taken = []
            for s, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if s != source:
                    source, free = s, True
                else:
                    free = None if a is None or until is None else a >= until
                if free:
                    until = b
                taken.append(free)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(taken, pa.bool_())], names=["fonte_id", "pedido_id", "aceito"])

    return ordered.mapInArrow(fold, schema)


# sources as tables
def usable_pages(pages: DataFrame, cooldowns: DataFrame | None = None, least: int = 200) -> DataFrame:
    """Pages as a fetch would give them: ``html`` is null for answers other than 200, pages shorter than ``least``, and hosts in cooldown at that time.

    Expects ``url, html, fetched_at, status``; ``cooldowns`` holds ``host, desde, ate``. ``pausa_s`` says how long a host that answered 429 or 503 is to be left alone.
    """
    from moradia.functions.urls import host

    out = pages.withColumn("host", host(F.col("url")))
    if cooldowns is not None:
        spans = cooldowns.groupBy("host").agg(F.collect_list(F.struct("desde", "ate")).alias("_c"))
        out = out.join(sized(spans, 100_000), "host", "left")
        paused = F.exists(F.coalesce("_c", F.array().cast("array<struct<desde:timestamp,ate:timestamp>>")), lambda c: (F.col("fetched_at") >= c["desde"]) & (F.col("fetched_at") < c["ate"]))
        out = out.withColumn("pausado", paused).drop("_c")
    else:
        out = out.withColumn("pausado", F.lit(False))
    ok = (F.col("status") == 200) & (F.length("html") >= least) & ~F.col("pausado")
    return out.withColumn("html", F.when(ok, F.col("html"))).withColumn("pausa_s", F.when(F.col("status").isin(429, 503), 60))


def city_ids(options: DataFrame) -> DataFrame:
    """``cidade, id`` of a list of choices, by normalised name, the first one of equal names. Expects ``id, nome, ordem``."""
    from moradia.functions.text import plain

    return options.groupBy(plain(F.col("nome")).alias("cidade")).agg(F.min_by("id", "ordem").alias("id"))


def columns_of(spark: SparkSession, table: str) -> DataFrame:
    """``nome, tipo, nulo`` of the columns of a table or view."""
    fields = spark.table(table).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in fields], "nome string, tipo string, nulo boolean")


def seed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Five sources and twenty listings, always the same, for demonstrations and tests."""
    cities = ("Caxias do Sul", "Porto Alegre", "Gramado", "Canela", "Farroupilha")
    kinds = ("apartamento", "casa", "terreno", "sala")
    sources = [(f"fonte-{k}", f"Fonte {k}", f"https://fonte{k}.example", c, "RS", "ok", True) for k, c in enumerate(cities, 1)]
    rows = [(k, f"fonte-{k % 5 + 1}", f"https://fonte{k % 5 + 1}.example/imovel/{1000 + k}", f"{kinds[k % 4].title()} {k}", kinds[k % 4], cities[k % 5], "RS", float(150_000 + 25_000 * k), float(40 + 5 * k), 0 if k % 4 > 1 else k % 4 + 1, k % 3 + 1, k % 3, True) for k in range(20)]
    return (
        spark.createDataFrame(sources, "id string, nome string, url string, cidade string, estado string, status string, ativa boolean"),
        spark.createDataFrame(rows, "id bigint, fonte_id string, url_anuncio string, titulo string, tipo string, cidade string, estado string, preco double, area_m2 double, quartos int, banheiros int, vagas int, disponivel boolean"),
    )


def best_list_page(candidates: DataFrame, early: int = 5, home: int = 30) -> DataFrame:
    """The list page of each site: the first candidate with ``early`` item links (``home`` for the home page), else the one with most. Expects ``site, ordem, url, inicio, n``."""
    enough = F.col("n") >= F.when(F.col("inicio"), home).otherwise(early)
    choice = F.coalesce(F.min_by("url", F.when(enough, F.col("ordem"))), F.max_by("url", F.when(F.col("n") > 0, F.struct("n", -F.col("ordem")))))
    return candidates.groupBy("site").agg(choice.alias("url"))


def pages_read(new_links: DataFrame, batch: int = 5, most: int = 100) -> DataFrame:
    """The pages of each site that a reader in batches takes: it stops after two batches without a new link, and reads page 1 alone where page 10 and all beyond are empty.

    Expects ``site, pagina, links, novos`` (1 and up). Batches are summed by an aggregate; what is ordered are the batches of a site, ``most`` pages at the most.
    """
    within = new_links.filter(F.col("pagina").between(1, most))
    b = F.floor((F.col("pagina") - 1) / batch).cast("int")
    sums = within.groupBy("site", b.alias("lote")).agg(F.sum("novos").alias("novos"))
    beyond = within.groupBy("site").agg(F.sum(F.when(F.col("pagina") >= 10, F.col("links"))).alias("longe"))
    w = Window.partitionBy("site").orderBy("lote")
    stop = sums.withColumn("par", (F.col("novos") == 0) & (F.coalesce(F.lag("novos").over(w), F.lit(1)) == 0)).groupBy("site").agg(F.min(F.when(F.col("par"), F.col("lote"))).alias("fim"))
    out = within.join(stop, "site").join(beyond, "site")
    read = F.when(F.coalesce(F.col("longe"), F.lit(1)) == 0, F.col("pagina") == 1).otherwise(F.col("fim").isNull() | (b <= F.col("fim")))
    return out.filter(read).select("site", "pagina")


# reports
def markdown(title: str, rows: DataFrame, most: int = 50) -> str:
    """A small table as Markdown, for a reader."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in small_rows(rows.limit(most), most, title)]
    return "\n".join(lines)


def report(runs: DataFrame, differences: DataFrame, form: str = "both") -> str:
    """A comparison of two runs for the console: ``json``, ``md`` or ``both``; its summary row and the first differences."""
    import json

    out = []
    if form in ("json", "both"):
        out.append(json.dumps({"resumo": [r.asDict() for r in small_rows(runs, 10, "summary")], "diferencas": [r.asDict() for r in small_rows(differences.limit(50), 50, "differences")]}, ensure_ascii=False, default=str))
    if form in ("md", "both"):
        out += [markdown("Resumo", runs), markdown("Diferenças", differences)]
    return "\n\n".join(out)
