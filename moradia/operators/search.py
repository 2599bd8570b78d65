"""Search over listings: optional conjunctive filters, sort modes, paging, favourites, source lists."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 12
LISTING = ("id", "url_anuncio", "titulo", "tipo", "transacao", "cidade", "bairro", "estado", "preco", "area_m2", "quartos", "banheiros", "vagas", "disponivel", "status", "created_at")


@dataclass(frozen=True)
class Filters:
    """A search request; a falsy value means that the filter is absent."""

    q: str = ""
    tipo: str = ""
    transacao: str = ""
    cidade: str = ""
    bairro: str = ""
    preco_min: float = 0
    preco_max: float = 0
    area_min: float = 0
    area_max: float = 0
    quartos: int = 0
    vagas: int = 0
    ordenar: str = "relevante"
    page: int = 1
    page_size: int = PAGE_SIZE


def local_number(s: str | None) -> float | None:
    """A number of a request: dots are thousands marks, the first comma is the decimal point; None if it is no number."""
    if not s:
        return None
    try:
        return float(s.strip().replace(".", "").replace(",", ".", 1))
    except ValueError:
        return None


def request(params: dict[str, str]) -> Filters:
    """Filters of request parameters; unknown sort modes and pages below 1 fall back to the defaults."""
    n = {k: local_number(params.get(k)) or 0 for k in ("preco_min", "preco_max", "area_min", "area_max", "quartos", "vagas")}
    sort = params.get("ordenar", "")
    page = params.get("page", "1")
    return Filters(
        **{k: params.get(k, "").strip() for k in ("q", "tipo", "transacao", "cidade", "bairro")},
        **n | {"quartos": int(n["quartos"]), "vagas": int(n["vagas"])},
        ordenar=sort if sort in ("preco_asc", "preco_desc", "area_desc", "recentes") else "relevante",
        page=max(1, int(page)) if re.fullmatch(r"\d+", page) else 1,
    )


def predicate(f: Filters) -> Column:
    """All given filters in conjunction; null never matches a filter. ``tipo`` and ``transacao`` keep live wildcards."""
    parts = [F.col("disponivel")]
    if f.q:
        parts.append(F.col("titulo").ilike(f"%{f.q}%") | F.col("bairro").ilike(f"%{f.q}%") | F.col("cidade").ilike(f"%{f.q}%"))
    parts += [F.col(c).ilike(v) for c, v in (("tipo", f.tipo), ("transacao", f.transacao)) if v]
    parts += [F.col(c).ilike(f"%{v}%") for c, v in (("cidade", f.cidade), ("bairro", f.bairro)) if v]
    parts += [F.col(c) >= F.lit(v).cast("decimal(18,2)") for c, v in (("preco", f.preco_min), ("area_m2", f.area_min)) if v]
    parts += [F.col(c) <= F.lit(v).cast("decimal(18,2)") for c, v in (("preco", f.preco_max), ("area_m2", f.area_max)) if v]
    parts += [F.col(c) >= v for c, v in (("quartos", f.quartos), ("vagas", f.vagas)) if v]
    return reduce(operator.and_, parts)


def order(mode: str) -> list[Column]:
    """Sort columns; unpriced listings come last upwards and first downwards; the key makes pages stable."""
    newest = [F.col("created_at").desc_nulls_first(), F.col("id").asc()]
    first = {"preco_asc": F.col("preco").asc_nulls_last(), "preco_desc": F.col("preco").desc_nulls_first(), "area_desc": F.col("area_m2").desc_nulls_first()}
    return [first[mode], *newest] if mode in first else newest


def with_source(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Left join with the source's name and address; Catalyst broadcasts the sources if they are small."""
    return listings.join(sources.select(F.col("id").alias("_fonte"), F.col("nome").alias("fonte_nome"), F.col("url").alias("fonte_url")), F.col("fonte_id") == F.col("_fonte"), "left").drop("_fonte")


def search(listings: DataFrame, sources: DataFrame, f: Filters) -> DataFrame:
    """One page of the search: top rows are taken before the join, so only a page of listings meets the sources."""
    page = listings.filter(predicate(f)).select(*LISTING, "fonte_id").orderBy(*order(f.ordenar)).offset((max(1, f.page) - 1) * f.page_size).limit(f.page_size)
    return with_source(page, sources)


def search_total(listings: DataFrame, f: Filters) -> DataFrame:
    n = F.count("*")
    return listings.filter(predicate(f)).agg(n.alias("total"), F.ceil(n / f.page_size).cast("bigint").alias("total_pages"))


def pages_shown(current: int, last: int) -> list[int]:
    """Pages of the paging bar: the first, the last and those within two of the current one."""
    return [p for p in range(1, last + 1) if p in (1, last) or abs(p - current) <= 2]


def sources_with_counts(sources: DataFrame, listings: DataFrame) -> DataFrame:
    """Every source with its number of listings, 0 if it has none."""
    n = listings.groupBy("fonte_id").agg(F.count("*").alias("n"))
    return sources.join(n, sources["id"] == n["fonte_id"], "left").select(sources["id"], "nome", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("total_imoveis"))


def cleanup_candidates(counted: DataFrame) -> DataFrame:
    """Sources in error, or idle without listings."""
    return counted.filter((F.col("status") == "erro") | ((F.col("status") != "crawling") & (F.col("total_imoveis") == 0)))


def toggled(clicks: DataFrame, keys: list[str]) -> DataFrame:
    """What is marked after all toggles: keys that were toggled an odd number of times."""
    return clicks.groupBy(*keys).agg(F.count("*").alias("cliques")).filter("cliques % 2 = 1")


def favourites(marks: DataFrame, listings: DataFrame, sources: DataFrame, user: str = "user_id", item: str = "imovel_id") -> DataFrame:
    """Marked listings as a nested record with the source's name."""
    shown = with_source(listings, sources)
    joined = marks.join(shown, marks[item] == shown["id"])
    return joined.select(user, item, F.struct("titulo", "tipo", "preco", "fonte_nome").alias("imovel"))
