"""Sources that are read from fetched pages: sitemaps, public JSON databases, registry tables, and how a page was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moradia.functions.text import any_of
from moradia.functions.urls import host

#: Words of addresses of items, and of pages beside the subject.
ITEM_WORDS = ("imovel", "imoveis", "property", "venda", "aluguel", "anuncio")
OFF_TOPIC = r"/(?:blog|noticias?|sobre|contato|equipe|politica|termos)(?:/|$)"


def child_sitemaps(index_xml: Column, most: int = 5) -> Column:
    """Addresses of the child sitemaps of an index: those with a word of items, else the first three that are no blog."""
    all_ = F.regexp_extract_all(index_xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    fitting = F.filter(all_, lambda u: any_of(u, ITEM_WORDS))
    rest = F.slice(F.filter(all_, lambda u: ~F.lower(u).contains("blog")), 1, 3)
    return F.slice(F.when(F.size(fitting) > 0, fitting).otherwise(rest), 1, most)


def sitemap_entries(pages: DataFrame, xml: str = "xml", base: str = "host") -> DataFrame:
    """``url, imagem`` of the entries of sitemaps on their own host, each address once (its first image); bare addresses if there is no markup."""
    blocks = F.explode(F.split(xml, r"<url>|<url\s[^>]*>"))
    tagged = pages.filter(F.col(xml).contains("<loc>")).select(base, blocks.alias("b")).select(
        base, F.regexp_extract("b", r"<loc>\s*([^<\s]+)\s*</loc>", 1).alias("url"), F.nullif(F.regexp_extract("b", r"<image:loc>\s*([^<\s]+)\s*</image:loc>", 1), F.lit("")).alias("imagem")
    )
    bare = pages.filter(~F.col(xml).contains("<loc>")).select(base, F.explode(F.regexp_extract_all(xml, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1))).alias("url"), F.lit(None).cast("string").alias("imagem"))
    kept = tagged.unionByName(bare).filter((F.col("url") != "") & (host(F.col("url")) == F.col(base)) & ~F.lower("url").rlike(OFF_TOPIC))
    return kept.groupBy("url").agg(F.min("imagem").alias("imagem"))


def json_database(df: DataFrame, column: str = "json") -> DataFrame:
    """Listings of a JSON object of objects; ``-1`` and empty texts mean nothing, photos come as a list or an object."""
    item = "map<string, struct<titulo: string, tipo: string, valor: string, dormitorios: string, fotos: string>>"
    blank = lambda c: F.when(~F.trim(c).isin("", "-1"), c)
    rows = df.select(F.explode(F.from_json(column, item)).alias("id", "o"))
    photos = F.coalesce(F.from_json("o.fotos", "array<string>"), F.map_values(F.from_json("o.fotos", "map<string,string>")))
    return rows.select("id", blank(F.col("o.titulo")).alias("titulo"), blank(F.col("o.tipo")).alias("tipo"), blank(F.col("o.valor")).try_cast("double").alias("preco"), blank(F.col("o.dormitorios")).try_cast("int").alias("quartos"), photos.alias("imagens"))


def registry_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of registry tables with five or more cells: registrations of companies (with a J), names of three or more letters, city and state apart."""
    lines = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("linha"))
    cells = F.transform(F.regexp_extract_all("linha", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    rows = lines.select(cells.alias("c")).filter(F.size("c") >= 5)
    place = F.split(F.get("c", F.lit(4)), "/")
    out = rows.select(F.get("c", F.lit(0)).alias("creci"), F.get("c", F.lit(1)).alias("nome"), F.get("c", F.lit(2)).alias("nome_fantasia"), F.get("c", F.lit(3)).alias("situacao"), F.trim(F.get(place, F.lit(0))).alias("cidade"), F.trim(F.get(place, F.lit(1))).alias("estado"))
    return out.filter(F.upper("creci").contains("J") & (F.length("nome") >= 3))


def usable_page(plain: Column, rendered: Column) -> Column:
    """The plainly fetched page if it has content, else the rendered one; pages under 200 characters are none."""
    ok = lambda c: F.when((F.length(c) >= 200) & any_of(c, ("quarto", "dormit", "m²", "r$", "banheiro")), c)
    return F.coalesce(ok(plain), F.when(F.length(rendered) >= 200, rendered))


def alive(links: DataFrame, checked: str = "vivo", unknown: bool = True) -> DataFrame:
    """Links that answer; what could not be told counts by policy."""
    return links.filter(F.coalesce(F.col(checked), F.lit(unknown)))


def last_page(pages: DataFrame, site: str = "site") -> DataFrame:
    """For each site the last page with links of all pages that were probed (``pagina, links``)."""
    return pages.filter("links > 0").groupBy(site).agg(F.max("pagina").alias("ultima"))


def best_list(candidates: DataFrame, least: int = 3) -> DataFrame:
    """For each site (``site, ordem, url, links``) the first candidate with ``least`` links, else the one with most."""
    w = Window.partitionBy("site").orderBy(F.when(F.col("links") >= least, 0).otherwise(1), F.when(F.col("links") >= least, F.col("ordem")).otherwise(-F.col("links")), "ordem")
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
