"""Discovery of listings: paging with a stop rule, choice of list pages, best sites of an entity, learning of selectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pages_read(links: DataFrame, site: str = "site", page: str = "pagina", url: str = "url", empty: int = 2) -> DataFrame:
    """``site, pagina, novos, lida``: new addresses of each page, and whether it is read before ``empty`` pages in a row bring none."""
    first = links.groupBy(site, url).agg(F.min(page).alias(page))
    new = first.groupBy(site, page).agg(F.count("*").alias("novos"))
    pages = links.select(site, page).distinct().join(new, [site, page], "left").fillna(0, ["novos"])
    w = Window.partitionBy(site).orderBy(page)
    run = F.sum(F.when(F.col("novos") == 0, 1).otherwise(0)).over(w.rowsBetween(-(empty - 1), 0))
    marked = pages.withColumn("_cheio", (run == empty).cast("int"))
    before = F.coalesce(F.max("_cheio").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("lida", before == 0).drop("_cheio")


def best_by_kind(lists: DataFrame, keep: int = 3, above: int = 6) -> DataFrame:
    """List pages (``site, tipo, url, links``): at most ``keep`` of each kind by number of links, if the site has more than ``above``."""
    site = Window.partitionBy("site")
    w = Window.partitionBy("site", "tipo").orderBy(F.desc("links"), "url")
    out = lists.withColumn("_n", F.count("*").over(site)).withColumn("_r", F.row_number().over(w))
    return out.filter((F.col("_n") <= above) | (F.col("_r") <= keep)).drop("_n", "_r")


def without_overlap(lists: DataFrame, most: float = 0.8) -> DataFrame:
    """List pages (``site, seq, url, itens``) in order of ``seq``: one is dropped if more than ``most`` of its items are in those kept before.

    The outcome depends on the order, so each site is folded in one task; a site's list pages are few by nature.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        kept = []
        for r in pdf.sort_values("seq").itertuples():
            items = set(r.itens)
            if items and len(items & seen) / len(items) > most:
                continue
            seen |= items
            kept.append((r.site, r.seq, r.url))
        return pd.DataFrame(kept, columns=["site", "seq", "url"])

    return lists.groupBy("site").applyInPandas(one, "site string, seq long, url string")


def best_sites(hits: DataFrame, keep: int = 3) -> DataFrame:
    """Search hits (``entidade, host, pontos, posicao``): the best of each host, then the best ``keep`` hosts of each entity."""
    best = hits.groupBy("entidade", "host").agg(F.max("pontos").alias("pontos"), F.min("posicao").alias("posicao"))
    w = Window.partitionBy("entidade").orderBy(F.desc("pontos"), "posicao", "host")
    return best.withColumn("lugar", F.row_number().over(w)).filter(F.col("lugar") <= keep)


def elected(votes: DataFrame, least: int = 2) -> DataFrame:
    """Votes (``site, campo, seletor, peso, seq``): for each field the selector with most weight, the first seen at a tie, if it has ``least`` votes; a
    selector that wins several fields keeps the one with more weight."""
    n = votes.groupBy("site", "campo", "seletor").agg(F.sum("peso").alias("peso"), F.count("*").alias("votos"), F.min("seq").alias("seq"))
    field = Window.partitionBy("site", "campo").orderBy(F.desc("peso"), "seq")
    top = n.withColumn("_r", F.row_number().over(field)).filter((F.col("_r") == 1) & (F.col("votos") >= least))
    owner = Window.partitionBy("site", "seletor").orderBy(F.desc("peso"), "campo")
    return top.withColumn("_o", F.row_number().over(owner)).filter("_o = 1").drop("_r", "_o")


def with_prefix(names: DataFrame, lookup: DataFrame) -> DataFrame:
    """``nome`` to ``id``: the entry with the same name, else the first (by ``ordem``) that begins with it.

    Every beginning of an entry is a row, so both steps are joins on equality, whatever the sizes.
    """
    exact = names.join(lookup, "nome", "left").select("nome", "id")
    rest = exact.filter("id is null and nome <> ''").select("nome").distinct()
    begun = lookup.filter("nome <> ''").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("nome")), lambda n: F.substring("nome", 1, n))).alias("nome"), "id", "ordem")
    near = begun.groupBy("nome").agg(F.min_by("id", "ordem").alias("_id")).join(rest, "nome", "left_semi")
    return exact.join(near, "nome", "left").select("nome", F.coalesce("id", "_id").alias("id"))
