"""Selectors learned from pages whose values are known, applied to further pages, dropped when they fail."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moradia.functions.html import SKIPPED, VOID
from moradia.functions.text import field_value
from moradia.session import sized

#: Classes that change from build to build.
VOLATILE = re.compile(r"\d{3,}|^(?:css|sc|jsx|svelte)-|^[a-z]{1,2}$|__[A-Za-z0-9]{5,}$")
CONFIRMED, USES, MISSES = 2, 15, 0.35
#: Most sites whose templates are broadcast; beyond that they are joined by shuffle.
MOST_SITES = 20_000


class Tree(HTMLParser):
    """The text under every selector of at most three levels (tag and stable classes)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.texts: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        classes = [c for c in (dict(attrs).get("class") or "").split() if not VOLATILE.search(c)]
        self.stack.append((tag, tag + "".join(f".{c}" for c in classes)))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if (t := " ".join(data.split())) and self.stack and not SKIPPED.intersection(t for t, _ in self.stack):
            self.texts.setdefault(" > ".join(s for _, s in self.stack[-3:]), []).append(t)


def texts_of(page: str | None) -> dict[str, list[str]]:
    t = Tree()
    t.feed(page or "")
    t.close()
    return t.texts


@F.pandas_udf(T.ArrayType(T.StringType()))
def selectors_for(pages: pd.Series, values: pd.Series) -> pd.Series:
    """Up to five selectors under which a page holds a value, alone before among other text."""

    def find(page: str | None, value: str | None) -> list[str]:
        if not value:
            return []
        v = value.strip().lower()
        hits = [(t.lower() != v, len(t), s) for s, texts in texts_of(page).items() for t in texts if v in t.lower()]
        return list(dict.fromkeys(s for _, _, s in sorted(hits)))[:5]

    return pd.Series([find(p, v) for p, v in zip(pages, values)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def texts_under(pages: pd.Series, selectors: pd.Series) -> pd.Series:
    """For each of the selectors the first text of a page under it; the page is parsed once."""

    def read(page: str | None, wanted: list[str]) -> list[str | None]:
        texts = texts_of(page)
        return [next(iter(texts.get(s, [])), None) if s else None for s in wanted]

    return pd.Series([read(p, list(s)) for p, s in zip(pages, selectors)])


def learned(samples: DataFrame) -> DataFrame:
    """``site, campo, seletor, votos`` of samples (``site, seq, html, campo, valor``): the selector most samples agree on, the first seen at a tie."""
    votes = samples.select("site", "seq", "campo", F.posexplode(selectors_for("html", "valor")).alias("lugar", "seletor"))
    n = votes.groupBy("site", "campo", "seletor").agg(F.count("*").alias("votos"), F.min(F.struct("lugar", "seq")).alias("_p"))
    best = n.groupBy("site", "campo").agg(F.max_by(F.struct("seletor", "votos"), F.struct("votos", (-F.col("_p.lugar")).alias("l"), (-F.col("_p.seq")).alias("s"))).alias("b"))
    return best.select("site", "campo", "b.*").filter(F.col("votos") >= CONFIRMED)


def applied(pages: DataFrame, template: DataFrame) -> DataFrame:
    """``site, url, campo, valor``: what the template of its site reads on each page (``site, url, html``). A page is joined and parsed once, for all fields together."""
    fields = template.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("campo", "seletor"))).alias("_t"))
    read = pages.join(sized(fields, MOST_SITES), "site").select("site", "url", "_t", texts_under("html", F.transform("_t", lambda x: x["seletor"])).alias("_v"))
    return read.select("site", "url", F.explode(F.zip_with("_t", "_v", lambda t, v: F.struct(t["campo"].alias("campo"), v.alias("valor")))).alias("c")).select("site", "url", "c.*")


def repaired(read: DataFrame, template: DataFrame, resets: int = 3) -> DataFrame:
    """The template without selectors whose texts are no value of their field on most pages that hold one, ``resets`` a site at the most, the worst first.

    Expects ``site, url, campo, valor`` as ``applied`` gives them.
    """
    fields = ("preco", "area_m2", "quartos", "banheiros", "vagas", "tipo", "transacao", "descricao", "titulo", "bairro", "cidade", "estado")
    value = F.coalesce(*(F.when(F.col("campo") == f, field_value(f, F.col("valor"))) for f in fields))
    n = read.withColumn("_v", value).groupBy("site", "campo").agg(F.count("valor").alias("_n"), F.count("_v").alias("_ok"))
    bad = n.filter((F.col("_n") > 0) & (F.col("_ok") * 2 < F.col("_n")))
    worst = bad.withColumn("_r", F.row_number().over(Window.partitionBy("site").orderBy(F.col("_ok") / F.col("_n"), F.desc("_n"), "campo"))).filter(F.col("_r") <= resets)
    return template.join(worst.select("site", "campo"), ["site", "campo"], "left_anti")


def still_good(read: DataFrame) -> DataFrame:
    """Sites whose template still works: a page with fewer than two values is a miss; too many misses after enough uses disable it."""
    page = read.groupBy("site", "url").agg(F.count("valor").alias("n"))
    use = page.groupBy("site").agg(F.count("*").alias("usos"), F.count_if(F.col("n") < 2).alias("falhas"))
    return use.withColumn("ativo", ~((F.col("usos") > USES) & (F.col("falhas") > F.col("usos") * MISSES)))
