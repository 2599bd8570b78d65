"""The listing of a detail page from everything that can be read from it, in order of trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moradia.functions import html, text, urls
from moradia.operators.fusion import falsy

FIELDS = ("titulo", "tipo", "transacao", "cidade", "bairro", "estado", "preco", "area_m2", "quartos", "banheiros", "vagas", "descricao")
#: Fields without which a model is asked, and words that a page's own title holds if it is about an item.
CORE = ("preco", "tipo", "cidade", "bairro", "transacao")
ABOUT_ITEM = r"apartamento|casa|sobrado|terreno|sala|loja|galp.o|cobertura|flat|kitnet|chácara|sítio|r\$|m²|quarto|dormit"


#: How a description tells baths and places to park.
BATHS = r"([0-9]+)\s*(?:banheiros?\s*sociais?|banheiros?|bwc|wc)"
CARS = (r"garagem\s+p/\s*([0-9]+)\s*carros?", r"garagem.*?([0-9]+)\s*carros?", r"([0-9]+)\s*vagas?")
GARAGE = "garagem|estacionamento"


def quick(url: Column, page: Column) -> Column:
    """What general patterns read from a parsed page: title, price, area, deal, kind and counts; null without a title and a price."""
    low = F.lower(page["texto"])
    og, h1 = F.nullif(F.trim(page["og_titulo"]), F.lit("")), page["h1"]
    title = F.coalesce(F.when(F.lower(og).rlike(ABOUT_ITEM), og), F.when(F.length(h1) > 20, h1))
    price = text.price(low)
    fields = {
        "titulo": title, "tipo": text.kind(F.coalesce(title, F.lit("")), low), "transacao": text.transaction(url, F.coalesce(title, F.lit("")), low), "preco": price, "area_m2": text.area(low),
        "quartos": text.bedrooms(low), "banheiros": text.bathrooms(low), "vagas": text.parking(low),
    }
    return F.when(title.isNotNull() | price.isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))


def overridden(url: Column, reading: Column) -> Column:
    """A template's reading corrected: place and kind of the address win, baths (1 to 15) and parking (1 to 10) that the description gives win, a garage without a number is one place."""
    at, d = urls.location(url), F.lower(F.coalesce(reading["descricao"], F.lit("")))
    kind = text.kind(F.lit(""), F.translate(url, "-/", "  "))
    baths = F.regexp_extract(d, BATHS, 1).try_cast("int")
    cars = F.coalesce(*(F.regexp_extract(d, p, 1).try_cast("int") for p in CARS))
    garage = F.when(cars.isNull() & reading["vagas"].isNull() & d.rlike(GARAGE), 1)
    changes = {
        "bairro": F.coalesce(at["bairro"], reading["bairro"]), "cidade": F.coalesce(at["cidade"], reading["cidade"]), "tipo": F.coalesce(kind, reading["tipo"]), "quartos": F.coalesce(reading["quartos"], text.bedrooms(d)),
        "banheiros": F.coalesce(F.when(baths.between(1, 15), baths), reading["banheiros"]), "vagas": F.coalesce(F.when(cars.between(1, 10), cars), garage, reading["vagas"]),
    }
    out = reading
    for f, c in changes.items():
        out = out.withField(f, c)
    return out


def detail_cascade(pages: DataFrame, model: str | None = None, template: str | None = None, city: str | None = None, state: str | None = None, strict: bool = False) -> DataFrame:
    """``url``, FIELDS, ``imagens`` and ``metodo`` of each page of ``pages`` (``url, html``).

    A template's reading (column ``template``, a struct of FIELDS) with two fields or more is taken as it is, corrected by ``overridden``. Else structured data,
    then general patterns, then, where a core field lacks, a model's reading (column ``model``) fill each other's gaps; then the columns ``city`` and ``state``
    of the source, the place in the address, and a title made of kind and place. With ``strict`` structured data alone are taken where they have a title and a
    price, else the model alone, but nothing rented. Pages that are gone or lists of items, and pages that give nothing, have no row. Each page is parsed once.
    """
    kept = [c for c in (model, template, city, state) if c]
    page = pages.select("url", *kept, F.substring("html", 1, 2000).alias("_a"), F.col("html").isNotNull().alias("_ok"), html.parsed("html").alias("_p"))
    title = F.lower(F.coalesce(F.nullif(F.col("_p.og_titulo"), F.lit("")), F.col("_p.h1"), F.lit("")))
    page = page.filter(F.col("_ok") & ~html.soft_404(F.col("_a")) & ~html.is_list_page(title))
    read = page.withColumn("_j", html.jsonld_item("_p.jsonld")).withColumn("_r", quick(F.col("url"), F.col("_p")))
    place = lambda f: text.place(F.col(f"_j.{f}"))
    own = F.col("_j.titulo").isNotNull() | F.col("_j.preco").isNotNull()
    none = F.lit(None)
    j = {f: place(f) if f in ("cidade", "bairro") else none if f in ("tipo", "transacao") else F.col(f"_j.{f}") for f in FIELDS}
    r = {f: F.col(f"_r.{f}") if f not in ("cidade", "bairro", "estado", "descricao") else none for f in FIELDS}
    m = {f: F.col(f"{model}.{f}") if model else none for f in FIELDS}
    if strict:
        enough = F.col("_j.titulo").isNotNull() & F.col("_j.preco").isNotNull()
        sold = ~F.coalesce(F.lower(m["transacao"].cast("string")).contains("alug"), F.lit(False)) if model else F.lit(True)
        values = {f: F.when(enough, j[f]).otherwise(m[f]) for f in FIELDS}
        asked = F.col(model).isNotNull() if model else F.lit(False)
        read = read.filter(enough | (asked & sold)).withColumns({f"_{f}": v for f, v in values.items()}).withColumn("metodo", F.when(enough, "json_ld").otherwise("model"))
    else:
        read = read.withColumns({f"_{f}": F.coalesce(j[f], r[f]) for f in FIELDS})
        lacking = [F.col(f"_{f}").isNull() for f in CORE]
        ask = lacking[0]
        for x in lacking[1:]:
            ask = ask | x
        ask = ask & (F.col(model).isNotNull() if model else F.lit(False))
        told = F.concat_ws("+", F.when(own, "json_ld"), F.when(F.col("_r").isNotNull(), "regex"), F.when(ask, "model"))
        read = read.withColumn("metodo", told).withColumns({f"_{f}": F.coalesce(F.col(f"_{f}"), F.when(ask, m[f])) for f in FIELDS}).filter("metodo <> ''")
    at = urls.location(F.col("url"))
    empty = lambda f: F.when(~falsy(F.col(f)), F.col(f))
    read = read.withColumns({"_cidade": F.coalesce(empty("_cidade"), F.col(city) if city else none, at["cidade"]), "_bairro": F.coalesce(empty("_bairro"), at["bairro"]), "_estado": F.coalesce(empty("_estado"), F.col(state) if state else none)})
    where = F.nullif(F.concat_ws(", ", "_bairro", "_cidade"), F.lit(""))
    made = F.when(F.col("_tipo").isNotNull() & where.isNotNull(), F.concat(F.initcap("_tipo"), F.lit(" em "), where))
    read = read.withColumn("_titulo", F.coalesce(empty("_titulo"), made))
    rows = F.struct(*(F.col(f"_{f}").alias(f) for f in FIELDS))
    if template:
        t = overridden(F.col("url"), F.col(template))
        filled = sum((F.when(F.col(f"{template}.{f}").isNotNull(), 1).otherwise(0) for f in FIELDS), F.lit(0))
        hit = F.coalesce(filled >= 2, F.lit(False))
        whole = F.struct(*(t[f].cast(dict(read.select(F.col(f"_{f}")).dtypes)[f"_{f}"]).alias(f) for f in FIELDS))
        return read.select("url", F.when(hit, whole).otherwise(rows).alias("_o"), F.col("_p.imagens").alias("imagens"), F.when(hit, "template").otherwise(F.col("metodo")).alias("metodo")).select("url", "_o.*", "imagens", "metodo")
    return read.select("url", rows.alias("_o"), F.col("_p.imagens").alias("imagens"), "metodo").select("url", "_o.*", "imagens", "metodo")
