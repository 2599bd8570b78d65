"""Several readings of one listing fused by priority, with provenance, confidence, validation and suspicion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moradia.functions.text import first_of, kind, place
from moradia.functions.urls import UFS, image_class

RESIDENTIAL = ("apartamento", "casa", "sobrado", "cobertura", "kitnet", "duplex", "triplex", "flat", "loft")
#: Confidence by source; a kind read from the address, numbers and other fields that a model or template gave, and images have their own.
TRUST = {"url_slug": 0.92, "json_ld": 0.88, "regex": 0.68, "llm_or_template": 0.58, "legacy_pipeline": 0.50}
KIND_BY_URL, NUMBER_BY_MODEL, IMAGES = 0.90, 0.55, 0.60
NUMBERS, PLACES = ("preco", "area_m2", "quartos", "banheiros", "vagas"), ("bairro", "cidade")
#: Fields that a kind should have. Fixed values.
_HOME, _SMALLER, _GROUND = ("preco", "bairro", "cidade", "quartos", "banheiros", "area_m2"), ("preco", "bairro", "cidade", "quartos", "banheiros"), ("preco", "bairro", "cidade", "area_m2")
EXPECTED = {
    "apartamento": _HOME, "casa": _HOME, "sobrado": _SMALLER, "studio": _SMALLER, "flat": _SMALLER, "cobertura": _SMALLER, "kitnet": ("preco", "bairro", "cidade", "banheiros"),
    "terreno": _GROUND, "lote": _GROUND, "sala comercial": _GROUND, "sala": _GROUND, "galpão": _GROUND, "prédio": _GROUND,
}


def fused(readings: DataFrame, fields: tuple[str, ...], methods: tuple[str, ...]) -> DataFrame:
    """Columns ``<method>_<field>`` to ``<field>`` and ``<field>_de``: the first non-null reading in the order of methods, and which one it was."""
    out = {}
    for f in fields:
        out[f] = F.coalesce(*(f"{m}_{f}" for m in methods))
        out[f"{f}_de"] = F.coalesce(*(F.when(F.col(f"{m}_{f}").isNotNull(), m) for m in methods))
    return readings.withColumns(out)


def filled_from(base: Column, extra: Column, falsy: bool = False) -> Column:
    """``base`` completed by ``extra``: nulls only, or empty and zero values too."""
    return first_of(base, extra) if falsy else F.coalesce(base, extra)


def provenance(field: str, value: Column, url: Column, json_ld: Column, regex: Column) -> Column:
    """``struct(de, confianca)`` of a field's value by the first source that has the same value; null without a value. The address is asked for places, without regard to case, and for the kind."""
    same = lambda c: F.coalesce(value == c, F.lit(False))
    by_url = F.lit(False)
    if field in PLACES:
        by_url = F.coalesce(F.lower(value) == F.lower(url), F.lit(False))
    elif field == "tipo":
        by_url = same(url)
    rest = "llm_or_template" if field in (*NUMBERS, *PLACES) else "legacy_pipeline"
    told = F.when(by_url, "url_slug").when(same(json_ld), "json_ld").when(same(regex), "regex").otherwise(rest)
    own = {**TRUST, "url_slug": KIND_BY_URL if field == "tipo" else TRUST["url_slug"], "llm_or_template": NUMBER_BY_MODEL if field in NUMBERS else TRUST["llm_or_template"]}
    trust = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
    return F.when(value.isNotNull(), F.struct(told.alias("de"), trust[told].alias("confianca")))


def image_provenance(images: Column) -> Column:
    """``struct(de, confianca)`` of images, null where there are none."""
    return F.when(F.size(images) > 0, F.struct(F.lit("dom_images").alias("de"), F.lit(IMAGES).alias("confianca")))


def missing(*fields: str) -> Column:
    return F.array_compact(F.array(*(F.when(F.col(f).isNull(), f) for f in fields)))


def missing_expected() -> Column:
    """Missing fields among those that the kind should have; kinds without an entry expect nothing."""
    out = F.array().cast("array<string>")
    for k, fields in EXPECTED.items():
        out = F.when(F.col("tipo") == k, missing(*fields)).otherwise(out)
    return out


def suspects() -> Column:
    """Fields whose values are almost surely misread and should be read again."""
    home = F.lower(F.coalesce("tipo", F.lit(""))).isin(*RESIDENTIAL)
    junk = F.col("bairro").contains(" | ") | F.lower("bairro").isin("imovel", "imóvel", "anúncio", "anuncio", "detalhe")
    rules = {"area_m2": home & (F.col("area_m2") > 1000), "banheiros": F.col("banheiros") > 8, "vagas": F.col("vagas") > 10, "quartos": home & (F.col("quartos") > 10), "preco": F.col("preco") > 50_000_000, "bairro": junk}
    return F.array_compact(F.array(*(F.when(c, f) for f, c in rules.items())))


APPROVED, WARN, REJECTED = 0, 1, 2
STATES = ("approved", "warn", "rejected")


def _rule(reason: str, confidence: float, grade: int) -> Column:
    return F.struct(F.lit(reason).alias("motivo"), F.lit(confidence).alias("confianca"), F.lit(grade).alias("grau"))


def validated(listings: DataFrame) -> DataFrame:
    """``estado_validacao`` (approved, warn, rejected: the worst rule), ``motivos`` (field to reasons) and ``confiancas`` (of every field that was looked at).

    A column ``fontes`` (field to source), where there is one, tells whether area and parking were read from the same place.
    What costs most, the kind and the place that a text names, is evaluated once, in a projection below the rules.
    """
    price, area, state = F.col("preco"), F.col("area_m2"), F.upper(F.col("estado"))
    named = {"_tipo": kind(F.lit(""), F.col("tipo")), "_bairro": place(F.col("bairro")), "_cidade": place(F.col("cidade")), "_raw": kind(F.lit(""), F.col("bairro")), "_i": image_summary(F.col("imagens"))}
    below = listings.withColumns(named)
    same = F.coalesce(F.col("fontes")["area_m2"].eqNullSafe(F.col("fontes")["vagas"]), F.lit(True)) if "fontes" in listings.columns else F.lit(True)
    missing_, fine = _rule("missing", 0.0, WARN), _rule("", 0.7, APPROVED)
    rules = {
        "tipo": F.when(F.col("tipo").isNull(), missing_).when(F.col("_tipo").isNull(), _rule("unknown_property_type", 0.35, WARN)).otherwise(fine),
        "preco": F.when(price.isNull(), missing_).when(price <= 1000, _rule("price_too_low", 0.2, REJECTED)).when(price > 500_000_000, _rule("price_too_high", 0.2, REJECTED)).otherwise(fine),
        "bairro": F.when(F.col("bairro").isNull(), missing_).when(F.col("_bairro").isNull(), _rule("invalid_location", 0.2, REJECTED)).when(F.col("_raw").isNotNull(), _rule("matches_property_type", 0.15, REJECTED)).otherwise(fine),
        "cidade": F.when(F.col("cidade").isNull(), missing_).when(F.col("_cidade").isNull(), _rule("invalid_city", 0.2, REJECTED)).otherwise(fine),
        "area_m2": F.when(area.isNull(), missing_).when(area <= 0, _rule("non_positive_area", 0.2, REJECTED)).when((F.col("vagas") != 0) & (F.col("vagas") == area) & same, _rule("matches_vagas_same_source", 0.25, WARN))
        .when(area < 10, _rule("area_suspiciously_low", 0.35, WARN)).otherwise(fine),
        "estado": F.when(F.col("estado") != "", F.when(state.isin(*UFS), _rule("", 0.8, APPROVED)).otherwise(_rule("invalid_state", 0.2, WARN))),
    }
    grade = F.when(F.col("_i.status") == "rejected", REJECTED).when(F.col("_i.status") == "warn", WARN).otherwise(APPROVED)
    seen = [F.when(F.col(f"_r_{f}").isNotNull(), F.struct(F.lit(f).alias("campo"), F.col(f"_r_{f}").alias("r"))) for f in rules]
    out = below.withColumns({f"_r_{f}": c for f, c in rules.items()}).withColumn("_h", F.array_compact(F.array(*seen)))
    worst = F.greatest(F.array_max(F.transform("_h", lambda x: x["r"]["grau"])), grade)
    bad = F.transform(F.filter("_h", lambda x: x["r"]["motivo"] != ""), lambda x: F.struct(x["campo"].alias("campo"), F.array(x["r"]["motivo"]).alias("motivos")))
    bad = F.concat(bad, F.filter(F.array(F.struct(F.lit("imagens").alias("campo"), F.col("_i.motivos").alias("motivos"))), lambda x: F.size(x["motivos"]) > 0))
    sure = F.transform("_h", lambda x: F.struct(x["campo"].alias("campo"), x["r"]["confianca"].alias("c")))
    sure = F.concat(sure, F.array(F.struct(F.lit("imagens").alias("campo"), F.when(F.col("_i.status") == "approved", 0.8).when(F.col("_i.status") == "warn", 0.45).otherwise(0.1).alias("c"))))
    told = {"estado_validacao": F.get(F.array(*map(F.lit, STATES)), worst), "motivos": F.map_from_entries(bad), "confiancas": F.map_from_entries(sure)}
    return out.withColumns(told).select(*listings.columns, *told)


def image_summary(images: Column) -> Column:
    """``struct(status, fotos, ruido, motivos)``: approved with a photo and at least as many photos as logos and maps, rejected without images; and why not."""
    classes = F.transform(F.coalesce(images, F.array().cast("array<string>")), image_class)
    n = lambda *k: F.size(F.filter(classes, lambda c: c.isin(*k)))
    photos, logos, maps = n("likely_property_photo"), n("logo_or_banner"), n("mapa_ou_planta")
    status = F.when((photos > 0) & (photos >= logos + maps), "approved").when(F.size(classes) > 0, "warn").otherwise("rejected")
    why = F.array_compact(F.array(F.when(F.size(classes) == 0, "no_images"), F.when(logos > 0, "contains_logo_or_banner"), F.when(maps > 0, "contains_map_or_floorplan"), F.when((photos == 0) & (F.size(classes) > 0), "no_likely_property_photo")))
    return F.struct(status.alias("status"), photos.alias("fotos"), (logos + maps).alias("ruido"), why.alias("motivos"))


def generated_title(title: Column, kind_: Column, hood: Column, city: Column) -> Column:
    """The title, or ``Kind em Hood, City`` of what is known; null without a title where the kind, or the place, is not known."""
    filled = lambda c: F.nullif(c, F.lit(""))
    where = F.nullif(F.concat_ws(", ", filled(hood), filled(city)), F.lit(""))
    return F.coalesce(filled(F.trim(title)), F.when(filled(kind_).isNotNull() & where.isNotNull(), F.concat(F.initcap(kind_), F.lit(" em "), where)))


def least_confidence(a: Column, b: Column) -> Column:
    """Maps of confidences, field by field the smaller one; a field of one side only keeps its value."""
    return F.map_zip_with(a, b, lambda _, x, y: F.least(x, y))


def clamped(listing: DataFrame) -> DataFrame:
    """Numbers that a model read, kept within bounds: prices above 1000, areas from 10 to 100 000, counts from 1 to 20."""
    keep = {"preco": F.col("preco") > 1000, "area_m2": F.col("area_m2").between(10, 100_000)} | {c: F.col(c).between(1, 20) for c in ("quartos", "banheiros", "vagas")}
    return listing.withColumns({c: F.when(ok, F.col(c)) for c, ok in keep.items()})


def better(a: DataFrame, b: DataFrame, key: str, fields: tuple[str, ...] = ("preco", "quartos", "area_m2", "bairro"), grown: float = 1.2) -> DataFrame:
    """For each key the reading of the plain page ``a`` or of the rendered page ``b``, and ``segunda``, whether it is the second.

    Both hold ``tamanho`` (characters of the page), ``a`` also ``tem_jsonld``. The second is taken if the first has fewer than two of the
    fields and no structured data, the second page is more than ``grown`` times as long, and it gave more of the fields.
    """
    full = lambda c: c.isNotNull() & ~c.cast("string").rlike(r"^(?:0+(?:\.0+)?)?$")
    n = lambda side: sum((F.when(full(F.col(f"{side}.{f}")), 1).otherwise(0) for f in fields), F.lit(0))
    second = F.col("a.tamanho").isNull() | ((n("a") < 2) & ~F.coalesce("a.tem_jsonld", F.lit(False)) & (F.col("b.tamanho") > F.col("a.tamanho") * grown) & (n("b") > n("a")))
    second = F.coalesce(second, F.lit(False))
    return a.alias("a").join(b.alias("b"), key, "full_outer").select(key, second.alias("segunda"), *(F.when(second, F.col(f"b.{f}")).otherwise(F.col(f"a.{f}")).alias(f) for f in fields))


#: Titles of error pages.
ERROR_TITLES, NO_TITLES = "nao_encontrado|não encontrad|not found|404", ("n/a", "")


def accepted(listings: DataFrame) -> DataFrame:
    """Scraped records that count: a title that is none of an error page, nothing rented, and one useful field at least."""
    title = F.lower(F.coalesce("titulo", F.lit("")))
    invalid = title.rlike(ERROR_TITLES) | title.isin(*NO_TITLES)
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).rlike("[^0.]")
    useful = full("preco") | full("quartos") | full("bairro") | (F.size(F.coalesce("imagens", F.array().cast("array<string>"))) > 0) | full("tipo")
    return listings.filter(~invalid & ~F.coalesce(F.lower("transacao").contains("alug"), F.lit(False)) & useful)


#: Fields that enrichment fills where they are empty.
ENRICHED = ("preco", "titulo", "tipo", "quartos", "banheiros", "vagas", "area_m2", "cidade", "bairro", "estado", "descricao")


def falsy(c: Column) -> Column:
    """Null, empty or zero."""
    return c.isNull() | c.cast("string").rlike(r"^(?:0+(?:\.0+)?)?$")


def to_enrich(listings: DataFrame) -> DataFrame:
    """Listings that lack price, rooms or neighbourhood."""
    return listings.filter(falsy(F.col("preco")) | falsy(F.col("quartos")) | falsy(F.col("bairro")))


def enriched(listings: DataFrame, details: DataFrame, key: str = "url_anuncio") -> DataFrame:
    """Listings that lack price, rooms or neighbourhood with empty fields filled from ``details`` (one row a key), images taken if there are more; the rest as it is."""
    gate = falsy(F.col("l.preco")) | falsy(F.col("l.quartos")) | falsy(F.col("l.bairro"))
    side = details.select(key, *ENRICHED, "imagens")
    both = listings.alias("l").join(side.alias("d"), key, "left")
    pick = {f: F.when(gate & falsy(F.col(f"l.{f}")) & ~falsy(F.col(f"d.{f}")), F.col(f"d.{f}")).otherwise(F.col(f"l.{f}")) for f in ENRICHED}
    n = lambda s: F.coalesce(F.size(f"{s}.imagens"), F.lit(0))
    pick["imagens"] = F.when(gate & (n("d") > n("l")), F.col("d.imagens")).otherwise(F.col("l.imagens"))
    return both.select(*(pick[c].alias(c) if c in pick else (F.col(c) if c == key else F.col(f"l.{c}")) for c in listings.columns))


def from_list_page(listings: DataFrame, cards: DataFrame, key: str = "url_anuncio", fields: tuple[str, ...] = ("titulo", "tipo", "bairro", "cidade", "estado", "preco", "area_m2", "quartos", "banheiros", "vagas")) -> DataFrame:
    """Listings of a sitemap with what their cards on the list page say: a field of the card that is not empty wins."""
    both = listings.alias("l").join(cards.select(key, *fields).alias("c"), key, "left")
    pick = {f: F.when(~falsy(F.col(f"c.{f}")), F.col(f"c.{f}")).otherwise(F.col(f"l.{f}")).alias(f) for f in fields}
    return both.select(*(pick[c] if c in pick else (F.col(c) if c == key else F.col(f"l.{c}")) for c in listings.columns))
