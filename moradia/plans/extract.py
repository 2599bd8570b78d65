"""Queries of extraction, fusion, comparison, discovery and state, with their SQL.

Extraction is checked by round trips: text or HTML is rendered from the columns of a table inside the query, read
again by the operator, and the SQL takes the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from moradia.functions import html, text, urls
from moradia.operators import compare, discovery, fusion, state
from moradia.plans.tables import FIRST
from moradia.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _rows(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "imoveis")


KIND_CASES = " ".join(f"when regexp_matches(t, '{k_sql}') then '{k}'" for k, k_sql in ((k, text.sql_word(p)) for k, p in text.KINDS))


def kind_sql(expression: str) -> str:
    """The kind that a text names, in SQL."""
    return f"(select case {KIND_CASES} end from (select lower({expression}) as t))"


UFS_SQL = ", ".join(f"'{u}'" for u in urls.UFS)
LABELS_SQL = ", ".join(f"'{w}'" for w in text.LABELS)


def place_sql(expression: str) -> str:
    """A place name in SQL, null where it is none: the rules of ``text.place`` in another order and dialect."""
    rescued = "coalesce(nullif(trim(regexp_extract(v, '(?i)(?:^|[^[:alnum:]_])no\\s+bairro\\s+([^,(-]+?)\\s+em\\s', 1)), ''), v)"
    noise = "r\\$[\\s0-9.,]|" + text.sql_word("<(?:à venda|para alugar|para locação|para comprar|imóv[eé]|imobili[áa]ria|no bairro)>") + "|" + text.sql_word(r"<cod\.?\s*[0-9]+")
    return (
        f"(select case when p is null or p = '' or o like '% | %' or contains(o, chr(10)) or contains(o, chr(13)) or length(p) > 80 or regexp_matches(lower(p), '{noise}') or lower(p) in ({LABELS_SQL}) "
        f"or (case {KIND_CASES.replace('(t,', '(lower(p),')} end) is not null then null else p end from (select o, {rescued} as p from (select {expression} as o, trim({expression}) as v)))"
    )


# addresses
HOST = "nullif(lower(regexp_extract(trim(url_anuncio), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]+)', 1)), '')"
query("url_host", f"select {HOST} as host, count(*) as n from imoveis group by 1")(lambda s, d: _rows(s, d).groupBy(urls.host(F.col("url_anuncio")).alias("host")).agg(F.count("*").alias("n")))
query(
    "url_detail",
    f"select id, coalesce({HOST} = 'umbral-prime-imoveis.imb.example', false) and (regexp_matches(url_anuncio, '/imovel/[0-9]+') or regexp_matches(lower(url_anuncio), '^[^?#]*/imovel/[a-z0-9][a-z0-9_-]{{5,}}') or regexp_matches(lower(url_anuncio), '/imovel[?](code|id|ref|cod)=[a-z0-9_]+') or regexp_matches(url_anuncio, '//[^?#]*/[0-9]+/?([?# ]|$)')) as detalhe from imoveis where {HOST} <> 'umbral-prime-imoveis.imb.example' or regexp_matches(url_anuncio, 'imovel')",
)(lambda s, d: _rows(s, d).filter((urls.host(F.col("url_anuncio")) != "umbral-prime-imoveis.imb.example") | F.col("url_anuncio").contains("imovel")).select("id", urls.is_detail(F.col("url_anuncio"), F.lit("umbral-prime-imoveis.imb.example")).alias("detalhe")))


def _base_host():  # noqa: ANN202
    """The host of a row's own source; ``www.`` on one side only makes no other host."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    own, base = urls.host(F.col("url_anuncio")), urls.host(F.col("fonte_url"))
    return F.when(bare(own) == bare(base), own).otherwise(base)


@query("url_detail_own_source")
def url_detail_own_source(s, d):  # noqa: ANN001, ANN201
    sources = table(s, d, "fontes").groupBy(F.col("id").alias("fonte_id")).agg(F.min("url").alias("fonte_url"))
    return _rows(s, d).select("id", "url_anuncio", "fonte_id").join(sources, "fonte_id", "left").select("id", urls.is_detail(F.col("url_anuncio"), _base_host()).alias("detalhe"))


def location_sql(part: str) -> str:
    """Neighbourhood or city of a path in SQL, in lower case: what is left of the segments without sections, numbers and names of kinds."""
    sections = ", ".join(f"'{w}'" for w in urls.SECTIONS)
    named = " or ".join(f"regexp_matches(lower(replace(x, '-', ' ')), '{text.sql_word(p)}')" for _, p in text.KINDS)
    keep = f"list_filter(string_split(regexp_extract(trim(url_anuncio), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]+([^?#]*)', 1), '/'), lambda x: trim(x) <> '' and x <> '-' and not regexp_matches(x, '^[0-9]+$') and lower(x) not in ({sections}) and not ({named}))"
    state = f"upper(q[len(q)]) in ({UFS_SQL})"
    pick = f"case when {state} then q[len(q) - {2 if part == 'bairro' else 1}] else q[{2 if part == 'bairro' else 1}] end"
    return f"(select lower(trim(regexp_replace({pick}, '-+', ' ', 'g'))) from (select {keep} as q))"


query("url_location", f"select id, {location_sql('bairro')} as bairro, {location_sql('cidade')} as cidade from imoveis")(lambda s, d: _rows(s, d).select("id", urls.location(F.col("url_anuncio")).alias("l")).select("id", F.lower("l.bairro").alias("bairro"), F.lower("l.cidade").alias("cidade")))
query("url_location_roundtrip", "select c_custkey as id, n_name as bairro, r_name as cidade from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")(
    lambda s, d: (
        table(s, d, "customer")
        .join(F.broadcast(table(s, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(F.broadcast(table(s, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
        .select("c_custkey", "n_name", "r_name", F.concat(F.lit("https://a.example/imovel/casa/"), urls.slug(F.col("n_name")), F.lit("/"), urls.slug(F.col("r_name")), F.lit("/RS/"), F.col("c_custkey").cast("string")).alias("u"))
        .select(F.col("c_custkey").alias("id"), F.upper(F.regexp_replace(urls.location(F.col("u"))["bairro"], " ", "_")).alias("b"), F.upper(urls.location(F.col("u"))["cidade"]).alias("c"), "n_name", "r_name")
        .select("id", F.when(F.regexp_replace("b", "[^A-Z0-9]", "") == F.regexp_replace(F.upper("n_name"), "[^A-Z0-9]", ""), F.col("n_name")).alias("bairro"), F.when(F.regexp_replace("c", "[^A-Z0-9]", "") == F.regexp_replace(F.upper("r_name"), "[^A-Z0-9]", ""), F.col("r_name")).alias("cidade"))
    )
)
query("slugs", "select nome, regexp_replace(regexp_replace(lower(strip_accents(nome)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from (select distinct nome from bairros_ref)")(
    lambda s, d: table(s, d, "bairros_ref").select("nome").distinct().select("nome", urls.slug(F.col("nome")).alias("slug"))
)
query("url_kinds", "select tipo, count(*) as n from (select regexp_extract(lower(url_anuncio), '/(apartamento|casa|terreno|sobrado|cobertura|kitnet|sala|loja|galpao|chacara)/', 1) as tipo from imoveis) where tipo <> '' group by 1")(
    lambda s, d: _rows(s, d).groupBy(urls.kind_in(F.col("url_anuncio")).alias("tipo")).agg(F.count("*").alias("n")).filter("tipo is not null")
)
query(
    "image_classes",
    "select classe, count(*) as n from (select case when regexp_matches(p, 'logo|icon|avatar|favicon|brand|sprite|banner|hero') then 'logo_or_banner' when regexp_matches(p, 'mapa|map|planta|floorplan|croqui') then 'mapa_ou_planta' when regexp_matches(p, 'imovel|property|galeria|gallery|foto|photo|upload|media') then 'likely_property_photo' else 'unknown' end as classe from (select lower(regexp_extract(u, '//[^/?#]+([^?#]*)', 1)) as p from (select unnest(imagens) as u from imoveis))) group by 1",
)(lambda s, d: _rows(s, d).select(F.explode("imagens").alias("u")).groupBy(urls.image_class(F.col("u")).alias("classe")).agg(F.count("*").alias("n")))
query("page_enumeration", "select f.id, 'https://x.example/lista?pg=' || n as url from fontes f, unnest(range(1, 20, 3)) t(n)")(
    lambda s, d: table(s, d, "fontes").select("id", F.explode(urls.numbered(urls.template(F.lit("https://x.example/lista?pg=1"), F.lit("https://x.example/lista?pg=2")), F.lit(1), F.lit(3), F.lit(19))).alias("url"))
)

# text
def spec():  # noqa: ANN201
    return F.concat_ws(
        ". ", F.concat(F.lit("Apartamento à venda por "), text.brl(F.col("preco"))), F.concat(F.regexp_replace(F.col("area_m2").cast("string"), r"\.", ","), F.lit(" m² privativos")),
        F.concat(F.col("quartos").cast("string"), F.lit(" quartos")), F.concat(F.col("banheiros").cast("string"), F.lit(" banheiros")), F.concat(F.col("vagas").cast("string"), F.lit(" vagas")),
    )


COUNTS_SQL = ", ".join(f"case when {c} between 1 and 20 then {c} end as {c}" for c in ("quartos", "banheiros", "vagas"))
query(
    "text_roundtrip",
    f"select id, case when preco > 10000 and preco < 500000000 then preco::double end as preco, case when abs(area_m2) > 10 and abs(area_m2) <= 100000 then abs(area_m2)::double end as area_m2, {', '.join(f'case when abs({c}) between 1 and 20 then abs({c}) end as {c}' for c in ('quartos', 'banheiros', 'vagas'))} from imoveis",
)(
    lambda s, d: (
        _rows(s, d)
        .select("id", spec().alias("t"))
        .select("id", text.price(F.col("t")).alias("preco"), text.area(F.col("t")).alias("area_m2"), text.bedrooms(F.col("t")).alias("quartos"), text.bathrooms(F.col("t")).alias("banheiros"), text.parking(F.col("t")).alias("vagas"))
    )
)
query("kind_detected", f"""select id, {kind_sql("coalesce(titulo, '') || ' ' || coalesce(left(descricao, 500), '')")} as tipo from imoveis""")(lambda s, d: _rows(s, d).select("id", text.kind(F.col("titulo"), F.col("descricao")).alias("tipo")))
query("kind_roundtrip", "select id, tipo from imoveis")(
    lambda s, d: _rows(s, d).select("id", text.kind(F.concat_ws("", F.lit("Belo(a) "), F.when(F.col("tipo") == "sala", "sala comercial").otherwise(F.col("tipo")), F.lit(" em ótimo local")), F.lit("")).alias("tipo"))
)
query("transaction_roundtrip", "select id, transacao from imoveis")(
    lambda s, d: _rows(s, d).select("id", text.transaction(F.lit("https://x.example/i"), F.when(F.col("transacao") == "ambos", "casa à venda ou para alugar").when(F.col("transacao") == "venda", "casa à venda").when(F.col("transacao").isNotNull(), "casa para alugar").otherwise("casa"), F.lit("")).alias("transacao"))
)
query("city_plain", "select cidade_id, lower(strip_accents(nome)) as nome from cidades_ref")(lambda s, d: table(s, d, "cidades_ref").select("cidade_id", text.plain(F.col("nome")).alias("nome")))
query("address_roundtrip", "select b.bairro_id, b.nome as bairro, c.nome as cidade, c.estado as uf from bairros_ref b join cidades_ref c using (cidade_id)")(
    lambda s, d: (
        table(s, d, "bairros_ref").select("bairro_id", "cidade_id", F.col("nome").alias("b"))
        .join(table(s, d, "cidades_ref").select("cidade_id", F.col("nome").alias("c"), "estado"), "cidade_id")
        .select("bairro_id", text.address(F.concat(F.lit("Rua das Acácias, "), F.col("b"), F.lit(", "), F.col("c"), F.lit("/"), F.col("estado"))).alias("a")).select("bairro_id", "a.*")
    )
)
query("places_sanitised", f"select id, {place_sql('bairro')} as bairro from imoveis")(lambda s, d: _rows(s, d).select("id", text.place(F.col("bairro")).alias("bairro")))
NAMES_SQL = ", ".join(f"'{w}'" for w in text.COMMON_NAMES)
query("registry_names", f"select registro_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents(nome)), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda w: length(w) >= 3 and w not in ({NAMES_SQL})), ' ') as palavras from creci_registros where nome is not null union all select registro_id, '' from creci_registros where nome is null")(lambda s, d: table(s, d, "creci_registros").select("registro_id", F.concat_ws(" ", text.name_tokens(F.col("nome"))).alias("palavras")))
def candidates_sql(pattern: str, ok: str) -> str:
    number = "try_cast(replace(replace(x, '.', ''), ',', '.') as double)"
    return f"array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: {number}), lambda v: {ok}), lambda v: round(v, 2)::decimal(18, 2)::varchar))), ' ')"


CANDIDATES = {
    "area_m2": (r"([0-9][0-9.,]*)\s*m[²2](?:[^[:alnum:]_áàâãéêíóôõúç]|$)", "v > 10 and v < 100000"), "preco": (r"r\$\s*([0-9.,]+)", "v > 10000 and v < 500000000"),
    "quartos": ("([0-9]+)\\s*(?:quartos?|dormit[óo]rios?|dorms?)", "v > 0 and v <= 20"), "banheiros": ("([0-9]+)\\s*(?:banheiros?|bwc|wcs?|lavabos?)", "v > 0 and v <= 20"), "vagas": ("([0-9]+)\\s*(?:vagas?|garagens?)", "v > 0 and v <= 20"),
}
query("number_candidates", f"select id, {', '.join(f"coalesce({candidates_sql(p, ok)}, '') as {f}" for f, (p, ok) in CANDIDATES.items())} from (select id, lower(descricao) as t from imoveis)")(
    lambda s, d: (
        _rows(s, d).select("id", text.candidates(F.col("descricao")).alias("c")).select("id", *(F.coalesce(F.array_join(F.array_sort(F.transform(F.try_element_at("c", F.lit(f)), lambda v: v.cast("decimal(18,2)").cast("string"))), " "), F.lit("")).alias(f) for f in CANDIDATES))
    )
)
query("money_short", "select id, case when preco >= 1000000 then 'R$' || cast(round(preco / 1000000.0, 1) as decimal(20,1)) || 'M' when preco >= 1000 then 'R$' || cast(round(preco / 1000.0) as bigint) || 'k' when preco is not null then 'R$' || cast(round(preco) as bigint) end as preco from imoveis")(
    lambda s, d: _rows(s, d).select("id", text.brl_short(F.col("preco").cast("decimal(18,2)")).alias("preco"))
)

# pages rendered from listings
def page():  # noqa: ANN201
    return F.concat(
    F.lit("<html><head><title>Site</title><meta property='og:title' content=\""), F.regexp_replace(F.coalesce("tipo", F.lit("")), '"', ""), F.lit("\"><script type='application/ld+json'>"),
    F.to_json(F.struct(F.lit("Product").alias("@type"), F.concat(F.lit("Item "), F.col("id").cast("string")).alias("name"), F.struct(F.col("preco").cast("string").alias("price")).alias("offers"), F.struct(F.col("area_m2").cast("double").alias("value")).alias("floorSize"))),
    F.lit("</script></head><body><nav><a href='/menu'>x</a></nav><h1>"), F.concat(F.lit("Item "), F.col("id").cast("string")), F.lit("</h1><p>um<p>dois<img data-src='/fotos/"), F.col("id").cast("string"), F.lit("/0.jpg'><img src='/logo.png'><a href='/imovel/"),
    F.col("id").cast("string"), F.lit("'>ver</a></p></body>"),
)


def _parsed(s, d):  # noqa: ANN001, ANN202
    return _rows(s, d).select("id", html.parsed(page()).alias("p")).select("id", "p.*")


query("html_fields", "select id, 'Item ' || id as h1, nullif(coalesce(tipo, ''), '') as og_titulo, '/fotos/' || id || '/0.jpg' as imagem, '/imovel/' || id as link from imoveis")(
    lambda s, d: _parsed(s, d).select("id", "h1", "og_titulo", F.get("imagens", F.lit(0)).alias("imagem"), F.get(F.filter("links", lambda x: x != "/menu"), F.lit(0)).alias("link"))
)
query("jsonld_roundtrip", "select id, 'Item ' || id as titulo, case when preco > 0 then preco::double end as preco, case when area_m2 > 0 then area_m2::double end as area_m2 from imoveis")(
    lambda s, d: _parsed(s, d).select("id", html.jsonld_item(F.col("jsonld")).alias("j")).select("id", "j.titulo", "j.preco", "j.area_m2")
)
query("island_roundtrip", "select id, titulo, tipo, case when preco > 0 then preco::double end as preco from (select *, count(*) over (partition by id // 20) as n from imoveis where titulo is not null and titulo <> '' and tipo is not null and (preco is null or preco > 0)) where n > 1")(
    lambda s, d: (
        _rows(s, d).filter("titulo is not null and titulo <> '' and tipo is not null and (preco is null or preco > 0)")
        .groupBy(F.floor(F.col("id") / 20).alias("g"))
        .agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.col("id").alias("codigo"), F.col("titulo").alias("title"), F.col("tipo").alias("type"), F.col("preco").alias("valor"))).alias("items")).alias("props"))).alias("t"))
        .select("g", F.explode(html.island_items(F.concat(F.lit('{"x": [1, 2], "y": '), F.col("t"), F.lit("}")))).alias("i"))
        .select(F.col("i.id").cast("bigint").alias("id"), "i.titulo", "i.tipo", "i.preco")
    )
)
query("cards_roundtrip", "select id, case when preco > 10000 and preco < 500000000 then preco::double end as preco from imoveis where preco is not null")(
    lambda s, d: (
        _rows(s, d).filter("preco is not null")
        .groupBy(F.floor(F.col("id") / 20).alias("g"))
        .agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<div class='card imovel'><a href='/imovel/"), F.col("id").cast("string"), F.lit("'>x</a><p>Casa</p><span>"), text.brl(F.col("preco")), F.lit("</span></div>")))).alias("t"))
        .select(F.explode(html.cards("t")).alias("c"))
        .select(F.regexp_extract("c.url", r"(\d+)$", 1).cast("bigint").alias("id"), text.price(F.col("c.texto")).alias("preco"))
    )
)
query("soft_404", """select regexp_matches(lower(left(coalesce(descricao, ''), 2000)), '(^|[^0-9])404([^0-9]|$)|não encontrad|not found') as sumiu, count(*) as n from imoveis group by 1""")(lambda s, d: _rows(s, d).groupBy(html.soft_404(F.coalesce("descricao", F.lit(""))).alias("sumiu")).agg(F.count("*").alias("n")))

# fusion and validation
query("fuse_cascade", "select id, coalesce(cidade, bairro, tipo) as lugar, case when cidade is not null then 'a' when bairro is not null then 'b' when tipo is not null then 'c' end as lugar_de from imoveis")(
    lambda s, d: fusion.fused(_rows(s, d).select("id", F.col("cidade").alias("a_lugar"), F.col("bairro").alias("b_lugar"), F.col("tipo").alias("c_lugar")), ("lugar",), ("a", "b", "c")).select("id", "lugar", "lugar_de")
)
def _sources(s, d):  # noqa: ANN001, ANN202
    """Every listing with what each source would say: the address its kind, structured data the price, the text the rooms."""
    u = F.col("url_anuncio")
    url_kind = text.kind(F.lit(""), F.translate(u, "-/", "  "))
    t = F.col("tipo").cast("string")
    none = F.lit(None).cast("string")
    price = F.col("preco").cast("string")
    return _rows(s, d).select(
        "id", fusion.provenance("tipo", t, url_kind, none, none).alias("tipo"), fusion.provenance("preco", price, none, F.when(F.col("disponivel"), price), F.when(F.col("status") == "ativo", price)).alias("preco"),
        fusion.provenance("bairro", F.col("bairro"), F.upper("bairro"), none, none).alias("bairro"), fusion.provenance("titulo", F.col("titulo"), none, none, none).alias("titulo"),
        fusion.provenance("cidade", F.col("cidade"), none, none, none).alias("cidade"), fusion.image_provenance(F.col("imagens")).alias("imagens"),
    )


query(
    "provenance",
    f"""select id, case when tipo is null then null when tipo = {kind_sql("translate(url_anuncio, '-/', '  ')")} then 'url_slug 0.9' else 'legacy_pipeline 0.5' end as tipo,
  case when preco is null then null when disponivel then 'json_ld 0.88' when status = 'ativo' then 'regex 0.68' else 'llm_or_template 0.55' end as preco, case when bairro is not null then 'url_slug 0.92' end as bairro,
  case when titulo is not null then 'legacy_pipeline 0.5' end as titulo, case when cidade is not null then 'llm_or_template 0.58' end as cidade, case when len(imagens) > 0 then 'dom_images 0.6' end as imagens from imoveis""",
)(lambda s, d: _sources(s, d).select("id", *(F.when(F.col(c).isNotNull(), F.concat_ws(" ", F.col(c)["de"], F.col(c)["confianca"].cast("string"))).alias(c) for c in ("tipo", "preco", "bairro", "titulo", "cidade", "imagens"))))
query(
    "suspects",
    "select id, concat_ws(',', case when r and area_m2 > 1000 then 'area_m2' end, case when banheiros > 8 then 'banheiros' end, case when vagas > 10 then 'vagas' end, case when r and quartos > 10 then 'quartos' end, case when preco > 50000000 then 'preco' end, case when bairro like '% | %' or lower(bairro) in ('imovel', 'imóvel', 'anúncio', 'anuncio', 'detalhe') then 'bairro' end) as campos from (select *, lower(coalesce(tipo, '')) in ('apartamento', 'casa', 'sobrado', 'cobertura', 'kitnet') as r from imoveis)",
)(lambda s, d: _rows(s, d).select("id", F.concat_ws(",", fusion.suspects()).alias("campos")))
IMAGES_SQL = """select id, count(u) as n, count(*) filter (k = 'photo') as fotos, count(*) filter (k = 'logo') as logos, count(*) filter (k = 'map') as mapas from (
    select id, u, case when regexp_matches(p, 'logo|icon|avatar|favicon|brand|sprite|banner|hero') then 'logo' when regexp_matches(p, 'mapa|map|planta|floorplan|croqui') then 'map' when regexp_matches(p, 'imovel|property|galeria|gallery|foto|photo|upload|media') then 'photo' end as k
    from (select id, u, lower(regexp_extract(u, '//[^/?#]+([^?#]*)', 1)) as p from (select id, unnest(imagens) as u from imoveis))) group by id"""
VALIDATED = f"""with g as ({IMAGES_SQL}),
  l as (select i.*, {kind_sql("tipo")} as k, {kind_sql("bairro")} as kb, {place_sql("bairro")} as pb, {place_sql("cidade")} as pc, coalesce(n, 0) as n, coalesce(fotos, 0) as fotos, coalesce(logos, 0) as logos, coalesce(mapas, 0) as mapas from imoveis i left join g on g.id = i.id),
  r as (select id, concat_ws(',',
      case when tipo is null then 'tipo:missing:0.0:1' when k is null then 'tipo:unknown_property_type:0.35:1' end,
      case when preco is null then 'preco:missing:0.0:1' when preco <= 1000 then 'preco:price_too_low:0.2:2' when preco > 500000000 then 'preco:price_too_high:0.2:2' end,
      case when bairro is null then 'bairro:missing:0.0:1' when pb is null then 'bairro:invalid_location:0.2:2' when kb is not null then 'bairro:matches_property_type:0.15:2' end,
      case when cidade is null then 'cidade:missing:0.0:1' when pc is null then 'cidade:invalid_city:0.2:2' end,
      case when area_m2 is null then 'area_m2:missing:0.0:1' when area_m2 <= 0 then 'area_m2:non_positive_area:0.2:2' when vagas <> 0 and vagas = area_m2 then 'area_m2:matches_vagas_same_source:0.25:1' when area_m2 < 10 then 'area_m2:area_suspiciously_low:0.35:1' end,
      case when estado <> '' and upper(estado) not in ({UFS_SQL}) then 'estado:invalid_state:0.2:1' end) as regras,
      concat_ws(',', case when n = 0 then 'no_images' end, case when logos > 0 then 'contains_logo_or_banner' end, case when mapas > 0 then 'contains_map_or_floorplan' end, case when fotos = 0 and n > 0 then 'no_likely_property_photo' end) as imagens,
      case when fotos > 0 and fotos >= logos + mapas then 0 when n > 0 then 1 else 2 end as grau from l)
  select id, regras, imagens, case greatest(grau, case when contains(regras, ':2') then 2 when contains(regras, ':1') then 1 else 0 end) when 0 then 'approved' when 1 then 'warn' else 'rejected' end as estado_validacao,
      case grau when 0 then 0.8 when 1 then 0.45 else 0.1 end::double as confianca_imagens from r"""


@query("validated_items", VALIDATED)
def validated_items(s, d):  # noqa: ANN001, ANN201
    v = fusion.validated(_rows(s, d))
    m, c = F.col("motivos"), F.col("confiancas")
    grade = {"missing": 1, "unknown_property_type": 1, "matches_vagas_same_source": 1, "area_suspiciously_low": 1, "invalid_state": 1}
    grades = F.create_map(*[F.lit(x) for kv in grade.items() for x in kv])
    rule = [F.when(m[f].isNotNull(), F.concat_ws(":", F.lit(f), m[f][0], c[f].cast("string"), F.coalesce(grades[m[f][0]], F.lit(2)).cast("string"))) for f in ("tipo", "preco", "bairro", "cidade", "area_m2", "estado")]
    return v.select("id", F.concat_ws(",", *rule).alias("regras"), F.concat_ws(",", m["imagens"]).alias("imagens"), "estado_validacao", c["imagens"].alias("confianca_imagens"))


#: The fields of each kind, as the SQL says them.
EXPECTED_SQL = """case when tipo in ('apartamento', 'casa') then concat_ws(',', p, b, c, q, w, a) when tipo in ('sobrado', 'studio', 'flat', 'cobertura') then concat_ws(',', p, b, c, q, w) when tipo = 'kitnet' then concat_ws(',', p, b, c, w)
  when tipo in ('terreno', 'lote', 'sala comercial', 'sala', 'galpão', 'prédio') then concat_ws(',', p, b, c, a) else '' end"""
query(
    "missing_expected",
    f"select id, {EXPECTED_SQL} as faltam from (select id, tipo, {', '.join(f"case when {f} is null then '{f}' end as {n}" for f, n in (('preco', 'p'), ('bairro', 'b'), ('cidade', 'c'), ('quartos', 'q'), ('banheiros', 'w'), ('area_m2', 'a')))} from imoveis)",
)(lambda s, d: _rows(s, d).select("id", F.concat_ws(",", fusion.missing_expected()).alias("faltam")))
query("generated_titles", "select id, titulo from imoveis where trim(titulo) <> ''")(
    lambda s, d: _rows(s, d).filter("trim(titulo) <> ''").select("id", F.when(fusion.generated_title(F.col("titulo"), F.col("tipo"), F.col("bairro"), F.col("cidade")) == F.trim("titulo"), F.col("titulo")).alias("titulo"))
)
query(
    "generated_titles_all",
    "select id, coalesce(nullif(trim(titulo), ''), case when tipo <> '' and lugar <> '' then upper(left(tipo, 1)) || lower(substr(tipo, 2)) || ' em ' || lugar end) as titulo from (select *, concat_ws(', ', nullif(bairro, ''), nullif(cidade, '')) as lugar from imoveis)",
)(lambda s, d: _rows(s, d).select("id", fusion.generated_title(F.col("titulo"), F.col("tipo"), F.col("bairro"), F.col("cidade")).alias("titulo")))
query("clamped_numbers", "select id, case when preco > 1000 then preco end as preco, case when area_m2 between 10 and 100000 then area_m2 end as area_m2, " + COUNTS_SQL + " from imoveis")(lambda s, d: fusion.clamped(_rows(s, d)).select("id", "preco", "area_m2", "quartos", "banheiros", "vagas"))

# comparison of two runs: the first and the last delivery of each advert
LAST = FIRST.replace("order by id", "order by id desc")


def _runs(s, d):  # noqa: ANN001, ANN202
    from moradia.operators.merge import first_by, last_by

    r = _rows(s, d).select("url_anuncio", "id", "preco", "quartos", "bairro", "tipo")
    return first_by(r, "url_anuncio", "id"), last_by(r.filter("tipo is not null"), "url_anuncio", "id")


query(
    "compare_fields",
    f"with a as ({FIRST}), b as (select * exclude (rn) from (select *, row_number() over (partition by url_anuncio order by id desc) as rn from imoveis where tipo is not null) where rn = 1) select * from (select coalesce(a.url_anuncio, b.url_anuncio) as url_anuncio, concat_ws(',', case when a.preco is distinct from b.preco then 'preco' end, case when a.quartos is distinct from b.quartos then 'quartos' end, case when a.bairro is distinct from b.bairro then 'bairro' end) as campos from a full join b on a.url_anuncio = b.url_anuncio) where campos <> ''",
)(lambda s, d: compare.differences(*_runs(s, d), ("preco", "quartos", "bairro")))
OVERLAP = "with a as (select distinct url_anuncio from imoveis_snapshots where snapshot_no = 1), b as (select distinct url_anuncio from imoveis_snapshots where snapshot_no = 2)"
query("compare_overlap", OVERLAP + " select count(a.url_anuncio) as n_a, count(b.url_anuncio) as n_b, count(*) filter (a.url_anuncio is not null and b.url_anuncio is not null) as comuns, round(count(*) filter (a.url_anuncio is not null and b.url_anuncio is not null) / count(*), 3) as jaccard, case when count(a.url_anuncio) > count(b.url_anuncio) then 'legacy' when count(a.url_anuncio) < count(b.url_anuncio) then 'candidate' else 'inconclusive' end as vencedor from a full join b on a.url_anuncio = b.url_anuncio")(
    lambda s, d: compare.winner(compare.overlap(*(table(s, d, "imoveis_snapshots").filter(f"snapshot_no = {k}") for k in (1, 2))))
)
query("exclusive_urls", OVERLAP + " select url_anuncio from a where url_anuncio not in (select url_anuncio from b) order by 1 limit 50")(
    lambda s, d: compare.exclusive(*(table(s, d, "imoveis_snapshots").filter(f"snapshot_no = {k}") for k in (1, 2)))
)

# discovery: events as visits of pages
query(
    "stop_rule_pages",
    """with l as (select user_id % 7 as site, cast(date_diff('day', timestamp '2024-01-01', ts) as bigint) as pagina, event_id % 60 as url from events), f as (select site, url, min(pagina) as pagina from l group by 1, 2), n as (select site, pagina, count(*) as novos from f group by 1, 2),
  p as (select distinct site, pagina from l), j as (select p.site, p.pagina, coalesce(n.novos, 0) as novos from p left join n on n.site = p.site and n.pagina = p.pagina), r as (select *, sum((novos = 0)::int) over (partition by site order by pagina rows between 1 preceding and current row) = 2 as cheio from j)
  select site, pagina, novos, coalesce(max(cheio::int) over (partition by site order by pagina rows between unbounded preceding and 1 preceding), 0) = 0 as lida from r""",
)(lambda s, d: discovery.pages_read(table(s, d, "events").select((F.col("user_id") % 7).alias("site"), F.datediff("ts", F.lit("2024-01-01")).cast("bigint").alias("pagina"), (F.col("event_id") % 60).alias("url"))))
query(
    "best_lists_by_kind",
    "with l as (select l_suppkey as site, l_returnflag as tipo, l_partkey % 10 as url, count(*) as links from lineitem group by 1, 2, 3), r as (select *, count(*) over (partition by site) as c, row_number() over (partition by site, tipo order by links desc, url) as k from l) select site, tipo, url, links from r where c <= 6 or k <= 3",
)(lambda s, d: discovery.best_by_kind(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("tipo"), (F.col("l_partkey") % 10).alias("url")).agg(F.count("*").alias("links"))))
query("lists_without_overlap", None)(
    lambda s, d: discovery.without_overlap(table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 20).cast("string").alias("site"), (F.col("l_partkey") % 30).alias("seq")).agg(F.collect_set((F.col("l_orderkey") % 200).cast("string")).alias("itens")).withColumn("url", F.col("seq").cast("string")))
)
query(
    "best_sites",
    "with h as (select fonte_id as entidade, regexp_extract(lower(trim(url_anuncio)), '//([^/?#:]+)', 1) as host, max(coalesce(quartos, 0)) as pontos, min(id) as posicao from imoveis group by 1, 2), r as (select *, cast(row_number() over (partition by entidade order by pontos desc, posicao, host) as integer) as lugar from h) select * from r where lugar <= 3",
)(lambda s, d: discovery.best_sites(_rows(s, d).select(F.col("fonte_id").alias("entidade"), F.regexp_extract(F.lower(F.trim("url_anuncio")), "//([^/?#:]+)", 1).alias("host"), F.coalesce("quartos", F.lit(0)).alias("pontos"), F.col("id").alias("posicao"))))
query(
    "selectors_elected",
    """with n as (select l_suppkey % 50 as site, l_returnflag as campo, l_linestatus || l_linenumber as seletor, sum(cast(l_quantity as bigint)) as peso, count(*) as votos, min(l_orderkey) as seq from lineitem group by 1, 2, 3),
  t as (select *, row_number() over (partition by site, campo order by peso desc, seq, seletor) as r from n), o as (select *, row_number() over (partition by site, seletor order by peso desc, campo) as q from t where r = 1 and votos >= 2) select site, campo, seletor, cast(peso as bigint) as peso from o where q = 1""",
)(lambda s, d: discovery.elected(table(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("site"), F.col("l_returnflag").alias("campo"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("seletor"), F.col("l_quantity").cast("bigint").alias("peso"), F.col("l_orderkey").alias("seq"))).select("site", "campo", "seletor", "peso"))

# state: events as answers of domains
RUNS = "with e as (select event_id, user_id % 20 as dominio, ts, event_type = 'purchase' as ok, event_type <> 'purchase' and event_id % 3 <> 0 as falha from events), r as (select *, sum(ok::int) over (partition by dominio order by ts, event_id rows unbounded preceding) as corrida from e), n as (select *, cast(sum(falha::int) over (partition by dominio, corrida order by ts, event_id rows unbounded preceding) as bigint) as seguidas from r)"


def _answers(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "events").select("event_id", (F.col("user_id") % 20).alias("dominio"), "ts", (F.col("event_type") == "purchase").alias("ok"), ((F.col("event_type") != "purchase") & (F.col("event_id") % 3 != 0)).alias("falha"))


query("circuit_breaker", RUNS + " select event_id, seguidas, case when falha and seguidas >= 8 then ts + interval 300 second end as aberto_ate from n")(
    lambda s, d: state.breaker(_answers(s, d), "dominio", "ts", "event_id", F.col("ok"), F.col("falha")).select("event_id", "seguidas", "aberto_ate")
)
query("cooldowns", "select event_id, max(ts + to_seconds(least(coalesce(nullif(cast(floor(value) as bigint), 0), 60), 3600))) over (partition by user_id order by ts, event_id rows unbounded preceding) as ate from events")(
    lambda s, d: state.cooldown(table(s, d, "events"), "user_id", "ts", "event_id", F.nullif(F.floor("value").cast("bigint"), F.lit(0)).cast("double")).select("event_id", "ate")
)
query("heartbeat_stale", "select id, case when status = 'crawling' and (last_crawl is null or date_diff('second', last_crawl, timestamp '2025-10-01') > 180) then 'erro' else status end as status from fontes")(
    lambda s, d: state.stale(table(s, d, "fontes"), F.lit("2025-10-01").cast("timestamp_ntz"), "last_crawl").select("id", "status")
)
query("history_ring", "select fonte_id, execucao_id, posicao from (select fonte_id, execucao_id, cast(row_number() over (partition by fonte_id order by finished_at desc nulls last, execucao_id desc) as integer) as posicao from crawl_history) where posicao <= 5")(
    lambda s, d: state.ring(table(s, d, "crawl_history"), "fonte_id", "finished_at", "execucao_id", 5).select("fonte_id", "execucao_id", "posicao")
)
query(
    "domain_modes",
    "with r as (select user_id as dominio, event_type <> 'click' as p, row_number() over (partition by user_id order by event_id) as r from events), f as (select dominio, count(*) as n, count(*) filter (p) as y from r where r <= 5 group by 1) select dominio, case when n = 5 and y = 5 then 'navegador' when n = 5 and y = 0 then 'http' end as modo from f",
)(lambda s, d: state.modes(table(s, d, "events").select(F.col("user_id").alias("dominio"), F.col("event_id").alias("seq"), (F.col("event_type") != "click").alias("precisa_navegador"))))
query(
    "progress_stalls",
    "with p as (select user_id, ts, event_id, cast(floor(value / 10) as bigint) as done from events), m as (select *, lag(done) over (partition by user_id order by ts, event_id) as antes from p), k as (select * from m where antes is null or antes <> done), w as (select *, epoch(date_trunc('second', lead(ts) over (partition by user_id order by ts, event_id))) - epoch(date_trunc('second', ts)) as parado from k) select event_id, cast(parado as bigint) as parado from w where parado > 120",
)(lambda s, d: state.stalls(table(s, d, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") / 10).cast("bigint").alias("done")), "user_id", "ts", "event_id", "done").select("event_id", "parado"))


# pages as sources
def _tag(name, value):  # noqa: ANN001, ANN202
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def sitemaps(s, d):  # noqa: ANN001, ANN201
    entry = _tag("url", F.concat(_tag("loc", F.concat(F.lit("https://s.example/imovel/"), F.col("id").cast("string"))), F.coalesce(_tag("image:loc", F.get("imagens", F.lit(0))), F.lit(""))))
    return _rows(s, d).groupBy(F.floor(F.col("id") / 20).alias("g")).agg(F.concat(F.lit("<urlset>"), F.concat_ws("", F.collect_list(entry)), F.lit("<url><loc>https://s.example/blog/1</loc></url><url><loc>https://t.example/imovel/1</loc></url></urlset>")).alias("xml")).withColumn("host", F.lit("s.example"))


@query("sitemap_roundtrip", "select 'https://s.example/imovel/' || id as url, imagens[1] as imagem from imoveis")
def sitemap_roundtrip(s, d):  # noqa: ANN001, ANN201
    from moradia.sources.pages import sitemap_entries

    return sitemap_entries(sitemaps(s, d))


@query("json_database_roundtrip", "select cast(id as varchar) as id, case when trim(titulo) not in ('', '-1') then titulo end as titulo, tipo, preco::double as preco, case when quartos <> -1 then quartos end as quartos from imoveis")
def json_database_roundtrip(s, d):  # noqa: ANN001, ANN201
    from moradia.sources.pages import json_database

    o = F.struct("titulo", "tipo", F.col("preco").cast("string").alias("valor"), F.col("quartos").cast("string").alias("dormitorios"), F.to_json("imagens").alias("fotos"))
    db = _rows(s, d).groupBy(F.floor(F.col("id") / 20).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), o)))).alias("json"))
    return json_database(db).select("id", "titulo", "tipo", "preco", "quartos")


@query("registry_roundtrip", "select 'J-' || registro_id as creci, coalesce(nome, 'sem nome') as nome, coalesce(cidade, '') as cidade, coalesce(estado, '') as estado from creci_registros")
def registry_roundtrip(s, d):  # noqa: ANN001, ANN201
    from moradia.sources.pages import registry_rows

    cells = [F.concat(F.lit("J-"), F.col("registro_id").cast("string")), F.concat(F.lit("<b>"), F.coalesce("nome", F.lit("sem nome")), F.lit("</b>")), F.coalesce("nome_fantasia", F.lit("")), F.coalesce("situacao", F.lit("")), F.concat(F.coalesce("cidade", F.lit("")), F.lit("/"), F.coalesce("estado", F.lit("")))]
    page_ = table(s, d, "creci_registros").groupBy((F.col("registro_id") % 10).alias("g")).agg(F.concat(F.lit("<table><tr><th>x</th></tr>"), F.concat_ws("", F.collect_list(_tag("tr", F.concat(*(_tag("td", c) for c in cells))))), F.lit("</table>")).alias("html"))
    return registry_rows(page_).select("creci", "nome", "cidade", "estado")


def _sites(s, d):  # noqa: ANN001, ANN202
    body = F.concat(F.lit("<body><div class='ficha a1234'><h1 class='t'>"), F.concat(F.lit("Item "), F.col("id").cast("string")), F.lit("</h1><span class='preco x'>"), F.format_string("%d", "id"), F.lit(" reais</span></div></body>"))
    return _rows(s, d).select(F.col("fonte_id").alias("site"), F.col("id").alias("seq"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), body.alias("html"), F.concat(F.lit("Item "), F.col("id").cast("string")).alias("titulo"))


@query("template_learned", "select fonte_id as site, 'titulo' as campo, 'body > div.ficha > h1' as seletor, count(*) as votos from imoveis group by 1 having count(*) >= 2")
def template_learned(s, d):  # noqa: ANN001, ANN201
    from moradia.operators.learning import learned

    return learned(_sites(s, d).withColumn("campo", F.lit("titulo")).withColumnRenamed("titulo", "valor"))


@query("template_applied", "select 'u' || id as url, 'Item ' || id as valor from imoveis where fonte_id in (select fonte_id from imoveis group by 1 having count(*) >= 2)")
def template_applied(s, d):  # noqa: ANN001, ANN201
    from moradia.operators.learning import applied

    return applied(_sites(s, d), template_learned(s, d)).select("url", "valor")
