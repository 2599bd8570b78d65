"""Queries of pages: cards, JSON, detail pages, menus, paging and the detail cascade, on pages rendered from the tables.

List pages hold at most CARDS cards, so a page stays as small as pages are whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moradia.functions import html, items, text, urls
from moradia.operators import cascade
from moradia.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CARDS, BASE = 20, "https://s.example/lista"


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


def listings(s, d) -> DataFrame:  # noqa: ANN001
    return table(s, d, "imoveis").filter("id is not null")


def local(c: str):  # noqa: ANN201
    return F.translate(F.format_number(c, 2), ",.", ".,")


def list_pages(rows: DataFrame, card) -> DataFrame:  # noqa: ANN001
    """Pages of the cards of CARDS listings each."""
    return rows.select(F.floor(F.col("id") / CARDS).alias("g"), "id", card.alias("c")).groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "c"))), lambda x: x["c"]), "\n").alias("html"))


def tagged(parts: list):  # noqa: ANN201
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def ident():  # noqa: ANN201
    return F.col("id").cast("string")


FOUR = "case when t like '%apartamento%' or t like '%apto%' then 'apartamento' when t like '%casa%' or t like '%sobrado%' then 'casa' when t like '%terreno%' or t like '%lote%' then 'terreno' when t like '%comercial%' or t like '%sala%' or t like '%loja%' or t like '%galpão%' then 'comercial' end"
CARD_SQL = f"select id, {FOUR} as tipo, case when abs(preco) > 0 then abs(preco)::double end as preco, case when abs(area_m2) > 0 then abs(area_m2)::double end as area_m2, case when abs(quartos) > 0 then abs(quartos) end as quartos from (select *, lower(coalesce(tipo, '')) as t from imoveis)"


def _read(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("i").alias("i")).select(F.regexp_extract("i.url", r"(\d+)$", 1).cast("bigint").alias("id"), "i.tipo", "i.preco", "i.area_m2", "i.quartos")


@query("cards_tecimob", CARD_SQL)
def cards_tecimob(s, d):  # noqa: ANN001, ANN201
    card = tagged(["<div class='property-item'><a href='/imovel/", ident(), "'>ver</a><h2>Item</h2><span class='property-type'>", F.coalesce("tipo", F.lit("")), "</span><b class='property-price'>R$ ", F.coalesce(local("preco"), F.lit("")), "</b><i class='area-util'>", F.coalesce(local("area_m2"), F.lit("")), " m²</i><i class='quartos'>", F.coalesce(F.col("quartos").cast("string"), F.lit("")), " dorm</i></div>"])
    return _read(list_pages(listings(s, d), card).select(items.platform_cards_of(F.col("html"), F.lit(BASE), "tecimob").alias("i")))


@query("cards_jetimob", CARD_SQL)
def cards_jetimob(s, d):  # noqa: ANN001, ANN201
    card = tagged(["<article class='card-property'><a href='https://s.example/imovel/", ident(), "'><h3>Item</h3></a><span class='tipo'>", F.coalesce("tipo", F.lit("")), "</span><b class='valor'>R$ ", F.coalesce(local("preco"), F.lit("")), "</b><i class='m2'>", F.coalesce(local("area_m2"), F.lit("")), " m2</i><i class='dorms'>", F.coalesce(F.col("quartos").cast("string"), F.lit("")), "</i></article>"])
    return _read(list_pages(listings(s, d), card).select(items.platform_cards_of(F.col("html"), F.lit(BASE), "jetimob").alias("i")))


@query("cards_unknown_builder", f"select id, {FOUR} as tipo, preco::double as preco, case when abs(area_m2) > 0 then abs(area_m2)::double end as area_m2, case when abs(quartos) > 0 then abs(quartos) end as quartos from (select *, lower(coalesce(tipo, '')) as t from imoveis) where preco > 0")
def cards_unknown_builder(s, d):  # noqa: ANN001, ANN201
    card = tagged(["<li class='imovel-box'><a href='/imovel/", ident(), "'>Item ", ident(), "</a><h4>", F.coalesce("tipo", F.lit("")), "</h4><p>R$ ", local("preco"), F.coalesce(F.concat(F.lit(" "), F.col("quartos").cast("string"), F.lit(" quartos")), F.lit("")), F.coalesce(F.concat(F.lit(" "), local("area_m2"), F.lit(" m²")), F.lit("")), "</p></li>"])
    return _read(list_pages(listings(s, d).filter("preco > 0"), card).select(items.heuristic_cards_of(F.col("html"), F.lit(BASE)).alias("i")))


def _island(rows: DataFrame, link) -> DataFrame:  # noqa: ANN001
    one = F.struct("id", F.struct(F.col("id").alias("codigo"), F.concat(F.lit("Item "), ident()).alias("title"), F.coalesce("tipo", F.lit("-")).alias("type"), F.lit(250000).alias("valor"), F.lit(2).alias("dormitorios")).alias("o"), link.alias("a"))
    pages = rows.select(F.floor(F.col("id") / CARDS).alias("g"), one.alias("x")).groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("x")).filter(F.size("x") >= 2)
    body = F.concat(F.lit("<html><script id='__NEXT_DATA__' type='application/json'>"), F.to_json(F.struct(F.struct(F.transform("x", lambda x: x["o"]).alias("items")).alias("props"))), F.lit("</script><body>"), F.array_join(F.transform("x", lambda x: x["a"]), ""), F.lit("</body></html>"))
    return pages.select(items.list_items_of(body, F.lit(BASE)).alias("i")).select(F.explode("i").alias("i")).select(F.col("i.id").cast("bigint").alias("id"), "i.url", "i.titulo", "i.preco", "i.quartos")


PAIRED = "id in (select id from (select id, count(*) over (partition by id // 20) as n from imoveis) where n > 1)"


@query("island_items_by_id", f"select id, 'https://s.example/imovel/' || id as url, 'Item ' || id as titulo, 250000.0::double as preco, 2 as quartos from imoveis where {PAIRED}")
def island_items_by_id(s, d):  # noqa: ANN001, ANN201
    return _island(listings(s, d), F.when(F.coalesce("disponivel", F.lit(False)), F.concat(F.lit("<a href='/imovel/"), ident(), F.lit("'>x</a>"))).otherwise(""))


@query("island_items_by_position", f"select id, 'https://s.example/imovel/a' || id || 'x' as url, 'Item ' || id as titulo, 250000.0::double as preco, 2 as quartos from imoveis where {PAIRED}")
def island_items_by_position(s, d):  # noqa: ANN001, ANN201
    return _island(listings(s, d), F.concat(F.lit("<a href='/imovel/a"), ident(), F.lit("x'>x</a>")))


@query("detail_breadcrumb", "select b.bairro_id as id, b.nome as bairro, c.nome as cidade, 100000.0 + b.bairro_id as preco, b.bairro_id % 5 + 1 as quartos from bairros_ref b join cidades_ref c using (cidade_id)")
def detail_breadcrumb(s, d):  # noqa: ANN001, ANN201
    rows = table(s, d, "bairros_ref").join(F.broadcast(table(s, d, "cidades_ref").select("cidade_id", F.col("nome").alias("cidade"))), "cidade_id")
    page = tagged(["<html><body><div class='breadcrumb'>Home › Imóveis › Venda › ", F.col("cidade"), " › ", F.col("nome"), " › Casa</div><h1>Casa com pátio</h1><p>Valor: R$ ", local("p"), "</p><p>Dormitórios: ", (F.col("bairro_id") % 5 + 1).cast("string"), "</p></body></html>"])
    rows = rows.withColumn("p", (F.lit(100000) + F.col("bairro_id")).cast("double")).select("bairro_id", items.detail_of(page, F.lit(BASE)).alias("i"))
    return rows.select(F.col("bairro_id").alias("id"), "i.bairro", "i.cidade", "i.preco", "i.quartos")


@query("detail_object", "select id, case when floor(preco + 0.5) > 1000 then floor(preco + 0.5)::double end as preco, case when quartos > 0 then quartos end as quartos, titulo from imoveis where floor(preco + 0.5) > 1000 and length(titulo) > 3")
def detail_object(s, d):  # noqa: ANN001, ANN201
    o = F.to_json(F.struct(F.struct(F.struct(F.col("titulo").alias("title"), F.col("preco").cast("double").alias("price"), F.coalesce("quartos", F.lit(0)).alias("bedrooms"), F.lit("casa").alias("type"), F.lit("X").alias("city")).alias("data")).alias("props")))
    rows = listings(s, d).filter("floor(preco + 0.5) > 1000 and length(titulo) > 3")
    return rows.select("id", items.detail_of(F.concat(F.lit("<script id='__NEXT_DATA__'>"), o, F.lit("</script>")), F.lit(BASE)).alias("i")).select("id", "i.preco", "i.quartos", "i.titulo")


@query("menu_list_page", "select id, case when status = 'ok' then 'https://s.example/imoveis/venda' else 'https://s.example/imoveis' end as url from fontes")
def menu_list_page(s, d):  # noqa: ANN001, ANN201
    page = tagged(["<nav><a href='/sobre'>Imóveis à venda</a><a href='/blog/imoveis'>Blog</a>", F.when(F.col("status") == "ok", "<a href='/imoveis/venda'>Comprar</a>").otherwise(""), "<a href='/imoveis'>Imóveis</a></nav><a href='/imoveis-a-venda/comprar/'>à venda</a>"])
    links = table(s, d, "fontes").select("id", F.posexplode(items.menu_of(page, F.lit(BASE))).alias("k", "l"))
    score = urls.menu_score(F.col("l.url"), F.col("l.rotulo"))
    best = links.withColumn("n", score).groupBy("id").agg(F.max(F.struct("n", (-F.col("k")).alias("k"), "l.url")).alias("m"))
    return best.select("id", F.when(F.col("m.n") >= urls.MENU_LEAST, F.col("m.url")).alias("url"))


# paging
def event_n():  # noqa: ANN201
    return F.col("event_id") % 50 + 1


@query("next_pages", "select event_id, case when event_id % 3 = 0 then 'https://s.example/p/seguinte' when event_id % 3 = 1 then 'https://s.example/lista?x=1&pagina=' || (event_id % 50 + 2) else 'https://s.example/mais' end as url from events")
def next_pages(s, d):  # noqa: ANN001, ANN201
    rel, more = F.lit("<link rel='next' href='/p/seguinte'>"), F.lit("<a href='/mais' class='b'> próxima </a>")
    links = F.concat(*(F.concat(F.lit("<a href='?x=1&pagina="), (event_n() + k).cast("string"), F.lit("'>p</a>")) for k in (5, -1, 1, 2)))
    links = F.regexp_replace(links, r"href='\?", "href='/lista?")
    page = F.when(F.col("event_id") % 3 == 0, F.concat(rel, more, links)).when(F.col("event_id") % 3 == 1, links).otherwise(F.concat(more, links))
    return table(s, d, "events").select("event_id", urls.next_page(page, F.concat(F.lit("https://s.example/lista?pagina="), event_n().cast("string"))).alias("url"))


@query("page_links", "select event_id, case event_id % 4 when 0 then 'https://s.example/l/page/7' when 1 then 'https://s.example/n' when 2 then 'https://s.example/sete' else 'https://s.example/lista?pagina=7' end as url from events")
def page_links(s, d):  # noqa: ANN001, ANN201
    k = F.col("event_id") % 4
    page = F.when(k == 0, "<a href='/l/page/7'>sete</a><a rel='next' href='/n'>n</a>").when(k == 1, "<a rel='next' href='/n'>n</a><a href='/sete'> 7 </a>").when(k == 2, "<a href='/sete'> 7 </a>").otherwise("<a href='/x'>8</a>")
    return table(s, d, "events").select("event_id", urls.page_link(page, F.lit(BASE), 7).alias("url"))


@query("page_urls", "select event_id, case event_id % 3 when 0 then 'https://s.example/l?pagina=' || n when 1 then 'https://s.example/l?t=1&pagina=' || n || '&page=' || n else 'https://s.example/l?page=2&pagina=' || n end as url from (select event_id, event_id % 50 + 1 as n from events)")
def page_urls(s, d):  # noqa: ANN001, ANN201
    k = F.col("event_id") % 3
    return table(s, d, "events").select("event_id", urls.with_page(F.when(k == 0, "https://s.example/l/").when(k == 1, "https://s.example/l?t=1").otherwise("https://s.example/l?page=2"), event_n()).alias("url"))


@query("page_numbers", "select event_id, case event_id % 3 when 0 then n when 1 then case when n > 1 then n else 2 end else 2 end as numero, case when event_id % 3 = 1 and n > 1 then n else 1 end as passo from (select event_id, (event_id % 50 + 1)::int as n from events)")
def page_numbers(s, d):  # noqa: ANN001, ANN201
    k = F.col("event_id") % 3
    url = F.when(k == 0, F.concat(F.lit("https://s.example/l?a=1&pg="), event_n().cast("string"), F.lit("&start=9"))).when(k == 1, F.concat(F.lit("https://s.example/l?start="), event_n().cast("string"))).otherwise("https://s.example/l")
    return table(s, d, "events").select("event_id", urls.page_number(url).alias("p")).select("event_id", "p.*")


# addresses against the own source
PATH_SQL = "regexp_extract(trim(u), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]+([^?#]*)', 1)"
HOST_SQL = "nullif(lower(regexp_extract(trim({0}), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]+)', 1)), '')"
OWN_SQL = f"(select i.id, i.url_anuncio as u, f.base, coalesce({HOST_SQL.format('i.url_anuncio')} = {HOST_SQL.format('f.base')}, false) as mesmo from imoveis i left join (select id, min(url) as base from fontes group by 1) f on f.id = i.fonte_id)"
WEAK_SQL = "(len(list_filter(s, lambda x: regexp_matches(x, '^[0-9]+$'))) > 0 or len(list_filter(s, lambda x: length(x) > 15 and contains(x, '-'))) > 0 or len(s) >= 3 or regexp_matches(lower(p), '(?:^|[^a-z0-9_])(?:ref|cod|id)[-_]?[0-9]+'))"
PARTS_SQL = f"(select *, {PATH_SQL} as p, list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '') as s from {OWN_SQL})"


def _own(s, d) -> DataFrame:  # noqa: ANN001
    base = table(s, d, "fontes").groupBy(F.col("id").alias("fonte_id")).agg(F.min("url").alias("base"))
    return listings(s, d).select("id", "fonte_id", F.col("url_anuncio").alias("u")).join(F.broadcast(base), "fonte_id", "left")


query("url_sale_detail", f"select id, mesmo and p not in ('', '/') and not regexp_matches(lower(u), '{urls.SKIP}') and not regexp_matches(lower(u), '{urls.RENTED}') and {WEAK_SQL} as detalhe from {PARTS_SQL} where u is not null union all select id, false from imoveis where url_anuncio is null")(
    lambda s, d: _own(s, d).select("id", urls.is_sale_detail(F.col("u"), urls.host(F.col("base"))).alias("detalhe"))
)
query(
    "url_item_link",
    f"select id, coalesce(lower(regexp_extract(u, '^([a-zA-Z]+://[^/?#]+)', 1)) = lower(regexp_extract(base, '^([a-zA-Z]+://[^/?#]+)', 1)) and regexp_extract(u, '^([a-zA-Z]+://[^/?#]+)', 1) <> '' and p <> '/' and length(p) >= 4 and regexp_matches(p, '/[0-9]{{4,}}|/imovel/|/property/|/venda/[^-].*/[0-9]|/aluguel/[^-].*/[0-9]'), false) as item from {PARTS_SQL}",
)(lambda s, d: _own(s, d).select("id", urls.is_item_link(F.col("u"), F.col("base")).alias("item")))
query(
    "url_card_link",
    f"select id, coalesce(starts_with(u, 'http') and mesmo and p not in ('', '/') and p <> regexp_extract(trim(base), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]+([^?#]*)', 1) and not regexp_matches(u, '{urls.NO_CARD}'), false) as cartao from {PARTS_SQL}",
)(lambda s, d: _own(s, d).select("id", urls.is_card_link(F.col("u"), F.col("base")).alias("cartao")))
query("url_metadata", "select b.bairro_id as id, trim(regexp_replace(lower(strip_accents(c.nome)), '[^a-z0-9]+', ' ', 'g')) as cidade, trim(regexp_replace(lower(strip_accents(b.nome)), '[^a-z0-9]+', ' ', 'g')) as bairro, case when b.bairro_id % 2 = 0 then 'Casa' else 'Sobrado' end as tipo from bairros_ref b join cidades_ref c using (cidade_id)")(
    lambda s, d: (
        table(s, d, "bairros_ref").join(F.broadcast(table(s, d, "cidades_ref").select("cidade_id", F.col("nome").alias("c"))), "cidade_id")
        .select("bairro_id", F.concat(F.lit("https://s.example/imoveis/"), F.when(F.col("bairro_id") % 3 == 0, "aluguel").otherwise("venda"), F.lit("/"), urls.slug(F.col("c")), F.lit("/"), urls.slug(F.col("nome")), F.lit("/-/"), F.when(F.col("bairro_id") % 2 == 0, "casa").otherwise("sobrado-de-esquina"), F.lit("/9/imovel/1")).alias("u"))
        .select(F.col("bairro_id").alias("id"), urls.metadata(F.col("u")).alias("m")).select("id", F.lower("m.cidade").alias("cidade"), F.lower("m.bairro").alias("bairro"), "m.tipo")
    )
)
NAMES_SQL = ", ".join(f"'{w}'" for w in text.COMMON_NAMES)
query(
    "official_sites",
    f"""with r as (select registro_id, cidade, list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(nome)), '[^a-z0-9]+', ' ', 'g')), ' +'), lambda w: length(w) >= 3 and w not in ({NAMES_SQL})) as t from creci_registros where nome is not null),
  f as (select distinct cidade, url, regexp_replace({HOST_SQL.format('url')}, '^www[.]', '') as h from fontes where cidade is not null and url is not null),
  j as (select registro_id, url, case when h is null then -100 else list_sum(list_concat([0], list_transform(t, lambda w: case when contains(h, w) then 3 else 0 end + case when string_split(h, '.')[1] = w then 5 else 0 end))) - case when len(string_split(url, '/')) > 5 then 1 else 0 end + case when ends_with(h, '.com.br') then 1 else 0 end end::int as nota from r join f using (cidade))
  select registro_id, url, nota from j""",
)(
    lambda s, d: (
        table(s, d, "creci_registros").filter("nome is not null").select("registro_id", "cidade", text.name_tokens(F.col("nome")).alias("t"))
        .join(table(s, d, "fontes").filter("cidade is not null and url is not null").select("cidade", "url").distinct(), "cidade").select("registro_id", "url", urls.site_score(F.col("url"), F.col("t")).alias("nota"))
    )
)

# what remains of broken input
query("json_recovered", "select event_id, event_id % 7 + 1 as n from events")(
    lambda s, d: (
        table(s, d, "events").select("event_id", F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.col("event_id") % 7), lambda k: F.concat(F.lit('{"a": '), k.cast("string"), F.lit("}"))), ","), F.lit(', {"a": 1')).alias("t"))
        .select("event_id", F.size(F.from_json(items.recovered("t"), "array<struct<a:int>>")).cast("bigint").alias("n"))
    )
)
query("bytes_decoded", "select id, titulo || chr(65533) as t from imoveis where titulo is not null")(lambda s, d: listings(s, d).filter("titulo is not null").select("id", items.decoded(F.concat(F.encode("titulo", "UTF-8"), F.unhex(F.lit("FF")))).alias("t")))
query("compact_pages", "select id, '<div class=''x''><p>a' || id || '</p></div>' as t from fontes")(
    lambda s, d: table(s, d, "fontes").select("id", items.compacted(F.concat(F.lit("<!-- c --><div class='x' style='color: red' onclick=\"f()\"><script>var a = 1;</script><p data-k='1'>a"), F.col("id"), F.lit("</p></div>"))).alias("t"))
)
query("template_fields", "select id, case when quartos between 0 and 15 then quartos when quartos < 0 and quartos >= -15 then -quartos end::varchar as quartos, case when vagas between 0 and 10 then vagas when vagas < 0 and vagas >= -10 then -vagas end::varchar as vagas, case when preco > 10000 and preco < 500000000 then preco::double end as preco from imoveis")(
    lambda s, d: listings(s, d).select("id", text.field_value("quartos", F.concat(F.col("quartos").cast("string"), F.lit(" quartos"))).alias("quartos"), text.field_value("vagas", F.concat(F.lit("Vagas: "), F.col("vagas").cast("string"))).alias("vagas"), text.field_value("preco", text.brl(F.col("preco"))).cast("double").alias("preco"))
)

# the cascade
PAD = f"<!--{'.' * 2000}-->"


def _detail_pages(s, d) -> DataFrame:  # noqa: ANN001
    """A page for each listing: structured data where it is available, else only text; the kind stands in the text alone, rooms too."""
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.concat(F.lit("Item "), ident()).alias("name"), F.struct(F.col("preco").cast("string").alias("price")).alias("offers")))
    say = lambda c, before, after: F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    kind = F.when(F.col("tipo") == "sala", "sala comercial").otherwise(F.col("tipo"))
    body = tagged(["<h1>Anúncio número ", ident(), " do site</h1><p>", say(kind, "Tipo ", ". "), say(local("preco"), "R$ ", ". "), say(local("area_m2"), "Área ", " m². "), say(F.col("quartos").cast("string"), "", " quartos. "), say(F.col("vagas").cast("string"), "", " vagas."), "</p>"])
    page = F.concat(F.lit(PAD), F.when(F.coalesce("disponivel", F.lit(False)), F.concat(F.lit("<script type='application/ld+json'>"), ld, F.lit("</script>"))).otherwise(""), body)
    return listings(s, d).select(F.concat(F.lit("https://s.example/imovel/"), ident()).alias("url"), page.alias("html"), F.when(F.col("status") == "ativo", F.struct(*(F.lit("venda").alias(f) if f == "transacao" else F.lit("Centro").alias(f) if f == "bairro" else F.lit(None).cast("double" if f in ("preco", "area_m2") else "int" if f in ("quartos", "banheiros", "vagas") else "string").alias(f) for f in cascade.FIELDS))).alias("modelo"))


CASCADE = """select id, case when coalesce(disponivel, false) then 'Item ' || id else 'Anúncio número ' || id || ' do site' end as titulo, tipo,
  case when coalesce(disponivel, false) and preco is not null then preco::double when preco > 10000 and preco < 500000000 then preco::double end as preco, case when abs(area_m2) > 10 and abs(area_m2) <= 100000 then abs(area_m2)::double end as area_m2,
  case when abs(quartos) between 1 and 20 then abs(quartos) end as quartos, case when abs(vagas) between 1 and 20 then abs(vagas) end as vagas, case when status = 'ativo' then 'Centro' end as bairro, case when status = 'ativo' then 'venda' end as transacao,
  case when coalesce(disponivel, false) then 'json_ld+regex' else 'regex' end || case when status = 'ativo' then '+model' else '' end as metodo from imoveis"""


@query("detail_cascade", CASCADE)
def detail_cascade(s, d):  # noqa: ANN001, ANN201
    out = cascade.detail_cascade(_detail_pages(s, d), model="modelo")
    return out.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("id"), "titulo", "tipo", "preco", "area_m2", "quartos", "vagas", "bairro", "transacao", "metodo")


@query("detail_cascade_strict", "select id, case when coalesce(disponivel, false) and preco is not null and preco <> 0 then 'json_ld' else 'model' end as metodo from imoveis where (coalesce(disponivel, false) and preco is not null) or status = 'ativo'")
def detail_cascade_strict(s, d):  # noqa: ANN001, ANN201
    return cascade.detail_cascade(_detail_pages(s, d), model="modelo", strict=True).select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("id"), "metodo")


@query(
    "template_overrides",
    "select id, 'charqueadas' as bairro, case when abs(banheiros) between 1 and 15 then abs(banheiros) else 9 end as banheiros, case when vagas is null then 1 when abs(vagas) between 1 and 10 then abs(vagas) else 7 end as vagas, 'casa' as tipo from imoveis",
)
def template_overrides(s, d):  # noqa: ANN001, ANN201
    told = F.concat_ws(". ", F.concat(F.col("banheiros").cast("string"), F.lit(" banheiros")), F.coalesce(F.concat(F.lit("garagem p/ "), F.col("vagas").cast("string"), F.lit(" carros")), F.lit("com garagem")))
    given = {"tipo": F.lit("terreno"), "bairro": F.lit("Outro"), "descricao": told, "banheiros": F.lit(9), "vagas": F.when(F.col("vagas").isNotNull(), 7)}
    reading = F.struct(*(given.get(f, F.lit(None).cast("double" if f in ("preco", "area_m2") else "int" if f == "quartos" else "string")).alias(f) for f in cascade.FIELDS))
    out = cascade.overridden(F.lit("https://s.example/imovel/casa/caxias-do-sul/charqueadas/18432"), reading)
    return listings(s, d).select("id", out.alias("o")).select("id", F.lower("o.bairro").alias("bairro"), "o.banheiros", "o.vagas", "o.tipo")


query("gone_and_list_pages", "select 3 as gone, 1 as lists")(
    lambda s, d: s.createDataFrame([("erro 404",), ("/10404/x",), ("Imóvel não encontrado",), ("Not Found",), ("12 imóveis para comprar",), ("3 imovel para alugar em X",), ("casa",)], "t string").agg(F.count_if(html.soft_404("t")).cast("int").alias("gone"), F.count_if(html.is_list_page("t")).cast("int").alias("lists"))
)
