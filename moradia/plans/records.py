"""Queries of records, changes, totals and state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from moradia.functions import text
from moradia.operators import discovery, fusion, learning, records
from moradia.plans import extract, tables
from moradia.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return keep


def t(s, d, n="imoveis"):  # noqa: ANN001, ANN201
    return table(s, d, n)


# lookups and projections
query("by_keys", "select id, titulo from imoveis where fonte_id in (select id from fontes where status = 'ok')")(
    lambda s, d: records.with_keys(t(s, d), t(s, d, "fontes").filter("status = 'ok'").select(F.col("id").alias("fonte_id")), "fonte_id").select("id", "titulo")
)
query("by_status", "select id from imoveis where status in ('possivelmente_vendido', 'vendido')")(lambda s, d: records.with_keys(t(s, d), ["possivelmente_vendido", "vendido"], "status").select("id"))
query("by_pattern", "select id from imoveis where url_anuncio like '%/1%2' or url_anuncio ilike '%CASA%'")(
    lambda s, d: records.like(t(s, d).select("id", "url_anuncio"), "url_anuncio", "%/1%2").union(records.like(t(s, d).select("id", "url_anuncio"), "url_anuncio", "%CASA%", anycase=True)).select("id").distinct()
)
query("urls_in_order", "select distinct url_anuncio from imoveis where fonte_id = (select min(id) from fontes) and url_anuncio is not null order by 1")(
    lambda s, d: t(s, d).join(F.broadcast(t(s, d, "fontes").agg(F.min("id").alias("fonte_id"))), "fonte_id").filter("url_anuncio is not null").select("url_anuncio").distinct().orderBy("url_anuncio")
)
query("text_and_image_sizes", "select id, length(descricao)::int as letras, case when len(imagens) > 0 then len(imagens)::int end as fotos from imoveis")(lambda s, d: records.sizes(t(s, d)))
query("flat_json", "select id, json_object('id', id, 'quartos', quartos) as j from imoveis where quartos is not null union all select id, json_object('id', id) from imoveis where quartos is null")(
    lambda s, d: t(s, d).select("id", records.flat(t(s, d), ("id", "quartos")).alias("j"))
)
query("rooms_desc_top", "select id, quartos from imoveis order by quartos desc nulls last, id limit 6")(lambda s, d: records.top(t(s, d).select("id", "quartos"), 6, F.desc_nulls_last("quartos"), F.col("id")))
query("recent_heads", "select id, created_at from imoveis where disponivel order by created_at desc nulls last, id limit 4")(lambda s, d: records.top(t(s, d).filter("disponivel").select("id", "created_at"), 4, F.desc_nulls_last("created_at"), F.col("id")))
query("favourites_page", "select i.id, i.titulo, f.nome from imoveis i left join fontes f on f.id = i.fonte_id where i.disponivel order by i.created_at desc nulls last, i.id limit 50")(
    lambda s, d: records.top(t(s, d).filter("disponivel").join(F.broadcast(t(s, d, "fontes").select(F.col("id").alias("fonte_id"), "nome")), "fonte_id", "left").select("id", "titulo", "nome", "created_at"), 50, F.desc_nulls_last("created_at"), F.col("id")).drop("created_at")
)
query("links_union", "select url_anuncio from imoveis where url_anuncio is not null union select url_anuncio from imoveis_snapshots where url_anuncio is not null")(
    lambda s, d: records.union_of(t(s, d).select("url_anuncio"), t(s, d, "imoveis_snapshots").select("url_anuncio"), key="url_anuncio").filter("url_anuncio is not null")
)
query("rows_union", "select registro_id, url from creci_registros where url is not null union all select registro_id, url from creci_registros where url is null")(
    lambda s, d: records.union_of(t(s, d, "creci_registros").filter("url is not null").select("registro_id", "url"), t(s, d, "creci_registros").filter("url is null").select("registro_id", "url"))
)

# changes
query("job_patch", "select c.execucao_id, coalesce(p.status, c.status) as status, c.failed from crawl_history c left join (select execucao_id, case when coalesce(failed, 0) > 5 then 'revisar' end as status from crawl_history) p using (execucao_id)")(
    lambda s, d: records.patched(t(s, d, "crawl_history").select("execucao_id", "status", "failed"), t(s, d, "crawl_history").select("execucao_id", F.when(F.coalesce("failed", F.lit(0)) > 5, "revisar").alias("status")), "execucao_id")
)
query("insert_defaults", "select registro_id, coalesce(situacao, 'novo') as situacao, 'pendente' as estado_importacao from creci_registros")(
    lambda s, d: records.with_defaults(t(s, d, "creci_registros").select("registro_id", "situacao"), situacao=F.lit("novo"), estado_importacao=F.lit("pendente"))
)
query("state_backfill", "select linha_id, coalesce(status, case when coalesce(disponivel, false) then 'ativo' else 'possivelmente_vendido' end) as status from imoveis_snapshots")(lambda s, d: records.with_state(t(s, d, "imoveis_snapshots")).select("linha_id", "status"))
query(
    "bare_upsert_hazard",
    "select i.url_anuncio, count(*) as n, count(i.titulo) as titulos, count(i.preco) as precos from imoveis i join (select distinct url_anuncio from imoveis_snapshots where snapshot_no = 4) b using (url_anuncio) where i.titulo is not null or i.preco is not null group by 1",
)(
    lambda s, d: (
        records.nulled_by_bare_upsert(t(s, d).select("url_anuncio", "titulo", "preco"), t(s, d, "imoveis_snapshots").filter("snapshot_no = 4").select("url_anuncio"), "url_anuncio", ("titulo", "preco"))
        .groupBy("url_anuncio").agg(F.count("*").alias("n"), F.count_if(F.array_contains("perdidos", "titulo")).alias("titulos"), F.count_if(F.array_contains("perdidos", "preco")).alias("precos"))
    )
)
query("last_run_states", "select fonte_id, finished_at, execucao_id, status from (select *, row_number() over (partition by fonte_id order by finished_at desc nulls last, execucao_id desc) n from crawl_history) where n = 1")(
    lambda s, d: records.last_states(t(s, d, "crawl_history").select("fonte_id", "finished_at", "execucao_id", "status"), "fonte_id", ["finished_at", "execucao_id"])
)
for policy, at in (("always", "finished_at"), ("ok", "case when status = 'ok' then finished_at end")):
    query(
        f"source_state_{policy}",
        f"select l.fonte_id, l.status, m.last_crawl from (select fonte_id, status from (select *, row_number() over (partition by fonte_id order by finished_at desc nulls last, execucao_id desc) n from crawl_history) where n = 1) l join (select fonte_id, max({at}) as last_crawl from crawl_history group by 1) m using (fonte_id)",
    )(lambda s, d, policy=policy: records.source_states(t(s, d, "crawl_history"), policy))

# totals
query("nav_counts", "select (select count(*) from imoveis where disponivel) as ativos, (select count(*) from fontes where status = 'erro') as erros")(lambda s, d: records.nav_counts(t(s, d), t(s, d, "fontes")))
query(
    "cleanup_counts",
    "with c as (select f.status, (select count(*) from imoveis i where i.fonte_id = f.id) as total from fontes f) select count(*) filter (status = 'erro') as com_erro, count(*) filter (status <> 'crawling' and total = 0) as vazias, count(*) filter (status = 'erro' or (status <> 'crawling' and total = 0)) as candidatas from c",
)(lambda s, d: records.cleanup_counts(t(s, d, "fontes").join(t(s, d).groupBy(F.col("fonte_id").alias("id")).count(), "id", "left").select("status", F.coalesce("count", F.lit(0)).alias("total"))))
SUMS = ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in ("urls_found", "enriched", "failed", "complete", "new_urls", "kept_urls", "sold_urls", "reactivated_urls"))
query("fleet_totals", f"select *, enriched / greatest(urls_found, 1) as taxa from (select count(*) as execucoes, count(*) filter (status = 'ok') as ok, {SUMS} from crawl_history)")(lambda s, d: records.fleet_totals(t(s, d, "crawl_history")))
query(
    "run_summary",
    "select n, ok, erro, media, t.tempos from (select count(*) as n, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'erro') as erro, floor(coalesce(sum(urls_found), 0) / greatest(count(*), 1))::bigint as media from crawl_history), (select string_agg(fase || '=' || t, ',' order by fase) as tempos from (select e.key as fase, sum(e.value)::bigint as t from (select unnest(map_entries(phase_times)) as e from crawl_history) group by 1)) t",
)(lambda s, d: records.run_summary(t(s, d, "crawl_history")).withColumn("tempos", F.array_join(F.transform(F.map_entries("tempos"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")))

# text
query("kind_of_four", "select id, case when t like '%apartamento%' or t like '%apto%' then 'apartamento' when t like '%casa%' or t like '%sobrado%' then 'casa' when t like '%terreno%' or t like '%lote%' then 'terreno' when t like '%comercial%' or t like '%sala%' or t like '%loja%' or t like '%galpão%' then 'comercial' end as tipo from (select id, lower(titulo) as t from imoveis)")(
    lambda s, d: t(s, d).select("id", text.kind_of_four(F.col("titulo")).alias("tipo"))
)
query("plain_numbers", "select id, case when preco > 0 then preco::double end as preco, case when area_m2 > 0 then area_m2::double end as area_m2, case when quartos > 0 then quartos end as quartos, case when floor(preco + 0.5) > 0 then floor(preco + 0.5)::bigint end as inteiro from imoveis where coalesce(preco, 0) >= 0 and coalesce(area_m2, 0) >= 0 and coalesce(quartos, 0) >= 0 union all select id, abs(preco)::double, abs(area_m2)::double, abs(quartos), floor(abs(preco) + 0.5)::bigint from imoveis where not (coalesce(preco, 0) >= 0 and coalesce(area_m2, 0) >= 0 and coalesce(quartos, 0) >= 0)")(
    lambda s, d: t(s, d).select(
        "id", text.any_price(text.brl(F.col("preco"))).alias("preco"), text.any_area(F.concat(F.translate(F.format_number("area_m2", 2), ",.", ".,"), F.lit(" m²"))).alias("area_m2"),
        text.any_count(F.concat(F.col("quartos").cast("string"), F.lit(" dorm."))).alias("quartos"), text.whole_number(text.brl(F.col("preco"))).alias("inteiro"),
    )
)
NOW = "timestamp '2025-06-15 12:00:00'"
query("day_labels", f"select execucao_id, case when h < 24 then 'Hoje' when h < 48 then 'Ontem' else strftime(finished_at, '%d/%m') end as dia from (select *, floor(epoch({NOW} - finished_at) / 3600) as h from crawl_history where finished_at is not null) union all select execucao_id, null from crawl_history where finished_at is null")(
    lambda s, d: t(s, d, "crawl_history").select("execucao_id", text.day_label(F.col("finished_at"), F.lit("2025-06-15 12:00:00").cast("timestamp_ntz")).alias("dia")) if dict(t(s, d, "crawl_history").dtypes)["finished_at"] == "timestamp_ntz"
    else t(s, d, "crawl_history").select("execucao_id", F.when(F.col("finished_at").isNotNull(), text.day_label(F.col("finished_at"), F.lit("2025-06-15 12:00:00").cast("timestamp"))).alias("dia"))
)
query("messages_mined", "select execucao_id, enriched as completos, failed as parciais from crawl_history")(
    lambda s, d: t(s, d, "crawl_history").select("execucao_id", F.concat(F.lit("Fim: "), F.coalesce(F.col("enriched").cast("string"), F.lit("?")), F.lit(" completos, "), F.coalesce(F.col("failed").cast("string"), F.lit("?")), F.lit(" parciais")).alias("m")).select("execucao_id", text.mined(F.col("m"), "completos").alias("completos"), text.mined(F.col("m"), "parciais").alias("parciais"))
)
query("elapsed_labels", "select execucao_id, case when v < 60 then round(v)::bigint || 's' when v < 3600 then round(v / 60.0, 1)::decimal(18,1) || 'min' else round(v / 3600.0, 1)::decimal(18,1) || 'h' end as rotulo from (select execucao_id, urls_found * 10 as v from crawl_history)")(
    lambda s, d: t(s, d, "crawl_history").select("execucao_id", text.elapsed_label(F.col("urls_found") * 10).alias("rotulo"))
)

# fusion
ACCEPTED = "not regexp_matches(lower(coalesce(titulo, '')), 'nao_encontrado|não encontrad|not found|404') and lower(coalesce(titulo, '')) not in ('n/a', '') and not coalesce(contains(lower(transacao), 'alug'), false) and (coalesce(preco, 0) <> 0 or coalesce(quartos, 0) <> 0 or coalesce(bairro, '') <> '' or coalesce(len(imagens), 0) > 0 or coalesce(tipo, '') <> '')"
query("accepted_records", f"select id from imoveis where {ACCEPTED}")(lambda s, d: fusion.accepted(t(s, d)).select("id"))
EMPTY = {c: f"({c} is null or {c} = 0)" for c in ("preco", "quartos", "vagas")} | {c: f"({c} is null or regexp_matches({c}, '^(0+([.]0+)?)?$'))" for c in ("bairro", "cidade")}
query("to_enrich", f"select id from imoveis where {EMPTY['preco']} or {EMPTY['quartos']} or {EMPTY['bairro']}")(lambda s, d: fusion.to_enrich(t(s, d)).select("id"))
D_SIDE = "d as (select url_anuncio as u, max(preco) as p, max(quartos) as q, max(bairro) as b from imoveis group by 1)"


def _details(s, d):  # noqa: ANN001, ANN202
    rows = t(s, d)
    none = {c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in (*fusion.ENRICHED, "imagens")}
    best = rows.groupBy("url_anuncio").agg(*(F.max(c).alias(c) for c in ("preco", "quartos", "bairro")))
    return best.select("url_anuncio", *(F.col(c) if c in ("preco", "quartos", "bairro") else none[c] for c in (*fusion.ENRICHED, "imagens")))


FILL = ", ".join(f"case when g and e{c[0]} and not ({e}) then d.{c[0]} else i.{c} end as {c}" for c, e in (("preco", "d.p is null or d.p = 0"), ("quartos", "d.q is null or d.q = 0"), ("bairro", "d.b is null or regexp_matches(d.b, '^(0+([.]0+)?)?$')")))
query("enriched_rows", f"with {D_SIDE}, i as (select *, {EMPTY['preco']} as ep, {EMPTY['quartos']} as eq, {EMPTY['bairro']} as eb, ep or eq or eb as g from imoveis) select i.id, {FILL} from i left join d on d.u = i.url_anuncio")(
    lambda s, d: fusion.enriched(t(s, d), _details(s, d)).select("id", "preco", "quartos", "bairro")
)
query("list_page_fields", f"with {D_SIDE} select i.id, case when d.p is not null and d.p <> 0 then d.p else i.preco end as preco, case when d.q is not null and d.q <> 0 then d.q else i.quartos end as quartos from imoveis i left join d on d.u = i.url_anuncio")(
    lambda s, d: fusion.from_list_page(t(s, d), _details(s, d), fields=("preco", "quartos")).select("id", "preco", "quartos")
)
FULLS = " + ".join(f"({c} is not null and {c}::varchar not in ('', '0', '0.00'))::int" for c in ("preco", "quartos", "area_m2", "bairro"))
query(
    "better_reading",
    f"with a as (select id, quartos, case when disponivel then preco end as preco, null::decimal(18,2) as area_m2, null::varchar as bairro, 100 as n, status = 'x' as j from imoveis), b as (select id, preco, quartos, area_m2, bairro, 100 + vagas as n from imoveis), c as (select a.id, coalesce(a.fa < 2 and not coalesce(a.j, false) and b.n > a.n * 1.02 and b.fb > a.fa, false) as segunda, a.preco as pa, b.preco as pb from (select *, {FULLS} as fa from a) a join (select *, {FULLS} as fb from b) b using (id)) select id, segunda, case when segunda then pb else pa end as preco from c",
)(
    lambda s, d: fusion.better(
        t(s, d).select("id", "quartos", F.when(F.col("disponivel"), F.col("preco")).alias("preco"), F.lit(None).cast("decimal(18,2)").alias("area_m2"), F.lit(None).cast("string").alias("bairro"), F.lit(100).alias("tamanho"), (F.col("status") == "x").alias("tem_jsonld")),
        t(s, d).select("id", "preco", "quartos", "area_m2", "bairro", (F.lit(100) + F.col("vagas")).alias("tamanho")), "id", grown=1.02,
    ).select("id", "segunda", "preco")
)

# state and discovery on the events
EV = "select event_id as pedido_id, 'u' || (user_id % 50) as fonte_id, ts as em, case when event_id % 3 > 0 then ts + to_seconds(600 + (event_id % 7) * 300) end as termino from events"


def _requests(s, d):  # noqa: ANN001, ANN202
    end = F.when(F.col("event_id") % 3 > 0, F.timestamp_add("SECOND", F.lit(600) + (F.col("event_id") % 7) * 300, F.col("ts")))
    return t(s, d, "events").select(F.col("event_id").alias("pedido_id"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("fonte_id"), F.col("ts").alias("em"), end.alias("termino"))


query(
    "admitted_requests",
    f"""with recursive r as (select *, row_number() over (partition by fonte_id order by a, pedido_id) as k from (select fonte_id, pedido_id, floor(epoch(em))::bigint as a, least(coalesce(floor(epoch(termino))::bigint, floor(epoch(em))::bigint + 1800), floor(epoch(em))::bigint + 1800) as b from ({EV}))),
  f as (select fonte_id, pedido_id, k, true as aceito, b as ate from r where k = 1 union all select r.fonte_id, r.pedido_id, r.k, r.a >= f.ate, case when r.a >= f.ate then r.b else f.ate end from f join r on r.fonte_id = f.fonte_id and r.k = f.k + 1) select fonte_id, pedido_id, aceito from f""",
)(lambda s, d: records.admitted(_requests(s, d)))
query(
    "best_list_pages",
    "with c as (select user_id as site, event_id as ordem, 'p' || event_id as url, event_id % 4 = 0 as inicio, (event_id % 11) as n from events) select site, coalesce(arg_min(url, ordem) filter (n >= case when inicio then 30 else 5 end), arg_max(url, n * 1000000 - ordem) filter (n > 0)) as url from c group by 1",
)(lambda s, d: records.best_list_page(t(s, d, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("ordem"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("url"), (F.col("event_id") % 4 == 0).alias("inicio"), (F.col("event_id") % 11).alias("n"))))
PAGES = "select user_id as site, (1 + row_number() over (partition by user_id order by event_id) - 1)::int as pagina, case when user_id % 5 = 0 and row_number() over (partition by user_id order by event_id) >= 10 then 0 else 3 end as links, case when event_id % 3 = 0 then 1 else 0 end * case when row_number() over (partition by user_id order by event_id) > 20 then 0 else 1 end as novos from events"


def _visits(s, d):  # noqa: ANN001, ANN202
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t(s, d, "events").select("user_id", "event_id", k.alias("k"))
    return rows.select(F.col("user_id").alias("site"), F.col("k").cast("int").alias("pagina"), F.when((F.col("user_id") % 5 == 0) & (F.col("k") >= 10), 0).otherwise(3).alias("links"), F.when((F.col("event_id") % 3 == 0) & (F.col("k") <= 20), 1).otherwise(0).alias("novos"))


query(
    "pages_in_batches",
    f"""with p as (select * from ({PAGES}) where pagina between 1 and 100), s as (select site, (pagina - 1) // 5 as lote, sum(novos) as novos from p group by 1, 2), z as (select site, lote, novos = 0 and coalesce(lag(novos) over (partition by site order by lote), 1) = 0 as par from s), e as (select site, min(lote) filter (par) as fim from z group by 1),
  l as (select site, sum(links) filter (pagina >= 10) as longe from p group by 1) select p.site, p.pagina from p join e using (site) join l using (site) where case when coalesce(longe, 1) = 0 then pagina = 1 else fim is null or (pagina - 1) // 5 <= fim end""",
)(lambda s, d: records.pages_read(_visits(s, d)))
query(
    "usable_pages",
    "with c as (select regexp_extract(url_anuncio, '//([^/?#:]+)', 1) as host, min(created_at) as desde, min(created_at) + interval 10 day as ate from imoveis where id % 7 = 0 group by 1) select i.id, coalesce(c.host is not null and i.created_at >= c.desde and i.created_at < c.ate, false) as pausado, coalesce(i.quartos = 2 and length(i.descricao) >= 200 and not coalesce(c.host is not null and i.created_at >= c.desde and i.created_at < c.ate, false), false) as serve from imoveis i left join c on c.host = nullif(lower(regexp_extract(trim(i.url_anuncio), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]+)', 1)), '')",
)(
    lambda s, d: records.usable_pages(
        t(s, d).select("id", F.col("url_anuncio").alias("url"), F.col("descricao").alias("html"), F.col("created_at").cast("timestamp").alias("fetched_at"), F.when(F.col("quartos") == 2, 200).when(F.col("quartos") == 3, 429).otherwise(500).alias("status")),
        t(s, d).filter("id % 7 = 0").groupBy(F.regexp_extract("url_anuncio", "//([^/?#:]+)", 1).alias("host")).agg(F.min(F.col("created_at").cast("timestamp")).alias("desde")).withColumn("ate", F.timestamp_add("DAY", F.lit(10), F.col("desde"))),
    ).select("id", "pausado", F.col("html").isNotNull().alias("serve"))
)
query("city_ids", "select cidade, arg_min(cidade_id, cidade_id) as id from (select trim(regexp_replace(lower(strip_accents(nome)), '\\s+', ' ', 'g')) as cidade, cidade_id from cidades_ref) group by 1")(
    lambda s, d: records.city_ids(t(s, d, "cidades_ref").select(F.col("cidade_id").alias("id"), "nome", F.col("cidade_id").alias("ordem")))
)
query(
    "names_by_prefix",
    "with l as (select nome, min(bairro_id) as id from bairros_ref group by 1), n as (select distinct left(nome, 4 + bairro_id % 9) as nome from bairros_ref) select n.nome, coalesce(l.id, (select min(x.id) from l x where starts_with(x.nome, n.nome))) as id from n left join l on l.nome = n.nome",
)(
    lambda s, d: discovery.with_prefix(
        t(s, d, "bairros_ref").select(F.expr("left(nome, 4 + bairro_id % 9)").alias("nome")).distinct(), t(s, d, "bairros_ref").groupBy("nome").agg(F.min("bairro_id").alias("id")).withColumn("ordem", F.col("id"))
    )
)
query(
    "template_repair",
    "select campo, count(*) as n from (select 'preco' as campo union all select 'tipo') group by 1",
)(
    lambda s, d: learning.repaired(
        t(s, d, "fontes").select(F.lit(1).alias("site"), F.col("id").alias("url"), F.explode(F.array(*(F.struct(F.lit(c).alias("campo"), F.lit(v).alias("valor")) for c, v in (("preco", "R$ 250.000,00"), ("bairro", "Apartamento"), ("tipo", "Casa"), ("vagas", "120"))))).alias("c")).select("site", "url", "c.*"),
        s.createDataFrame([(1, c, "p") for c in ("preco", "bairro", "tipo", "vagas")], "site int, campo string, seletor string"),
    ).groupBy("campo").agg(F.count("*").alias("n"))
)


# every snapshot against the one before: the SQL of the first two, for each pair of the four
for _name in ("snapshot_sync", "sync_counts", "disable_missing", "delta_counts", "compare_overlap", "exclusive_urls"):
    _sql = {**tables.ORACLE, **extract.ORACLE}[_name]
    _steps = [_sql.replace("snapshot_no = 2", f"snapshot_no = -{b}").replace("snapshot_no = 1", f"snapshot_no = {b - 1}").replace(f"= -{b}", f"= {b}") for b in (2, 3, 4)]
    ORACLE[f"{_name}_all"] = " union all ".join(f"select {b}::int as snapshot_no, * from ({x})" for b, x in zip((2, 3, 4), _steps))
