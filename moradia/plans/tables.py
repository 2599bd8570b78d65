"""Queries of search, dashboards and table changes, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moradia.operators import compare, merge, quality, search
from moradia.operators.snapshots import MOST_SNAPSHOTS
from moradia.session import small_rows
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


LIST = ", ".join(f"i.{c}" for c in search.LISTING) + ", i.fonte_id, f.nome as fonte_nome, f.url as fonte_url"
JOIN = "from imoveis i left join fontes f on f.id = i.fonte_id"
FULL = search.Filters(q="centro", tipo="apartamento", preco_min=100_000, preco_max=900_000, area_min=30, quartos=2, ordenar="preco_asc", page=2)
FULL_SQL = "i.disponivel and (i.titulo ilike '%centro%' or i.bairro ilike '%centro%' or i.cidade ilike '%centro%') and i.tipo ilike 'apartamento' and i.preco >= 100000 and i.preco <= 900000 and i.area_m2 >= 30 and i.quartos >= 2"


def _search(f):  # noqa: ANN001, ANN202
    return lambda s, d: search.search(table(s, d, "imoveis"), table(s, d, "fontes"), f)


query("search_page", f"select {LIST} {JOIN} where {FULL_SQL} order by i.preco asc nulls last, i.created_at desc nulls first, i.id limit 12 offset 12")(_search(FULL))
query("search_recent", f"select {LIST} {JOIN} where i.disponivel order by i.created_at desc nulls first, i.id limit 12")(_search(search.Filters()))
query("search_price_desc_nulls_first", f"select {LIST} {JOIN} where i.disponivel and i.bairro ilike '%jardim%' order by i.preco desc nulls first, i.created_at desc nulls first, i.id limit 50")(
    _search(search.Filters(bairro="jardim", ordenar="preco_desc", page_size=50))
)
query("search_area_desc", f"select {LIST} {JOIN} where i.disponivel and i.transacao ilike 'venda' and i.cidade ilike '%pedra%' and i.vagas >= 1 order by i.area_m2 desc nulls first, i.created_at desc nulls first, i.id limit 12")(
    _search(search.request({"transacao": "venda", "cidade": "pedra", "vagas": "1", "ordenar": "area_desc", "page": "x"}))
)
query("search_total", f"select count(*) as total, cast(ceil(count(*) / 12.0) as bigint) as total_pages from imoveis i where {FULL_SQL}")(lambda s, d: search.search_total(table(s, d, "imoveis"), FULL))


@query("sources_with_counts", "select f.id, f.nome, f.status, (select count(*) from imoveis i where i.fonte_id = f.id) as total_imoveis from fontes f")
def sources_with_counts(s, d):  # noqa: ANN001, ANN201
    return search.sources_with_counts(table(s, d, "fontes"), table(s, d, "imoveis"))


@query(
    "cleanup_candidates",
    "select * from (select f.id, f.nome, f.status, (select count(*) from imoveis i where i.fonte_id = f.id) as total_imoveis from fontes f) where status = 'erro' or (status <> 'crawling' and total_imoveis = 0)",
)
def cleanup_candidates(s, d):  # noqa: ANN001, ANN201
    return search.cleanup_candidates(sources_with_counts(s, d))


@query(
    "favourites_toggle",
    "select user_id, cast(value as bigint) % 400 as imovel_id, count(*) as cliques from events where event_type is not null group by all having count(*) % 2 = 1",
)
def favourites_toggle(s, d):  # noqa: ANN001, ANN201
    clicks = table(s, d, "events").filter("event_type is not null").select("user_id", (F.floor("value").cast("bigint") % 400).alias("imovel_id"))
    return search.toggled(clicks, ["user_id", "imovel_id"])


ORACLE["favourites_toggle"] = ORACLE["favourites_toggle"].replace("cast(value as bigint)", "cast(floor(value) as bigint)")


@query(
    "favourites_nested",
    "with c as (" + ORACLE["favourites_toggle"] + ") select c.user_id, c.imovel_id, i.titulo, i.tipo, i.preco, f.nome as fonte_nome from c join imoveis i on i.id = c.imovel_id left join fontes f on f.id = i.fonte_id",
)
def favourites_nested(s, d):  # noqa: ANN001, ANN201
    out = search.favourites(favourites_toggle(s, d), table(s, d, "imoveis"), table(s, d, "fontes"))
    return out.select("user_id", "imovel_id", "imovel.*")


@query(
    "dashboard_stats",
    "select (select count(*) from imoveis) as imoveis, (select count(*) from imoveis where disponivel) as disponiveis, (select count(*) from fontes) as fontes, (select count(*) from fontes where ativa) as ativas, (select count(*) from fontes where status = 'erro') as com_erro",
)
def dashboard_stats(s, d):  # noqa: ANN001, ANN201
    return quality.dashboard(table(s, d, "imoveis"), table(s, d, "fontes"))


PROFILE = """select fonte_id, count(*) as total, count(titulo) as com_titulo, count(tipo) as com_tipo, count(transacao) as com_transacao, count(cidade) as com_cidade,
  count(bairro) as com_bairro, count(preco) as com_preco, count(area_m2) as com_area_m2, count(quartos) as com_quartos,
  count(*) filter (length(descricao) > 10) as com_descricao, count(*) filter (len(imagens) > 0) as com_imagens,
  round(sum(preco)::double / count(preco), 0) as preco_medio, min(preco) as preco_min, max(preco) as preco_max,
  round(avg(quartos), 1) as quartos_medio, max(quartos) as quartos_max, round(sum(area_m2)::double / count(area_m2), 0) as area_media, max(area_m2) as area_max,
  count(*) filter (preco > 0 and preco < 500) as preco_baixo, count(*) filter (preco > 50000000) as preco_alto,
  count(*) filter (tipo in ('apartamento', 'casa', 'sobrado', 'cobertura', 'kitnet') and quartos is null) as sem_quartos
  from imoveis group by 1"""
query("quality_profile", PROFILE)(lambda s, d: quality.profile(table(s, d, "imoveis")))
query(
    "quality_score",
    f"""with p as ({PROFILE}), n as (select fonte_id, greatest(0, 100 - (case when com_preco / total < 0.5 then 20 when com_preco / total < 0.75 then 10 else 0 end)
  - (case when com_bairro / total < 0.8 then 15 else 0 end) - (case when com_tipo / total < 0.8 then 15 else 0 end)
  - (case when sem_quartos > 5 and sem_quartos / total > 0.2 then 15 when sem_quartos > 5 and sem_quartos / total > 0.05 then 5 else 0 end)
  - (case when com_descricao / total < 0.3 then 10 else 0 end) - (case when com_imagens / total < 0.3 then 5 else 0 end)) as nota from p)
  select fonte_id, cast(nota as integer) as nota, case when nota >= 90 then 'otimo' when nota >= 70 then 'bom' when nota >= 50 then 'regular' else 'ruim' end as faixa from n""",
)(lambda s, d: quality.score(quality.profile(table(s, d, "imoveis"))).select("fonte_id", "nota", "faixa"))
query(
    "top_kinds",
    "select fonte_id, tipo, n, posicao from (select fonte_id, tipo, count(*) as n, cast(row_number() over (partition by fonte_id order by count(*) desc, tipo) as integer) as posicao from imoveis where tipo is not null group by 1, 2) where posicao <= 12",
)(lambda s, d: quality.top_kinds(table(s, d, "imoveis")))
query("transaction_counts", "select fonte_id, coalesce(transacao, 'NULL') as transacao, count(*) as n from imoveis group by 1, 2")(lambda s, d: quality.transactions(table(s, d, "imoveis")))
query("transaction_maps", None)(lambda s, d: quality.transaction_maps(table(s, d, "imoveis")))
query("missing_by_kind", "select tipo, count(*) as faltam from imoveis where quartos is null group by 1")(lambda s, d: quality.missing_by_kind(table(s, d, "imoveis"), "quartos"))
query(
    "completeness",
    "select concat_ws('+', case when coalesce(preco > 0, false) then null else 'preco' end, case when coalesce(tipo, '') = '' then 'tipo' end, case when coalesce(bairro, '') = '' and coalesce(cidade, '') = '' then 'local' end) as faltam, count(*) as n from imoveis group by 1",
)(lambda s, d: quality.completeness(table(s, d, "imoveis")))
query(
    "filled_fields",
    "select cast(coalesce((preco > 0)::int, 0) + coalesce((area_m2 > 0)::int, 0) + coalesce((quartos > 0)::int, 0) + coalesce((banheiros > 0)::int, 0) + (coalesce(titulo, '') <> '')::int + (coalesce(tipo, '') <> '')::int + (coalesce(bairro, '') <> '')::int as integer) as preenchidos, count(*) as n from imoveis group by 1",
)(lambda s, d: quality.filled_fields(table(s, d, "imoveis")))
query("rooms_equal_baths", "select fonte_id, count(*) filter (quartos = banheiros) as iguais, round(count(*) filter (quartos = banheiros) * 100.0 / count(*), 1) as pct from imoveis group by 1")(
    lambda s, d: quality.contaminated(table(s, d, "imoveis"))
)
query("suspicious_rooms", "select quartos, count(*) as n from imoveis where quartos in (0, 44, 99, 999, -1) group by 1")(
    lambda s, d: table(s, d, "imoveis").filter(F.col("quartos").isin(0, 44, 99, 999, -1)).groupBy("quartos").agg(F.count("*").alias("n"))
)
query("top_hoods", "select bairro, count(*) as n from imoveis where bairro is not null group by 1 order by n desc, bairro limit 10")(
    lambda s, d: table(s, d, "imoveis").filter("bairro is not null").groupBy("bairro").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bairro").limit(10)
)
query("sample_by_source", None)(lambda s, d: quality.samples(table(s, d, "imoveis")))
query(
    "crawl_summary",
    """with h as (select *, case when regexp_matches(elapsed_s, '^\\s*[0-9]+(\\.[0-9]+)?\\s*(s|min)\\s*$') then try_cast(regexp_extract(elapsed_s, '([0-9]+(?:\\.[0-9]+)?)', 1) as double) * case when elapsed_s like '%min%' then 60 else 1 end end as seg from crawl_history)
  select fonte_id, count(*) as execucoes, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'erro') as erro, cast(coalesce(sum(urls_found), 0) as bigint) as urls, cast(coalesce(sum(enriched), 0) as bigint) as enriquecidos,
  cast(floor(coalesce(sum(urls_found), 0) / count(*)) as bigint) as urls_media, round(coalesce(sum(enriched), 0) * 100.0 / greatest(coalesce(sum(urls_found), 0), 1), 1) as pct, round(sum(seg), 1) as segundos from h group by 1""",
)(lambda s, d: quality.crawl_summary(table(s, d, "crawl_history")))
query("phase_times", "select fonte_id, e.key as fase, cast(sum(e.value) as bigint) as ms from (select fonte_id, unnest(map_entries(phase_times)) as e from crawl_history) group by 1, 2")(
    lambda s, d: quality.phase_times(table(s, d, "crawl_history"))
)

# merge: what one advert delivered first is stored, its later rows are the batch
FIRST = "select * exclude (rn) from (select *, row_number() over (partition by url_anuncio order by id) as rn from imoveis) where rn = 1"
LATER = "select * exclude (rn) from (select *, row_number() over (partition by url_anuncio order by id) as rn from imoveis) where rn > 1"


def _stored_and_batch(s, d):  # noqa: ANN001, ANN202
    rows = table(s, d, "imoveis")
    first = rows.groupBy("url_anuncio").agg(F.min("id").alias("id"))
    return rows.join(first.select("id"), "id", "left_semi"), rows.join(first.select("id"), "id", "left_anti")


FIELDS = "titulo tipo transacao cidade bairro estado preco area_m2 descricao".split()
FOLD = (
    f"with l as ({LATER}), b as (select url_anuncio, "
    + ", ".join(f"arg_max({c}, id) filter ({c} is not null) as {c}" for c in FIELDS)
    + ", max(struct_pack(i := id, v := quartos)).v as quartos, max(struct_pack(i := id, v := banheiros)).v as banheiros, max(struct_pack(i := id, v := vagas)).v as vagas from l group by 1)"
)
SHOWN = ["url_anuncio", *FIELDS, "quartos", "banheiros", "vagas"]
query("batch_folded", f"{FOLD} select {', '.join(SHOWN)} from b")(lambda s, d: merge.folded(_stored_and_batch(s, d)[1], "id").select(*SHOWN))


def _upsert(policy):  # noqa: ANN001, ANN202
    def run(s, d):  # noqa: ANN001, ANN202
        stored, batch = _stored_and_batch(s, d)
        return merge.upsert(stored, merge.folded(batch, "id"), policy).select(*SHOWN, "disponivel", "status")

    return run


query(
    "upsert_coalesce",
    f"{FOLD}, f as ({FIRST}) select f.url_anuncio, {', '.join(f'coalesce(b.{c}, f.{c}) as {c}' for c in FIELDS)}, {', '.join(f'case when b.url_anuncio is null then f.{c} else b.{c} end as {c}' for c in ('quartos', 'banheiros', 'vagas'))}, case when b.url_anuncio is null then f.disponivel else true end as disponivel, case when b.url_anuncio is null then f.status else 'ativo' end as status from f left join b on b.url_anuncio = f.url_anuncio",
)(_upsert("coalesce"))
query(
    "upsert_overwrite",
    f"{FOLD}, f as ({FIRST}) select f.url_anuncio, {', '.join(('f.transacao' if c == 'transacao' else f'case when b.url_anuncio is null then f.{c} else b.{c} end') + f' as {c}' for c in (*FIELDS, 'quartos', 'banheiros', 'vagas'))}, case when b.url_anuncio is null then f.disponivel else true end as disponivel, f.status from f left join b on b.url_anuncio = f.url_anuncio",
)(_upsert("overwrite"))
STORED = "select url_anuncio, status, disponivel from (select *, row_number() over (partition by url_anuncio order by linha_id) rn from imoveis_snapshots where snapshot_no = 1) where rn = 1"


def _snapshots(s, d):  # noqa: ANN001, ANN202
    snap = table(s, d, "imoveis_snapshots")
    return merge.first_by(snap.filter("snapshot_no = 1").select("url_anuncio", "status", "disponivel", "linha_id", "titulo"), "url_anuncio", "linha_id"), snap.filter("snapshot_no = 2").select("url_anuncio")


query(
    "snapshot_sync",
    f"with s as ({STORED}), v as (select distinct url_anuncio from imoveis_snapshots where snapshot_no = 2), m as (select s.*, v.url_anuncio is not null as visto, v.url_anuncio is not null and coalesce(s.status <> 'ativo', false) as reativado from s left join v using (url_anuncio)) select url_anuncio, case when not visto then 'possivelmente_vendido' when reativado then 'ativo' else status end as status, case when not visto then false when reativado then true else disponivel end as disponivel, reativado, not visto as vendido from m",
)(lambda s, d: merge.synced(*_snapshots(s, d)).select("url_anuncio", "status", "disponivel", "reativado", "vendido"))
query("sync_counts", f"with m as ({ORACLE['snapshot_sync']}) select count(*) filter (reativado) as reativados, count(*) filter (vendido) as vendidos from m")(
    lambda s, d: merge.synced(*_snapshots(s, d)).agg(F.count_if("reativado").alias("reativados"), F.count_if("vendido").alias("vendidos"))
)
query("disable_missing", f"with s as ({STORED}) select url_anuncio from s where disponivel and url_anuncio not in (select url_anuncio from imoveis_snapshots where snapshot_no = 2)")(
    lambda s, d: merge.disabled_missing(*_snapshots(s, d)).select("url_anuncio")
)
query(
    "delta_counts",
    "with s as (select distinct url_anuncio from (select *, row_number() over (partition by url_anuncio order by linha_id) rn from imoveis_snapshots where snapshot_no = 1) where rn = 1 and titulo is not null), v as (select distinct url_anuncio from imoveis_snapshots where snapshot_no = 2) select count(*) filter (s.url_anuncio is null) as novos, count(*) filter (s.url_anuncio is not null and v.url_anuncio is not null) as mantidos, count(*) filter (v.url_anuncio is null) as sumidos from s full join v on s.url_anuncio = v.url_anuncio",
)(lambda s, d: merge.delta_counts(*_snapshots(s, d)))


def _each(f):  # noqa: ANN001, ANN202
    """``f(stored, seen)`` for every snapshot against the one before, with the later one's ``snapshot_no``."""

    def run(s, d):  # noqa: ANN001, ANN202
        snap = table(s, d, "imoveis_snapshots").select("snapshot_no", "url_anuncio", "status", "disponivel", "linha_id", "titulo")
        numbers = sorted(r[0] for r in small_rows(snap.filter("snapshot_no is not null").select("snapshot_no").distinct(), MOST_SNAPSHOTS, "snapshots"))
        at = lambda k: snap.filter(F.col("snapshot_no") == k).drop("snapshot_no")
        steps = list(zip(numbers, numbers[1:])) or [(0, 0)]  # a single snapshot changes nothing
        out = [f(merge.first_by(at(a), "url_anuncio", "linha_id"), at(b).select("url_anuncio")).select(F.lit(b).cast("int").alias("snapshot_no"), "*") for a, b in steps]
        return reduce(DataFrame.unionByName, out) if len(numbers) > 1 else out[0].limit(0)

    return run


query("snapshot_sync_all")(_each(lambda a, b: merge.synced(a, b).select("url_anuncio", "status", "disponivel", "reativado", "vendido")))
query("sync_counts_all")(_each(lambda a, b: merge.synced(a, b).agg(F.count_if("reativado").alias("reativados"), F.count_if("vendido").alias("vendidos"))))
query("disable_missing_all")(_each(lambda a, b: merge.disabled_missing(a, b).select("url_anuncio")))
query("delta_counts_all")(_each(merge.delta_counts))
query("compare_overlap_all")(_each(lambda a, b: compare.winner(compare.overlap(a, b))))
query("exclusive_urls_all")(_each(compare.exclusive))
query("json_merge", """select event_id, json_merge_patch(props, '{"revisto":"sim"}')::varchar as config from events""")(
    lambda s, d: table(s, d, "events").select("event_id", merge.merged_json(F.col("props"), F.lit('{"revisto":"sim"}')).alias("config"))
)
query(
    "delete_cascade",
    "select (select count(*) from fontes where status <> 'erro') as fontes, (select count(*) from imoveis i where not exists (select 1 from fontes f where f.id = i.fonte_id and f.status = 'erro')) as imoveis",
)(lambda s, d: (lambda r: r[0].agg(F.count("*").alias("fontes")).crossJoin(r[1].agg(F.count("*").alias("imoveis"))))(merge.cascaded(table(s, d, "fontes").filter("status is not null"), table(s, d, "imoveis"), "id", "fonte_id", table(s, d, "fontes").filter("status = 'erro'"))))
query("stuck_reset", "select id, case when status = 'crawling' then 'pendente' else status end as status, coalesce(status = 'crawling', false) as solta from fontes")(lambda s, d: merge.unstuck(table(s, d, "fontes")).select("id", "status", "solta"))
query("dedupe_first", "select url_anuncio, min(id) as id, arg_min(fonte_id, id) as fonte_id from imoveis group by 1")(lambda s, d: merge.first_by(table(s, d, "imoveis").select("url_anuncio", "id", "fonte_id"), "url_anuncio", "id"))
query("dedupe_last", "select url_anuncio, max(id) as id, arg_max(fonte_id, id) as fonte_id from imoveis group by 1")(lambda s, d: merge.last_by(table(s, d, "imoveis").select("url_anuncio", "id", "fonte_id"), "url_anuncio", "id"))
