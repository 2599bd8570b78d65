"""The queries of the training-data problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moradia.operators.impute import fill_all, fill_missing
from moradia.operators.snapshots import snapshot_changes, with_old_values
from moradia.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = fill_missing(table(spark, d, "imoveis"), table(spark, d, "bairros_ref"), table(spark, d, "cidades_ref"))
    # the exact check: the group agrees, and the prediction is the value agreed upon
    return cells.filter(F.col("concordam") & (F.col("valor") == F.col("unico")) & ~F.col("valor").startswith("?")).select("id", "campo", "valor")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "imoveis_snapshots")).select("snapshot_no", "linha_id", "mudanca")


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every missing cell of all rows with what the model puts there."""
    return fill_all(table(spark, d, "imoveis"), table(spark, d, "bairros_ref"), table(spark, d, "cidades_ref"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Every change with the values before and after."""
    rows = table(spark, d, "imoveis_snapshots")
    return with_old_values(snapshot_changes(rows), rows)


QUERIES = {"p5_found": p5_found, "p5_filled": p5_filled, "p6_found": p6_found, "p6_values": p6_values}
#: The page of an address, in SQL.
PAGE = r"""
  with a as (select linha_id, snapshot_no, fonte_id, disponivel, preco, status, capturado_em,
                    regexp_replace(regexp_replace(regexp_replace(url_anuncio, '\s', '', 'g'), '#.*$', ''), '^(?:https?:)?/*', '', 'i') as u
             from imoveis_snapshots where trim(url_anuncio) <> ''),
       b as (select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') as host,
                    regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/{2,}', '/', 'g'), '/$', '') as path,
                    list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'),
                                lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|sessao|origem)(=|$)', 'i')) as args from a),
       k as (select *, host || path || case when len(args) > 0 then '?' || array_to_string(list_sort(args), '&') else '' end as pagina from b)
"""
FOUND = (
    PAGE
    + """
     , r as (select * exclude (n) from (select *, row_number() over (partition by snapshot_no, fonte_id, pagina order by capturado_em desc nulls last, linha_id desc) n from k) where n = 1),
       s as (select distinct fonte_id, snapshot_no from r),
       c as (select fonte_id, snapshot_no, lag(snapshot_no) over (partition by fonte_id order by snapshot_no) antes from s)
  select n.snapshot_no, n.linha_id,
         case when o.linha_id is null then 'adicionado' else 'alterado' end as mudanca
  from r n join c on c.fonte_id = n.fonte_id and c.snapshot_no = n.snapshot_no and c.antes is not null
       left join r o on o.fonte_id = n.fonte_id and o.snapshot_no = c.antes and o.pagina = n.pagina
  where o.linha_id is null or o.disponivel is distinct from n.disponivel or o.preco is distinct from n.preco or o.status is distinct from n.status
  union all
  select c.snapshot_no, o.linha_id, 'removido'
  from c join r o on o.fonte_id = c.fonte_id and o.snapshot_no = c.antes
       left join r n on n.fonte_id = c.fonte_id and n.snapshot_no = c.snapshot_no and n.pagina = o.pagina
  where n.linha_id is null"""
)
VALUES = ", ".join(f"{a}.{c} as {c}_{n}" for a, n in (("o", "antes"), ("n", "depois")) for c in ("disponivel", "preco", "status"))
ORACLE: dict[str, str] = {
    "p6_found": FOUND,
    "p6_values": FOUND.replace("as mudanca\n", f"as mudanca, {VALUES}\n").replace("'removido'\n", f"'removido', {VALUES}\n"),
}
