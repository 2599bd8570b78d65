"""The queries of the training-data problems that are tagged llm, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moradia.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.canonical import canonical_places

    return canonical_places(table(spark, d, "imoveis"), table(spark, d, "cidades_ref"), table(spark, d, "bairros_ref"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.residue import residue_cells

    return residue_cells(table(spark, d, "imoveis")).select("id", "campo")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.survivor import chosen

    return chosen(table(spark, d, "imoveis")).select("grupo_id", "descricao_id", "quartos_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.survivor import survivors

    return survivors(table(spark, d, "imoveis"))


def p3_late(spark: SparkSession, d: str) -> DataFrame:
    """The choice where late rows count as undated, so that the learned transitions decide."""
    from moradia.llm.survivor import chosen, with_doubtful_times

    return chosen(with_doubtful_times(table(spark, d, "imoveis"))).select("grupo_id", "descricao_id", "quartos_id", "preco_id", "status_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.same_item import same_item_groups, same_item_pairs

    return same_item_pairs(same_item_groups(table(spark, d, "imoveis"), table(spark, d, "cidades_ref"), table(spark, d, "bairros_ref")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.same_item import same_item_groups

    return same_item_groups(table(spark, d, "imoveis"), table(spark, d, "cidades_ref"), table(spark, d, "bairros_ref")).select("id", "anuncio", "estrela")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.same_item import same_item_links

    return same_item_links(table(spark, d, "imoveis"), table(spark, d, "cidades_ref"), table(spark, d, "bairros_ref"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.packing import pack

    return pack(table(spark, d, "documents"), table(spark, d, "recipientes")).filter("dividido").select("recipiente_id", "doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.packing import fill_report, pack

    return fill_report(pack(table(spark, d, "documents"), table(spark, d, "recipientes")), table(spark, d, "recipientes"))


def p7_vector(spark: SparkSession, d: str) -> DataFrame:
    """The containers where all three limits bind: tokens, at most eight texts, loss on at most two thirds of the tokens (all but the first line)."""
    from moradia.llm.packing import body_size, fill_report, pack

    docs = table(spark, d, "documents")
    limits = {"segments": 8, "loss_share": 2 / 3}
    return fill_report(pack(docs, table(spark, d, "recipientes"), loss=body_size(F.coalesce("text", F.lit(""))), **limits), table(spark, d, "recipientes"), **limits)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.leaks import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "aval_itens")).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from moradia.llm.sentences import sentences

    return sentences(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_records": p3_records, "p3_late": p3_late, "p4_found": p4_found, "p4_groups": p4_groups, "p4_links": p4_links, "p7_found": p7_found, "p7_fill": p7_fill, "p7_vector": p7_vector, "p8_found": p8_found, "p9_found": p9_found}
ORACLE: dict[str, str] = {
    "p7_found": """
  select distinct r.recipiente_id, d.doc_id from documents d, recipientes r where octet_length(encode(coalesce(d.text, ''))) + 1 > r.capacidade""",
}
