import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moradia.functions import html, text, urls
from moradia.functions.names import edits, fold, nothing_known, readings, repair
from moradia.functions.pages import page_key
from moradia.operators import merge, search, state
from moradia.operators.impute import fill_missing, filled_with_mask
from moradia.operators.snapshots import snapshot_changes, with_old_values
from moradia.session import TooLarge, small_rows


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        (" //WWW.Ab.com:443//x//y/?utm_a=1&b=2&a=1#z", "ab.com/x/y?a=1&b=2"), ("HTTPS://ab.com/X", "ab.com/X"), ("http://ab.com", "ab.com"), ("ab.com/", "ab.com"), ("", None), ("  ", None), (None, None),
        ("https://h.example/imovel?utm_source=feed&code=1", "h.example/imovel?code=1"), ("https://h.example/i?fbclid=a1", "h.example/i"),
    ],
)
def test_page_key(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(page_key(F.col("u"))).first()[0] == key


def test_names():
    assert fold("  São-Luiz! ") == "sao luiz" and repair("VialponÃ£ &ccedil;") == "Vialponã ç"
    assert nothing_known("N/I") and nothing_known(None) and nothing_known("--") and not nothing_known("Centro")
    assert edits("centro", "cnetro", 2) == 0.8 and edits("centro", "centrro", 2) == 0.8 and edits("a", "abcd", 2) > 2 and edits("", "", 1) == 0
    assert [w for _, w in readings("Santa X / Josetim - PR")][-1] == ["josetim"] and readings("") == []


def test_location(spark):
    assert tuple(one(spark, urls.location(F.lit("https://a.b/imovel/casa/caxias-do-sul/charqueadas/18432")))) == ("Charqueadas", "Caxias Do Sul")
    assert tuple(one(spark, urls.location(F.lit("https://a.b/imovel/Apartamento/Pio-X/Caxias-do-Sul/RS/3455")))) == ("Pio X", "Caxias Do Sul")


def test_template(spark):
    assert one(spark, urls.template(F.lit("https://a.b/l?pg=1&x=9"), F.lit("https://a.b/l?pg=2&x=9"))) == "https://a.b/l?pg={N}&x=9"
    assert one(spark, urls.template(F.lit("https://a.b/1/1"), F.lit("https://a.b/2/2"))) is None


def test_text(spark):
    t = "Casa à venda R$ 1.234.567,89 - 450 m² privativos, 3 quartos, 2 banheiros e 1 vaga"
    assert one(spark, text.price(F.lit(t))) == 1234567.89
    assert one(spark, text.area(F.lit("12 m² x"))) == 12 and one(spark, text.area(F.lit("salão comum de condomínio de 200 m². " + "x" * 60 + " área privativa de 80 m²"))) == 80
    assert one(spark, text.kind(F.lit(""), F.lit("linda casa de cômodo"))) == "casa"
    assert one(spark, text.transaction(F.lit("https://x/aluguel/1"), F.lit(""), F.lit(""))) == "aluguel"
    assert one(spark, text.place(F.lit("Loja para comprar no bairro CENTRO em Caxias do Sul - COD. 3698"))) == "CENTRO"
    assert one(spark, text.place(F.lit("Casa"))) is None and one(spark, text.place(F.lit(""))) is None
    assert one(spark, text.any_price(F.lit("R$ 450.000"))) == 450000
    assert one(spark, text.brl_short(F.lit(1_250_000).cast("decimal(18,2)"))) == "R$1.3M"


def test_html():
    page = "<html><title>T</title><script type='application/ld+json'>{\"@type\":\"Product\",\"name\":\"N\",\"offers\":{\"price\":\"10\"}}</script><script>x='</p>'</script><p>um<p>dois</b><img data-src=/a.jpg><a href=/i>v"
    title, h1, og, body, links, images, ld, island, told = html.read(page)
    assert (title, h1, links, images) == ("T", None, ["/i"], ["/a.jpg"]) and "um dois" in body
    assert html.item_of(ld)["titulo"] == "N" and html.item_of(["{"]) is None and html.item_of(None) is None
    assert html.read(None) == (None,) * 9 and html.read("")[3] == ""
    assert html.island_rows('{"a":[{"id":1,"title":"x"},{"id":2,"title":"y"}]}')[1][:2] == ("2", "y") and html.island_rows("[") == []


def test_soft_404(spark):
    assert one(spark, html.soft_404(F.lit("Erro 404"))) and not one(spark, html.soft_404(F.lit("cdn/10404/x")))


def test_request():
    f = search.request({"preco_min": "1.500", "preco_max": "x", "page": "0", "ordenar": "?"})
    assert f.preco_min == 1500 and f.preco_max == 0 and f.page == 1 and f.ordenar == "relevante"
    assert search.local_number("1.5") == 15 and search.pages_shown(5, 9) == [1, 3, 4, 5, 6, 7, 9]


def test_upsert_is_idempotent(spark):
    cols = "url_anuncio string, titulo string, tipo string, transacao string, cidade string, bairro string, estado string, preco double, area_m2 double, descricao string, quartos int, banheiros int, vagas int, imagens array<string>, fonte_id string, created_at string, disponivel boolean, status string, n int"
    rows = spark.createDataFrame([("u", "a", "casa", "venda", None, None, None, 1.0, None, None, 2, 1, None, ["i"], "f", "t", True, "ativo", 1)], cols)
    batch = merge.folded(spark.createDataFrame([("u", None, "sobrado", None, None, None, None, None, 5.0, None, None, 2, None, [], "g", "s", None, None, 1), ("v", "b", None, None, None, None, None, None, None, None, None, None, None, None, "g", "s", None, None, 2)], cols), "n")
    once = merge.upsert(rows, batch)
    got = {r.url_anuncio: r for r in once.collect()}
    assert got["u"].titulo == "a" and got["u"].tipo == "sobrado" and got["u"].quartos is None and got["u"].imagens == ["i"] and got["u"].fonte_id == "f"
    assert got["v"].status == "ativo" and sorted(map(str, merge.upsert(once, batch).collect())) == sorted(map(str, once.collect()))


SNAP = "linha_id long, snapshot_no int, fonte_id string, url_anuncio string, titulo string, preco decimal(18,2), disponivel boolean, status string, capturado_em timestamp, recebido_em timestamp"


def test_snapshots(spark):
    t = lambda h: dt.datetime(2025, 1, 1, h)
    rows = [
        (1, 1, "f", "http://a/1", "x", None, True, "ativo", t(1), None), (2, 1, "f", "http://a/2", "x", None, True, None, t(1), None), (3, 1, "f", "http://a/2/", "x", None, False, None, t(2), None),
        (4, 1, "g", "http://b/1", "x", None, True, "ativo", t(1), None), (5, 2, "f", "https://a/1#p", "y", None, True, "ativo", t(3), None), (6, 2, "f", "http://a/3", "x", None, True, "ativo", t(3), None),
        (7, 3, "g", "http://b/1", "x", None, None, "ativo", t(4), None), (8, 3, None, "http://b/1", None, None, None, None, None, None), (9, 3, "f", None, None, None, None, None, None, None), (7, 3, "g", "http://b/1", "x", None, None, "ativo", t(4), None),
    ]
    snap = spark.createDataFrame(rows, SNAP).withColumn("k1", F.lit(0))
    out = snapshot_changes(snap)
    assert sorted((r[0], r[1], r[2]) for r in out.collect()) == [(2, 3, "removido"), (2, 6, "adicionado"), (3, 7, "alterado")]
    assert with_old_values(out, snap).filter("linha_id = 7").first()["disponivel_antes"] is True
    assert snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0


def test_filling(spark):
    cols = "id long, created_at timestamp, caracteristicas string, quartos int, banheiros int, vagas int, bairro string, cidade string, n_quartos int"
    info = '{"cod_condominio": "C1", "planta": "A"}'
    t = dt.datetime(2025, 1, 1)
    rows = [(1, t, info, 3, None, 99, "Centro", "X", 0), (2, t, info, 3, 1, 1, "centro", "X", 0), (3, None, info, None, 2, 1, "N/I", "X", 0), (4, t, None, None, None, None, None, None, 0), (5, t, '{"planta": "A"}', None, 1, 1, None, None, 0), (6, t, "{", None, 1, 1, None, None, 0)]
    hoods = spark.createDataFrame([(1, 1, "Centro", []), (2, 1, "Jardim Alto", None)], "bairro_id int, cidade_id int, nome string, outros_nomes array<string>")
    cities = spark.createDataFrame([(1, "X", "SP", [])], "cidade_id int, nome string, estado string, outros_nomes array<string>")
    df = spark.createDataFrame(rows, cols)
    got = {(r.id, r.campo): (r.valor, r.concordam) for r in fill_missing(df, hoods, cities).collect()}
    assert got[3, "quartos"] == ("3", True) and got[1, "vagas"] == ("1", True) and got[3, "bairro"] == ("Centro", True) and not got[1, "banheiros"][1] and not {4, 5, 6} & {i for i, _ in got}
    masked = {r.id: r for r in filled_with_mask(df.withColumn("tipo", F.lit(None).cast("string")), hoods, cities).collect()}
    assert masked[3].quartos == 3 and masked[3].preenchido["quartos"] and not masked[2].preenchido["quartos"]
    assert fill_missing(spark.createDataFrame([], cols), hoods, cities).count() == 0


def test_breaker_matches_fold(spark):
    rows = [("d", i, i, i % 11 == 0, i % 5 != 0 and i % 11 != 0) for i in range(60)]
    df = spark.createDataFrame(rows, "d string, t int, seq int, ok boolean, falha boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.seq: r.seguidas for r in state.breaker(df, "d", "ts", "seq", F.col("ok"), F.col("falha")).collect()}
    n = 0
    for _, _, i, ok, bad in rows:
        n = 0 if ok else n + bad
        assert got[i] == n


def test_breaker_stream(spark, tmp_path):
    from moradia.streaming.state import breaker_stream

    rows = [("d", dt.datetime(2025, 1, 1, 0, 0, i), i, i == 3, i != 3) for i in range(14)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "dominio string, ts timestamp, seq long, ok boolean, falha boolean").coalesce(1).write.parquet(src)
    stream = breaker_stream(spark.readStream.schema("dominio string, ts timestamp, seq long, ok boolean, falha boolean").parquet(src))
    q = stream.writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.table("breaker").toPandas().sort_values("seq")
    assert list(out["seguidas"]) == [1, 2, 3, 0, *range(1, 11)] and out["aberto_ate"].notna().sum() == 3
    assert isinstance(out, pd.DataFrame)


def test_size_guard(spark):
    with pytest.raises(TooLarge):
        small_rows(spark.range(10), 5, "numbers")


def test_queries_over_all_rows(spark, tmp_path):
    from moradia.plans import extract

    data = [
        (1, "http://a.example/imovel/77", "f", None, "casa", "Centro", "Josetim"), (2, "http://www.b.example/contato/12", "g", " ", None, "Centro", None), (3, "http://www.b.example/a/b/casa-12", "g", " Bela ", "sala", None, None),
        (4, "http://www.b.example/imovel/5", "f", "x", "loja", None, None), (5, None, "h", None, "galpao", None, None),
    ]
    numbers = [F.lit(None).cast(t).alias(c) for c, t in (("preco", "double"), ("area_m2", "double"), ("quartos", "int"), ("banheiros", "int"), ("vagas", "int"))]
    spark.createDataFrame(data, "id long, url_anuncio string, fonte_id string, titulo string, tipo string, bairro string, cidade string").select("*", *numbers).write.parquet(f"{tmp_path}/imoveis.parquet")
    spark.createDataFrame([("f", "http://a.example"), ("g", "http://b.example/")], "id string, url string").write.parquet(f"{tmp_path}/fontes.parquet")
    got = lambda name: dict(map(tuple, extract.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got("generated_titles_all") == {1: "Casa em Centro, Josetim", 2: None, 3: "Bela", 4: "x", 5: None}
    assert got("url_detail_own_source") == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert got("missing_expected") == {1: "preco,quartos,banheiros,area_m2", 2: "", 3: "preco,bairro,cidade,area_m2", 4: "", 5: ""}


def test_areas_side_by_side(spark):
    near = "condominio com 5000 m2 de lazer, empreendimento novo de alto padrao, apto com 82 m2 de area privativa"
    assert one(spark, text.area(F.lit(near))) == 82 and one(spark, text.area(F.lit("total 120 m², útil 90 m²"))) == 120
    assert one(spark, text.area(F.lit("lote de 300 m²" + " x" * 40 + " área útil 12m2, 15 m2 e 60m²"))) == 60
    assert one(spark, text.area(F.lit("sem nada"))) is None and one(spark, text.area(F.lit(None).cast("string"))) is None


def test_admitted_requests_of_one_busy_source(spark):
    """Sixty thousand requests of one source are folded in their order, each step at the same cost."""
    from moradia.operators.records import admitted

    n = 60_000
    rows = spark.range(n).select(F.lit("f").alias("fonte_id"), F.col("id").alias("pedido_id"), F.timestamp_seconds(F.col("id") * 10).alias("em"), F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.col("id") * 10 + 25)).alias("termino"))
    began, until, want = time.perf_counter(), -1, 0
    for k in range(n):
        if k * 10 >= until:
            until, want = k * 10 + (25 if k % 2 == 0 else 1800), want + 1
    got = admitted(rows)
    assert (got.count(), got.filter("aceito").count()) == (n, want)
    assert time.perf_counter() - began < 30


def test_admitted_requests_without_a_time_or_before_1970(spark):
    from moradia.operators.records import admitted

    data = [("a", 1, -500, -400), ("a", 2, -450, None), ("a", 3, -400, None), ("a", 4, None, None), (None, 5, 10, 20), (None, 6, 15, None), (None, 7, 20, None)]
    rows = spark.createDataFrame(data, "fonte_id string, pedido_id long, a long, b long").select("fonte_id", "pedido_id", F.timestamp_seconds("a").alias("em"), F.timestamp_seconds("b").alias("termino"))
    assert {r.pedido_id: r.aceito for r in admitted(rows).collect()} == {1: True, 2: False, 3: True, 4: None, 5: True, 6: False, 7: True}
