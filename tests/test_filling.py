"""The filling model against hidden cells, and the snapshot index over several runs."""

import random
from datetime import datetime

import pytest

from moradia.operators import impute, snapshots

HOODS = [(1, 1, "Centro", None), (2, 1, "Lourdes", None), (3, 2, "Centro", None), (4, 2, "Bela Vista", None)]
CITIES = [(1, "Caxias do Sul", "RS", None), (2, "Gramado", "RS", None)]
SCHEMA = "id bigint, created_at timestamp, tipo string, caracteristicas string, quartos int, banheiros int, vagas int, bairro string, cidade string, id_ int"


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(HOODS, "bairro_id int, cidade_id int, nome string, outros_nomes array<string>"), spark.createDataFrame(CITIES, "cidade_id int, nome string, estado string, outros_nomes array<string>")


def world(n=1500, seed=5):
    """Rows whose counts depend on kind, place and group, and whose neighbourhood depends on group, city and month."""
    r = random.Random(seed)
    out, truth = [], {}
    groups = [(f"c{k}", f"p{k}", r.choice(["casa", "apartamento"]), *r.choice([(1, "Caxias do Sul", "Centro"), (1, "Caxias do Sul", "Lourdes"), (2, "Gramado", "Bela Vista")]), r.randint(1, 5)) for k in range(150)]
    for i in range(n):
        month = r.randint(1, 6)
        if r.random() < 0.6:
            cod, planta, tipo, _, city, hood, q = r.choice(groups)
            info = f'{{"cod_condominio": "{cod}", "planta": "{planta}"}}'
            q = q if r.random() < 0.9 else q + 1
        else:
            tipo, info = r.choice(["casa", "apartamento", "terreno"]), None
            city = r.choice(["Caxias do Sul", "Gramado"])
            hood = ("Centro" if (month <= 3) == (r.random() < 0.9) else "Lourdes") if city == "Caxias do Sul" else r.choice(["Centro", "Bela Vista", "Bela Vista"])
            q = {"casa": 4, "apartamento": 2, "terreno": None}[tipo]
            q = q and q + (hood == "Centro") + (r.random() < 0.2)
        row = [i, datetime(2024, month, 3), tipo, info, q, q and 1, q and 1, hood, city, 0]
        for field, at in (("quartos", 4), ("bairro", 7)):
            if row[at] is not None and r.random() < 0.15:
                truth[i, field] = str(row[at])
                row[at] = None
        out.append(tuple(row))
    return out, truth


def test_hidden_cells_are_met_better_than_by_mean_or_mode(spark, refs):
    rows, truth = world()
    got = {(r.id, r.campo): r.valor for r in impute.fill_all(spark.createDataFrame(rows, SCHEMA), *refs).collect()}
    assert set(truth) <= set(got)
    known = [r[4] for r in rows if r[4] is not None]
    mean = sum(known) / len(known)
    error = lambda f: sum((f(k) - float(v)) ** 2 for k, v in truth.items() if k[1] == "quartos")
    assert error(lambda k: float(got[k])) < 0.3 * error(lambda k: mean)
    hits = lambda f: sum(f(k) == v for k, v in truth.items() if k[1] == "bairro")
    mode = {c: max({r[7] for r in rows if r[7]}, key=lambda h: sum(r[7] == h and r[8] == c for r in rows)) for c in ("Caxias do Sul", "Gramado")}
    assert hits(lambda k: got[k]) > 1.15 * hits(lambda k: mode[rows[k[0]][8]])


def test_kinds_without_rooms_empty_and_repeated_rows(spark, refs):
    rows = [(1, None, "terreno", None, None, None, None, "Centro", "Gramado", 0), (2, None, "loja", None, None, None, 2, "Centro", "Gramado", 0), (3, None, "loja", "no json", None, 1, None, None, None, 0), (3, None, "loja", "no json", None, 1, None, None, None, 0)]
    got = sorted(map(tuple, impute.fill_all(spark.createDataFrame(rows, SCHEMA), *refs).collect()))
    assert got == [(2, "banheiros", "1", "tipo"), (3, "vagas", "2", "tipo"), (3, "vagas", "2", "tipo")]
    assert impute.fill_all(spark.createDataFrame([], SCHEMA), *refs).count() == 0
    marked = impute.filled_with_mask(spark.createDataFrame(rows[:3], SCHEMA), *refs).orderBy("id").collect()
    assert [r.preenchido["vagas"] for r in marked] == [False, False, True] and [r.vagas for r in marked] == [None, 2, 2]


SNAP = "snapshot_no int, fonte_id string, url_anuncio string, linha_id bigint, capturado_em timestamp, disponivel boolean, preco decimal(18,2), status string"


def test_index_is_opened_probed_and_swapped(spark):
    day = [datetime(2024, 1, d) for d in range(1, 5)]
    rows = [(1, "f", "http://a/1", 1, day[0], True, None, "ativo"), (1, "f", "http://a/2", 2, day[0], True, None, "ativo"), (2, "f", "a/1/", 3, day[1], False, None, "ativo"), (2, "f", "http://a/3", 4, day[1], True, None, "ativo"), (2, "g", "http://b/1", 5, day[1], True, None, None)]
    slim = snapshots.counting_rows(spark.createDataFrame(rows, SNAP)).cache()
    part = lambda n: slim.filter(f"snapshot_no = {n}").select("fonte_id", "k1", "k2", "linha_id", "h")
    index = snapshots.SnapshotIndex(spark, 3)
    assert index.apply(part(1)).count() == 0 and index.rows().count() == 2
    later = snapshots.SnapshotIndex(spark, 3, index.path)  # another run opens what the first one left
    assert sorted(map(tuple, later.apply(part(2)).collect())) == [(2, "removido", 2), (3, "alterado", 1), (4, "adicionado", None)]
    assert later.rows().count() == 3
    met = snapshots.probe(later.rows(), part(2).repartition(3, "k1", "k2"))
    side = met._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in side
    changes = snapshots.snapshot_changes(spark.createDataFrame(rows, SNAP))
    got = snapshots.with_old_values(changes, spark.createDataFrame(rows, SNAP)).filter("mudanca = 'alterado'").first()
    assert (got.disponivel_antes, got.disponivel_depois) == (True, False)
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0
