"""Missing values filled from similar records (problem 5).

Counts are predicted by a model of nested mixed effects: mean of the kind, effect of the place shrunk by its evidence,
effect of the group (condominium and floor plan) shrunk towards its place, effect of the month. Categories come from a
multinomial of the group, smoothed towards that of the city, and where there is no group from that of city and month,
smoothed towards the city and then towards all rows. All of it rests on aggregates with map-side combine; no list of a
group's rows is ever held. Every filled cell is marked in a mask.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moradia.functions.names import Entry, Typed, fold, nothing_known, readings, score
from moradia.session import sized, small_rows, written

COUNTS = ("quartos", "banheiros", "vagas")
#: Most names of neighbourhoods that are broadcast.
MOST_NAMES = 100_000
#: Most months with an effect of their own.
MOST_MONTHS = 6_000
#: Most places or city months that are broadcast; beyond that they are joined by shuffle.
MOST_PLACES = 50_000
#: Kinds to which a count does not apply.
BARE = ("terreno", "lote")
NOT_LIVED_IN = (*BARE, "loja", "sala", "comercial", "galpao", "galpão", "pavilhao", "pavilhão", "box", "predio", "prédio")
DOES_NOT_APPLY = {"quartos": NOT_LIVED_IN, "banheiros": BARE, "vagas": BARE}
#: Rows that the multinomial of the wider level counts for: a city in its group, a city in its month, all rows in a city.
SMOOTH_GROUP, SMOOTH_MONTH, SMOOTH_CITY = 0.5, 5.0, 1.0


class NameReader:
    """The name of a list that a typed value means; the value itself, folded, after ``?`` if it names something else; None if it names nothing."""

    def __init__(self, names: list[tuple[str, list[str]]]) -> None:
        self.exact = {n for n, _ in names}
        self.entries = [(Entry(0, form, whole=form == n), n) for n, others in names for form in (n, *others) if fold(form)]
        self.folded = {e.full: n for e, n in reversed(self.entries)}
        self.single = [(e, n) for e, n in self.entries if not e.tail]
        self.by_length: dict[int, list[tuple[Entry, str]]] = {}
        for e, n in self.entries:
            for size in {len(e.full), len(e.tail)} - {0}:
                self.by_length.setdefault(size, []).append((e, n))
        self.known: dict[tuple[str, str], str | None] = {}

    def read(self, value: str | None, around: str = "") -> str | None:
        if value is None or value in self.exact:
            return value
        if (value, around) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[value, around] = self._read(value, around)
        return self.known[value, around]

    def _read(self, value: str, around: str) -> str | None:
        if nothing_known(value):
            return None
        best: tuple[float, str] = (9.0, "")
        for part, words in readings(value, around):
            q = Typed(words)
            if q.full in self.folded:
                best = min(best, (0.05 * (part > 0), self.folded[q.full]))
                continue
            letters = set(q.full)
            near = [x for s in {n + k for n in (len(q.full), len(q.tail)) for k in range(-2, 3)} for x in self.by_length.get(s, ())]
            for e, n in [*near, *self.single]:
                if len(letters & set(e.full)) * 2 >= len(letters) and (c := score(q, e)) < 9:
                    best = min(best, (c + 0.05 * (part > 0), n))
        return best[1] if best[0] < 9 else "?" + fold(value)


class PlaceReader:
    """Neighbourhoods read among those of the row's city; among all where the city is not known."""

    def __init__(self, hoods: list[tuple[str | None, str, list[str]]], cities: list[tuple[str, list[str]]]) -> None:
        self.cities = NameReader(cities)
        by_city: dict[str, list[tuple[str, list[str]]]] = {}
        for city, name, others in hoods:
            by_city.setdefault(city or "", []).append((name, others))
        self.hoods = {c: NameReader(h) for c, h in by_city.items()}
        self.all = NameReader([(n, o) for _, n, o in hoods])

    def read(self, bairro: str | None, cidade: str | None) -> str | None:
        if bairro is None:
            return None
        city = self.cities.read(cidade)
        return self.hoods.get(city or "", self.all).read(bairro, fold(city or "").replace(" ", ""))


def read_hoods(rows: DataFrame, hoods: DataFrame, cities: DataFrame, most_names: int = MOST_NAMES, towns_too: bool = False) -> DataFrame:
    """``rows`` with ``bairro`` read as a name of ``hoods``, and with ``towns_too`` ``cidade`` as one of ``cities``; names in no list start with ``?``."""
    places = hoods.select("cidade_id", "nome", "outros_nomes").filter("nome is not null")
    towns = cities.select("cidade_id", "nome", "outros_nomes").filter("nome is not null")
    names = {r[0]: (r[1], list(r[2] or [])) for r in small_rows(towns, most_names, "cities")}
    listed = [(names.get(r[0], (None, []))[0], r[1], list(r[2] or [])) for r in small_rows(places, most_names, "neighbourhoods")]
    shared = rows.sparkSession.sparkContext.broadcast((listed, list(names.values())))
    at = rows.columns.index("bairro"), rows.columns.index("cidade")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PlaceReader(*shared.value)
        for b in batches:
            values = [reader.read(v, c) for v, c in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist())]
            if towns_too:
                towns = [t if t is None or not t.startswith("?") else None for t in map(reader.cities.read, b.column(at[1]).to_pylist())]
                b = b.set_column(at[1], "cidade", pa.array(towns, pa.string()))
            yield b.set_column(at[0], "bairro", pa.array(values, pa.string()))

    return rows.mapInArrow(read, rows.schema)


def usable_count(c: str) -> Column:
    return F.when(F.col(c).between(1, 20), F.col(c))


def prepared(listings: DataFrame, hoods: DataFrame, cities: DataFrame) -> DataFrame:
    """The rows that belong to a group (``cod_condominio`` and ``planta`` both given), with unusable values as null."""
    info = F.from_json("caracteristicas", "cod_condominio string, planta string")
    rows = listings.select(F.col("id").cast("bigint").alias("id"), F.trunc("created_at", "month").alias("mes"), info.alias("i"), *COUNTS, "bairro", "cidade")
    rows = rows.select("id", "mes", F.col("i.cod_condominio").alias("cod"), F.col("i.planta").alias("planta"), *(usable_count(c).cast("int").alias(c) for c in COUNTS), "bairro", "cidade")
    return read_hoods(rows.filter(F.col("cod").isNotNull() & F.col("planta").isNotNull()), hoods, cities)


def group_evidence(rows: DataFrame) -> DataFrame:
    """For each group and field: how many values, the least and greatest, sum and sum of squares; for ``bairro`` the least and greatest name."""
    aggs = [F.count("*").alias("linhas")]
    for c in COUNTS:
        aggs += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"ss_{c}")]
    aggs += [F.count("bairro").alias("n_bairro"), F.min("bairro").alias("lo_bairro"), F.max("bairro").alias("hi_bairro")]
    return rows.groupBy("cod", "planta").agg(*aggs)


def components(evidence: DataFrame) -> dict[str, tuple[float, float, float]]:
    """For each count: overall mean, variance between groups and variance within groups (by moments)."""
    aggs = []
    for c in COUNTS:
        n, s, ss = (F.col(f"{k}_{c}").cast("double") for k in ("n", "s", "ss"))
        aggs += [F.sum(n), F.sum(s), F.sum(ss), F.sum(F.when(n > 0, ss - s * s / n)), F.sum(F.when(n > 0, n - 1)), F.count(F.when(n > 0, 1))]
    r = evidence.agg(*aggs).first()
    out = {}
    for k, c in enumerate(COUNTS):
        n, s, ss, within, df, groups = (float(x or 0) for x in r[6 * k : 6 * k + 6])
        if not n:
            out[c] = (0.0, 1.0, 1.0)
            continue
        mean, w = s / n, within / df if df else 0.0
        total = max(0.0, ss / n - mean * mean)
        out[c] = (mean, max(total - w, 1e-6), max(w, 1e-9))
    return out


def month_effects(rows: DataFrame, evidence: DataFrame, means: dict[str, tuple[float, float, float]]) -> DataFrame:
    """For each month and count: mean of what groups leave unexplained, shrunk towards 0 as a month of one row would say little."""
    left = rows.join(evidence, ["cod", "planta"])
    aggs = [(F.sum(F.col(c) - F.col(f"s_{c}") / F.col(f"n_{c}")) / (F.count(c) + 20)).alias(f"t_{c}") for c in COUNTS]
    return left.groupBy("mes").agg(*aggs)


def predicted(rows: DataFrame) -> DataFrame:
    """Each row with, for every field, the prediction ``p_*``, the group's evidence and whether the cell was missing."""
    evidence = written(group_evidence(rows), "impute-groups")
    parts = components(evidence)
    months = small_rows(month_effects(rows, evidence, parts), MOST_MONTHS, "months")
    effects = rows.sparkSession.createDataFrame([(m[0], *(float(x or 0) for x in m[1:])) for m in months], "mes date, " + ", ".join(f"t_{c} double" for c in COUNTS))
    out = rows.filter(" or ".join(f"{c} is null" for c in (*COUNTS, "bairro"))).join(evidence, ["cod", "planta"]).join(F.broadcast(effects), "mes", "left")
    for c in COUNTS:
        mean, between, within = parts[c]
        n, s, ss = (F.col(f"{k}_{c}").cast("double") for k in ("n", "s", "ss"))
        own = F.when(n > 1, (ss - s * s / n) / n).otherwise(F.lit(within))
        # a group whose values agree speaks for itself; one that scatters is drawn towards the mean
        weight = F.when(n > 0, n * between / (n * between + own)).otherwise(F.lit(0.0))
        effect = F.coalesce(F.col(f"t_{c}"), F.lit(0.0)) * F.least(F.lit(1.0), own / F.lit(max(within, 1e-9)))
        guess = F.lit(mean) + weight * F.coalesce(s / n - mean, F.lit(0.0)) + effect
        out = out.withColumn(f"p_{c}", F.greatest(F.lit(1), F.least(F.lit(20), F.round(guess).cast("int"))))
    return out.withColumn("p_bairro", F.when(F.col("lo_bairro") == F.col("hi_bairro"), F.col("lo_bairro")))


def fill_missing(listings: DataFrame, hoods: DataFrame, cities: DataFrame, agreeing: int = 2) -> DataFrame:
    """``id, campo, valor, concordam`` of each filled cell of rows that belong to a group of one condominium and floor plan.

    ``valor`` is the prediction; ``concordam`` tells whether at least ``agreeing`` rows have a usable value and all of
    these agree. Usable is a count from 1 to 20, and a ``bairro`` that names a place. Rows without a group, cells with
    a usable value, and ``bairro`` cells of groups that do not agree are not filled. An empty input gives no rows.
    """
    p = predicted(written(prepared(listings, hoods, cities), "impute-rows"))
    cells = [
        F.struct(
            F.lit(c).alias("campo"), F.col(f"p_{c}").cast("string").alias("valor"),
            ((F.col(f"n_{c}") >= agreeing) & (F.col(f"lo_{c}") == F.col(f"hi_{c}"))).alias("concordam"), F.col(f"lo_{c}").cast("string").alias("unico"), F.col(c).isNull().alias("falta"),
        )
        for c in (*COUNTS, "bairro")
    ]
    out = p.select("id", F.explode(F.array(*cells)).alias("c")).select("id", "c.*")
    return out.filter(F.col("falta") & F.col("valor").isNotNull()).drop("falta")


def all_rows(listings: DataFrame, hoods: DataFrame, cities: DataFrame) -> DataFrame:
    """Every row with kind, place, group and month, unusable values as null and the neighbourhood as a name of the list."""
    info = F.from_json("caracteristicas", "cod_condominio string, planta string")
    rows = listings.select(F.col("id").cast("bigint").alias("id"), F.trunc("created_at", "month").alias("mes"), F.lower(F.trim("tipo")).alias("tipo"), info.alias("i"), *COUNTS, "bairro", "cidade")
    both = F.col("i.cod_condominio").isNotNull() & F.col("i.planta").isNotNull()
    cod = F.when(both, F.col("i.cod_condominio")), F.when(both, F.col("i.planta"))
    return read_hoods(rows.select("id", "mes", "tipo", cod[0].alias("cod"), cod[1].alias("planta"), *(usable_count(c).cast("int").alias(c) for c in COUNTS), "bairro", "cidade"), hoods, cities, towns_too=True)


def shrunk(n: Column, own: Column, wider: Column, ratio: float) -> Column:
    """The mean of a level drawn towards that of the wider one as if the wider one had ``ratio`` rows."""
    return F.when(n > 0, (n * own + F.lit(ratio) * wider) / (n + F.lit(ratio))).otherwise(wider)


def level(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """For each key and count: number of values and their mean."""
    aggs = [x for c in COUNTS for x in (F.count(c).alias(f"n{tag}_{c}"), F.avg(c).alias(f"m{tag}_{c}"))]
    return rows.groupBy(*keys).agg(*aggs)


def ratios(rows: DataFrame, keys: list[str]) -> dict[str, float]:
    """For each count: variance within the keys over variance between them, by moments; what a mean is shrunk by."""
    per = rows.groupBy(*keys).agg(*(x for c in COUNTS for x in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_samp(c).alias(f"v_{c}"))))
    r = per.agg(*(x for c in COUNTS for x in (F.sum(F.col(f"v_{c}") * (F.col(f"n_{c}") - 1)) / F.sum(F.when(F.col(f"n_{c}") > 1, F.col(f"n_{c}") - 1)), F.var_samp(f"m_{c}")))).first()
    return {c: max(0.01, min(100.0, (r[2 * k] if r[2 * k] is not None else 1.0) / max(r[2 * k + 1] or 0.0, 1e-3))) for k, c in enumerate(COUNTS)}


def predicted_counts(rows: DataFrame) -> DataFrame:
    """``id, campo, valor, origem`` for each missing count of a kind to which it applies."""
    applies = {c: ~F.coalesce(F.col("tipo").isin(*kinds), F.lit(False)) for c, kinds in DOES_NOT_APPLY.items()}
    roomy = rows.select("*", F.coalesce("tipo", F.lit("?")).alias("_k"))
    place = ["_k", "cidade", "bairro"]
    by_kind, by_place = level(roomy, ["_k"], "k"), level(roomy.filter("cidade is not null and bairro is not null"), place, "p")
    by_group = level(roomy.filter("cod is not null"), ["cod", "planta"], "g")
    near = ratios(roomy.filter("cod is not null"), ["cod", "planta"])
    local = ratios(roomy.filter("cidade is not null and bairro is not null"), place)
    months = roomy.join(sized(by_kind, MOST_PLACES), "_k").groupBy("mes").agg(*((F.sum(F.col(c) - F.col(f"mk_{c}")) / (F.count(c) + 20)).alias(f"t_{c}") for c in COUNTS))
    out = roomy.filter(reduce(or_, (F.col(c).isNull() & applies[c] for c in COUNTS))).join(sized(by_kind, MOST_PLACES), "_k", "left").join(sized(by_place, MOST_PLACES), place, "left")
    out = out.join(by_group, ["cod", "planta"], "left").join(sized(months, MOST_MONTHS), "mes", "left")
    cells = []
    for c in COUNTS:
        zero = F.lit(0.0)
        base = F.coalesce(F.col(f"mk_{c}"), F.lit(1.0))
        here = shrunk(F.coalesce(F.col(f"np_{c}"), F.lit(0)), F.col(f"mp_{c}"), base, local[c])
        n = F.coalesce(F.col(f"ng_{c}"), F.lit(0))
        guess = shrunk(n, F.col(f"mg_{c}"), here + F.coalesce(F.col(f"t_{c}"), zero), near[c])
        valor = F.greatest(F.lit(1), F.least(F.lit(20), F.round(guess).cast("int"))).cast("string")
        origem = F.when(n > 0, "grupo").when(F.coalesce(F.col(f"np_{c}"), F.lit(0)) > 0, "local").otherwise("tipo")
        known = (n > 0) | (F.coalesce(F.col(f"nk_{c}"), F.lit(0)) > 0)
        cells.append(F.when(F.col(c).isNull() & known & applies[c], F.struct(F.lit(c).alias("campo"), valor.alias("valor"), origem.alias("origem"))))
    return out.select("id", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("id", "c.*")


def predicted_hoods(rows: DataFrame) -> DataFrame:
    """``id, campo, valor, origem`` for each row without a neighbourhood: the likeliest one under the multinomials of group, city and month."""
    named = rows.filter("bairro is not null and not startswith(bairro, '?')")
    town = written(named.filter("cidade is not null").groupBy("cidade", "bairro").agg(F.count("*").alias("n")), "impute-hoods")
    total = town.groupBy("bairro").agg(F.sum("n").alias("_nb")).crossJoin(F.broadcast(town.agg(F.sum("n").alias("_na"))))
    city = town.groupBy("cidade").agg(F.sum("n").alias("_nc"))
    p = town.join(sized(city, MOST_PLACES), "cidade").join(sized(total, MOST_PLACES), "bairro")
    p = p.select("cidade", "bairro", ((F.col("n") + SMOOTH_CITY * F.col("_nb") / F.col("_na")) / (F.col("_nc") + SMOOTH_CITY)).alias("p"))
    p = written(p, "impute-shares")
    best = lambda score: F.max(F.struct(score.alias("s"), F.col("bairro").alias("b")))
    city_top = p.groupBy("cidade").agg(best(F.col("p")).alias("_c"))
    month = named.filter("cidade is not null and mes is not null").groupBy("cidade", "mes", "bairro").agg(F.count("*").alias("n"))
    in_month = month.groupBy("cidade", "mes").agg(F.sum("n").alias("_nm"))
    scored = month.join(sized(p, MOST_PLACES), ["cidade", "bairro"])
    month_top = scored.groupBy("cidade", "mes").agg(best(F.col("n") + SMOOTH_MONTH * F.col("p")).alias("_m")).join(in_month, ["cidade", "mes"])
    grouped = named.filter("cod is not null").groupBy("cod", "planta", "cidade", "bairro").agg(F.count("*").alias("n"))
    group_top = grouped.join(sized(p, MOST_PLACES), ["cidade", "bairro"], "left").groupBy("cod", "planta").agg(best(F.col("n") + SMOOTH_GROUP * F.coalesce("p", F.lit(0.0))).alias("_g"))
    out = rows.filter("bairro is null").join(group_top, ["cod", "planta"], "left").join(sized(month_top, MOST_PLACES), ["cidade", "mes"], "left").join(sized(city_top, MOST_PLACES), "cidade", "left")
    by_month = F.when(F.col("_m.s") >= SMOOTH_MONTH * F.col("_c.s"), F.col("_m.b")).otherwise(F.col("_c.b"))
    valor = F.coalesce(F.col("_g.b"), by_month)
    origem = F.when(F.col("_g").isNotNull(), "grupo").otherwise("local")
    return out.select("id", F.lit("bairro").alias("campo"), valor.alias("valor"), origem.alias("origem")).filter("valor is not null")


def fill_all(listings: DataFrame, hoods: DataFrame, cities: DataFrame) -> DataFrame:
    """``id, campo, valor, origem`` of every filled cell of all rows, each row of the result being one mark.

    ``origem`` says whose values decided: ``grupo`` (condominium and floor plan), ``local`` (kind and neighbourhood, or city
    and month) or ``tipo``. Counts are not filled in kinds to which they do not apply, neighbourhoods not where the city is unknown and the row has
    no group. Values out of range count as missing. An empty input gives no rows; repeated rows are filled each time.
    """
    rows = written(all_rows(listings, hoods, cities), "impute-all")
    return predicted_counts(rows).unionByName(predicted_hoods(rows))


def filled_with_mask(listings: DataFrame, hoods: DataFrame, cities: DataFrame) -> DataFrame:
    """The listings with missing counts and neighbourhoods filled, and ``preenchido``: a map from each field to whether it was filled."""
    fills = fill_all(listings, hoods, cities).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("campo", "valor"))).alias("_f"))
    out = listings.join(fills.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    mask = F.create_map(*[x for c in (*COUNTS, "bairro") for x in (F.lit(c), F.coalesce(F.map_contains_key("_f", F.lit(c)), F.lit(False)))])
    out = out.withColumn("preenchido", mask)
    for c in COUNTS:
        out = out.withColumn(c, F.when(F.col("preenchido")[c], F.col("_f")[c].cast("int")).otherwise(F.col(c)))
    return out.withColumn("bairro", F.when(F.col("preenchido")["bairro"], F.col("_f")["bairro"]).otherwise(F.col("bairro"))).drop("_f", "_id")
