"""One surviving record for each group of rows of one advert (problem 3).

Every choice is an aggregate with map-side combine, so a group with most of the rows is no bottleneck. Where a row
has no timestamp, its place in time is reasoned. From dated rows it is learned how often each value of a field (state,
availability, place of the price among those of the group, pictures) gives way to each other one. In a group with
undated rows the states of its rows, a bounded number whatever the number of rows, are put into a partial order: dated
states by their times, others by the learned transitions of all fields together. An undated row then counts as seen with
the newest dated row whose state does not follow its own, after that row if its state follows; where nothing is
dated, the topologically latest state is the newest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moradia.functions.pages import with_page_key
from moradia.llm.residue import residue_cells
from moradia.session import small_rows, written

FIELDS = ("titulo", "tipo", "transacao", "cidade", "bairro", "estado", "preco", "area_m2", "banheiros", "vagas", "imagens", "disponivel", "status")
#: States of an advert that are told apart, the most frequent ones; any other counts as ``outro``.
MOST_STATES = 20
#: Log odds at which a state precedes another.
PRECEDES = math.log(2)
ASPECTS = ("situacao", "disponivel", "preco", "imagens")
STATE = ", ".join(f"{a}: string" for a in ASPECTS)


def with_states(rows: DataFrame) -> DataFrame:
    """``rows`` with ``estado_anuncio``: what a row tells of its time, each aspect one of a few values.

    Expects ``grupo, status, disponivel, preco, n_imagens``; the price is told by its place among those of the group.
    """
    common = small_rows(rows.filter("status is not null").groupBy("status").count().orderBy(F.desc("count"), "status").limit(MOST_STATES).select("status"), MOST_STATES, "states")
    span = rows.groupBy("grupo").agg(F.min("preco").alias("_lo"), F.max("preco").alias("_hi"))
    c = F.col
    situation = F.when(c("status").isNull(), "nulo").when(c("status").isin(*(r[0] for r in common)), c("status")).otherwise("outro")
    price = F.when(c("preco").isNull(), "nulo").when(c("_lo") == c("_hi"), "unico").when(c("preco") == c("_lo"), "menor").when(c("preco") == c("_hi"), "maior").otherwise("meio")
    pictures = F.when(c("n_imagens") <= 0, "0").when(c("n_imagens") < 4, "1").otherwise("4")
    state = F.struct(situation.alias("situacao"), F.coalesce(c("disponivel").cast("string"), F.lit("nulo")).alias("disponivel"), price.alias("preco"), F.coalesce(pictures, F.lit("0")).alias("imagens"))
    return rows.join(span, "grupo").withColumn("estado_anuncio", state).drop("_lo", "_hi")


def transitions(rows: DataFrame) -> dict[tuple[str, str, str], float]:
    """Log odds ``(aspect, a, b)`` that a value ``a`` comes before ``b``: in how many groups all of ``a`` is earlier, against the other way round.

    Learned from dated rows. Each aspect has a bounded number of values, so has the result.
    """
    values = F.explode(F.array(*(F.struct(F.lit(a).alias("aspecto"), F.col(f"estado_anuncio.{a}").alias("v")) for a in ASPECTS))).alias("x")
    spans = rows.filter("updated_at is not null").select("grupo", "updated_at", values).groupBy("grupo", "x.aspecto", "x.v").agg(F.min("updated_at").alias("de"), F.max("updated_at").alias("ate"))
    by_group = spans.groupBy("grupo", "aspecto").agg(F.collect_list(F.struct("v", "de", "ate")).alias("s")).filter(F.size("s") > 1)
    pairs = by_group.select("aspecto", F.explode("s").alias("a"), "s").select("aspecto", "a", F.explode("s").alias("b")).filter(F.col("a.ate") < F.col("b.de"))
    n = {(r[0], r[1], r[2]): r[3] for r in small_rows(pairs.groupBy("aspecto", F.col("a.v").alias("a"), F.col("b.v").alias("b")).count(), 4 * (MOST_STATES + 2) ** 2, "transitions")}
    both = n.keys() | {(f, b, a) for f, a, b in n}
    return {(f, a, b): math.log((n.get((f, a, b), 0) + 1) / (n.get((f, b, a), 0) + 1)) for f, a, b in both}


State = tuple[str, ...]


def ordered(spans: dict[State, tuple[datetime, datetime] | None], odds: dict[tuple[str, str, str], float]) -> dict[State, set[State]]:
    """For each state of one group the states that it precedes: by time if both are dated, else by the transitions of all aspects together."""
    after: dict[State, set[State]] = {s: set() for s in spans}
    for s, own in spans.items():
        for t, other in spans.items():
            if s == t:
                continue
            if own and other:
                earlier = own[1] < other[0]
            else:
                earlier = sum(odds.get((f, a, b), 0.0) for f, a, b in zip(ASPECTS, s, t) if a != b) >= PRECEDES
            if earlier:
                after[s].add(t)
    return after


def depths(after: dict[State, set[State]]) -> dict[State, int]:
    """Topological depth of each state; in a cycle the state that precedes most of what is left comes first."""
    left, depth = set(after), dict.fromkeys(after, 0)
    while left:
        free = [s for s in left if not any(s in after[t] for t in left if t != s)]
        for s in free or [max(left, key=lambda x: (len(after[x] & left), x))]:
            left.discard(s)
            for t in after[s] & left:
                depth[t] = max(depth[t], depth[s] + 1)
    return depth


def placed(spans: dict[State, tuple[datetime, datetime] | None], odds: dict[tuple[str, str, str], float]) -> dict[State, tuple[datetime | None, int]]:
    """For an undated row of each state of one group: the time it counts for, and its place among rows of that time (dated rows have 0)."""
    after = ordered(spans, odds)
    depth = depths(after)
    out = {}
    for s in spans:
        before = [(span[1], d) for d, span in spans.items() if span and d not in after[s]]
        if not any(spans.values()):
            out[s] = None, depth[s]
        elif not before:
            out[s] = None, -1
        else:
            t, d = max(before)
            out[s] = t, 1 if d != s and s in after[d] else -1
    return out


def dated(rows: DataFrame) -> DataFrame:
    """``rows`` with ``quando`` and ``posto``: the timestamp and 0, or for undated rows the reasoned time (null if nothing is dated before) and their place in it.

    Only groups with undated rows are reasoned about; each is one row with its distinct states, whose number has a bound.
    """
    done = rows.filter("updated_at is not null").withColumn("quando", F.col("updated_at")).withColumn("posto", F.lit(0))
    undated = rows.filter("updated_at is null")
    if undated.isEmpty():
        return done
    odds = transitions(rows)
    groups = rows.join(undated.select("grupo").distinct(), "grupo", "left_semi").groupBy("grupo", "estado_anuncio").agg(F.min("updated_at").alias("de"), F.max("updated_at").alias("ate"))
    lists = groups.groupBy("grupo").agg(F.collect_list(F.struct("estado_anuncio", "de", "ate")).alias("estados"))
    schema = f"grupo string, estado_anuncio struct<{STATE}>, quando timestamp, posto int"
    arrow = pa.schema([("grupo", pa.string()), ("estado_anuncio", pa.struct([(a, pa.string()) for a in ASPECTS])), ("quando", pa.timestamp("us", "UTC")), ("posto", pa.int32())])

    def reason(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, states in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = {tuple(x["estado_anuncio"][a] for a in ASPECTS): (x["de"], x["ate"]) if x["de"] else None for x in states}
                out += [(g, dict(zip(ASPECTS, s)), t, k) for s, (t, k) in placed(spans, odds).items()]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, arrow)], schema=arrow)

    told = lists.mapInArrow(reason, schema)
    return done.unionByName(undated.join(told, ["grupo", "estado_anuncio"], "left").withColumn("posto", F.coalesce("posto", F.lit(0))))


def chosen(listings: DataFrame) -> DataFrame:
    """``grupo_id, descricao_id, quartos_id`` and ``<field>_id`` for every other field: the ids of the rows that give each field
    of the surviving record, 0 if none is usable. One row for each group of two or more rows of one advert.

    Texts and values do not travel: rows are reduced to the address, the time, the state and what is usable first.
    """
    unusable = residue_cells(listings, ("descricao",)).select(F.col("id").alias("_id"), F.lit(True).alias("_residuo"))
    length = F.length(F.regexp_replace("descricao", r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    filled = sum((F.when(F.col(f).isNotNull(), 1 << k).otherwise(0) for k, f in enumerate(FIELDS)), F.lit(0))
    rows = with_page_key(listings.select("id", "url_anuncio", "updated_at", "quartos", "descricao", *FIELDS), "grupo").select(
        F.col("id").cast("bigint").alias("id"), "grupo", "updated_at", "status", "disponivel", F.col("preco").cast("double").alias("preco"), F.size("imagens").alias("n_imagens"),
        F.col("quartos").between(1, 20).alias("_quartos"), length.alias("_n"), filled.alias("_cheios"),
    )
    rows = written(rows, "survivor-rows")
    rows = dated(with_states(rows) if rows.filter("updated_at is null").limit(1).count() else rows).join(unusable, F.col("id") == F.col("_id"), "left")
    order = [F.col("quando").alias("t"), F.col("posto").alias("p"), F.col("updated_at").isNotNull().alias("d"), (-F.col("id")).alias("i")]
    told = (F.col("_n") > 0) & F.col("_residuo").isNull()
    one = rows.groupBy("grupo").agg(
        F.count("*").alias("linhas"), F.min("id").alias("grupo_id"),
        F.max(F.when(told, F.struct("_n", *order))).alias("descricao"), F.max(F.when(F.col("_quartos"), F.struct(*order))).alias("quartos"),
        *(F.max(F.when(F.col("_cheios").bitwiseAND(1 << k) > 0, F.struct(*order))).alias(f) for k, f in enumerate(FIELDS)),
    )
    picked = [F.coalesce(-F.col(f"{f}.i"), F.lit(0)).cast("bigint").alias(f"{f}_id") for f in ("descricao", "quartos", *FIELDS)]
    return one.filter("linhas > 1").select("grupo_id", *picked)


def survivors(listings: DataFrame) -> DataFrame:
    """One surviving record for each group of two or more rows of one advert: ``grupo_id``, the ids ``<field>_id`` of ``chosen``, and the values.

    ``grupo_id`` is the smallest id. ``descricao`` is the longest usable one, ``quartos`` the newest from 1 to 20, every other
    field the newest that is not null. Rows without an address belong to no group. Repeated rows (same id) count as
    rows. Undated rows stand where the order of states puts them; ties fall to dated rows, then to the smallest id.
    """
    ids = written(chosen(listings), "survivor-ids")
    fields = ("descricao", "quartos", *FIELDS)
    wanted = ids.select("grupo_id", F.explode(F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f"{f}_id").alias("id")) for f in fields))).alias("c")).select("grupo_id", "c.*")
    values = listings.dropDuplicates(["id"]).select(F.col("id").cast("bigint").alias("id"), *fields)
    got = wanted.filter("id > 0").join(values, "id").groupBy("grupo_id").agg(*(F.max_by(f, F.when(F.col("campo") == f, 1)).alias(f) for f in fields))
    return ids.join(got, "grupo_id", "left")


def with_doubtful_times(listings: DataFrame, days: int = 30) -> DataFrame:
    """The listings without the ``updated_at`` of rows that arrived (``recebido_em``) more than ``days`` days after it, whose clock is in doubt."""
    late = F.col("recebido_em") > F.col("updated_at") + F.make_interval(days=F.lit(days))
    return listings.withColumn("updated_at", F.when(~F.coalesce(late, F.lit(False)), F.col("updated_at")))
