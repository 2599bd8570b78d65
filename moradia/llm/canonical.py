"""Freely typed values mapped to the entries of a list (problem 1).

A symmetric-delete dictionary of the list is broadcast; each typed value meets only the entries that share a form
with at most two letters deleted, and these are ranked by weighted Damerau-Levenshtein distance, then by how often
the data hold the entry's name exactly. There is no shuffle of the rows: each task keeps the readings it has made.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moradia.functions.names import UFS, Entry, Typed, fold, nothing_known, readings, repair, score, state_in
from moradia.session import TooLarge, small_rows

PREFIX, DELETES, NO_ENTRY = 8, 2, -1
#: Most entries of a list that are broadcast; the index takes about 5 kB an entry.
MOST_ENTRIES = 100_000
#: Readings that a task keeps.
KEPT = 200_000


def deletions(s: str) -> set[str]:
    """The forms of the first letters of ``s`` with up to two of them deleted."""
    s = s[:PREFIX]
    out = {s}
    for k in range(1, min(DELETES, len(s) - 1) + 1):
        out.update("".join(c) for c in combinations(s, len(s) - k))
    return out


class DeleteIndex:
    """Symmetric-delete dictionary over (id, name, other names, scope); ``find`` looks within one scope."""

    def __init__(self, rows: list[tuple[int, str | None, list[str], object]], frequency: dict[str, int]) -> None:
        self.entries: list[tuple[Entry, object, int]] = []
        self.by_form: dict[object, dict[str, list[int]]] = {}
        self.exact: dict[object, set[str]] = {}
        self.folded: dict[tuple[object, str], list[int]] = {}
        for ref_id, name, others, scope in rows:
            if name is not None:
                self.exact.setdefault(scope, set()).add(name)
            for k, n in enumerate([name, *others]):
                if not n or not fold(n):
                    continue
                e, at = Entry(ref_id, n, whole=k == 0), len(self.entries)
                self.entries.append((e, scope, frequency.get(name or "", 0)))
                self.folded.setdefault((scope, e.full), []).append(at)
                forms = deletions(e.full) | (deletions(e.tail) if e.tail else {e.full[0] + "~"})
                own = self.by_form.setdefault(scope, {})
                for f in forms:
                    own.setdefault(f, []).append(at)

    def find(self, value: str, scope: object = None, around: str = "") -> list[int]:
        """Ids of the entries that fit ``value`` best: several only if they tie in cost and name; empty if none fits."""
        best: list[tuple[float, int, int]] = []
        by_form = self.by_form.get(scope, {})
        for part, words in readings(value, around):
            q = Typed(words)
            if part == 0 and (scope, q.full) in self.folded:
                same = [self.entries[at] for at in self.folded[scope, q.full]]
                most = max(n for _, _, n in same)
                return list(dict.fromkeys(sorted(e.id for e, _, n in same if n == most)))
            forms = deletions(q.full) | (deletions(q.tail) if len(q.tail) > 2 else set())
            if not q.tail:
                forms.add(q.full[:1] + "~")
            seen: set[int] = set()
            for f in forms:
                for at in by_form.get(f, ()):
                    if at in seen:
                        continue
                    seen.add(at)
                    e, _, n = self.entries[at]
                    if (cost := score(q, e)) < 9:
                        best.append((cost + 0.05 * (part > 0), -n, e.id))
        if not best:
            return []
        best.sort()
        low = best[0]
        return list(dict.fromkeys(i for c, n, i in best if c <= low[0] + 1e-9 and n == low[1]))


class Places:
    """Cities by name and state, neighbourhoods by name within their city."""

    def __init__(self, cities: list[tuple], hoods: list[tuple], city_n: dict[str, int], hood_n: dict[str, int]) -> None:
        self.state = {i: uf for i, _, uf, _ in cities}
        self.joined = {i: fold(n or "").replace(" ", "") for i, n, _, _ in cities}
        self.city_names = {n for _, n, _, _ in cities}
        self.cities = DeleteIndex([(i, n, o, None) for i, n, _, o in cities], city_n)
        self.hoods = DeleteIndex([(i, n, o, c) for i, c, n, o in hoods], hood_n)
        self.known: OrderedDict = OrderedDict()

    def keep(self, key: tuple, make) -> object:  # noqa: ANN001
        if key in self.known:
            return self.known[key]
        if len(self.known) >= KEPT:
            self.known.popitem(last=False)
        out = self.known[key] = make()
        return out

    def city(self, cidade: str, estado: str | None, bairro: str | None) -> int:
        def first() -> list[int]:
            ids = self.cities.find(cidade)
            if len(ids) > 1:
                uf = state_in(repair(cidade)) or (fold(estado).upper() if estado else None)
                if uf in UFS and (own := [i for i in ids if self.state[i] == uf]):
                    ids = own
            return ids

        ids: list[int] = self.keep((cidade, estado), first)
        if len(ids) > 1 and bairro and (own := [i for i in ids if self.hood(i, bairro) != NO_ENTRY]):
            return own[0]
        return ids[0] if ids else NO_ENTRY

    def hood(self, city: int, bairro: str) -> int:
        return self.keep((city, bairro), lambda: next(iter(self.hoods.find(bairro, city, self.joined[city])), NO_ENTRY))

    def cells(self, cidade: str | None, bairro: str | None, estado: str | None) -> Iterator[tuple[str, int]]:
        """The cells of one row that are not written as their entry, with the entry meant."""
        if cidade is None or nothing_known(cidade):
            return
        city = self.city(cidade, estado, bairro)
        if cidade not in self.city_names:
            yield "cidade", city
        if city != NO_ENTRY and bairro is not None and bairro not in self.hoods.exact.get(city, ()) and not self.keep((bairro,), lambda: nothing_known(bairro)):
            yield "bairro", self.hood(city, bairro)


def name_counts(listings: DataFrame, field: str, names: list[str]) -> dict[str, int]:
    """How often each name of the list stands in the field exactly; the result is as small as the list."""
    spark = listings.sparkSession
    ref = spark.createDataFrame([(n,) for n in sorted(set(names))], f"{field} string") if names else None
    if ref is None:
        return {}
    found = listings.select(field).join(F.broadcast(ref), field).groupBy(field).count()
    return {r[0]: r[1] for r in found.collect()}


def city_blocks(hoods: DataFrame, shared: set[int], most: int) -> Iterator[tuple[list[tuple], set[int]]]:
    """Neighbourhoods in blocks of whole cities with at most ``most`` rows each, and the cities of the block.

    Those of ``shared`` (cities whose name is not unique) stand in every block, as they decide which city is meant.
    """
    rows = hoods.select("bairro_id", "cidade_id", "nome", "outros_nomes").filter("bairro_id is not null and cidade_id is not null")
    always = [(r[0], r[1], r[2], list(r[3] or [])) for r in small_rows(rows.filter(F.col("cidade_id").isin(*shared)), most, "neighbourhoods of cities with one name")] if shared else []
    block: list[tuple] = []
    cities: set[int] = set()
    own: list[tuple] = []
    others = rows.filter(~F.col("cidade_id").isin(*shared)) if shared else rows
    for r in chain(others.orderBy("cidade_id").toLocalIterator(), [None]):
        if own and (r is None or r[1] != own[0][1]):
            if len(block) + len(own) > most:
                yield always + block, cities
                block, cities = [], set()
            block, cities, own = block + own, cities | {own[0][1]}, []
        if r is not None:
            own.append((r[0], r[1], r[2], list(r[3] or [])))
            if len(own) > most:
                raise TooLarge(f"neighbourhoods of city {own[0][1]}: more than {most} rows")
    yield always + block, cities | shared


def canonical_places(listings: DataFrame, cities: DataFrame, hoods: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """``id, campo, ref_id`` of each cell of ``cidade`` and ``bairro`` that is not written as a name of the list.

    ``ref_id`` is the entry meant, -1 if none. Null, blank and nothing-known cells give no row, nor does ``bairro``
    where the city is null or belongs to no entry. Where a name occurs in two states ``estado`` decides, without it
    the neighbourhood, then frequency. Repeated rows give repeated results. Other columns of the listings are not read.
    Neighbourhoods beyond ``most_entries`` are read in further passes, a block of cities in each, of which the driver holds two
    at a time; more cities than that, or a city with more neighbourhoods, raise TooLarge.
    """
    cs = [(r[0], r[1], r[2], list(r[3] or [])) for r in small_rows(cities.select("cidade_id", "nome", "estado", "outros_nomes"), most_entries, "cities") if r[0] is not None]
    named = Counter(fold(n or "") for _, n, _, _ in cs)
    shared = {i for i, n, _, _ in cs if named[fold(n or "")] > 1}
    blocks = city_blocks(hoods, shared, most_entries)
    block, k = next(blocks), 0
    city_n = name_counts(listings, "cidade", [n for _, n, _, _ in cs if n])
    parts = []
    while block:
        (hs, own), block = block, next(blocks, None)
        hood_n = name_counts(listings, "bairro", [n for _, _, n, _ in hs if n])
        lists = listings.sparkSession.sparkContext.broadcast((cs, hs, city_n, hood_n))
        parts.append(pass_over(listings, lists, own if block or k else None, k == 0))
        k += 1
    return reduce(DataFrame.unionByName, parts)


def pass_over(listings: DataFrame, lists, own: set[int] | None, first: bool) -> DataFrame:  # noqa: ANN001
    """One pass with the lists of a block: ``bairro`` cells of the block's cities, ``cidade`` cells in the first pass only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(*lists.value)
        for b in batches:
            ids, fields, refs = [], [], []
            for i, c, h, uf in zip(*(b.column(k).to_pylist() for k in range(4))):
                for field, ref in places.cells(c, h, uf):
                    if own is None or (first if field == "cidade" else places.city(c, uf, h) in own):
                        ids.append(i)
                        fields.append(field)
                        refs.append(ref)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(refs, pa.int32())], ["id", "campo", "ref_id"])

    return listings.select(F.col("id").cast("bigint"), "cidade", "bairro", "estado").mapInArrow(read, "id bigint, campo string, ref_id int")
