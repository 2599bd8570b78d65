"""Listings of different sources that describe the same item (problem 4).

Each advert becomes a set of normalised tokens: place, kind, area, price, rooms, building, street, number and floor, in
the units and spellings of any seller; area and price fall into staggered cells, so that values within the tolerance
share a cell. A token holds all of place, kind, area and price that both of two rows state, so each pair has one
token, whatever the rows lack, and two rows are compared only if what either states could weigh enough in its
surroundings (length filter); neither loses a pair. The exact tolerances and the
weighted containment decide: what both state counts by its weight, learned from document frequencies, what the shorter
list has and the longer lacks counts against. Star clustering then groups the adverts.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moradia.functions.names import fold
from moradia.functions.pages import with_page_key
from moradia.llm.canonical import NO_ENTRY, Places
from moradia.session import discard, sized, small_rows, written

#: Tolerances: prices up to 3 % apart; areas up to 0.65 %, and half a square metre more where one is a whole number.
PRICE_TOLERANCE, AREA_TOLERANCE, AREA_METRES = 0.0305, 0.0065, 0.56
#: Units of area in square metres.
UNITS = {"ha": 10_000.0, "hectares": 10_000.0, "hectare": 10_000.0, "alqueires": 24_200.0, "alqueire": 24_200.0}
#: Words for one kind of item, tried in this order.
KINDS = tuple(
    (k, re.compile(p))
    for k, p in (
        ("kitnet", r"kitnet|kitchenette|conjugado|studio|quitinete"),
        ("cobertura", r"cobertura|penthouse"),
        ("apartamento", r"apartamento|apto|\bap\b|flat|loft"),
        ("sobrado", r"sobrado"),
        ("casa", r"\bcasa\b|residencia\b"),
        ("galpao", r"galpao|pavilhao|barracao"),
        ("loja", r"\bloja|ponto comercial"),
        ("sala", r"\bsala comercial|^(?:\W*\w+\W+){0,4}sala\b"),
        ("chacara", r"chacara\b|sitio"),
        ("terreno", r"terreno|\blote\b|\barea\b"),
    )
)
#: Features of an item by the words that name them.
FEATURES = (
    ("energia solar", "solares no telhado", "fotovoltaic", "placas solares"), ("aquecimento a gas", "agua quente a gas", "passagem a gas", "gas central"), ("portaria", "porteiro", "seguranca 24"), ("o vale", "vista livre"), ("elevador",), ("porcelanato",),
    ("closet",), ("quintal", "gramado", "com grama"), ("sol da manha", "sol cedo", "leste"), ("lavanderia", "area de servico"), ("pe direito", "altura dupla"), ("churrasq", "grill"), ("piscina",), ("hidro",), ("lareira",), (" poco",), ("salao", "festas", "eventos"), ("cozinha",),
)
FLAGS = [(w, 1 << k) for k, words in enumerate(FEATURES) for w in words]

_NUM = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?)"
AREA = re.compile(_NUM + r"\s*(m²|m2|mts²|mts2|metros quadrados|ha\b|hectares?\b|alqueires?\b)", re.I)
PRICE = re.compile(r"(?:valor|por|investimento:?|pre[cç]o:?|r\$)\s*(?:r\$)?\s*" + _NUM + r"\s*(mil\b|milh[oõ]es|milh[aã]o|reais)?(?=[\s.|;,\n]|$)", re.I)
ROOMS = re.compile(r"(\d{1,2}|um|uma)\s?(?:(q\b|qtos?\b|quartos?\b|dorm\w*)|(wc\b|banhos?\b|banheiros?\b)|(vagas?\b|box\b|carros?\b))", re.I)
FLOOR = re.compile(r"andar: (\d+)|(\d+)[oº] (?:andar|pavimento)")
UNIT = re.compile(r"unidade (\d+)")
YEAR = re.compile(r"(?:entregue em|constru[cç][aã]o de|ano:|constru[ií]d[oa] em) (\d{4})")
_NAME = r"((?:[A-ZÀ-Ý][\wÀ-ÿ]+)(?: (?:d[aoe]s? )?[A-ZÀ-Ý][\wÀ-ÿ]+)*)"
STREET = re.compile(r"\b(?:Rua|R\.|Avenida|Av\.|Travessa|Trav\.|Alameda|Al\.|RUA|AVENIDA|TRAVESSA) ((?:d[aoe]s? |D[AOE]S? )?[A-ZÀ-Ý][\wÀ-ÿ]+(?: (?:d[aoe]s? )?[A-ZÀ-Ý][\wÀ-ÿ]+)*)(?:, (\d+)(?=[\s.:|\n]|$))?")
BUILDING = re.compile(r"\b(?:Condom[ií]nio|Edif[ií]cio|Ed\.|Residencial|Cond\.|Res\.|CONDOMÍNIO|EDIFÍCIO|ED\.|RESIDENCIAL) ([A-ZÀ-Ý][\wÀ-ÿ]+ (?:d[aoe]s?|D[AOE]S?) [A-ZÀ-Ý][\wÀ-ÿ]+)")
PLACE = re.compile(r"\bno bairro ([A-ZÀ-Ý][^.:|,;\n]{2,40}?)(?=\s*[.:|;\n]|$)|\bem ([A-ZÀ-Ý][^.:|,;\n]{2,40}), ([A-ZÀ-Ý][^.:|,;\n]{2,40}?)(?=\s*[.:|;\n]|$)")
SLUG = re.compile(r"/imovel/[^/?#]+/([^/?#]+)/([^/?#]+)/(?:([a-z]{2})/)?\d+", re.I)
#: What every street and every building is led by; texts without any are not searched.
STREET_MARKS = ("Rua ", "R. ", "Avenida ", "Av. ", "Travessa ", "Trav. ", "Alameda ", "Al. ", "RUA ", "AVENIDA ", "TRAVESSA ")
BUILDING_MARKS = ("Condomínio ", "Condominio ", "Edifício ", "Edificio ", "Ed. ", "Residencial ", "Cond. ", "Res. ", "CONDOMÍNIO ", "EDIFÍCIO ", "ED. ", "RESIDENCIAL ")
CUT = re.compile(r"\s*(?:\.\.\. ver mais|\.\.\.|…)\s*$")


def number(s: str) -> float:
    """A number written the local way; one dot followed by other than three digits is a decimal point."""
    if "," in s:
        return float(s.replace(".", "").replace(",", "."))
    return float(s.replace(".", "")) if re.fullmatch(r"\d{1,3}(?:\.\d{3})+", s) else float(s)


def key(text: str) -> int:
    """48 bits of hash."""
    return xxhash.xxh3_64_intdigest(text) >> 16


def cells(x: Column) -> list[Column]:
    """Two staggered cells of width 2: numbers at most 1 apart share one of them."""
    return [F.floor(x / 2), F.floor((x + 1) / 2)]


def area_scale(a: Column) -> Column:
    """Areas on a scale where 1 is the tolerance: 0.56 m2 and 0.3 % of small areas, 0.65 % of large ones."""
    slope = 0.003
    edge = AREA_METRES / (AREA_TOLERANCE - slope)
    return F.ln(1 + slope * F.least(a, F.lit(edge)) / AREA_METRES) / slope + F.when(a > edge, F.ln(a / edge) / AREA_TOLERANCE).otherwise(0.0)


def led(pattern: re.Pattern, marks: tuple[str, ...], text: str) -> re.Match | None:
    """The first match of a pattern each of whose matches begins with one of ``marks``."""
    return pattern.search(text) if any(m in text for m in marks) else None


def marked(more: str | None) -> str:
    """What a JSON object of features marks as true, as words; whatever is no such object marks nothing."""
    if not more or "true" not in more:
        return ""
    try:
        fields = json.loads(more)
    except ValueError:
        return ""
    return ". ".join(k for k, v in fields.items() if v is True).lower().replace("_", " ") if isinstance(fields, dict) else ""


def usable(v: int | None) -> int | None:
    return v if v is not None and 1 <= v <= 20 else None


class Described:
    """What a row states, from its fields first, from its text and address where a field is empty."""

    __slots__ = ("area", "building", "city", "features", "floor", "hood", "kind", "number", "price", "rooms", "street", "unit", "year")

    def __init__(self, places: Places, url, title, kind, cidade, bairro, estado, price, area, quartos, banheiros, vagas, text, more=None) -> None:  # noqa: ANN001
        title, text = title or "", text or ""
        if text.endswith(("...", "…", "ver mais")):
            text = CUT.sub("", text)
        both = f"{title}\n{text}"
        plain = unicodedata.normalize("NFD", both).encode("ascii", "ignore").decode().lower().replace("-", " ")
        city = places.city(cidade, estado, bairro) if cidade else NO_ENTRY
        hood = places.hood(city, bairro) if city != NO_ENTRY and bairro else NO_ENTRY
        if city == NO_ENTRY or hood == NO_ENTRY:
            city, hood = self.place(places, url or "", both, estado, city, hood)
        self.city, self.hood = city, hood
        self.kind = kind or next((k for k, r in KINDS if r.search(plain)), None)
        self.price = float(price) if price and price > 0 else self.price_in(text)
        self.area = float(area) if area and area > 0 else self.area_in(both)
        q, b, v = usable(quartos), usable(banheiros), usable(vagas)
        if q is None or b is None or v is None:
            for m in ROOMS.finditer(both):
                n = usable(1 if m[1].lower() in ("um", "uma") else int(m[1]))
                if m[2]:
                    q = q or n
                elif m[3]:
                    b = b or n
                else:
                    v = v or n
        self.rooms = q, b, v
        low = text.lower()
        m = FLOOR.search(low) if "andar" in low or "pavimento" in low else None
        self.floor = int(m[1] or m[2]) if m else None
        m = UNIT.search(low) if "unidade " in low else None
        self.unit = int(m[1]) if m and m.end() < len(low) else None
        m = YEAR.search(low) if "entregue em" in low or "constru" in low or "ano:" in low else None
        self.year = int(m[1]) if m else None
        m = led(STREET, STREET_MARKS, text) or led(STREET, STREET_MARKS, title)
        whole = m and m.end() < len(m.string)
        self.street = fold(m[1]) if m and (whole or m.string is title) else None
        self.number = int(m[2]) if m and m[2] and whole else None
        m = led(BUILDING, BUILDING_MARKS, text) or led(BUILDING, BUILDING_MARKS, title)
        self.building = fold(m[1]) if m and (m.end() < len(m.string) or m.string is title) else None
        listed, flags = f"{plain}\n {marked(more)}", 0
        for word, flag in FLAGS:
            if word in listed:
                flags |= flag
        self.features = flags

    @staticmethod
    def place(places: Places, url: str, both: str, estado: str | None, city: int, hood: int) -> tuple[int, int]:
        m = SLUG.search(url)
        pairs = []
        if m:
            pairs.append((m[1], m[2]) if m[3] else (m[2], m[1]))
        for m in PLACE.finditer(both):
            pairs.append((m[1] or m[2], m[3]))
        for h, c in pairs:
            if city == NO_ENTRY and c:
                city = places.city(c, estado, h)
            if city != NO_ENTRY and hood == NO_ENTRY and h:
                hood = places.hood(city, h)
        return city, hood

    @staticmethod
    def price_in(text: str) -> float | None:
        for m in PRICE.finditer(text):
            if m.end() < len(text):
                v = number(m[1]) * (1e3 if (u := (m[2] or "").lower()) == "mil" else 1e6 if u.startswith("milh") else 1)
                if v >= 100:
                    return v
        return None

    @staticmethod
    def area_in(text: str) -> float | None:
        m = AREA.search(text)
        if not m:
            return None
        v = number(m[1]) * UNITS.get(m[2].lower(), 1.0)
        return v if v > 5 else None


STATED = "city int, hood int, kind string, price double, area double, quartos int, banheiros int, vagas int, floor int, unit int, year int, number int, street bigint, building bigint, features int"


def describe(listings: DataFrame, cities: DataFrame, hoods: DataFrame, most_entries: int = 100_000) -> DataFrame:
    """``id, anuncio`` (the page) and what each row states."""
    cs = [(r[0], r[1], r[2], list(r[3] or [])) for r in small_rows(cities.select("cidade_id", "nome", "estado", "outros_nomes"), most_entries, "cities") if r[0] is not None]
    hs = [(r[0], r[1], r[2], list(r[3] or [])) for r in small_rows(hoods.select("bairro_id", "cidade_id", "nome", "outros_nomes"), most_entries, "neighbourhoods") if r[0] is not None]
    lists = listings.sparkSession.sparkContext.broadcast((cs, hs))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("anuncio", T.LongType()), *T.StructType.fromDDL(STATED).fields])
    arrow = pa.schema(
        [("id", pa.int64()), ("anuncio", pa.int64()), ("city", pa.int32()), ("hood", pa.int32()), ("kind", pa.string()), ("price", pa.float64()), ("area", pa.float64())]
        + [(n, pa.int32()) for n in ("quartos", "banheiros", "vagas", "floor", "unit", "year", "number")]
        + [("street", pa.int64()), ("building", pa.int64()), ("features", pa.int32())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(*lists.value, {}, {})
        for b in batches:
            rows = []
            for i, page, *fields in zip(*(c.to_pylist() for c in b.columns)):
                d = Described(places, *fields)
                rows.append((i, page, d.city, d.hood, d.kind, d.price, d.area, *d.rooms, d.floor, d.unit, d.year, d.number, d.street and key(d.street), d.building and key(d.building), d.features))
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    fields = ("url_anuncio", "titulo", "tipo", "cidade", "bairro", "estado", F.col("preco").cast("double"), F.col("area_m2").cast("double"), *(F.col(c).cast("int") for c in ("quartos", "banheiros", "vagas")), "descricao", "caracteristicas")
    rows = with_page_key(listings.select("id", "url_anuncio", "titulo", "tipo", "cidade", "bairro", "estado", "preco", "area_m2", "quartos", "banheiros", "vagas", "descricao", "caracteristicas"), "_pagina")
    return rows.select(F.col("id").cast("bigint"), F.xxhash64("_pagina").alias("anuncio"), *fields).mapInArrow(read, schema)


#: For each field how often two rows of one item agree on it, and how often two others do; the latter is learned, this is what is
#: assumed before PRIOR pairs are seen. Fixed values.
FIELDS = {
    "building": (0.98, 0.0198), "street": (0.98, 0.1086), "number": (0.98, 0.0109), "unit": (0.98, 0.0488), "floor": (0.98, 0.0804), "year": (0.98, 0.0361),
    "price": (0.98, 0.098), "quartos": (0.975, 0.535), "banheiros": (0.975, 0.535), "vagas": (0.975, 0.535),
}
#: Fields that another one goes with, which is then no chance of its own: a unit stands on its floor, a building in its street, of its year. Of two rows that
#: agree on the other one so many agree by chance; learned likewise.
GIVEN = {"unit": ("floor", 0.131), "street": ("building", 0.8), "number": ("building", 0.8), "year": ("building", 0.8), "banheiros": ("quartos", 0.57)}
#: A feature that the shorter list of two rows of one item holds stands in the longer one so often.
LISTED = 0.91
PRIOR = 20_000.0
#: Fields on which two rows of one item never differ, those that rule out most first, and those of which one may be miscounted.
IDENTIFYING = ("price", "area", "kind", "unit", "floor", "building", "street", "number", "hood", "city", "year")
COUNTED = ("quartos", "banheiros", "vagas")
#: What equal areas to the decimal weigh more than areas within the tolerance, and others by the square of their distance as a share of it; the same for prices.
#: From how these distances spread in pairs of one item (those of log odds above 6 without them) and in pairs that agree by chance (below -3).
EXACT_AREA, NEAR_AREA, FAR_AREA, EXACT_PRICE, FAR_PRICE = 1.3, 0.3, 3.0, 0.5, 2.4
#: Items of which a row finds another row, on average.
PARTNERS = 0.17
#: Log odds that a link needs: one to one, as fields that go together are weighed together (``GIVEN``) and the odds are those that links between rows of
#: one source tell; see the README.
ENOUGH = 0.0
CARRIED = ("city", "hood", "kind", "price", "area", "quartos", "banheiros", "vagas", "floor", "unit", "year", "number", "street", "building", "features")
#: Rows of a small table that are broadcast; beyond that it is joined by shuffle.
MOST_CELLS = 50_000
#: Rows that share a token and are compared in one task; more are split into cells of that size.
HOT = 4_000


class Weights:
    """Weights of agreement and disagreement, as log odds, from how often two rows agree by chance: ``given`` where they agree on the field of ``GIVEN`` too.

    ``each`` is how much of a list's length counts for each feature that it may hold by chance.
    """

    def __init__(self, chance: dict[str, float] | None = None, each: float = 1 / len(FEATURES)) -> None:
        chance = {f: u for f, (_, u) in FIELDS.items()} | {f"{f}|": u for f, (_, u) in GIVEN.items()} | (chance or {})
        self.same = {f: math.log(r / chance[f]) for f, (r, _) in FIELDS.items()}
        self.given = {f: min(self.same[f], math.log(FIELDS[f][0] / chance[f"{f}|"])) for f in GIVEN}
        self.differs = {f: math.log((1 - FIELDS[f][0]) / (1 - chance[f])) for f in COUNTED}
        self.each = each

    def listed(self, length: Column) -> tuple[Column, Column]:
        """What a feature weighs that a list of this length holds, and one that it lacks: a long list holds more by chance."""
        chance = F.least(length * self.each, F.lit(LISTED))
        return F.ln(LISTED / chance), F.ln((1 - LISTED) / (1 - chance))


def learned(nodes: DataFrame) -> Weights:
    """The weights of these rows: for each field the share of pairs of one kind (and place, area, street or building) that agree by chance, from counts over all rows.

    Counting is an aggregate with map-side combine by field, surroundings and value; what comes to the driver is one row a field.
    """
    c = F.col
    kind = F.coalesce("kind", F.lit("?"))
    place = F.xxhash64("city", "hood", kind)
    sized_alike = F.xxhash64(kind, cells(area_scale(c("area")))[0])
    within = {"building": place, "street": place, "number": c("street"), "unit": c("building"), "price": F.when(c("area").isNotNull(), sized_alike), "quartos": sized_alike, "banheiros": sized_alike, "vagas": sized_alike}
    value = {"price": cells(F.ln("price") / PRICE_TOLERANCE)[0]}
    pairs_of = {f: (within.get(f, F.xxhash64(kind)).cast("bigint"), value.get(f, c(f)).cast("bigint")) for f in FIELDS}
    surroundings = {"floor": F.xxhash64(kind, "floor"), "building": F.xxhash64(place, "building"), "quartos": F.xxhash64(sized_alike, "quartos")}
    pairs_of |= {f"{f}|": (F.when(c(g).isNotNull(), surroundings[g]), pairs_of[f][1]) for f, (g, _) in GIVEN.items()}
    seen = [F.when(s.isNotNull() & v.isNotNull(), F.struct(F.lit(f).alias("f"), s.alias("s"), v.alias("v"))) for f, (s, v) in pairs_of.items()]
    counts = nodes.select(F.explode(F.array_compact(F.array(*seen))).alias("x")).select("x.*").groupBy("f", "s", "v").agg(F.count("*").cast("double").alias("n"))
    scopes = counts.groupBy("f", "s").agg(F.sum(c("n") * (c("n") - 1)).alias("same"), F.sum("n").alias("n"))
    pairs = scopes.groupBy("f").agg(F.sum("same"), F.sum(c("n") * (c("n") - 1)))
    before = {f: u for f, (_, u) in FIELDS.items()} | {f"{f}|": u for f, (_, u) in GIVEN.items()}
    chance = {f: (same + PRIOR * before[f]) / (n + PRIOR) for f, same, n in (tuple(r) for r in pairs.collect())}
    bits = [F.sum(F.shiftright("features", k).bitwiseAND(1)) for k in range(len(FEATURES))]
    times = [x or 0 for x in nodes.filter("features > 0").agg(*bits).first()]
    # a feature listed at random meets one of another list at random so often
    return Weights(chance, (sum(x**2 for x in times) + 200**2 / len(FEATURES)) / (sum(times) ** 2 + 200**2))


def crowds(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``crowd``: how many rows of the same place and kind would have this area by chance; all of them where no area is stated.
    ``wider`` is the logarithm of how many times as many there are in all places in which a row may stand that states no neighbourhood or no city.

    Two small tables are joined by broadcast if they have MOST_CELLS rows at most, else by shuffle: rows by place and kind, and rows by kind and cell of area.
    """
    kind = F.coalesce("kind", F.lit("?"))
    n = nodes.withColumn("_k", kind).withColumn("_c", F.when(F.col("area").isNotNull(), cells(area_scale(F.col("area")))[0]))
    local = written(n.groupBy("city", "hood", "_k").agg(F.count("*").alias("_n")), "crowd-places")
    cell = written(n.filter("_c is not null").groupBy("_k", "_c").agg(F.count("*").alias("_m")), "crowd-cells")
    town, land = local.groupBy("city", "_k").agg(F.sum("_n").alias("_i")), local.groupBy("_k").agg(F.sum("_n").alias("_l"))
    around = F.when(F.col("hood") >= 0, F.col("_n")).when(F.col("city") >= 0, F.col("_i")).otherwise(F.col("_l"))
    local = written(local.join(town, ["city", "_k"]).join(land, "_k").select("city", "hood", "_k", "_n", F.ln(around / F.col("_n")).cast("float").alias("wider")), "crowd-wider")
    whole = cell.groupBy("_k").agg(F.sum("_m").alias("_t"))
    share = written(cell.join(whole, "_k").select("_k", "_c", (F.col("_m") / F.col("_t")).alias("_p")), "crowd-areas")
    out = n.join(sized(local, MOST_CELLS), ["city", "hood", "_k"], "left").join(sized(share, MOST_CELLS), ["_k", "_c"], "left")
    return out.withColumn("crowd", F.col("_n") * F.coalesce("_p", F.lit(1.0))).select(*nodes.columns, "crowd", "wider")


#: What a row does not state, as bits.
NO_HOOD, NO_PRICE, NO_AREA, NO_CITY, NO_KIND = 1, 2, 4, 8, 16
#: Width of a cell, in tolerances; a little more than the two tolerances around a value, so that these lie in two cells at most.
WIDTH, MARGIN = 2.001, 1e-6
#: Rows of one sort that are looked up by broadcast, as each has some tens of tokens; beyond that they are joined by shuffle.
MOST_RARE = MOST_CELLS // 40


def lacks() -> Column:
    """The bits of what a row does not state."""
    c = F.col
    bits = ((c("hood") < 0, NO_HOOD), (c("price").isNull(), NO_PRICE), (c("area").isNull(), NO_AREA), (c("city") < 0, NO_CITY), (c("kind").isNull(), NO_KIND))
    return reduce(Column.bitwiseOR, (F.when(no, bit).otherwise(0) for no, bit in bits))


def area_reach(a: Column) -> Column:
    """Areas on a scale where those that ``agrees`` takes for equal are at most 1 apart: m - n <= 0.0062 m + 0.5, so m - n <= c + s n with the c and s below."""
    s, c = 0.00624, 0.5032
    return F.ln(1 + s * a / c) / s


def need() -> Column:
    """What two rows must weigh together in the surroundings of one: the more rows would have its area by chance, the more."""
    return F.ln(F.greatest(F.col("crowd"), F.lit(0.01))) - math.log(PARTNERS) + ENOUGH


def most(w: Weights) -> Column:
    """What a row could weigh at most with another one: the length of its set."""
    total = F.when(F.col("area").isNotNull(), EXACT_AREA).otherwise(0.0)
    for f, weight in w.same.items():
        total = total + F.when(F.col(f).isNotNull(), max(0.0, weight) + (EXACT_PRICE if f == "price" else 0.0)).otherwise(0.0)
    long = F.bit_count("features")  # of two lists the longer one has no fewer, so that each weighs no more
    return total + F.when(long > 0, long * w.listed(long)[0]).otherwise(0.0)


def with_cells(rows: DataFrame) -> DataFrame:
    """``rows`` with ``lacks`` and the cells of area and price, each evaluated once a row: where a row stands (``_a``, ``_p``), and the first and
    the last that it looks into (``_a0``, ``_a1``, ``_p0``, ``_p1``). Of two rows that lack nothing the one with the smaller area looks for the other.
    """
    cell = lambda x: F.floor(x / WIDTH)
    out = rows.withColumns({"lacks": lacks(), "_x": area_reach(F.col("area")), "_y": F.ln("price") / PRICE_TOLERANCE})
    reach = 1 + MARGIN
    x, y = F.col("_x"), F.col("_y")
    out = out.withColumns({"_a": cell(x), "_a0": F.when(F.col("lacks") == 0, cell(x)).otherwise(cell(x - reach)), "_a1": cell(x + reach), "_p": cell(y), "_p0": cell(y - reach), "_p1": cell(y + reach)})
    return out.drop("_x", "_y")


def sign(looking: Column, standing: Column, area: str, price: str) -> Column:
    """The token of two sorts of rows, by the bits that they lack: the place, kind, area and price that both state."""
    both = looking.bitwiseOR(standing)
    stated = lambda bit, x: F.when(both.bitwiseAND(bit) == 0, F.col(x))
    place = F.coalesce(stated(NO_HOOD, "hood"), stated(NO_CITY, "city"))
    return F.xxhash64(looking, standing, place, stated(NO_KIND, "kind"), stated(NO_AREA, area), stated(NO_PRICE, price))


def tokens(rows: DataFrame, sorts: list[int], looking: bool) -> DataFrame:
    """``rows`` with ``sinal``, their tokens with each of ``sorts`` of other rows, by the bits that these lack: they only lead to candidates, which are verified exactly.

    The row of the pair that lacks more (whose bits are the greater number) looks into all cells within the tolerance, the other one stands in one
    cell. A token holds all of place, kind, area and price that both rows state, none of which may differ, and nothing else: so each pair of
    rows that may be linked has just one token, whatever the rows lack, and no other rows are compared. Expects the columns of ``with_cells``.
    """
    own, other = F.col("lacks"), F.col("_k")
    rows = rows.withColumn("_k", F.lit(sorts[0]) if len(sorts) == 1 else F.explode(F.array(*map(F.lit, sorts))))
    fields = ("node", "anuncio", *CARRIED, "need", "wider", "most", "lacks")
    if not looking:
        return rows.filter(own <= other).select(*fields, sign(other, own, "_a", "_p").alias("sinal"))
    both = own.bitwiseOR(other)
    wide, dear = (both.bitwiseAND(NO_AREA) == 0) & (F.col("_a1") > F.col("_a0")), (both.bitwiseAND(NO_PRICE) == 0) & (F.col("_p1") > F.col("_p0"))
    grid = (("_a0", "_p0", F.lit(True)), ("_a1", "_p0", wide), ("_a0", "_p1", dear), ("_a1", "_p1", wide & dear))
    found = F.array_compact(F.array(*(F.when(when, sign(own, other, a, p)) for a, p, when in grid)))
    return rows.filter(own >= other).select(*fields, F.explode(found).alias("sinal"))


def celled(looking: DataFrame, standing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``cela``: the standing rows of a token of which there are more than HOT are dealt into cells, and the looking ones look into each."""
    hot = standing.groupBy("sinal").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("sinal", F.ceil(F.col("n") / HOT).cast("int").alias("_n"))
    hot = written(hot, "hot-tokens")
    if hot.isEmpty():
        return looking.withColumn("cela", F.lit(0)), standing.withColumn("cela", F.lit(0))
    looking, standing = (x.join(sized(hot, MOST_CELLS), "sinal", "left").withColumn("_n", F.coalesce("_n", F.lit(1))) for x in (looking, standing))
    return looking.withColumn("cela", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n"), standing.withColumn("cela", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")).drop("_n")


def met(looking: DataFrame, standing: DataFrame) -> DataFrame:
    """``a, b``: rows that share a token, agree and are long enough, each pair once."""
    looking, standing = celled(looking, standing)
    a, b = F.col("a.anuncio"), F.col("b.anuncio")
    alike = F.col("a.lacks") == F.col("b.lacks")
    by_area = alike & (F.col("a.lacks") == 0) & (F.col("a.area") != F.col("b.area"))
    once = (a != b) & F.when(by_area, F.col("a.area") < F.col("b.area")).otherwise(~alike | (a < b))
    long_enough = F.least("a.most", "b.most") >= F.greatest("a.need", "b.need")
    same = (F.col("a.sinal") == F.col("b.sinal")) & (F.col("a.cela") == F.col("b.cela"))
    pairs = looking.alias("a").join(standing.alias("b").hint("merge"), same & once & long_enough & agreeing_rows())
    return pairs.select(*(F.struct(*(F.col(f"{r}.{c}") for c in (*CARRIED, "anuncio", "need", "wider"))).alias(r) for r in "ab"))


def candidates(able: DataFrame) -> DataFrame:
    """``a, b``: all pairs of rows of different adverts that agree and of which each is long enough for the other.

    Rows that lack nothing look for each other. Rows that lack something look for all others; those are dealt with by sorts, so that no row has a token for
    a sort that no row is of. Tokens that lead to rare sorts only are dropped before the shuffle if no row of these looks for them.
    """
    rows = with_cells(able)
    sorts = dict(map(tuple, rows.groupBy("lacks").count().collect()))
    rare, often, n = [], [], 0
    for k in sorted(set(sorts) - {0}, key=sorts.get):
        n += sorts[k]
        (rare if n <= MOST_RARE else often).append(k)
    full, every = rows.filter("lacks = 0"), [0, *sorted(set(sorts) - {0})]
    looking, standing = [tokens(full, [0], True)], [tokens(full, [0], False)]
    if often:
        looking.append(tokens(rows.filter(F.col("lacks").isin(often)), every, True))
        standing.append(tokens(rows, often, False))
    if rare:
        looking.append(tokens(rows.filter(F.col("lacks").isin(rare)), every, True))
        standing.append(tokens(rows, rare, False).join(F.broadcast(looking[-1].select("sinal").distinct()), "sinal", "left_semi").select(*standing[0].columns))
    return met(reduce(DataFrame.unionAll, looking), reduce(DataFrame.unionAll, standing))


def agrees(f: str) -> Column:
    """Whether both rows agree on a field; null where one of them does not state it."""
    a, b = F.col(f"a.{f}"), F.col(f"b.{f}")
    if f == "price":
        return F.abs(F.ln(a / b)) <= PRICE_TOLERANCE
    if f == "area":
        whole = (a == F.floor(a)) | (b == F.floor(b))
        return F.abs(a - b) <= F.greatest(a, b) * 0.0062 + F.when(whole, 0.5).otherwise(0.06)
    if f in ("city", "hood"):
        return F.when((a >= 0) & (b >= 0), a == b)
    if f == "number":
        return F.when(F.col("a.street") == F.col("b.street"), a == b)
    return a == b


def containment(w: Weights) -> Column:
    """What rows ``a`` and ``b`` both state by its weight, less what the shorter list of features has and the longer lacks and a count that differs."""
    same = {f: agrees(f) for f in (*w.same, "area")}
    total = F.lit(0.0)
    for f, weight in w.same.items():
        if f in GIVEN:
            weight = F.when(same[GIVEN[f][0]], w.given[f]).otherwise(weight)
        if f in COUNTED:
            total = total + F.when(same[f], weight).when(same[f].isNull(), 0.0).otherwise(w.differs[f])
        elif f == "price":
            total = total + F.when(same[f], F.lit(weight + EXACT_PRICE) - FAR_PRICE * F.pow(F.ln(F.col("a.price") / F.col("b.price")) / PRICE_TOLERANCE, 2)).otherwise(0.0)
        else:
            total = total + F.when(same[f], weight).otherwise(0.0)
    apart = F.abs(F.col("a.area") - F.col("b.area"))
    near = F.lit(NEAR_AREA) - FAR_AREA * F.pow(apart / (F.greatest("a.area", "b.area") * 0.0062 + 0.5), 2)
    total = total + F.when(apart < 0.051, EXACT_AREA).otherwise(F.when(same["area"], near).otherwise(0.0))
    shared = F.bit_count(F.col("a.features").bitwiseAND(F.col("b.features")))
    shorter, longer = F.least(F.bit_count("a.features"), F.bit_count("b.features")), F.greatest(F.bit_count("a.features"), F.bit_count("b.features"))
    holds, lacking = w.listed(longer)
    return total + F.when(shorter > 0, shared * holds + (shorter - shared) * lacking).otherwise(0.0)


def agreeing_rows() -> Column:
    """Whether no identifying field of rows ``a`` and ``b`` differs, and at most one count does."""
    wrong = sum((F.when(~F.coalesce(agrees(f), F.lit(True)), 1).otherwise(0) for f in COUNTED), F.lit(0))
    return reduce(Column.__and__, (F.coalesce(agrees(f), F.lit(True)) for f in IDENTIFYING)) & (wrong <= 1)


def enough(w: Weights) -> Column:
    """Whether what is contained in both rows weighs enough where the two stand: in all places that a row leaves open, unless the same
    building or street settles the place, as these weigh what they do within a place.
    """
    settled = F.coalesce(agrees("building"), F.lit(False)) | F.coalesce(agrees("street"), F.lit(False))
    needs = [F.col(f"{r}.need") + F.when(settled, 0.0).otherwise(F.col(f"{r}.wider")) for r in "ab"]
    return containment(w) >= F.greatest(*needs)


def links(stated: DataFrame) -> DataFrame:
    """``u, v`` (u < v): adverts of which some rows are verified to describe one item.

    Rows of an advert that state the same are one node, so copies meet others once.
    """
    nodes = stated.groupBy("anuncio", *CARRIED).agg(F.min("id").alias("node"))
    nodes = written(nodes, "same-item-nodes")
    w = learned(nodes)
    weighed = crowds(nodes.select("node", "anuncio", *CARRIED)).withColumns({"need": need().cast("float"), "most": most(w).cast("float")}).drop("crowd")
    weighed = written(weighed, "same-item-weighed")
    discard(nodes)
    able = weighed.filter("most >= need")  # a row that cannot weigh enough with any other has no link
    # the candidates are few; written apart, the join's condition stays small enough to be compiled
    pairs = written(candidates(able), "same-item-candidates").filter(enough(w))
    found = pairs.select(F.least("a.anuncio", "b.anuncio").alias("u"), F.greatest("a.anuncio", "b.anuncio").alias("v")).distinct()
    return agreeing(found, weighed)


def agreeing(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose adverts agree as a whole: a row that says less must not link what another row of its advert rules out."""
    fields = ("unit", "floor", "building", "street", "number", "year")
    found = written(found, "same-item-links")
    ends = found.select(F.explode(F.array("u", "v")).alias("anuncio")).distinct()
    span = nodes.join(ends, "anuncio", "left_semi").groupBy("anuncio").agg(*(f(c).alias(f"{n}_{c}") for c in fields for n, f in (("lo", F.min), ("hi", F.max))))
    both = found.join(span.alias("x"), F.col("u") == F.col("x.anuncio")).join(span.alias("y"), F.col("v") == F.col("y.anuncio"))
    ok = F.lit(True)
    for c in fields:
        ok = ok & F.coalesce((F.col(f"x.hi_{c}") >= F.col(f"y.lo_{c}")) & (F.col(f"y.hi_{c}") >= F.col(f"x.lo_{c}")), F.lit(True))
    return both.filter(ok).select("u", "v")


def stars(edges: DataFrame) -> DataFrame:
    """``anuncio, estrela``: star clusters of the links, overlapping where a link joins two of them: no link is lost.

    In each round the adverts whose degree is greatest among their free neighbours (ties: the smaller key) become centres,
    and free neighbours join the centre of greatest degree; what is left takes part in the next round, until nothing is: the
    greatest of all is always a centre. A link whose ends then stand in different stars makes a star of its own.
    """
    edges = written(edges.select("u", "v"), "stars-links")
    both = written(edges.union(edges.select("v", "u")).toDF("u", "v"), "stars-edges")
    out, left = None, both
    for k in count():
        degree = left.groupBy("u").agg(F.count("*").alias("g"))
        ranked = left.join(degree.withColumnsRenamed({"u": "v", "g": "gv"}), "v")
        best = ranked.groupBy("u").agg(F.max(F.struct("gv", (-F.col("v")).alias("nv"))).alias("m"))
        centres = best.join(degree, "u").filter(F.struct("g", (-F.col("u")).alias("nv")) > F.struct(F.col("m.gv"), F.col("m.nv"))).select(F.col("u").alias("estrela"), "g")
        near = left.join(centres, left["v"] == centres["estrela"]).groupBy("u").agg(F.max_by("estrela", F.struct("g", -F.col("estrela"))).alias("estrela"))
        own = centres.select(F.col("estrela").alias("u"), "estrela")
        taken = written(near.join(centres.select(F.col("estrela").alias("u")), "u", "left_anti").unionByName(own), f"stars-{k}")
        out = taken if out is None else out.unionByName(taken)
        gone = taken.select("u")
        before = left
        left = written(left.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v"), f"stars-left-{k}")
        if k:
            discard(before)
        if left.isEmpty():
            break
    ends = edges.join(out.withColumnRenamed("estrela", "eu"), "u", "left").join(out.withColumnsRenamed({"u": "v", "estrela": "ev"}), "v", "left")
    across = ends.filter(~F.col("eu").eqNullSafe(F.col("ev")) | F.col("eu").isNull()).select(F.explode(F.array("u", "v")).alias("u"), F.xxhash64("u", "v").alias("estrela"))
    return out.unionByName(across).withColumnRenamed("u", "anuncio")


def same_item_groups(listings: DataFrame, cities: DataFrame, hoods: DataFrame) -> DataFrame:
    """``id, anuncio, estrela`` of each row whose advert is in a group with another advert of the same item.

    Rows without an address state no advert and are left out; null texts and fields state nothing; repeated rows share
    their advert; other columns are not read.
    """
    stated = written(describe(listings, cities, hoods), "same-item-stated")
    groups = stars(links(stated))
    return stated.select("id", "anuncio").join(groups, "anuncio").select("anuncio", "id", "estrela")


def same_item_pairs(groups: DataFrame) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): rows of different adverts of one group."""
    a, b = groups.toDF("anuncio_a", "id_a", "estrela"), groups.toDF("anuncio_b", "id_b", "estrela")
    return a.join(b, "estrela").filter((F.col("id_a") < F.col("id_b")) & (F.col("anuncio_a") != F.col("anuncio_b"))).select("id_a", "id_b").distinct()


def same_item_links(listings: DataFrame, cities: DataFrame, hoods: DataFrame) -> DataFrame:
    """``id_u, id_v``: one row for each link between two adverts, each by the smallest id of its rows, so copies are not expanded. Together with the
    membership of ``same_item_groups`` this is all that the pairs hold."""
    stated = written(describe(listings, cities, hoods), "same-item-stated")
    first = stated.groupBy("anuncio").agg(F.min("id").alias("id"))
    found = links(stated).join(first.toDF("u", "id_u"), "u").join(first.toDF("v", "id_v"), "v")
    return found.select(F.least("id_u", "id_v").alias("id_u"), F.greatest("id_u", "id_v").alias("id_v"))
