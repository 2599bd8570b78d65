"""One tolerant parse of a page into all the fields that are read from HTML, in an Arrow UDF over the standard parser."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


STR, DBL = T.StringType(), T.DoubleType()
SKIPPED = frozenset(("script", "style", "iframe", "noscript", "svg", "nav", "footer", "template"))
VOID = frozenset(("br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "param", "track"))
#: Parts of the types of JSON-LD objects that describe no item, and of those that do.
NO_ITEM = ("organization", "localbusiness", "website", "webpage", "breadcrumb", "searchaction", "person", "imageobject", "agent", "broker", "service")
ITEM_TYPES = ("realestate", "residence", "house", "apartment", "property", "product", "offer", "place")
#: What an image's address holds if it shows no item.
NOISE = re.compile(r"logo|icon|sprite|avatar|placeholder|pixel|banner|whatsapp|\.svg", re.I)
#: Attributes that hold the address of an image loaded late.
LAZY = ("data-src", "data-lazy", "data-original", "data-lazy-src", "src")
SCHEMA = struct(titulo=STR, h1=STR, og_titulo=STR, texto=STR, links=T.ArrayType(STR), imagens=T.ArrayType(STR), jsonld=T.ArrayType(STR), ilha=STR, descricao=STR)


class Page(HTMLParser):
    """Reads a page once; unclosed tags and stray end tags do no harm."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.text: list[str] = []
        self.title: list[str] = []
        self.h1: list[str] = []
        self.links: list[str] = []
        self.og, self.images, self.more = "", [], []
        self.blocks: list[str] = []
        self.leaf: list[str] = []
        self.jsonld: list[str] = []
        self.island = ""
        self.script: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name, value = a.get("property", a.get("name", "")), a.get("content", "")
            if name == "og:title":
                self.og = self.og or value.strip()
            elif name in ("og:image", "twitter:image") and value:
                self.images.append(value)
        elif tag == "link" and a.get("rel") == "image_src" and a.get("href"):
            self.images.append(a["href"])
        elif tag == "img" and (src := next((a[k] for k in LAZY if a.get(k)), "")):
            self.more.append(src)
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "script":
            self.script = "ld" if "ld+json" in a.get("type", "") else "island" if a.get("id") in ("__NEXT_DATA__", "__NUXT_DATA__") else "other"
        if tag in ("p", "div", "li", "section", "article"):
            self.close_block()
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "div", "li", "section", "article"):
            self.close_block()
        if tag == "script":
            self.script = None
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def close_block(self) -> None:
        if t := " ".join("".join(self.leaf).split()):
            self.blocks.append(t)
        self.leaf = []

    def handle_data(self, data: str) -> None:
        if self.script == "ld":
            self.jsonld.append(data.strip())
        elif self.script == "island":
            self.island = self.island or data.strip()
        elif not self.script and not SKIPPED.intersection(self.stack):
            if "title" in self.stack:
                self.title.append(data)
            else:
                self.text.append(data)
                self.leaf.append(data)
                if "h1" in self.stack:
                    self.h1.append(data)


def read(page: str | None, most: int = 6000) -> tuple:
    """The fields of SCHEMA of one page; nulls for a null page."""
    if page is None:
        return (None,) * 9
    p = Page()
    p.feed(page)
    p.close()
    p.close_block()
    squeeze = lambda parts: " ".join("".join(parts).split())
    title, text = squeeze(p.title), " ".join(" ".join(p.text).split())
    if title and title not in text[:200]:
        text = f"{title} {text}"
    images = [u for u in dict.fromkeys([*p.images, *p.more]) if not NOISE.search(u) and not u.startswith("data:")][:30]
    told = max((b for b in p.blocks if 80 <= len(b) <= 2000 and "cookie" not in b.lower()), key=len, default=None)
    return title or None, squeeze(p.h1) or None, p.og or None, text[:most], list(dict.fromkeys(p.links)), images, p.jsonld, p.island or None, told and told[:500]


@F.pandas_udf(SCHEMA)
def parsed(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(x) for x in pages], columns=SCHEMA.names)


def item_of(blocks: list[str] | None) -> dict | None:
    """The first JSON-LD object of an item's type with a name or a price; broken blocks are passed over."""
    for b in [] if blocks is None else blocks:
        try:
            found = json.loads(b)
        except ValueError:
            continue
        for o in found if isinstance(found, list) else [found]:
            if not isinstance(o, dict):
                continue
            kind = str(o.get("@type", "")).lower()
            if any(t in kind for t in NO_ITEM) or not any(t in kind for t in ITEM_TYPES):
                continue
            try:
                got = _item(o)
            except (TypeError, ValueError, AttributeError):
                continue
            if got["titulo"] or got["preco"]:
                return got
    return None


def _item(o: dict) -> dict:
    offer = o.get("offers", {})
    offer = (offer[0] if offer else {}) if isinstance(offer, list) else offer
    where = o.get("address", {})
    where = {} if isinstance(where, str) else where
    price = offer.get("price") or o.get("price") or offer.get("lowPrice")
    region = where.get("addressRegion") or ""
    text = lambda v: v if v is None or isinstance(v, str) else str(v)
    return {
        "titulo": text(o.get("name") or o.get("headline")), "descricao": (o.get("description") or "")[:500] or None, "cidade": text(where.get("addressLocality")), "bairro": text(where.get("streetAddress") or region.split(",")[0].strip() or None),
        "estado": region[-2:].upper() or None, "preco": float(price) if price else None, "area_m2": floor_size(o.get("floorSize")), "quartos": safe_count(o.get("numberOfRooms") or o.get("numberOfBedrooms")),
        "banheiros": safe_count(o.get("numberOfBathroomsTotal") or o.get("numberOfBathrooms")), "vagas": safe_count(o.get("numberOfParkingSpaces")),
    }


def floor_size(v: object) -> float | None:
    """A floor area as a number, an object with a value, or a text written the local way."""
    if isinstance(v, dict):
        v = v.get("value", v.get("unitText"))
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v) if v > 0 else None
    m = re.search(r"[0-9.,]+", v.replace(".", "").replace(",", ".")) if isinstance(v, str) else None
    try:
        return float(m[0]) if m else None
    except ValueError:
        return None


def safe_count(v: object) -> int | None:
    """A whole number above 0."""
    try:
        n = int(v)
    except (TypeError, ValueError):
        return None
    return n if n > 0 else None


def positive(v: object) -> float | None:
    try:
        x = float(str(v).replace(",", "."))
    except ValueError:
        return None
    return x if x > 0 else None


INT = T.IntegerType()
READING = struct(titulo=STR, descricao=STR, cidade=STR, bairro=STR, estado=STR, preco=DBL, area_m2=DBL, quartos=INT, banheiros=INT, vagas=INT)


@F.pandas_udf(READING)
def jsonld_item(blocks: pd.Series) -> pd.DataFrame:
    rows = [item_of(b) or {} for b in blocks]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object, index=blocks.index) for c in READING.names})


#: Names under which sites keep a field.
ALIASES = {"titulo": ("titulo", "title", "nome", "name"), "preco": ("preco", "price", "valor", "valor_venda"), "tipo": ("tipo", "type", "categoria"), "id": ("id", "codigo", "code", "ref"), "quartos": ("quartos", "dormitorios", "bedrooms", "rooms")}


def listing_arrays(node: object, depth: int = 0) -> list[list[dict]]:
    """Arrays of two or more objects anywhere in a JSON value; of an array only the first three members are searched."""
    out: list[list[dict]] = []
    if depth > 10:
        return out
    if isinstance(node, list):
        objects = [x for x in node if isinstance(x, dict)]
        if len(objects) >= 2:
            out.append(objects)
        for x in node[:3]:
            out += listing_arrays(x, depth + 1)
    elif isinstance(node, dict):
        for x in node.values():
            out += listing_arrays(x, depth + 1)
    return out


def alias(o: dict, field: str) -> object:
    low = {k.lower(): v for k, v in o.items()}
    return next((low[a] for a in ALIASES[field] if low.get(a) not in (None, "")), None)


def island_rows(text: str | None) -> list[tuple]:
    """``(id, titulo, tipo, preco, quartos)`` of the array of the island that looks most like listings, then the longest one."""
    try:
        arrays = listing_arrays(json.loads(text)) if text else []
    except ValueError:
        return []
    if not arrays:
        return []
    points = lambda a: sum(alias(a[0], f) is not None for f in ALIASES)
    best = max(arrays, key=lambda a: (points(a), len(a)))
    if points(best) < 2:
        return []
    text_of = lambda v: None if v is None else str(v)
    return [(text_of(alias(o, "id")), text_of(alias(o, "titulo")), text_of(alias(o, "tipo")), positive(alias(o, "preco")), positive(alias(o, "quartos"))) for o in best]


@F.pandas_udf(T.ArrayType(struct(id=STR, titulo=STR, tipo=STR, preco=DBL, quartos=DBL)))
def island_items(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("id", "titulo", "tipo", "preco", "quartos"), r)) for r in island_rows(t)] for t in texts])


CARD = re.compile(r"<(?:div|article|li)[^>]*class=[\"'][^\"']*(?:card|imovel|property|listing)[^\"']*[\"'][^>]*>(.*?)(?=<(?:div|article|li)[^>]*class=[\"'][^\"']*(?:card|imovel|property|listing)|$)", re.I | re.S)


def card_rows(page: str | None) -> list[tuple]:
    """``(url, titulo, texto)`` of the cards of a page of listings that hold a price; cards with the same address count once."""
    out: dict[str, tuple] = {}
    for m in CARD.finditer(page or ""):
        p = Page()
        p.feed(m[1])
        p.close()
        text = " ".join(" ".join(p.text).split())
        if "R$" in text and p.links:
            out.setdefault(p.links[0], (p.links[0], (p.blocks[0] if p.blocks else None), text))
    return list(out.values())


@F.pandas_udf(T.ArrayType(struct(url=STR, titulo=STR, texto=STR)))
def cards(pages: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("url", "titulo", "texto"), r)) for r in card_rows(x)] for x in pages])


@F.pandas_udf(T.ArrayType(STR))
def chunks(pages: pd.Series) -> pd.Series:
    """Pages in pieces of up to 16 000 characters that end before a closing tag where there is one."""

    def cut(s: str | None, size: int = 16_000) -> list[str]:
        out = []
        while s:
            end = len(s) if len(s) <= size else (s.rfind("</", 1, size) if s.rfind("</", 1, size) > 0 else size)
            out.append(s[:end])
            s = s[end:]
        return out

    return pd.Series([cut(x) for x in pages])


#: What the first part of a page says if the item is gone, and how the title of a list of items reads.
GONE, A_LIST = r"(?<![0-9])404(?![0-9])|não encontrad|not found", r"[0-9]+\s*im[óo]veis?\s+para\s+(?:alugar|comprar|venda)"


def soft_404(text):  # noqa: ANN001, ANN201
    """Whether the first 2 000 characters of a page say that there is nothing."""
    return F.lower(F.substring(text, 1, 2000)).rlike(GONE)


def is_list_page(title):  # noqa: ANN001, ANN201
    """Whether a title announces many items."""
    return F.coalesce(F.lower(title).rlike(A_LIST), F.lit(False))
