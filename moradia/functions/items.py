"""What pages say about items: cards of list pages, the object of a detail page, its text and breadcrumb, menus; one Arrow call a page."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moradia.functions.dom import Node, matcher, tree
from moradia.functions.html import struct

TEXT, REAL, WHOLE = T.StringType(), T.DoubleType(), T.IntegerType()
ITEM = struct(url=TEXT, titulo=TEXT, tipo=TEXT, bairro=TEXT, cidade=TEXT, estado=TEXT, preco=REAL, area_m2=REAL, quartos=WHOLE, banheiros=WHOLE, vagas=WHOLE, imagens=T.ArrayType(TEXT), id=TEXT)
FIELDS = ITEM.names

#: Where the builders of sites put the fields of a card.
BUILDERS = {
    "tecimob": {
        "card": ".property-item, .imovel-item, [data-property-id], .listing-item", "titulo": ".property-title, .imovel-title, h2, h3",
        "preco": ".property-price, .imovel-preco, .price, [class*='preco'], [class*='price']", "tipo": ".property-type, .imovel-tipo, [class*='tipo'], [class*='type']",
        "endereco": ".property-address, .imovel-endereco, address, [class*='address'], [class*='endereco']", "area_m2": "[class*='area'], [class*='m2'], [class*='metros']",
        "quartos": "[class*='quarto'], [class*='dorm'], [class*='bedroom']", "banheiros": "[class*='banheiro'], [class*='bathroom']", "vagas": "[class*='vaga'], [class*='garagem'], [class*='garage']",
        "img": ("src", "data-src"),
    },
    "jetimob": {
        "card": ".property-block, .listing-property, .card-property, .imovel-card, [class*='property-card']", "titulo": ".property-title, .imovel-titulo, h2, h3, [class*='title']",
        "preco": ".property-price, .valor, .preco, [class*='price'], [class*='valor']", "tipo": ".property-type, .tipo, [class*='type'], [class*='tipo']",
        "endereco": ".property-address, .endereco, address, [class*='address'], [class*='bairro']", "area_m2": "[class*='area'], [class*='m2'], [title*='m²']",
        "quartos": "[class*='quarto'], [class*='dorm'], [title*='quarto'], [title*='dormitório']", "banheiros": "[class*='banheiro'], [class*='bath']", "vagas": "[class*='vaga'], [class*='garagem'], [class*='garage']",
        "img": ("src", "data-src", "data-lazy"),
    },
}
#: Names under which sites keep a field, in order of preference.
NAMES = {
    "preco": ("preco", "price", "valor", "valor_venda", "preco_venda", "venda"), "quartos": ("quartos", "dormitorios", "bedrooms", "rooms"), "banheiros": ("banheiros", "bathrooms", "banheiro", "wc"),
    "vagas": ("vagas", "garagem", "garage", "parking"), "area_m2": ("area", "area_util", "area_privativa", "area_total", "metragem"), "tipo": ("tipo", "type", "categoria"), "titulo": ("titulo", "title", "nome", "name"),
    "cidade": ("cidade", "city"), "bairro": ("bairro", "neighborhood", "district"), "estado": ("estado", "uf", "state"), "imagens": ("fotos", "photos", "imagens", "images"), "id": ("id", "codigo", "code", "ref"), "url": ("url", "link", "href", "slug"),
}
TOLD = ("preco", "quartos", "area_m2", "tipo", "cidade", "imagens")


def local_float(s: str) -> float | None:
    """The leading number of a text written the local way, once everything but digits, the first comma and dots of thousands is gone."""
    m = re.match(r"\d*\.?\d*", re.sub(r"[^\d.]", "", s.replace(".", "").replace(",", ".", 1)))
    try:
        v = float(m[0])
    except (TypeError, ValueError):
        return None
    return v if v > 0 else None


def price_of(s: str) -> float | None:
    return local_float(re.sub(r"R\$\s*", "", s, flags=re.I)) if s else None


def area_of(s: str) -> float | None:
    m = re.search(r"([\d.,]+)\s*m[²2]", s, re.I)
    return local_float(m[1]) if m else None


def count_of(s: str) -> int | None:
    m = re.search(r"\d+", s or "")
    return int(m[0]) or None if m else None


def kind_of(s: str | None) -> str | None:
    """One of four classes by the words of a text."""
    t = (s or "").lower()
    rules = (("apartamento", ("apartamento", "apto")), ("casa", ("casa", "sobrado")), ("terreno", ("terreno", "lote")), ("comercial", ("comercial", "sala", "loja", "galpão")))
    return next((k for k, words in rules if any(w in t for w in words)), None)


def place_of(s: str) -> tuple[str | None, str | None, str | None]:
    """``(neighbourhood, city, state)`` of an address between commas and dashes; a part ``City/UF`` names city and state, else the last two parts are neighbourhood and city."""
    parts = [p.strip() for p in re.split(r"[,–-]", s) if p.strip()]
    slash = next((p for p in parts if re.search(r"/\s*[A-Za-z]{2}$", p)), None)
    if slash:
        city, uf = (x.strip() for x in slash.rsplit("/", 1))
        k = parts.index(slash)
        return (parts[k - 1] if k else None), city or None, uf.upper()
    if parts and re.fullmatch(r"[A-Z]{2}", parts[-1]):
        return (parts[-3] if len(parts) > 2 else None), (parts[-2] if len(parts) > 1 else None), parts[-1]
    return (parts[-2] if len(parts) > 1 else parts[0] if parts else None), (parts[-1] if len(parts) > 1 else None), None


@lru_cache(maxsize=256)
def _test(selector: str):  # noqa: ANN202
    return matcher(selector)


def first_text(n: Node, selector: str) -> str:
    got = n.find(_test(selector))
    return got.text().strip() if got else ""


def item(**values: object) -> dict:
    return {f: values.get(f) or None for f in FIELDS}


def platform_cards(page: str | None, base: str, builder: str) -> list[dict]:
    """The cards of a list page of one site builder; a card without a link is none."""
    where, out = BUILDERS[builder], []
    for card in tree(page or "").find_all(_test(where["card"])):
        link = card.find(_test("a[href]")) or card.up(lambda n: n.tag == "a")
        href = link.attrs.get("href", "") if link else ""
        if not href:
            continue
        title = first_text(card, where["titulo"])
        if not title and builder == "tecimob":
            title = f"{first_text(card, '.property-type, .imovel-tipo')} {first_text(card, '.property-address, .imovel-endereco, .neighborhood')}".strip()
        hood, city, uf = place_of(first_text(card, where["endereco"]))
        images = []
        for img in card.find_all(_test("img")):
            src = next((img.attrs[a] for a in where["img"] if img.attrs.get(a)), "")
            if src and "placeholder" not in src and "loading" not in src and (builder == "tecimob" or "http" in src):
                images.append(urljoin(base, src))
        values = dict(
            url=urljoin(base, href), titulo=title, tipo=kind_of(first_text(card, where["tipo"])) or kind_of(title), bairro=hood, cidade=city, estado=uf, preco=price_of(first_text(card, where["preco"])),
            area_m2=area_of(first_text(card, where["area_m2"])), quartos=count_of(first_text(card, where["quartos"])), banheiros=count_of(first_text(card, where["banheiros"])), vagas=count_of(first_text(card, where["vagas"])), imagens=images[:5],
        )
        out.append(item(**values))
    return out


ANY_CARD = "[class*='card'], [class*='imovel'], [class*='property'], [class*='listing']"


def heuristic_cards(page: str | None, base: str) -> list[dict]:
    """Cards of an unknown builder: the smallest elements of a card's class that hold a price and a link, else the smallest ones that hold a price at all; one for each beginning of 80 characters."""
    root = tree(page or "")
    priced = [n for n in root.walk() if "R$" in n.text()]
    holds = {id(n) for n in priced}
    leaf = lambda n: not any(isinstance(c, Node) and id(c) in holds for c in n.children)
    named = [n for n in priced if _test(ANY_CARD)(n) and n.find(_test("a[href]"))]
    inner = {id(p) for n in named for p in _above(n)}
    found = [n for n in named if id(n) not in inner]
    if not found:
        found = [n.up(lambda x: x.parent is None or x.find(_test("a[href]")) is not None) for n in priced if leaf(n)]
    seen: dict[str, dict] = {}
    for n in found:
        text = n.words()
        link = n.find(_test("a[href]"))
        price = price_of((re.search(r"R\$\s*([\d.,]+)", text) or [None, ""])[1])
        if not link or not price:
            continue
        number = lambda p, t=text: count_of((re.search(rf"(\d+)\s*(?:{p})", t, re.I) or [None, ""])[1])
        title = first_text(n, "h1, h2, h3, h4, [class*='title'], [class*='titulo']") or (n.find(_test("img[alt]")).attrs["alt"] if n.find(_test("img[alt]")) else "")
        images = [urljoin(base, i.attrs.get("src") or i.attrs.get("data-src") or "") for i in n.find_all(_test("img")) if i.attrs.get("src") or i.attrs.get("data-src")]
        card = item(url=urljoin(base, link.attrs["href"]), titulo=title, tipo=kind_of(title) or kind_of(text), preco=price, area_m2=area_of(text), quartos=number("quartos?|dorm"), banheiros=number("banheiros?|wc"), vagas=number("vagas?|garage"), imagens=images[:5])
        seen.setdefault(text[:80], card)
    return list(seen.values())


def _above(n: Node) -> list[Node]:
    out = []
    while n.parent is not None:
        n = n.parent
        out.append(n)
    return out


def island(page: str) -> str | None:
    """The JSON that a page's own script starts from: by the script's name, or what is assigned to it."""
    m = re.search(r"<script[^>]*id=[\"'](?:__NEXT_DATA__|__NUXT_DATA__)[\"'][^>]*>(.*?)</script>", page, re.S) or re.search(r"window\.__NUXT__\s*=\s*(\{.*?\})\s*;?\s*</script>", page, re.S)
    return m[1] if m else None


def load(text: str | None) -> object:
    """JSON, or what is left of it if it was cut off: up to the last closing brace of a list; None if nothing can be read."""
    if not text:
        return None
    try:
        return json.loads(text)
    except ValueError:
        pass
    end = text.rfind("}")
    while end > 0:
        for tail in ("", "]", "}", "]}"):
            try:
                return json.loads(text[: end + 1] + tail)
            except ValueError:
                continue
        end = text.rfind("}", 0, end)
        if len(text) - end > 20_000:
            break
    return None


def named(o: dict, field: str) -> object:
    low = {k.lower(): v for k, v in o.items()}
    return next((low[a] for a in NAMES[field] if low.get(a) not in (None, "")), None)


def whole(v: object) -> int | None:
    """A number or a number's text as a whole number, half up; None unless positive."""
    if isinstance(v, bool) or v is None:
        return None
    x = float(v) if isinstance(v, (int, float)) else local_float(v) if isinstance(v, str) else None
    return int(x + 0.5) or None if x and x > 0 else None


def addresses(v: object) -> list[str]:
    """Addresses in a text, a list of texts or a list of objects that hold one."""
    if isinstance(v, str):
        v = [v]
    if not isinstance(v, list):
        return []
    keys = ("url", "src", "thumb", "medium", "large", "original")
    out = [next((x[k] for k in keys if x.get(k) is not None), "") if isinstance(x, dict) else x for x in v]
    return [x for x in out if isinstance(x, str) and x.startswith("http")]


def property_object(o: object, depth: int = 0) -> dict | None:
    """The first object, ten levels down at most, that holds three of the known names; of a list only five members are looked at, of a long one none."""
    if depth > 10:
        return None
    if isinstance(o, list):
        return next((x for m in o[:5] if (x := property_object(m, depth + 1))), None) if len(o) <= 20 else None
    if not isinstance(o, dict):
        return None
    low = {k.lower() for k in o}
    if sum(n in low for f in TOLD for n in NAMES[f]) >= 3:
        return o
    return next((x for m in o.values() if (x := property_object(m, depth + 1))), None)


def from_object(o: dict) -> dict:
    price = whole(named(o, "preco"))
    title, city, hood, uf = (named(o, f) for f in ("titulo", "cidade", "bairro", "estado"))
    text = lambda v, n: v if isinstance(v, str) and len(v) > n else None
    return item(
        preco=float(price) if price and price > 1000 else None, tipo=kind_of(str(named(o, "tipo") or "")), quartos=whole(named(o, "quartos")), banheiros=whole(named(o, "banheiros")), vagas=whole(named(o, "vagas")),
        area_m2=float(whole(named(o, "area_m2")) or 0), titulo=text(title, 3), cidade=text(city, 1), bairro=text(hood, 1), estado=text(uf, 0), imagens=addresses(named(o, "imagens"))[:10], id=str(named(o, "id") or ""), url=text(named(o, "url"), 0),
    )


#: How the text of a detail page labels its fields, tried in this order; what leads to the place in a breadcrumb; a place in the text.
LABELLED = {
    "preco": (r"(?:venda|pre[cç]o|valor)[:\s]*R\$\s*([\d.,]+)", r"R\$\s*([\d.,]+)"),
    "quartos": (r"(?:dormit[oó]rios?|quartos?|dorms?)\s*[:\s]\s*(\d+)",),
    "banheiros": (r"(?:banheiros?|wc|lavabos?)\s*[:\s]\s*(\d+)",),
    "vagas": (r"(?:vagas?|garagem|estacionamento)\s*[:\s]\s*(\d+)",),
    "area_m2": (r"(?:[aá]rea\s*(?:privativa|total|[uú]til)?)\s*[:\s]\s*([\d.,]+)\s*m[²2]",),
    "tipo": (r"tipo\s*(?:do\s*)?im[oó]vel\s*[:\s]*([a-záàãâéêíóôõú\s]+)",),
}
CRUMBS, CRUMB_MARKS, DEALS = "nav, [class*='breadcrumb'], [class*='caminho']", r"[>›»/|]", "venda|aluguel|comprar"
PLACE_IN_TEXT = r"([A-ZÀ-Ú][a-záàãâéêíóôõú\s]+)\s*[-–]\s*([A-ZÀ-Ú][a-záàãâéêíóôõú\s]+)"
ITEM_PATH = r"/\d{4,}|/imovel/|/property/|/venda/[^-].*/\d|/aluguel/[^-].*/\d"
READ_AS = {"preco": price_of, "quartos": count_of, "banheiros": count_of, "vagas": count_of, "area_m2": lambda v: local_float(v) if v else None, "tipo": kind_of}


def labelled(text: str, field: str) -> object:
    """What the first label of a field that a text holds is followed by, read as the field's value."""
    found = (m[1] for p in LABELLED[field] if (m := re.search(p, text, re.I)))
    return READ_AS[field](next(found, ""))


def crumb_places(root: Node) -> tuple[str | None, str | None]:
    """City and neighbourhood of a breadcrumb: what comes after the deal."""
    crumb = root.find(_test(CRUMBS))
    parts = [p.strip() for p in re.split(CRUMB_MARKS, crumb.text() if crumb else "") if len(p.strip()) > 1]
    rest = next((parts[k + 1 :] for k, p in enumerate(parts) if re.search(DEALS, p, re.I)), [])
    return (rest[0], rest[1]) if len(rest) > 1 else (None, None)


def detail(page: str | None, base: str = "") -> dict:
    """The item of a detail page: the object of its JSON if that has a price or rooms, completed by labels in its text and its breadcrumb."""
    page = page or ""
    o = property_object(load(island(page)))
    out = from_object(o) if o else item()
    if out["preco"] or out["quartos"]:
        return out
    root = tree(page)
    text = root.words(frozenset(("script", "style")))
    for field in LABELLED:
        value = None if out[field] else labelled(text, field)
        if value and not (field == "preco" and value <= 1000):
            out[field] = value
    heading = root.find(_test("h1"))
    title = heading.text().strip() if heading else ""
    out["titulo"] = out["titulo"] or (title if len(title) > 5 else None)
    out["tipo"] = out["tipo"] or kind_of(out["titulo"])
    if not (out["bairro"] and out["cidade"]):
        city, hood = crumb_places(root)
        if not (out["bairro"] or hood) and (m := re.search(PLACE_IN_TEXT, text)):
            hood, named_city, _ = place_of(f"{m[1]} - {m[2]}")
            city = city or named_city
        out["cidade"], out["bairro"] = out["cidade"] or city, out["bairro"] or hood
    return out


def island_list(o: object, depth: int = 0) -> list[dict]:
    """The list of objects in a JSON value that looks most like items, then the longest; empty if none holds two of the known names."""
    lists: list[list[dict]] = []
    stack = [(o, depth)]
    while stack:
        x, d = stack.pop()
        if d > 10:
            continue
        if isinstance(x, list):
            objects = [m for m in x if isinstance(m, dict)]
            if len(objects) >= 2:
                lists.append(objects)
            stack += [(m, d + 1) for m in x[:3]]
        elif isinstance(x, dict):
            stack += [(m, d + 1) for m in x.values()]
    points = lambda a: sum(named(a[0], f) is not None for f in NAMES)
    best = max(lists, key=lambda a: (points(a), len(a)), default=[])
    return best if best and points(best) >= 4 else []


def linked(items: list[dict], links: list[str], base: str) -> list[dict]:
    """Items with addresses: the first link whose path holds the id as a segment; if none does and there are as many links as items to twice as many, one after the other;
    else, where every match ends in its id, the same path with the own id."""
    split = [(u, re.split(r"[/=?#]", urlsplit(u).path)) for u in links]
    at = {}
    for u, parts in split:
        for p in parts:
            at.setdefault(p, u)
    got = [i["url"] and urljoin(base, i["url"]) or (at.get(i["id"]) if i["id"] else None) for i in items]
    if not any(got) and len(items) <= len(links) <= 2 * len(items):
        return [i | {"url": u} for i, u in zip(items, links)]
    matched = [(i["id"], u) for i, u in zip(items, got) if u and i["id"]]
    if matched and all(urlsplit(u).path.rstrip("/").endswith(f"/{k}") for k, u in matched):
        first, u = matched[0]
        prefix = urlsplit(u)._replace(query="", fragment="").geturl().rstrip("/")[: -len(first)]
        got = [u or (prefix + i["id"] if i["id"] else None) for i, u in zip(items, got)]
    return [i | {"url": u} for i, u in zip(items, got)]


def item_links(root: Node, base: str) -> list[str]:
    origin = urlsplit(base)
    out = []
    for a in root.find_all(_test("a[href]")):
        u = urljoin(base, a.attrs["href"])
        p = urlsplit(u)
        if p.netloc == origin.netloc and len(p.path) >= 4 and re.search(ITEM_PATH, p.path):
            out.append(u)
    return list(dict.fromkeys(out))


def list_items(page: str | None, base: str) -> list[dict]:
    """The items of a list page: those of its JSON with their addresses; else its cards if there are three; items with the same address count once, the last one."""
    found = island_list(load(island(page or "")))
    if found:
        items = linked([from_object(o) for o in found], item_links(tree(page), base), base)
        items = [i | {"url": i["url"] or (urljoin(base, f"/imovel/{i['id']}") if i["id"] else None)} for i in items]
    else:
        items = heuristic_cards(page, base)
    return list({i["url"] or id(i): i for i in items}.values())


def menu(page: str | None, base: str, most: int = 40) -> list[dict]:
    """Links of the navigation with their labels, of the whole page where it has none; distinct, ``most`` at the most."""
    root = tree(page or "")
    navs = root.find_all(_test("nav, header, [class*='menu']"))
    links = [a for n in navs for a in n.find_all(_test("a[href]"))] or root.find_all(_test("a[href]"))
    out: dict[str, dict] = {}
    for a in links:
        u = urljoin(base, a.attrs["href"])
        if u.startswith("http"):
            out.setdefault(u, {"url": u, "rotulo": a.words()})
    return list(out.values())[:most]


KEPT_ATTRIBUTES = frozenset(("href", "src", "alt", "title", "class"))


def compact(page: str | None) -> str:
    """A page for reading by a model: without scripts, styles, comments and attributes other than the telling ones, white space squeezed."""
    page = re.sub(r"(?is)<(script|style|noscript|svg|iframe)\b.*?</\1\s*>|<!--.*?-->", "", page or "")
    page = re.sub(r"\s([\w:-]+)(?:=(\"[^\"]*\"|'[^']*'|[^\s>]+))?", lambda m: m[0] if m[2] is None or m[1].lower() in KEPT_ATTRIBUTES else "", page)
    return re.sub(r"\s+", " ", page).strip()


ITEMS = T.ArrayType(ITEM)


def _per_page(f, schema: T.DataType):  # noqa: ANN001, ANN202
    @F.pandas_udf(schema)
    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([f(p, b or "") for p, b in zip(pages, bases)])

    return run


list_items_of = _per_page(list_items, ITEMS)
heuristic_cards_of = _per_page(heuristic_cards, ITEMS)
menu_of = _per_page(menu, T.ArrayType(struct(url=TEXT, rotulo=TEXT)))
item_links_of = _per_page(lambda p, b: item_links(tree(p or ""), b), T.ArrayType(T.StringType()))


def platform_cards_of(page: Column, base: Column, builder: str) -> Column:
    return _per_page(lambda p, b: platform_cards(p, b, builder), ITEMS)(page, base)


@F.pandas_udf(ITEM)
def detail_of(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detail(p, b or "") for p, b in zip(pages, bases)], columns=FIELDS)


@F.pandas_udf(T.StringType())
def compacted(pages: pd.Series) -> pd.Series:
    return pages.map(compact)


@F.pandas_udf(T.StringType())
def recovered(texts: pd.Series) -> pd.Series:
    """JSON texts as far as they can be read, in one form; null where nothing can."""
    return pd.Series([None if (x := load(t)) is None else json.dumps(x, ensure_ascii=False) for t in texts])


def decoded(raw: Column) -> Column:
    """Bytes as text, whatever is no UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("string"))
