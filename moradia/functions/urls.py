"""Addresses: classes, places, templates and paging, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moradia.functions.text import kind

#: What an address of no item holds.
SKIP_PATTERNS = (
    r"/(contato|sobre|blog|faq|politica|termos|privacidade|quem-somos)",
    r"/(login|cadastro|admin|painel|area-do-cliente|minha-conta)",
    r"/(listar|comparar|favorit)",
    r"/(trabalhe|carreiras|equipe|corretor)",
    r"/(plantao|atendimento|simulador|financiamento)",
    r"/(anuncie|anunciar|anuncie-o-seu|anuncie-seu|publicar)",
    r"/imoveis/?(\?|#|$)",
    r"/-/-",
    r"/(page|pagina|pag)/[0-9]+",
    r"[?&](page|pagina|pag)=[0-9]+",
    r"/#",
    r"\.(pdf|jpg|jpeg|png|gif|svg|css|js|ico|webp|mp4|xml)(\?|$)",
)
#: Paths of lists.
LIST_PATTERNS = (
    r"/(comprar|venda|alugar|aluguel)/(cidade|bairro|tipo|regiao)/",
    r"^/(comprar|venda|alugar|aluguel)/?$",
    r"^/imoveis/(comprar|venda|alugar|aluguel)/?$",
)
SKIP, LISTS = "|".join(SKIP_PATTERNS), "|".join(LIST_PATTERNS)
#: Path words that name a section.
SECTIONS = ("imovel", "imoveis", "imovel-detalhe", "property", "properties", "venda", "aluguel", "locacao", "comprar", "alugar", "lancamento", "lancamentos", "temporada", "permuta")
#: Path words that name a kind.
KIND_SLUGS = ("apartamento", "casa", "terreno", "sobrado", "cobertura", "kitnet", "sala", "loja", "galpao", "chacara", "predio", "pavilhao", "box", "rural", "comercial", "flat", "loft", "duplex", "triplex", "lote", "sitio", "barracao")
UFS = ("AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA", "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO")


def host(url: Column) -> Column:
    """Host in lower case, without port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]+)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]+([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def is_detail(url: Column, base_host: Column) -> Column:
    """Whether an address leads to one item of the site ``base_host``: sure signs first, then what rules it out, then weak signs."""
    p, u, s = path(url), F.lower(url), segments(url)
    sure = p.rlike(r"/imovel/[0-9]+") | F.lower(p).rlike(r"/imovel/[a-z0-9][a-z0-9_-]{5,}") | u.rlike(r"/imovel\?(?:code|id|ref|cod)=[a-z0-9_]+")
    weak = F.exists(s, lambda x: x.rlike("^[0-9]+$")) | F.exists(s, lambda x: (F.length(x) > 15) & x.contains("-")) | (F.size(s) >= 3) | F.lower(p).rlike(r"(?:^|[^a-z0-9_])(?:ref|cod|id)[-_]?[0-9]+")
    same = F.coalesce(host(url) == F.lower(base_host), F.lit(False))
    return F.when(~same, False).when(sure, True).when(F.coalesce(p, F.lit("")).isin("", "/"), False).when(u.rlike(SKIP) | F.lower(p).rlike(LISTS), False).otherwise(F.coalesce(weak, F.lit(False)))


def deslug(s: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(s, "-+", " ")))


def slug(c: Column) -> Column:
    low = F.translate(F.lower(c), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def location(url: Column) -> Column:
    """``struct(bairro, cidade)`` of a path without sections, numbers and names of kinds: with a state at the end neighbourhood then city, else city then neighbourhood."""
    named = lambda s: kind(F.lit(""), F.replace(s, F.lit("-"), F.lit(" "))).isNotNull()
    parts = F.filter(segments(url), lambda s: (F.trim(s) != "") & (s != "-") & ~s.rlike("^[0-9]+$") & ~F.lower(s).isin(*SECTIONS) & ~named(s))
    n = F.size(parts)
    state = F.coalesce(F.upper(F.get(parts, n - 1)).isin(*UFS), F.lit(False))
    hood = F.when(state, F.when(n >= 3, F.get(parts, n - 3))).when(n >= 2, F.get(parts, F.lit(1)))
    city = F.when(state, F.when(n >= 2, F.get(parts, n - 2))).when(n >= 1, F.get(parts, F.lit(0)))
    return F.struct(deslug(hood).alias("bairro"), deslug(city).alias("cidade"))


def kind_in(url: Column) -> Column:
    return F.get(F.filter(F.transform(segments(url), F.lower), lambda s: s.isin(*KIND_SLUGS)), F.lit(0))


def image_class(url: Column) -> Column:
    """Class of an image by its path: logo, map or plan, photo, unknown."""
    p = F.lower(F.coalesce(F.nullif(path(url), F.lit("")), url))
    return F.when(p.rlike("logo|icon|avatar|favicon|brand|sprite|banner|hero"), "logo_or_banner").when(p.rlike("mapa|map|planta|floorplan|croqui"), "mapa_ou_planta").when(p.rlike("imovel|property|galeria|gallery|foto|photo|upload|media"), "likely_property_photo").otherwise("unknown")


def platform(url: Column, html: Column) -> Column:
    """Site builder by its mark in the address or the page; the first of the fixed order wins."""
    u, h = F.lower(url), F.lower(html)
    marks = (("tecimob", "tecimob.com.br", ("tecimob",)), ("jetimob", "jetimob.com", ("jetimob",)), ("bume", "bume.com.br", ("bume.com",)), ("imoview", "imoview.com.br", ("imoview",)), ("sobressai", "\u0000", ("sobressai", "imobtotal")))
    out = F.lit("generic")
    for name, domain, words in reversed(marks):
        hit = u.contains(domain)
        for w in words:
            hit = hit | h.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def template(first: Column, second: Column) -> Column:
    """The page template of two addresses of pages 1 and 2: the number that differs becomes ``{N}``; null if none or several differ."""
    a, b = F.split(first, "(?<=[^0-9])(?=[0-9])|(?<=[0-9])(?=[^0-9])"), F.split(second, "(?<=[^0-9])(?=[0-9])|(?<=[0-9])(?=[^0-9])")
    zipped = F.arrays_zip(a.alias("a"), b.alias("b"))
    differ = F.filter(zipped, lambda x: ~x["a"].eqNullSafe(x["b"]))
    out = F.array_join(F.transform(zipped, lambda x: F.when(x["a"].eqNullSafe(x["b"]), x["b"]).otherwise("{N}")), "")
    return F.when((F.size(a) == F.size(b)) & (F.size(differ) == 1) & F.forall(differ, lambda x: x["b"].rlike("^[0-9]+$")), out)


def numbered(url_template: Column, first: Column, step: Column, last: Column) -> Column:
    """Addresses of pages ``first, first + step, ...`` up to ``last``."""
    return F.transform(F.sequence(first, last, step), lambda n: F.replace(url_template, F.lit("{N}"), n.cast("string")))


def absolute(link: Column, base: Column) -> Column:
    """A link against its page: absolute as is, ``//x`` with the scheme, ``/x`` with the host, anything else beside the page."""
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([a-zA-Z]+://[^?#]+)", 1), "(?<=[^/])/[^/]*$", "/")
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), link))


#: What the path and the label of a menu link are worth, and what rules a link out.
MENU_PATHS = (
    ("/imoveis/venda", 10), ("/imoveis/comprar", 10), ("/imoveis-a-venda", 10), ("/imoveis/para-venda", 10), ("/comprar/", 8), ("/venda/", 8), ("/imoveis", 6),
    ("/residencial", 4), ("/busca", 3), ("/buscar", 3), ("/search", 2), ("/listing", 2), ("/properties", 2),
)
MENU_LABELS = (("comprar|à venda|a venda", 6), ("imóveis|imoveis", 4), ("venda", 3), ("buscar|busca", 2), ("residencial", 2))
MENU_AGAINST, MENU_LEAST = "/blog|/noticias|/sobre|/contato|/equipe|/parceiros|/trabalhe|/login|/cadastro", 4


def menu_score(link: Column, label: Column) -> Column:
    """How much a menu link looks like the list of items: the worth of its path and label, 10 less for another subject; null if it is no address."""
    p, t = F.lower(path(link)), F.lower(F.coalesce(label, F.lit("")))
    points = sum((F.when(p.contains(w), n).otherwise(0) for w, n in MENU_PATHS), F.lit(0)) + sum((F.when(t.rlike(w), n).otherwise(0) for w, n in MENU_LABELS), F.lit(0))
    return F.when(host(link).isNotNull(), points - F.when(p.rlike(MENU_AGAINST), 10).otherwise(0))


#: Addresses of rented items.
RENTED = r"/alug(?:ar|uel)|/locac(?:ao|ão)|[?&]finalidade=alug"


def is_sale_detail(url: Column, base_host: Column) -> Column:
    """The stricter test of an item's address: no sure signs, nothing rented; else as ``is_detail`` by numbers, long slugs, depth and references."""
    p, u, s = path(url), F.lower(url), segments(url)
    weak = F.exists(s, lambda x: x.rlike("^[0-9]+$")) | F.exists(s, lambda x: (F.length(x) > 15) & x.contains("-")) | (F.size(s) >= 3) | F.lower(p).rlike(r"(?:^|[^a-z0-9_])(?:ref|cod|id)[-_]?[0-9]+")
    same = F.coalesce(host(url) == F.lower(base_host), F.lit(False))
    return F.when(~same | p.isin("", "/") | u.rlike(SKIP) | u.rlike(RENTED), False).otherwise(F.coalesce(weak, F.lit(False)))


def is_item_link(url: Column, base: Column) -> Column:
    """Whether a link of a page leads to an item of the same origin: a number of four digits, or a word of items in its path."""
    origin = lambda x: F.lower(F.regexp_extract(x, r"^([a-zA-Z]+://[^/?#]+)", 1))
    p = path(url)
    sign = p.rlike(r"/[0-9]{4,}|/imovel/|/property/|/venda/[^-].*/[0-9]|/aluguel/[^-].*/[0-9]")
    return F.coalesce((origin(url) == origin(base)) & (origin(url) != "") & (p != "/") & (F.length(p) >= 4) & sign, F.lit(False))


#: What the address of a card never holds.
NO_CARD = r"cdn-cgi|/challenge|[?&][^=]+=.{50,}|/[A-Za-z0-9_-]{40,}$|(?i:logout|login|signin|signup|cadastro|conta|perfil|contato|sobre|blog|politica|privacidade)"


def is_card_link(url: Column, base: Column) -> Column:
    """Whether the address of a card may be that of an item: same host, neither the home page nor the list itself, no other service of the site."""
    ok = url.startswith("http") & (host(url) == host(base)) & ~path(url).isin("", "/") & (path(url) != path(base)) & ~url.rlike(NO_CARD)
    return F.coalesce(ok, F.lit(False))


#: Kinds as whole path segments.
PATH_KINDS = (
    "apartamento", "casa", "terreno", "sobrado", "cobertura", "kitnet", "loft", "flat", "sala", "loja", "galpao", "galpão", "chacara", "chácara", "sitio", "sítio", "fazenda", "imovel-comercial", "comercial",
    "rural", "studio", "duplex", "triplex", "garden", "lote", "barracão", "barracao",
)


def metadata(url: Column) -> Column:
    """``struct(cidade, bairro, tipo)``: the two segments after ``venda`` or ``aluguel``, and the first segment that is, or begins with, a kind."""
    s = F.transform(segments(url), F.lower)
    at = F.when(F.array_contains(s, "venda"), F.array_position(s, "venda")).otherwise(F.array_position(s, "aluguel")).cast("int")
    far = (at > 0) & (F.size(s) > at + 1)
    part = lambda k: F.when(far & (F.length(F.get(s, at + k)) > 1), deslug(F.get(s, at + k)))
    whole = F.get(F.filter(s, lambda x: x.isin(*PATH_KINDS)), F.lit(0))
    begun = F.get(F.filter(F.transform(s, lambda x: F.get(F.filter(F.array(*map(F.lit, PATH_KINDS)), lambda k: x.startswith(F.concat(k, F.lit("-"))) | x.startswith(F.concat(k, F.lit("_")))), F.lit(0))), lambda x: x.isNotNull()), F.lit(0))
    return F.struct(part(0).alias("cidade"), part(1).alias("bairro"), deslug(F.coalesce(whole, begun)).alias("tipo"))


#: Query parameters that number pages, and those that count from an offset.
PAGE_PARAMS, OFFSET_PARAMS = ("pagination", "pagina", "page", "pag", "pg", "p"), ("start", "offset")


def page_number(url: Column) -> Column:
    """``struct(numero, passo)`` of the address of a second page: its number with step 1, its offset as both, else 2 and 1."""
    number = lambda names: F.coalesce(*(F.regexp_extract(url, rf"(?i)[?&]{n}=([0-9]+)", 1).try_cast("int") for n in names))
    page, offset = number(PAGE_PARAMS), F.coalesce(*(F.when(number((n,)) > 1, number((n,))) for n in OFFSET_PARAMS))
    return F.struct(F.coalesce(page, offset, F.lit(2)).alias("numero"), F.when(page.isNull(), offset).otherwise(1).alias("passo")).withField("passo", F.coalesce(F.when(page.isNull(), offset), F.lit(1)))


#: How a page names the next one, and the parameters that number pages there.
_Q = "[\"']"
NEXT_LINK = (rf"(?i)<link[^>]+rel={_Q}next{_Q}[^>]+href={_Q}([^\"']+){_Q}", rf"(?i)<link[^>]+href={_Q}([^\"']+){_Q}[^>]+rel={_Q}next{_Q}")
NEXT_BUTTON = rf"(?iu)href={_Q}([^\"']+){_Q}[^>]*>\s*(?:próxima?|next|avançar|&gt;|›|»|>)\s*<"
NUMBERED = "(?:pagina|page|pg|p|start|offset)"
#: What names a page by its number in an address.
PAGE_WORDS = ("pagina=", "page=", "pag=", "/pagina/", "/page/", "/pag/")


def next_page(html: Column, base: Column) -> Column:
    """The next page of a list: the page's own ``rel=next``, a button that says so, else the link to the least page number above its own."""
    rel = F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in NEXT_LINK))
    button = F.nullif(F.regexp_extract(html, NEXT_BUTTON, 1), F.lit(""))
    q, param = _Q, NUMBERED
    own = F.coalesce(F.regexp_extract(base, rf"(?i)[?&]{param}=([0-9]+)", 1).try_cast("int"), F.lit(1))
    links = F.regexp_extract_all(html, F.lit(rf"(?i)href={q}([^\"']*[?&]{param}=[0-9]+[^\"']*){q}"), F.lit(1))
    numbered_ = F.transform(links, lambda x, k: F.struct(F.regexp_extract(x, rf"(?i)[?&]{param}=([0-9]+)", 1).try_cast("int").alias("n"), k.alias("k"), x.alias("u")))
    least = F.array_min(F.filter(numbered_, lambda x: x["n"] > own))["u"]
    return absolute(F.coalesce(rel, button, least), base)


def with_page(url: Column, page: Column) -> Column:
    """The address of page ``page`` of a list: the parameter ``pagina`` (and ``page`` where other parameters stand already) added or replaced."""
    n = page.cast("string")
    put = lambda u, name: F.when(u.rlike(rf"[?&]{name}="), F.regexp_replace(u, F.lit(rf"([?&]{name}=)[^&#]*"), F.concat(F.lit("$1"), n))).otherwise(F.concat(u, F.lit(f"&{name}="), n))
    many = put(url, "pagina")
    return F.when(url.contains("?"), F.when(url.rlike("[?&]page="), many).otherwise(put(many, "page"))).otherwise(F.concat(F.regexp_replace(url, "/$", ""), F.lit("?pagina="), n))


def page_link(html: Column, base: Column, page: int) -> Column:
    """The address of page ``page``: a link that names it in a parameter or path, the next-page link, a link labelled with the number, else the list with ``pagina``."""
    q = _Q
    named = [F.nullif(F.regexp_extract(html, rf"(?i)<a[^>]+href={q}([^\"']*{w}{page}[^\"']*){q}", 1), F.lit("")) for w in PAGE_WORDS]
    rel = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (rf"(?i)<a[^>]+rel={q}next{q}[^>]*href={q}([^\"']+){q}", rf"(?i)<a[^>]+href={q}([^\"']+){q}[^>]*rel={q}next{q}")]
    label = F.nullif(F.regexp_extract(html, rf"(?i)<a[^>]+href={q}([^\"']+){q}[^>]*>\s*{page}\s*</a>", 1), F.lit(""))
    return F.coalesce(absolute(F.coalesce(*named, *rel, label), base), with_page(base, F.lit(page)))


#: Hosts and paths that are no company's own site.
PORTALS = (
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "olx.com", "vivareal.com", "zapimoveis.com", "imovelweb.com", "mercadolivre.com", "imobiliarias.com", "imoveiscaxias.net",
    "creci-rs.gov", "creci.gov", "wikipedia.org", "tiktok.com", "youtube.com", "google.com", "yelp.com", "cnpj.biz", "econodata.com", "consultacnpj.com", "applocal.com.br", "assimobcaxias.com.br",
    "bolsadeimoveiscaxias.com.br", "olimoveis.com.br",
)
OTHER_PATHS = ("/politica", "/privacidade", "/termos", "/contato", "/sobre", "/blog", "/noticias", "/imobiliarias?", "/search", "/resultados")


def may_be_official(url: Column) -> Column:
    """Whether a search hit may be the site of a company: neither a portal nor a page about something else."""
    u = F.lower(url)
    out = u.isNotNull()
    for w in (*PORTALS, *OTHER_PATHS):
        out = out & ~u.contains(w)
    return F.coalesce(out, F.lit(False))


def site_score(url: Column, tokens: Column) -> Column:
    """How likely an address is the site of the company with these name tokens: tokens in the host, as the domain itself, depth, local domain; -100 without a host."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    domain = F.substring_index(h, ".", 1)
    points = F.aggregate(tokens, F.lit(0), lambda a, t: a + F.when(h.contains(t), 3).otherwise(0) + F.when(domain == t, 5).otherwise(0))
    deep = F.when(F.size(F.split(url, "/")) > 5, 1).otherwise(0)
    return F.when(h.isNull(), -100).otherwise(points - deep + F.when(h.endswith(".com.br"), 1).otherwise(0))
