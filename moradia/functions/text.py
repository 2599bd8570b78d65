"""Numbers, kinds, transactions and places read from text, as Columns. Texts are lowered first; classes are spelt out so that accents count as letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of property by the pattern that names them in lower-case text; the first hit wins.
KINDS = (
    ("cobertura", "cobertura"), ("kitnet", "kitnet|conjugado"), ("sobrado", "sobrado"), ("duplex", "d[uú]plex"), ("triplex", "triplex"), ("flat", r"<flat>"), ("loft", r"<loft>"),
    ("apartamento", r"apartamento|<apto?>|<ap>"), ("casa", r"<casa>"), ("terreno", r"terreno|<lotes?>"), ("chacara", "ch[aá]cara|s[ií]tio"), ("galpao", "galp[aã]o|barrac[aã]o|galpoes"),
    ("sala", r"<sala comercial>|salas?[ -]?comercia(?:l|is)"), ("loja", r"<lojas?>"), ("pavilhao", "pavilh[aã]o|pavilh[oõ]es"), ("comercial", "comercial"), ("rural", r"<rural>|<fazenda>"),
    ("condominio", "condom[ií]nio fechado"), ("box", r"<box>"), ("predio", "pr[eé]dio"),
)
#: Words of sale and of rent.
SALE, RENT = "comprar|venda|para vender", "alugar|aluguel|loca[cç][aã]o"
#: Labels of pages that are no places.
LABELS = (
    "início", "inicio", "home", "página inicial", "pagina inicial", "bairro", "cidade", "estado", "localização", "localizacao", "endereço", "endereco", "tipo", "transação", "transacao", "categoria", "subtipo",
    "preço", "preco", "valor", "aluguel", "venda", "compra", "quartos", "quarto", "dormitórios", "dormitorios", "banheiros", "banheiro", "vagas", "vaga", "garagem", "área", "area", "m²", "m2", "descrição", "descricao",
    "detalhes", "características", "caracteristicas", "imóvel", "imovel", "imóveis", "imoveis", "anúncio", "anuncio", "ver mais", "saiba mais", "clique aqui", "ver anúncio", "contato", "fale conosco", "whatsapp",
    "anterior", "próximo", "proximo", "voltar", "filtros", "filtrar", "buscar", "pesquisar",
)
#: Words of a company's name that do not tell it apart.
COMMON_NAMES = (
    "ltda", "me", "epp", "eireli", "sa", "imoveis", "imobiliaria", "imobiliarios", "negocios", "investimentos", "investimento", "empreendimentos", "empreendimento",
    "administracao", "corretagem", "consultoria", "assessoria", "gestao", "de", "do", "da", "dos", "das", "e",
)
_LETTER = r"[\p{L}\p{N}_]"


def word(pattern: str) -> str:
    """``<`` and ``>`` of a pattern as word boundaries that treat accented letters as letters."""
    return pattern.replace("<", rf"(?<!{_LETTER})").replace(">", rf"(?!{_LETTER})")


def sql_word(pattern: str) -> str:
    """The same for SQL engines without look-around and with ASCII word boundaries: a character on either side that is no letter, or the end."""
    other = "[^[:alnum:]_áàâãéêíóôõúç]"
    return pattern.replace("<", f"(?:^|{other})").replace(">", f"(?:{other}|$)")


def local_number(s: Column) -> Column:
    """``1.234,56`` as a double: dots are thousands marks, the comma is the decimal point. Null if it is no number."""
    return F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".").try_cast("double")


def prices(text: Column) -> Column:
    """All prices of a text, between 10 000 and 500 million, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"r\$\s*([0-9][0-9.,]*)"), F.lit(1))
    return F.filter(F.transform(found, local_number), lambda v: (v > 10_000) & (v < 500_000_000))


def price(text: Column) -> Column:
    return F.get(prices(text), F.lit(0))


def any_price(text: Column) -> Column:
    """The number of a field that holds only a price (digits, dots and the first comma of it); null unless positive."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)r\$\s*|\.", ""), r"^([^,]*),", "$1."), r"[^0-9.]", "")
    v = F.regexp_extract(digits, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")
    return F.when(v > 0, v)


def any_area(text: Column) -> Column:
    """The first number before ``m²`` or ``m2``; null unless positive."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"(?i)([0-9.,]+)\s*m[²2]", 1), r"\.", ""), r"^([^,]*),", "$1.")
    v = F.regexp_extract(v, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")
    return F.when(v > 0, v)


def any_count(text: Column) -> Column:
    """The first whole number of a field; null unless positive."""
    v = F.regexp_extract(text, r"([0-9]+)", 1).try_cast("int")
    return F.when(v > 0, v)


def kind_of_four(text: Column) -> Column:
    """One of four classes by the words of a field; null for any other."""
    has = lambda *w: any_of(text, w)
    return F.when(has("apartamento", "apto"), "apartamento").when(has("casa", "sobrado"), "casa").when(has("terreno", "lote"), "terreno").when(has("comercial", "sala", "loja", "galpão"), "comercial")


def whole_number(text: Column) -> Column:
    """A number written the local way, rounded half up to a whole one; null unless positive."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.", ""), r"^([^,]*),", "$1."), r"[^0-9.]", "")
    v = F.regexp_extract(v, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")
    return F.when(v > 0, F.floor(v + 0.5).cast("bigint"))


def day_label(at: Column, now: Column) -> Column:
    """``Hoje`` within 24 hours, ``Ontem`` within 48, else day and month."""
    hours = F.timestamp_diff("HOUR", at, now)
    return F.when(hours < 24, "Hoje").when(hours < 48, "Ontem").otherwise(F.date_format(at, "dd/MM"))


def mined(message: Column, label: str) -> Column:
    """The number that stands before ``label`` in a message of progress; null if none does."""
    return F.regexp_extract(message, rf"([0-9]+) {label}", 1).try_cast("int")


def elapsed_label(seconds: Column) -> Column:
    """``42s``, ``3.5min`` or ``1.2h``."""
    tenth = lambda v: F.round(v, 1).cast("decimal(18,1)").cast("string")
    return F.when(seconds < 60, F.concat(F.round(seconds).cast("bigint").cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(tenth(seconds / 60), F.lit("min"))).otherwise(F.concat(tenth(seconds / 3600), F.lit("h")))


def field_value(field: str, raw: Column) -> Column:
    """The text found under a learned selector as the value of ``field``, as text: numbers within 15 rooms and baths and 10 places, no label of the page, no kind for a place."""
    t = F.nullif(F.trim(raw), F.lit(""))
    if field == "preco":
        return price(t).cast("string")
    if field == "area_m2":
        return area(t).cast("string")
    if field in ("quartos", "banheiros", "vagas"):
        n = F.regexp_extract(t, r"([0-9]+)", 1).try_cast("int")
        return F.when(n <= (10 if field == "vagas" else 15), n).cast("string")
    if field == "tipo":
        return kind(t, t)
    if field == "transacao":
        return transaction(F.lit(""), t, F.lower(t))
    if field == "descricao":
        return F.when(F.length(t) >= 10, F.substring(t, 1, 500))
    ok = ~F.lower(t).isin(*LABELS) & (F.length(t) >= 2) & ~t.rlike(r"^[0-9]+$")
    return F.when(ok & kind(F.lit(""), t).isNull() if field in ("bairro", "cidade") else ok, t)


def areas(text: Column) -> Column:
    """All areas of a text above 10 and up to 100 000 square metres, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"([0-9][0-9.,]*)\s*m[²2](?!{_LETTER})"), F.lit(1))
    return F.filter(F.transform(found, local_number), lambda v: (v > 10) & (v <= 100_000))


def area(text: Column, window: int = 48) -> Column:
    """The area of the item itself: each candidate is scored by the ``window`` characters around it (words of own area count
    for it, words of the condominium against it, an early place and 40 or more a little for it); best score, then first place."""
    low = F.lower(text)
    measure = rf"[0-9][0-9.,]*\s*m[²2](?!{_LETTER})"
    # the text is split into what stands before, between and after the areas; the ends of each area are then sums of lengths
    found = F.regexp_extract_all(low, F.lit(measure), F.lit(0))
    gaps = F.split(low, measure)
    own = r"[aá]rea|privativa|[uú]til|total|constru[ií]da|metr"
    shared = r"condom[ií]nio|empreendimento|lazer|sal[aã]o|academia"
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    places = F.transform(lengths, lambda x, k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(1), lambda a, y: a + y["g"] + y["m"]) + x["g"])

    def scored(m: Column, at: Column) -> Column:
        start = F.greatest(at - window, F.lit(1))
        p = F.substring(low, start, at - start + F.length(m) + window)
        early = F.when(at <= 2500, 2).otherwise(0)
        v = local_number(F.regexp_extract(m, r"([0-9][0-9.,]*)", 1))
        points = F.when(p.rlike(own), 4).otherwise(0) - F.when(p.rlike(shared), 3).otherwise(0) + early + F.when(v >= 40, 1).otherwise(0)
        return F.struct((-points).alias("p"), at.alias("k"), v.alias("v"))

    kept = F.filter(F.zip_with(found, places, scored), lambda x: (x["v"] > 10) & (x["v"] <= 100_000))
    return F.array_min(kept)["v"]


def count(text: Column, pattern: str) -> Column:
    """The first number before a word of ``pattern`` if it is from 1 to 20."""
    n = F.regexp_extract(F.lower(text), rf"([0-9]+)\s*(?:{pattern})", 1).try_cast("int")
    return F.when(n.between(1, 20), n)


def bedrooms(text: Column) -> Column:
    return F.coalesce(count(text, "quartos?|dormit[oó]rios?|dorms?"), count(text, "dorm"))


def bathrooms(text: Column) -> Column:
    return count(text, "banheiros?|bwc|wcs?|lavabos?")


def parking(text: Column) -> Column:
    return count(text, "vagas?|garagens?|box")


def candidates(text: Column) -> Column:
    """Numbers a text offers for each field, sorted and distinct; fields without any are left out."""
    low = F.lower(text)
    found = lambda p: F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), local_number)
    counts = lambda p: F.filter(F.transform(F.regexp_extract_all(low, F.lit(rf"([0-9]+)\s*(?:{p})"), F.lit(1)), lambda x: x.try_cast("double")), lambda v: (v > 0) & (v <= 20))
    tidy = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda v: F.bround(v, 2))))
    fields = {
        "area_m2": F.filter(found(rf"([0-9][0-9.,]*)\s*m[²2](?!{_LETTER})"), lambda v: (v > 10) & (v < 100_000)), "preco": F.filter(found(r"r\$\s*([0-9.,]+)"), lambda v: (v > 10_000) & (v < 500_000_000)),
        "quartos": counts("quartos?|dormit[óo]rios?|dorms?"), "banheiros": counts("banheiros?|bwc|wcs?|lavabos?"), "vagas": counts("vagas?|garagens?"),
    }
    return F.map_from_entries(F.array_compact(F.array(*(F.when(F.size(v) > 0, F.struct(F.lit(k).alias("k"), tidy(v).alias("v"))) for k, v in fields.items()))))


def kind(title: Column, text: Column) -> Column:
    """Kind of property by the title and the first 500 characters; null if none is named."""
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 500)))
    return F.coalesce(*(F.when(t.rlike(word(p)), k) for k, p in KINDS))


def transaction(url: Column, title: Column, text: Column) -> Column:
    """Sale, rent, both or null: address and title decide if only one is named there, else the body after its menu."""
    primary = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))
    t = F.coalesce(text, F.lit(""))
    body = F.when(F.length(t) > 200, F.substring(t, 201, 500)).otherwise(F.substring(t, 1, 500))
    s1, r1 = primary.rlike(SALE), primary.rlike(RENT)
    s2, r2 = s1 | body.rlike(SALE), r1 | body.rlike(RENT)
    return F.when(s1 & ~r1, "venda").when(r1 & ~s1, "aluguel").when(s2 & r2, "ambos").when(s2, "venda").when(r2, "aluguel")


def place(value: Column) -> Column:
    """A place name, or null where a page's title, label, price, company, code or kind was taken for one."""
    v = F.trim(value)
    v = F.coalesce(F.nullif(F.trim(F.regexp_extract(v, r"(?iu)no\s+bairro\s+([^,(-]+?)\s+em\s", 1)), F.lit("")), v)
    noise = F.lower(v).rlike(r"r\$[\s0-9.,]|" + word("<(?:à venda|para alugar|para locação|para comprar|imóv[eé]|imobili[áa]ria|no bairro)>") + "|" + word(r"<cod\.?\s*[0-9]+"))
    return F.when((v != "") & ~value.rlike(r" \| |[\n\r]") & (F.length(v) <= 80) & ~noise & ~F.lower(v).isin(*LABELS) & kind(F.lit(""), v).isNull(), v)


def plain(c: Column) -> Column:
    """Lower case without accents, single spaces."""
    low = F.translate(F.lower(c), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def name_tokens(c: Column) -> Column:
    """Words of a company's name of three or more letters that tell it apart."""
    words = F.split(F.trim(F.regexp_replace(plain(c), r"[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_NAMES))


def address(text: Column) -> Column:
    """``struct(bairro, cidade, uf)`` of an address whose parts stand between commas or dashes; a part ``City/UF`` names city and state."""
    parts = F.filter(F.transform(F.split(text, r"\s*[,–]\s*|\s+-\s+"), F.trim), lambda p: p != "")
    slash = F.get(F.filter(parts, lambda p: p.rlike(r"/[A-Z]{2}$")), F.lit(0))
    rest = F.filter(parts, lambda p: ~p.rlike(r"/[A-Z]{2}$"))
    return F.struct(
        F.get(rest, F.greatest(F.size(rest) - 1, F.lit(0))).alias("bairro"), F.nullif(F.regexp_extract(slash, r"^(.*)/[A-Z]{2}$", 1), F.lit("")).alias("cidade"), F.nullif(F.regexp_extract(slash, r"/([A-Z]{2})$", 1), F.lit("")).alias("uf")
    )


def brl(v: Column) -> Column:
    """A number as local money, ``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(v, 2), ",.", ".,"))


def brl_short(v: Column) -> Column:
    """``R$1.2M``, ``R$350k`` or the rounded number."""
    tenth = F.round(v / 1e6, 1)
    return F.when(v >= 1e6, F.concat(F.lit("R$"), tenth.cast("decimal(20,1)").cast("string"), F.lit("M"))).when(v >= 1e3, F.concat(F.lit("R$"), F.round(v / 1e3).cast("bigint").cast("string"), F.lit("k"))).otherwise(F.concat(F.lit("R$"), F.round(v).cast("bigint").cast("string")))


def retry_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or the time until a date, not below 0; null for anything else."""
    until = F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} [A-Z][a-z]{2} \d{4} [\d:]{8})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return F.when(header.rlike(r"^\s*\d+\s*$"), F.trim(header).try_cast("double")).otherwise(F.greatest(F.lit(0.0), (F.unix_timestamp(until) - F.unix_timestamp(now)).cast("double")))


def percent(done: Column, total: Column) -> Column:
    """Progress in whole per cent, half to even, 0 without a total."""
    return F.coalesce(F.bround(F.try_divide(done * 100.0, F.nullif(total, F.lit(0)))), F.lit(0)).cast("int")


def first_of(*columns: Column) -> Column:
    """The first column that is neither null, empty nor zero."""
    return F.coalesce(*(F.when(c.cast("string").isin("", "0", "0.0", "0.00"), None).otherwise(c) for c in columns))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(text).contains(w) for w in words))
