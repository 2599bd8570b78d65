"""Template residue, filler, error and waiting messages, script notices (problem 2).

Unresolved slots and serialised nothings are found inside any cell by column expressions. Messages are mined: every
sentence-like part of every cell is masked (numbers, names and addresses become ``<*>``), masked parts are counted with the
cells, sources and cities they stand in, a prefix tree of fixed depth (number of tokens, first two tokens) leads to the
leaves in which similar parts merge to templates, each template is classified once, and its verdict goes back to every part
that fell under it. A template is a message by what it says, or because it is all that its cells hold, stands alike in cells of
several sources and cities, names nothing particular, and consists of words foreign to ordinary texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import eq, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moradia.session import sized, written

#: Names of record fields as they stand in slots.
FIELD = (
    r"(?:titulo|descricao(?:_curta)?|bairro|cidade|estado|uf|telefone|celular|whatsapp|email|valor|preco|vagas|quartos|dormitorios|banheiros|suites|"
    r"area(?:_util|_total|_m2)?|nome(?:_[a-z]+)?|corretor|link(?:_[a-z]+)?|endereco|condominio|iptu|codigo|referencia|tipo|imovel|data|title|price|city|name|phone)"
)
NAME = rf"(?:{FIELD}|[a-z]+(?:[._][a-z]+)+)"

#: Slots that no real text holds: two-sided marks around any identifier, and marks around a field name.
SLOT = "(?iu)" + "|".join(
    [
        r"\{\{\s*[\w.]+\s*\}\}", r"\{#\s*[\w.]+\s*#\}", r"\{%\s*[\w. ]+\s*%\}", r"<%=?\s*[\w.]+\s*%>", r"[$#]\{\s*[\w.]+\s*\}",
        r"%%\s*[\w.]+\s*%%", r"@@\s*[\w.]+\s*@@", r"__[a-z][\w.]*__", r"\[\[\s*[\w.]+\s*\]\]", r"<<\s*[\w.]+\s*>>",
        r"\[(?:inserir|insira|preencher|colocar|insert)\b[^\]]*\]", rf"\{{\s*{NAME}\s*\}}", rf"\${NAME}\$", rf"&lt;\s*{NAME}\s*&gt;", rf"<\s*{NAME}\s*>",
        rf"%\(?{NAME}\)?%", r"(?<![0-9])%(?:s|d|\.[0-9]f)(?![\p{L}0-9])",
    ]
)
#: Serialised nothings; letter case matters.
NOTHING = r"\[object Object\]|#(?:VALOR|VALUE|REF|NOME|NAME|DIV/0|N/D|NULL|NUM)[!?]|(?<![\p{L}0-9_])(?:undefined|NaN|None|null)(?![\p{L}0-9_])"
#: Syllables of filler Latin.
SYLLABLES = "lorem|lor|lo|rem|ip|sum|do|sit|am|et|con|sec|tetur|tur|ad|na|la|vel|nul|mag|elit|us"
#: Five words in a row that consist of such syllables, in lower case; it can begin only after something that is no letter.
LATIN = rf"lorem ipsum|(?:^|[^a-zà-ÿ])(?:(?:{SYLLABLES})++(?=[^a-zà-ÿ]|$)[\s,.]*){{5,}}"

#: Verdicts over templates in lower case without accents. Fixed values.
MESSAGES = {
    "script": r"(?=.*\b(?:java)?scripts?\b)(?=.*(?:\bativ|\bactiv|habilit(?:e|ar|acao)\b|enable|turn on|requer|nao executa|sem suporte|navegador|browser|recarregue))|^ative-os|"
    r"\b(?:habilite|ative|permita|aceite|enable|accept|allow) (?:os |the )?cookies\b|\b(?:navegador|browser)\b.*\b(?:nao (?:e )?(?:compativel|suportado)|desatualizado|antigo|not supported|unsupported|outdated)|(?:desative|disable) .*\b(?:bloqueador|ad ?block)",
    "wait": r"\bcarregando(?:\W*$| (?:dados|imovel|anuncio|ficha|pagina|conteudo)\b)|^\W*loading\b|^\W*aguarde\b|please wait|^\W*wait\b|verificando se voce|checking your browser|^isso leva alguns|^(?:voce sera|you will be|you are being) redirec|^redirec(?:ionando|ting)\b",
    "error": r"\berror?\b[ :]*(?:<\*>|interno|ao\b|no servidor|de servidor|inesperado|desconhecido|fatal)|\b(?:internal|fatal|unexpected|unknown|parse|syntax|server) error\b|exception in|stack ?trace|traceback|type ?error\b|sqlstate|acesso negado(?:\W*$|\W+(?:seu|voce|ao site))|access denied|too many requests|"
    r"muitas requisicoes|(?:pagina|endereco|anuncio|conteudo|imovel) nao (?:foi )?encontrad|not found|nao achamos|(?:pagina|anuncio|endereco|conteudo|imovel|link)\b.*\bnao existe mais|(?:conteudo|servico|pagina|anuncio|site|servidor)\b.*\b(?:indisponivel|fora do ar|offline)|unavailable|sess(?:ao|ion) (?:expirada|expirou|expired)|"
    r"dominio suspenso|\b(?:site|pagina|portal)\b.*\bem (?:manutencao|construcao)|under (?:construction|maintenance)|^coming soon|^em breve\W*$|conexao (?:esgotad|recusad|perdid)|tempo de (?:conexao|espera)|saiu do ar|foi bloquead|(?:request|access|ip) blocked|campo \S+ ausente|not a function|could not (?:complete|connect|load)|"
    r"falha (?:ao carregar|na conexao|interna|no servidor|de conexao)|slow down|gateway|^http <\*>|\btimed? ?out\b|^(?:ops|oops|ooops)\b|(?:algo|alguma coisa) (?:deu|saiu) errado|something went wrong|tente (?:novamente|de novo)(?: mais tarde| em| daqui)|try again (?:later|in)|bad request|forbidden|unauthorized|"
    r"variavel \S+ (?:indefinida|nao definida)|undefined (?:variable|index|offset)|(?:warning|notice|aviso|deprecated):.*(?:/[a-z]\S*\.[a-z]+|\blin(?:e|ha)\b)|\.(?:php|aspx?|jsp|py|js)\b.*\blin(?:e|ha)\b|^<\*> (?:service|forbidden|not|bad|internal|moved|gone)",
    "filler": r"texto de exemplo|troque por uma|insira o texto|insira (?:aqui|sua|seu)|digite aqui|escreva algo|(?:headline|title|text|content) goes here|\(editar\)|descricao padrao|substituir antes|\b([a-z]{4,}) \1 \1\b|\basdf\b|x{4,}|(?:your|placeholder|sample|dummy) (?:text|title|description)\b|conteudo (?:de )?teste\b",
}
PARTS = r"(?<=[.!?…:;,])\s+|[\n\r]+|\s+[|+]\s+|\s+[-–]\s+|\s+e\s+"
#: Share of equal tokens at which two parts of a leaf are one template; groups of a leaf that are merged apart at first.
SIMILAR, SALTS = 0.7, 16
#: A foreign template stands in so many cells at least; words of this many letters tell; so many of them may be ordinary.
SUPPORT, LONG, ORDINARY_SHARE = 5, 4, 0.34
#: Most templates with a verdict whose hashes are broadcast; beyond that they are joined by shuffle.
MOST_VERDICTS = 200_000


def plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).replace("'", "")


def verdict(template: str) -> str | None:
    """Class of a message template, None for ordinary text."""
    t = plain(template)
    return next((k for k, p in COMPILED.items() if p.search(t)), None)


COMPILED = {k: re.compile(p) for k, p in MESSAGES.items()}


def masked(part: Column) -> Column:
    """A part with its numbers as ``<*>``, without list marks and closing punctuation."""
    p = F.regexp_replace(part, r"[0-9]+(?:[.,][0-9]+)*", "<*>")
    return F.regexp_replace(p, r"^[\s•*–-]+|[\s.!…,;:]+$", "")


#: Words before a name.
BEFORE_NAME = r"(?:em|n[ao]s?|d[aeo]s?|bairro|rua|r\.|avenida|av\.|travessa|alameda|edif[ií]cio|ed\.|condom[ií]nio|residencial|empreendimento|fica)"


def key_of(part: Column) -> Column:
    """A masked part with its names (capital words after a word that leads to a name) as ``<*>`` too: what parts are counted by."""
    name = r"\p{Lu}[\p{Ll}'’]++(?!\p{L})"
    return F.regexp_replace(part, rf"(?iu:(?<![\p{{L}}])({BEFORE_NAME}))\s+{name}(?:,?\s+(?:(?:d[aeo]s?)\s+)?{name})*", "$1 <*>")


def merged(texts: Iterable[str]) -> list[int]:
    """For each text of one leaf the number of the text that stands for its template: the first, in the given order, of those it is similar to.

    Similar texts of one length differ in few places; of as many chunks and one more, one at least is equal, so a text
    meets only the templates that have a chunk in common with it.
    """
    leaders: list[list[str]] = []
    by_chunk: dict[tuple, list[int]] = {}
    at: list[int] = []
    out: list[int] = []
    for k, text in enumerate(texts):
        tokens = text.split()
        n = len(tokens)
        apart = int(n * (1 - SIMILAR) + 1e-9)
        if apart == 0:
            out.append(k)
            continue
        cuts = [n * i // (apart + 1) for i in range(apart + 2)]
        chunks = [(n, i, *tokens[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        best, leader = -1, -1
        for t in sorted({t for c in chunks for t in by_chunk.get(c, ())}):
            same = sum(map(eq, leaders[t], tokens))
            if same >= n - apart and same > best:
                best, leader = same, t
        if leader >= 0:
            out.append(at[leader])
            continue
        for c in chunks:
            by_chunk.setdefault(c, []).append(len(leaders))
        leaders.append(tokens)
        at.append(k)
        out.append(k)
    return out


def leaves(parts: DataFrame, column: str, keys: list[str], schema: str, finish) -> DataFrame:  # noqa: ANN001
    """Each row (``column``, ``n``) through ``finish(leaf, text, leader, (n, text))``, leaf by leaf; a task holds the leaves of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, list[tuple]] = {}
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns):
                own.setdefault(row[: len(keys)], []).append(row[len(keys) :])
        out: list[tuple] = []
        for key, rows in own.items():
            rows.sort(key=lambda r: (-r[0], r[1]))
            texts = [r[1] for r in rows]
            for k, leader in enumerate(merged(texts)):
                out.append(finish(key, texts[k], texts[leader], rows[k]))
        for k in range(0, len(out), 50_000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[k : k + 50_000]), types)], list(names))

    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[k] for k in kinds]
    return parts.repartition(*keys).select(*keys, "n", column).mapInArrow(run, schema)


def mine(parts: DataFrame) -> DataFrame:
    """``parte, modelo, classe`` for each counted part (``parte, n``); ``classe`` is null for ordinary text.

    The tree leads by number of tokens and first two tokens to the leaves. Leaves are salted first, so that one with most of the
    parts is many groups; their templates, far fewer, merge then. A template is spelt as its most frequent part and
    classified by that; a part that its own words condemn keeps that verdict whatever template it fell under.
    """
    first = F.split(F.col("parte"), " ")
    start = F.concat_ws(" ", *(F.when(F.get(first, F.lit(k)).contains("<*>"), "<*>").otherwise(F.get(first, F.lit(k))) for k in (0, 1)))
    leaf = parts.select("parte", "n", F.size(first).alias("tokens"), start.alias("inicio"), F.pmod(F.xxhash64("parte"), F.lit(SALTS)).alias("sal"))
    found = leaves(leaf, "parte", ["tokens", "inicio", "sal"], "parte string, modelo string, n bigint, tokens int, inicio string", lambda key, text, leader, row: (text, leader, row[0], key[0], key[1]))
    found = written(found, "residue-leaves")
    once = found.groupBy("modelo", "tokens", "inicio").agg(F.sum("n").alias("n"))
    top = leaves(once, "modelo", ["tokens", "inicio"], "modelo string, final string, classe string", lambda key, text, leader, row: (text, leader, verdict(leader) or verdict(text)))
    return found.select("parte", "modelo").join(top, "modelo").select("parte", F.col("final").alias("modelo"), "classe")


def words_of(part: Column) -> Column:
    """The telling words of a part: lower case, letters only, LONG or more."""
    return F.array_distinct(F.filter(F.split(F.lower(part), r"[^\p{L}]+"), lambda w: F.length(w) >= LONG))


def foreign(counted: DataFrame) -> DataFrame:
    """The parts that are residue by where they stand: alone in their cells, in SUPPORT cells of several sources and cities, without a mask, of foreign words.

    A word is ordinary if it stands in parts of SUPPORT cells that hold other parts. Expects ``parte, n, sozinha, fontes, cidades``.
    """
    alone = counted.filter((F.col("sozinha") >= SUPPORT) & F.col("fontes") & F.col("cidades") & ~F.col("parte").contains("<*>"))
    words = alone.select("parte", F.explode(words_of(F.col("parte"))).alias("w"))
    told = counted.filter(F.col("n") > F.col("sozinha")).select((F.col("n") - F.col("sozinha")).alias("m"), F.explode(words_of(F.col("parte"))).alias("w"))
    ordinary = told.join(words.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.sum("m").alias("m")).filter(F.col("m") >= SUPPORT)
    share = words.join(ordinary.withColumn("_o", F.lit(1)), "w", "left").groupBy("parte").agg(F.avg(F.coalesce("_o", F.lit(0))).alias("s"))
    return share.filter(F.col("s") <= ORDINARY_SHARE).select("parte", F.lit("foreign").alias("classe"))


def holds_slot(text: Column) -> Column:
    """Whether a cell holds an unresolved slot, a serialised nothing or filler Latin."""
    signs = ("{", "<", "@@", "__", "%%", "%s", "%d", "%.", "[[", "&lt;")
    marked = reduce(or_, (text.contains(c) for c in signs)) | text.rlike(r"\$[a-zA-Z{]|\[[iIpPcC]|%\(?[a-zA-Z._]+\)?%")
    nothing = reduce(or_, (text.contains(c) for c in ("undefined", "NaN", "None", "null", "[object", "#")))
    return (marked & text.rlike(SLOT)) | (nothing & text.rlike(NOTHING)) | F.lower(text).rlike(LATIN)


def residue_cells(listings: DataFrame, fields: tuple[str, ...] = ("titulo", "descricao")) -> DataFrame:
    """``id, campo, classe`` of each cell that is, or holds, residue; one row a cell.

    Null and blank cells, cut-off real text and real text that only uses such words give no row. Repeated rows
    give one result for each id. Columns other than ``fields``, ``id`` and, where there are any, ``fonte_id`` and ``cidade`` are not read. The texts are
    read once; masked parts stand in a table from which they are counted and to which the verdicts go back.
    """
    cell = F.explode(F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f).alias("texto")) for f in fields))).alias("c")
    spread = [F.col(c) if c in listings.columns else F.lit(None).cast("string").alias(c) for c in ("fonte_id", "cidade")]
    cells = listings.select(F.col("id").cast("bigint").alias("id"), *spread, cell).select("id", "fonte_id", "cidade", "c.campo", "c.texto").filter(F.trim("texto") != "")
    slot = F.coalesce(holds_slot(F.col("texto")), F.lit(False))
    parts = F.filter(F.transform(F.split("texto", PARTS), lambda p: key_of(masked(p))), lambda p: F.length(p) > 2)
    told = written(cells.select("id", "fonte_id", "cidade", "campo", slot.alias("vaga"), parts.alias("partes")), "residue")
    open_cells = told.filter(~F.col("vaga") & (F.size("partes") > 0))
    alone = (F.size("partes") <= 3).cast("int").alias("so")
    pieces = open_cells.select("fonte_id", "cidade", alone, F.explode("partes").alias("parte"))
    counted = pieces.groupBy("parte").agg(
        F.count("*").alias("n"), F.sum("so").cast("bigint").alias("sozinha"),
        F.coalesce(F.min("fonte_id") != F.max("fonte_id"), F.lit(False)).alias("fontes"), F.coalesce(F.min("cidade") != F.max("cidade"), F.lit(False)).alias("cidades"),
    )
    counted = written(counted, "residue-parts")
    verdicts = mine(counted.select("parte", "n")).filter("classe is not null").select("parte", "classe").unionByName(foreign(counted))
    verdicts = written(verdicts.groupBy(F.xxhash64("parte").alias("h")).agg(F.min("classe").alias("classe")), "residue-verdicts")
    by_part = open_cells.select("id", "campo", F.explode(F.transform("partes", lambda p: F.xxhash64(p))).alias("h"))
    found = by_part.join(sized(verdicts, MOST_VERDICTS), "h").groupBy("id", "campo").agg(F.min("classe").alias("classe"))
    return told.filter("vaga").select("id", "campo", F.lit("slot").alias("classe")).distinct().unionByName(found)
