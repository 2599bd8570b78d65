"""Sentence units of texts in any script (problem 9).

A text is cut into blocks first (paragraphs, headings, list lines, message lines; a line broken at the wrap width goes
on). In spaced scripts, and in scripts with a full stop of their own, the terminators of a block are the nodes of a lattice:
each has a leaning towards an end by what stands before it (abbreviation, number) and after it, a sentence between two nodes
costs more if it ends inside a quotation or holds next to nothing, and the cheapest way through the block gives its
sentences. Thai has no terminators: there the gaps are the candidates; a lattice of dictionary words segments both sides of
a gap, and the gap ends a sentence by final particles, units and opening words. The dictionary is learned from the
corpus; only the grammatical words are given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moradia.session import small_rows

#: A line that breaks off here or later, and whose last word began before, was broken by wrapping.
WRAP = 66

#: Abbreviations before a name.
TITLES = frozenset(
    "sr sra srs sras srta dr dra drs dras eng engª arq prof profa profª adv exmo exma ilmo ilma d st sta sto mr mrs ms messrs mx rev pe cel gal gov pres dep sen ver "
    "av al r trav tv pça pç pca rod estr lgo lg vl jd pq res ed edif cond conj cia ltda cf obs pref min dept gob ud uds vd vds डॉ श्री नं د م".split()
)
#: Abbreviations before a number, a letter or a roman numeral.
REFERENCES = frozenset(
    "n no nº nr num núm fl fls cap cl p pp pag pág págs art arts inc al fig figs tab item ref ap apt apto aptos bl qd lt lj cj sl gr aprox approx ca tel fone ramal ext vol ed sec secc séc "
    "jan fev feb mar abr apr mai may jun jul ago aug set sep sept out oct nov dez dec km i.e e.g नं cód cod par sect ch eq no".split()
)
#: Abbreviations that never end a sentence.
INNER = frozenset("p.ex p.ej i.e e.g vs cf aprox approx ex ej".split())

#: Abbreviations that may end a sentence, but not before a small letter.
SHORTENED = frozenset("etc min max máx mín hab sq a.m p.m s.a s.m.j ltda obs trav jr v.g op cit esp aprox tb tbm vc seg pav const cons".split())

#: Words of the Thai lattice by what they do at a gap.
THAI_FINAL = frozenset("ครับ ค่ะ คะ นะคะ นะครับ นะ จ้ะ จ้า จ๊ะ ฮะ ไหม หรือเปล่า แล้ว เลย".split())
THAI_POLITE = frozenset("ครับ ค่ะ คะ นะคะ นะครับ จ้ะ จ้า จ๊ะ ฮะ".split())
THAI_UNIT = frozenset("ปี เดือน วัน สัปดาห์ ชั่วโมง นาที คน คัน เมตร กิโลเมตร กม. ตร.ม. ตร.ว. ตารางเมตร ไร่ งาน ห้อง ห้องนอน ห้องน้ำ ชั้น เรอัล บาท ดอลลาร์ น. นาฬิกา เปอร์เซ็นต์ หลัง ตัว แห่ง กิโลกรัม กก.".split())
THAI_JOIN = frozenset("และ หรือ แต่ โดย โดยประมาณ ถึง จนถึง ไม่รวม รวม เวลา ประมาณ เพราะ จึง ซึ่ง ที่ กับ พร้อม ต่อ ละ เพื่อ ด้วย คือ เช่น".split())
THAI_GIVEN = THAI_FINAL | THAI_UNIT | THAI_JOIN
THAI_STOPS = tuple(w for w in THAI_UNIT if w.endswith("."))
#: A learned word has so many letters at most, stands so often in the corpus at least, and has so many different neighbours on either side.
LONGEST, LEAST_OFTEN, LEAST_VARIED = 14, 5, 3
#: A word of two words stands so many times as often as they would stand together by chance.
COHESION = 10
#: Cost of a letter outside the dictionary, and of a given word that the corpus does not show.
STRANGE, GIVEN = 14.0, 6.0
#: Most learned words that are broadcast.
MOST_WORDS = 200_000

OPEN = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“", "‹": "›", '"': '"'}
EVENT = re.compile(r'[“«「『„‹"]|[.!?。！？।॥؟۔｡…]+|[\U0001F300-\U0001FAFF☀-➿]️?')
CLOSERS = re.compile(r"[”»’)\]」』›\"'）】]*")
PICTURES = re.compile(r"(?:\s*[\U0001F300-\U0001FAFF☀-➿️‍])+")
LINE = re.compile(r"\r\n|\r|\n|\x85| | ")
LIST = re.compile(r"\s*(?:[•◦▪*·‣]|[-–](?=\s)|\d{1,3}[.)](?=\s)|\d+(?:\.\d+)+(?=\s+[^\W\d]))")
ENUMERATOR = re.compile(r"(?:[ivx]+|[a-h])\)\s")
WORD_BEFORE = re.compile(r"[^\s(\[“«\"'‘/]+$")
THAI = re.compile("[฀-๿]")
HARD_STOPS = frozenset("。！？।॥؟۔｡")


class Lexicon:
    """The word lattice of a script without spaces: the segmentation of least cost, a word costing the less the more often the corpus holds it."""

    def __init__(self, counts: dict[str, int] | None = None) -> None:
        total = math.log(sum((counts or {}).values()) + 1)
        self.cost = dict.fromkeys(THAI_GIVEN, GIVEN) | {w: max(1.0, total - math.log(n)) for w, n in (counts or {}).items()}
        self.counts = counts
        self.words = lru_cache(maxsize=50_000)(self._words)

    def __reduce__(self) -> tuple:
        return Lexicon, (self.counts,)

    def _words(self, run: str) -> tuple[str, ...]:
        n, known = len(run), self.cost
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            here = best[i]
            if here + STRANGE < best[i + 1]:
                best[i + 1], back[i + 1] = here + STRANGE, i
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                c = known.get(run[i:j])
                if c is not None and here + c < best[j]:
                    best[j], back[j] = here + c, i
        out, j = [], n
        while j:
            i = back[j]
            strange = run[i:j] not in known
            while strange and i and run[back[i] : i] not in known:
                i = back[i]  # letters outside the dictionary make one unknown word
            out.append(run[i:j])
            j = i
        return tuple(reversed(out))


#: Letters that cannot begin a Thai word, and those that cannot end one.
_NO_START, _NO_END = frozenset("ะัาำิีึืฺุู็่้๊๋์ํ๎ๅๆ"), frozenset("เแโใไ")
_THAI_RUN = re.compile("[ก-๎]+")


def word_counts(texts: Iterable[str]) -> dict[str, list[int]]:
    """For every piece of the Thai runs that may be a word: how often it stands there, and its left and right neighbours as bits."""
    out: dict[str, list[int]] = {}
    for text in texts:
        for m in _THAI_RUN.finditer(text):
            run = m[0]
            n = len(run)
            may = [k for k in range(n + 1) if k == n or run[k] not in _NO_START]
            for x, i in enumerate(may[:-1]):
                left = 1 << (ord(run[i - 1]) % 61 if i else 62)
                for j in may[x + 1 :]:
                    if j - i > LONGEST:
                        break
                    if j - i < 2 or run[j - 1] in _NO_END:
                        continue
                    got = out.setdefault(run[i:j], [0, 0, 0])
                    got[0] += 1
                    got[1] |= left
                    got[2] |= 1 << (ord(run[j]) % 61 if j < n else 62)
    return out


def learned_words(documents: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """The words of the Thai texts of the corpus with their counts: pieces that stand often enough among enough different neighbours.

    A piece that begins with a given linking word or ends in a given final particle is not one word. Counting is an aggregate
    with map-side combine; the result has a checked bound.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                got = word_counts(b.column(0).slice(k, 200).to_pylist())
                yield pa.record_batch([pa.array(list(got), pa.string()), *(pa.array([v[i] for v in got.values()], pa.int64()) for i in range(3))], ["w", "n", "l", "r"])

    counts = documents.filter(F.col("text").rlike("[ก-๎]")).select("text").mapInArrow(count, "w string, n bigint, l bigint, r bigint")
    total = counts.groupBy("w").agg(F.sum("n").alias("n"), F.bit_or("l").alias("l"), F.bit_or("r").alias("r"))
    good = total.filter((F.col("n") >= LEAST_OFTEN) & (F.bit_count("l") >= LEAST_VARIED) & (F.bit_count("r") >= LEAST_VARIED)).select("w", "n")
    given = [w for w in THAI_JOIN | THAI_FINAL if len(w) > 1]
    found = {w: n for w, n in small_rows(good, most, "Thai words") if w in THAI_GIVEN or not any(w.startswith(g) and g in THAI_JOIN or w.endswith(g) and g in THAI_FINAL for g in given)}
    total = sum(found.values())
    # two words that stand together no more often than their counts make likely are two words
    return {w: n for w, n in found.items() if not any((a := found.get(w[:k])) and (b := found.get(w[k:])) and n * total < COHESION * a * b for k in range(2, len(w) - 1))}


_NUMBER = re.compile(r"[\d.,:/%-]*\d[\d.,:/%-]*")


def thai_end(before: str, after: str, then: str, words: Callable[[str], tuple[str, ...]]) -> bool:
    """Whether the gap between two runs ends a sentence; ``then`` is the run after the next gap."""
    if not after or after[0].isdigit() or after[0] in "(\"“«":
        return bool(after) and after[0] in "(\"“«" and words(before)[-1] in THAI_POLITE
    first = words(after)
    last = words(before)[-1] if not _NUMBER.fullmatch(before) else ""
    if after in THAI_FINAL or after in THAI_JOIN or first[0] in THAI_JOIN and first[0] not in ("ที่", "เวลา", "ละ"):
        return False
    if after == "มี" or after == "เวลา":
        return False
    if not last:  # a number: its unit goes on, anything else begins anew
        return not (first[0] in THAI_UNIT and (len(first) == 1 or first[1] in THAI_FINAL) or after in THAI_UNIT)
    if last in THAI_POLITE:
        return True
    # a row of things: the run after the next begins with "and"
    return not (then and words(then)[0] in ("และ", "หรือ") and len(first) <= 2)


def thai_gaps(text: str, start: int, end: int, lexicon: Lexicon) -> list[int]:
    """Ends of Thai statements between ``start`` and ``end``."""
    words = lexicon.words
    runs = [(m.start(), m.end()) for m in re.compile(r"\S+").finditer(text, start, end)]
    out = []
    open_quote = False
    for k, (a, b) in enumerate(runs[:-1]):
        run = text[a:b]
        if run.count('"') % 2:
            open_quote = not open_quote
        if open_quote:
            continue
        c, d = runs[k + 1]
        after = text[c:d]
        if not THAI.search(run) and not _NUMBER.fullmatch(run) or not (THAI.search(after) or after[0].isdigit() or after[0] in '("'):
            continue
        if run.endswith('"') or run[-1] in ".!?" and run not in THAI_UNIT:
            if run.endswith('"') and words(after)[0] in THAI_FINAL:
                continue
        then = text[runs[k + 2][0] : runs[k + 2][1]] if k + 2 < len(runs) else ""
        if thai_end(run, after, then, words):
            out.append(b)
    return out


def begins(c: str) -> bool:
    """Whether a character can begin a sentence: not a lower-case letter, a comma, a dash or the like."""
    return c.isupper() or c.isdigit() or c in "¿¡“«\"'(‘[「『„R$#@+" or (c.isalpha() and not c.islower())


def caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def whole_word(text: str, start: int, a: int) -> bool:
    """Whether what ends at ``a`` is a word or a number, not an abbreviation."""
    m = WORD_BEFORE.search(text, max(start, a - 24), a)
    word = (m[0] if m else text[a - 1 : a]).lower()
    if word in TITLES | REFERENCES | INNER | SHORTENED or re.search(r"\w\.\w", word) and not word[-1].isdigit():
        return False
    return word[-1:] in ")]%²º\"”»" or word[-1:].isdigit() or (len(word) > 2 and (word[-1] in "aeiouáéíóúâêôãõyàsrlmnzdt" or len(word) > 8 and word[-1] != "q"))


def stop_ends(text: str, a: int, b: int, after: int, start: int, end: int) -> bool:
    """Whether the terminators ``text[a:b]``, whose unit closes at ``after``, end a sentence in the block ``[start, end)``."""
    if after >= end:
        return True
    marks = text[a:b]
    if marks[-1] in HARD_STOPS or "……" in marks:
        return True
    nxt = after
    while nxt < end and text[nxt].isspace():
        nxt += 1
    if nxt >= end:
        return True
    c = text[nxt]
    if marks in ("…", "...") and caseless(c) and nxt == after:
        return True
    if nxt == after:  # no space: only a capital before a small letter, after a word or bracket
        if not (c.isupper() and nxt + 1 < end and (text[nxt + 1].islower() or text[nxt + 1] == " ")) or marks == "." and (a == start or not (text[a - 1].islower() or text[a - 1].isdigit() or after > b or text[a - 1] in ")]%²")):
            return False
    if ENUMERATOR.match(text, nxt, end):
        return True
    if not begins(c):
        # a small letter: after "!" or "?" or a full word the writer began anew without a capital
        if not c.islower() or after > b or marks in ("...", "…"):
            return False
        return marks != "." or whole_word(text, start, a)
    if marks != ".":
        return True
    m = WORD_BEFORE.search(text, max(start, a - 24), a)
    word = m[0] if m else ""
    low = word.lower()
    if word.isdigit() and (m.start() == start or not text[start : m.start()].strip()):
        return False  # "1. Heading"
    if low in INNER:
        return False
    if c.isdigit() or c in "#":
        return low not in REFERENCES
    if low in ("inc", "art", "cap", "n", "no", "fl", "al", "bl", "fig", "tab", "cl") and re.compile(r"(?:[IVXLC]+|[A-Z])\b").match(text, nxt, end):
        return False
    return low not in TITLES


#: Costs of the terminator lattice: an end against the leaning of its node, an end inside a quotation, a sentence without two letters or digits.
AGAINST, QUOTED, EMPTY = 2.0, 8.0, 3.0


def nodes(text: str, start: int, end: int) -> list[tuple[int, float]]:
    """``(end, leaning)`` of each terminator, pictogram and closed quotation of a block: above 0 for an end, below 0 against."""
    out: list[tuple[int, float]] = []
    at = start
    closes = start  # where the quotation that is open now ends
    while m := EVENT.search(text, at, end):
        a, b = m.span()
        c = text[a]
        if c in OPEN and a >= closes:
            at = b
            if c == '"' and a > start and not (text[a - 1].isspace() or text[a - 1] in "([{:—-–/،、,") and not caseless(text[a - 1]):
                continue
            close = text.find(OPEN[c], b, end)
            if close < 0:
                continue
            closes = close + 1
            inner = text[b:close].rstrip()
            if inner and inner[-1] in ".!?…" and not (inner.endswith(".") and inner.split()[-1].lower().rstrip(".") in TITLES):
                tail = CLOSERS.match(text, closes, end).end()
                p = PICTURES.match(text, tail, end)
                tail = p.end() if p else tail
                nxt = following(text, tail, end)
                if nxt < end and nxt > tail and begins(text[nxt]) and not caseless(text[nxt]):
                    out.append((tail, AGAINST))
                    closes = tail
            continue
        if c in OPEN:
            at = b
            continue
        quoted = QUOTED if a < closes else 0.0
        if ord(c) >= 0x2600 and c not in HARD_STOPS:  # a pictogram
            p = PICTURES.match(text, a, end)
            b = p.end() if p else b
            nxt = following(text, b, end)
            out.append((b, (AGAINST if nxt < end and begins(text[nxt]) and a > start else -AGAINST) - quoted))
            at = b
            continue
        after = CLOSERS.match(text, b, end).end()
        if after > b and text[b] == '"' and text.count('"', start, b) % 2 == 0:
            after = b  # this mark opens the next quotation
        if after > b and text[b] in "'’" and after < end and text[after].isalpha():
            after = b
        p = PICTURES.match(text, after, end)
        tail = p.end() if p else after
        out.append((tail, (AGAINST if stop_ends(text, a, b, tail, start, end) else -AGAINST) - quoted))
        at = b if quoted else max(tail, b)
    best: dict[int, float] = {}
    for e, leaning in out:
        best[e] = max(leaning, best.get(e, -1e9))
    return sorted(best.items())


def following(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def letters(text: str, a: int, b: int) -> int:
    """How many of the letters and digits of a span there are, 2 at most."""
    n = 0
    for k in range(a, b):
        n += text[k].isalnum()
        if n == 2:
            break
    return n


def way_through(text: str, start: int, found: list[tuple[int, float]]) -> list[int]:
    """The ends of the cheapest way through a block: an end of positive leaning that is passed over costs that, so does one of negative leaning that is taken.

    Linear in the nodes: a sentence's cost depends on where it begins only if it holds next to nothing.
    """
    ends, before, cost = [start], [-1], [0.0]  # of each entry; the cost is less what passing over all nodes before would be
    held, filled = [0], 0  # letters up to each entry, at most two of each span
    far, least, step = -1, 0, 0  # the cheapest entry two letters back or more, the cheapest of all, the first entry that is not far
    at_last = start
    for at, leaning in found:
        filled += letters(text, at_last, at)
        at_last = at
        while step < len(ends) and filled - held[step] >= 2:
            if far < 0 or cost[step] < cost[far]:
                far = step
            step += 1
        come, k = (cost[least] + EMPTY, least) if far < 0 or cost[least] + EMPTY < cost[far] else (cost[far], far)
        ends.append(at)
        before.append(k)
        cost.append(come - leaning)  # taking an end saves passing over it, or costs what speaks against it
        held.append(filled)
        if cost[-1] < cost[least]:
            least = len(ends) - 1
    k = min(range(len(ends)), key=cost.__getitem__)
    out = []
    while k > 0:
        out.append(ends[k])
        k = before[k]
    return out[::-1]


def block_ends(text: str, start: int, end: int, lexicon: Lexicon) -> list[int]:
    """Ends of the sentences of one block, its own end included."""
    out = way_through(text, start, nodes(text, start, end))
    if THAI.search(text, start, end):
        stops = {e for e in out if e == end or not text.endswith(THAI_STOPS, start, e)}
        out = sorted({*stops, *thai_gaps(text, start, end, lexicon)})
    if not out or out[-1] != end:
        out.append(end)
    return out


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of each block without white space around it."""
    lines, at = [], 0
    for m in LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    begun: int | None = None
    last = 0
    for k, (a, b) in enumerate(lines):
        body = text[a:b]
        if not body.strip():
            if begun is not None:
                yield begun, last
                begun = None
            continue
        first = a + len(body) - len(body.lstrip())
        last_char = a + len(body.rstrip())
        if begun is not None and LIST.match(body):
            # a wrapped line may begin with a number and a stop only if it is no list mark
            if not (text[first].isdigit() and text[begun:last][-1:] not in ".!?:" and not LIST.match(text, begun)):
                yield begun, last
                begun = None
        if begun is None:
            begun = first
        last = last_char
        line = body.rstrip()
        wrapped = k + 1 < len(lines) and len(line) >= WRAP and len(line.rsplit(None, 1)[0]) < WRAP and not THAI.search(line[-1:])
        if not wrapped:
            yield begun, last
            begun = None
    if begun is not None:
        yield begun, last


#: The lattice with the given words alone.
BARE = Lexicon()


def sentence_ends(text: str, lexicon: Lexicon | None = None) -> list[int]:
    """Code points up to and including the last character of each sentence, in order."""
    out: list[int] = []
    lexicon = lexicon or BARE
    for a, b in blocks(text):
        for e in block_ends(text, a, b, lexicon):
            while e > a and text[e - 1].isspace():
                e -= 1
            if e > a and (not out or e > out[-1]):
                out.append(e)
    return out


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, fim`` of every sentence. Null and blank texts have none; repeated rows give their sentences each time.

    The words of the spaceless texts are learned first; then one pass over the texts without a shuffle; texts of any length are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learned_words(documents))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for b in batches:
            ids, ends = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    e = sentence_ends(t, lexicon)
                    ends += e
                    ids += [i] * len(e)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ends, pa.int32())], ["doc_id", "fim"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, "doc_id bigint, fim int")


def sentence_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, ordem, frase``: the sentences themselves, numbered from 0 in each row."""
    shared = documents.sparkSession.sparkContext.broadcast(learned_words(documents))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for b in batches:
            rows: list[tuple[int, int, str]] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                for k, e in enumerate(sentence_ends(t or "", lexicon)):
                    rows.append((i, k, t[at:e].strip()))
                    at = e
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()))], ["doc_id", "ordem", "frase"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, "doc_id bigint, ordem int, frase string")
