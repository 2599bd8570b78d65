"""Folding of freely typed names, edit distance, and the score of a typed value against one entry. Pure Python for Arrow UDFs."""

from __future__ import annotations

import html
import re
import unicodedata

#: The codes of the federative units.
UFS = frozenset("AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split())

#: What a cell says when nothing is known (folded).
NOTHING_KNOWN = frozenset(
    "|null|none|nil|nan|na|n a|ni|n i|nd|n d|nao informado|nao informada|nao se aplica|sem bairro|sem cidade|sem informacao|a definir|"
    "a informar|desconhecido|desconhecida|indefinido|indefinida|nao consta|nao disponivel|nao definido|undefined|vazio|s n|x|xx|xxx|tbd|sem dados|outro|outros|selecione|selecione o bairro|selecione a cidade|selecione uma opcao".split("|")
)

_MOJIBAKE = re.compile("[ÂÃ][\u0080-¿]")
_ALNUM = re.compile(r"[^0-9a-z]+")


_ENTITY = re.compile(r"&([a-zA-Z])[a-zA-Z]{2,7};")
_SLUG_ENTITY = re.compile(r"-([a-z])(?:acute|circ|tilde|cedil|grave|uml)-")
_SLUG_CODE = re.compile(r"-(19[2-9]|2[0-4]\d|25[0-5])-")


def repair(s: str) -> str:
    """Undo HTML entities (also misspelt ones and those left in slugs) and UTF-8 that was read as Latin-1."""
    if "&" in s:
        s = _ENTITY.sub(r"\1", html.unescape(s))
    if "-" in s:
        s = _SLUG_CODE.sub(lambda m: chr(int(m[1])), _SLUG_ENTITY.sub(r"\1", s))
    if _MOJIBAKE.search(s):
        s = _MOJIBAKE.sub(lambda m: m[0].encode("latin-1").decode("utf-8", "replace"), s)
    return s


def fold(s: str) -> str:
    """Lower case, no accents, words of letters and digits with one space between them."""
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return _ALNUM.sub(" ", s.lower()).strip()


def nothing_known(value: str | None) -> bool:
    return value is None or fold(repair(value)) in NOTHING_KNOWN


def edits(a: str, b: str, most: float) -> float:
    """Weighted restricted Damerau-Levenshtein distance; above ``most`` any larger number may come out.

    A transposition, or a letter doubled or undoubled, costs 0.8; any other edit 1.
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    if abs(n - m) * 0.8 > most:
        return most + 1
    band, far = int(most / 0.8), most + 1
    before: list[float] = []
    row = [float(j) if j <= band else far for j in range(m + 1)]
    for i in range(1, n + 1):
        x, low = a[i - 1], far
        now = [far] * (m + 1)
        if i <= band:
            now[0] = low = float(i)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            y = b[j - 1]
            c = row[j - 1] if x == y else row[j - 1] + 1
            up = row[j] + (0.8 if i > 1 and x == a[i - 2] else 1)
            left = now[j - 1] + (0.8 if j > 1 and y == b[j - 2] else 1)
            if up < c:
                c = up
            if left < c:
                c = left
            if x != y and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and before[j - 2] + 0.8 < c:
                c = before[j - 2] + 0.8
            now[j] = c
            if c < low:
                low = c
        if low > most:
            return far
        before, row = row, now
    return row[m]


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` can be an abbreviation of ``word``: same first letter, its letters in order, and shorter."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def reach(length: int) -> int:
    """Edits allowed for a name of so many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2


#: Usual abbreviations of names of one word.
ABBREVIATED = {"centro": ("cent", "ctro")}


class Entry:
    """A name of the list, cut into its first word and the rest."""

    __slots__ = ("full", "head", "id", "tail", "whole")

    def __init__(self, entry_id: int, name: str, whole: bool = True) -> None:
        words = fold(name).split()
        self.id, self.whole = entry_id, whole
        self.full = "".join(words)
        self.head, self.tail = (words[0], "".join(words[1:])) if len(words) > 1 else (self.full, "")


class Typed:
    """A typed value (or a part of one) in the forms that are compared."""

    __slots__ = ("full", "heads", "tail")

    def __init__(self, words: list[str]) -> None:
        self.full = "".join(words)
        self.heads, self.tail = (words[0], "".join(words[1:])) if len(words) > 1 else ("", "")


def score(q: Typed, e: Entry) -> float:
    """Cost of reading ``q`` as ``e``: edits of the whole name, of its rest under a shortened first word, or of its rest alone; 9 if none fits."""
    best = 9.0
    most = reach(len(e.full))
    if abs(len(q.full) - len(e.full)) <= most:
        d = edits(q.full, e.full, most)
        best = d if d <= most else best
    if e.tail:
        most = reach(len(e.tail))
        if q.tail and q.heads[0] == e.head[0] and abs(len(q.tail) - len(e.tail)) <= most:
            short = shortens(q.heads, e.head) or q.heads == e.head
            if short or len(q.heads) <= 4:
                d = edits(q.tail, e.tail, most)
                best = min(best, d + (0.3 if short else 0.9)) if d <= most else best
        if e.whole and abs(len(q.full) - len(e.tail)) <= most:
            d = edits(q.full, e.tail, most) + 0.5
            best = min(best, d) if d <= most + 0.5 else best
    elif shortens(q.full, e.full) and 3 <= len(q.full) <= 0.75 * len(e.full):
        best = min(best, 0.7)
    elif 3 < len(q.full) < len(e.full) and q.full[0] == e.full[0]:
        best = min([best, *(d + 0.9 for a in ABBREVIATED.get(e.full, ()) if (d := edits(q.full, a, 1)) <= 1)])
    return best


_LABEL = re.compile(r"^\s*(?:bairro|cidade|munic[ií]pio|localidade|distrito)\s*:\s*", re.I)
_PARTS = re.compile(r"\s+[-–|]\s+|[/,;()|]")


def readings(value: str, around: str = "") -> list[tuple[int, list[str]]]:
    """The word lists under which a cell can be read: (0, the whole), then (k, part k), without labels, states and country.

    ``around`` is the folded name, without spaces, of the larger place, which may stand at the end.
    """
    value = _LABEL.sub("", repair(value))
    out: list[tuple[int, list[str]]] = []
    seen: set[str] = set()
    parts = [value, *(p for p in _PARTS.split(value) if p and p.strip())]
    for k, part in enumerate(parts):
        words = fold(part).split()
        while len(words) > 1 and (words[-1] == "brasil" or words[-1].upper() in UFS):
            words = words[:-1]
        if not words or (len(words) == 1 and words[0].upper() in UFS and k):
            continue
        forms, rest = [words], words
        while len(rest) > 1 and (rest[0] == "b" or (len(rest[0]) > 4 and edits(rest[0], "bairro", 1) <= 1)):
            rest = rest[1:]
            forms.append(rest)
        if len(words) > 1 and len(words[-1]) == 1:
            forms.append(words[:-1])
        joined = "".join(words)
        if joined.startswith("bairro") and len(words) == 1 and len(joined) > 9:
            forms.append([joined[6:]])
        if around and joined.endswith(around) and joined != around:
            keep, n = [], len(joined) - len(around)
            for w in words:
                keep += [w[: max(0, n)]] if n > 0 else []
                n -= len(w)
            forms.append(keep)
        for w in forms:
            if (key := " ".join(w)) not in seen:
                seen.add(key)
                out.append((k, w))
    return out


def state_in(value: str) -> str | None:
    """A state code that stands as the last word (before the country) of a typed value."""
    words = fold(value).upper().split()
    while words and words[-1] == "BRASIL":
        words = words[:-1]
    return words[-1] if len(words) > 1 and words[-1] in UFS else None
