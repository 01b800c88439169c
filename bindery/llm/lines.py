"""Keys of printed lines that survive case, spacing, marks, numbers and misread characters."""

from __future__ import annotations

import re
import unicodedata
# Characters that scanners confuse, as classes with one letter each, then pairs read as one letter.
_CLASSES = {
    "a": "@",
    "c": "e€(",
    "b": "h",
    "g": "9",
    "l": "i1|!",
    "o": "0",
    "s": "5ſ$",
    "t": "†",
}
_PAIRS = (("vv", "w"), ("ln", "m"), ("rn", "m"), ("rl", "n"), ("ll", "u"), ("cl", "d"))
# Words that stand beside a page number.
PAGE_WORDS = ("page", "pages", "pag", "pg", "p", "seite", "s", "página", "pagina", "pág", "folio", "fol", "leaf", "blatt")

_FOLD = {ord(c): k for k, cs in _CLASSES.items() for c in cs}


class _Letters(dict):
    """Translation of characters to folded letters, worked out when first met; all else goes but line ends."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code in _FOLD:
            to = _FOLD[code]
        elif c == "\n":
            to = "\n"
        else:
            to = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isalpha())
            to = "".join(_FOLD.get(ord(x), x) for x in to)
        self[code] = to
        return to


_LETTERS = _Letters()
_ONE = [_LETTERS[i] for i in range(256)]
_BYTES = bytes(ord(x) if len(x) == 1 and ord(x) < 256 else i for i, x in enumerate(_ONE))
_GONE = bytes(i for i, x in enumerate(_ONE) if not x)
_BYTE_PAIRS = [(a.encode(), b.encode()) for a, b in _PAIRS]
_NUMBER = re.compile(r"\d[\d.,/:lo|-]*")
_ASCII_NUMBER = re.compile(r"[0-9][0-9.,/:lo|-]*")  # the same in such text, found faster
_ROMAN_EDGE = re.compile(r"^\W*[ivxl]+(?=\W*\s{2})|(?<=\s\s)\W*[ivxl]+\W*$")
_PLAIN = (("€", "e"), ("†", "t"), ("“", ""), ("”", ""), ("’", ""), ("‘", ""), ("—", ""), ("–", ""), ("…", ""))

_ROMAN = r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_BARE = re.compile(
    rf"[\W_]*(?:(?:{'|'.join(PAGE_WORDS)})[\W_]*)?(?:\d{{1,4}}|(?=[ivxlc]){_ROMAN})(?:\s*(?:/|of|von|sur|de)\s*\d{{1,4}})?[\W_]*",
    re.I,
)
_MARKS = re.compile(r"[\W_]{3}")
#: Ranges of letters and digits only; where all else is taken for a mark, nothing is missed, and sets of fixed ranges are searched fast.
LETTER_RANGES = "A-Za-z0-9À-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԯא-תؠ-يぁ-ゖァ-ヺ一-龥가-힣"
_MAY_BE_MARKS = re.compile(rf"[^{LETTER_RANGES}\n]" * 3)
_DRAWN = re.compile(r"([\W_]{1,2})\1+")
_DECORATED = re.compile(r"\s*(?P<a>[\[(*–—~-]*\s*)(?P<n>[\dlIiOoSsBZz|!]{1,4}|[ivxlcIVXLC1|]{1,7})(?P<b>\s*[\])*–—~.-]*)\s*")


def is_page_number(line: str) -> bool:
    """Whether a line holds only a page number: arabic or roman, with or without a word such as page,
    brackets, dashes or a total, and with digits that may be misread as letters. The last word of
    a sentence that is a number (a full stop right after it) is none."""
    s = line.strip()
    if len(s) > 24:  # long only by its decoration, or none
        if not _MARKS.search(s):
            return False
        s = _DRAWN.sub(r"\1", s)
        if len(s) > 24:
            return False
    if not s:
        return False
    if _BARE.fullmatch(s):
        return not re.fullmatch(r"\w+[.,;:!?]+[\"'”’]?", s) and any(c.isalnum() for c in s)
    words = s.split()
    if len(words) > 1 and words[0].strip(".*[(-").lower() in PAGE_WORDS:
        s = s[s.index(words[0]) + len(words[0]) :]
    parts = s.split("/") if "/" in s else [s]
    if len(parts) > 2:
        return False
    for x in parts:
        m = _DECORATED.fullmatch(x)
        if not m:
            return False
        n = m["n"]
        digits = sum(c.isdigit() for c in n)
        shown = bool(m["a"].strip()) or bool(m["b"].strip(" .")) or len(words) > 1
        if n.lower().translate(str.maketrans("1|!", "iii")) and re.fullmatch(_ROMAN, n.lower().translate(str.maketrans("l1|!", "iiii"))) and shown:
            continue
        if not (digits or (shown and re.fullmatch(r"[lI|OoSZB]{1,3}", n)) or re.fullmatch(r"[lI|]O|[lI|]{2}O?", n)):
            return False
        if re.search(r"[a-zA-Z]", n) and not re.fullmatch(r"[\dlIiOoSsBZz|!]{1,4}", n):
            return False
    return True


def long_lines(text: str, lines: list[str]) -> list[bool]:
    """Whether each line of a text is too long for a page number. Lines that hold no three marks in a row are known by their length,
    of which two characters at each end may be blanks, without a look at the line."""
    long = [len(x) > 28 for x in lines]
    no = at = 0
    for m in _MAY_BE_MARKS.finditer(text):
        no += text.count("\n", at, at := m.start())
        long[no] = False
    return long


def _number(m: re.Match) -> str:
    """Nothing for a number standing for itself; a digit beside a letter is a misread letter."""
    t, a, b = m.string, m.start(), m.end()
    return m[0] if (a and t[a - 1].isalpha()) or (b < len(t) and t[b].isalpha()) else " "


def line_keys(text: str) -> list[str]:
    """The key of each line of a text: its letters, folded; empty for lines without letters."""
    t = text.casefold()
    if not t.isascii():
        for a, b in _PLAIN:
            t = t.replace(a, b)
    t = (_ASCII_NUMBER if t.isascii() else _NUMBER).sub(_number, t)
    if "  " in t:
        t = "\n".join([_ROMAN_EDGE.sub(" ", x) if "  " in x else x for x in t.split("\n")])
    try:  # bytes are translated several times faster than other text
        raw = t.encode("latin-1").translate(_BYTES, _GONE)
        for a, b in _BYTE_PAIRS:
            raw = raw.replace(a, b)
        return raw.decode("latin-1").split("\n")
    except UnicodeEncodeError:
        t = t.translate(_LETTERS)
        for a, b in _PAIRS:
            t = t.replace(a, b)
        return t.split("\n")


#: Keys of lines of page words alone, never a case.
PAGE_KEYS = {k for w in PAGE_WORDS for k in line_keys(w)} | {""}
#: Edits between keys of one printed line: one, and one more for so many letters; none for keys of fewer letters than LEAST.
LETTERS_PER_EDIT, LEAST = 14, 6
#: Edits may shift the letters between them by so many places.
SHIFT = 3


def allowed(size: int) -> int:
    """Edits between a repeated line of so many letters and a copy of it."""
    return 0 if size < LEAST else 1 + size // LETTERS_PER_EDIT
