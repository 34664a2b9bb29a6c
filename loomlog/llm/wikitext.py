"""The readable text of wiki markup, and its words folded so that case, accents, invisible characters and the spelling of
characters as entities make no difference."""

from __future__ import annotations

import functools
import html
import html.entities
import re
import sys
import unicodedata

import numpy as np

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NOWIKI = re.compile(r"<nowiki\s*>((?:(?!<nowiki\s*>).)*?)</nowiki\s*>", re.S | re.I)
_REF_EMPTY = re.compile(r"<ref\b[^<>]*/\s*>", re.I)
_REF = re.compile(r"<ref\b[^<>]*>(?:(?!<ref\b).)*?</ref\s*>", re.S | re.I)
_MATH = re.compile(r"<(math|templatedata|timeline|score|syntaxhighlight)\b[^<>]*>(?:(?!<\1\b).)*?</\1\s*>", re.S | re.I)
_GALLERY = re.compile(r"(<gallery\b[^<>]*>)((?:(?!<gallery\b).)*?)(</gallery\s*>)", re.S | re.I)
_GALLERY_TARGET = re.compile(r"^[^|\n]*\|?", re.M)
_BRACES = re.compile(r"\{\{+|\}\}+")
_TABLE_LINE = re.compile(r"^[ \t:]*(?:\{\||\|-).*$", re.M)
_ATTRIBUTE = r"""[\w-]++\s*+=\s*+(?:"[^"\n]*+"|'[^'\n]*+'|[\w%#.-]++)\s*+"""
_CELL = re.compile(rf"((?:^[ \t]*+[|!])|\|\||!!)[ \t]*+(?:{_ATTRIBUTE})++\|(?!\|)", re.M)
_BRACKETS = re.compile(r"\[\[|\]\]")
_EXTERNAL = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]*+[ \t]*+([^\[\]\n]*+)\]", re.I)
_BREAK = re.compile(r"<(?:br|hr|p|div|li|tr|td|th)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_QUOTES = re.compile(r"''+")
_SWITCH = re.compile(r"__[A-Z]+__")
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
#: Names of link targets that show nothing where they stand, and of files, which show their caption.
_HIDDEN = {"category", "kategorie", "catégorie", "categoría", "категория", "κατηγορία", "カテゴリ", "分类", "分類", "تصنيف", "श्रेणी"}
_FILES = {"file", "image", "datei", "bild", "fichier", "файл"}
_OPTION = re.compile(r"(?:thumb|thumbnail|frame|frameless|border|left|right|center|none|upright|mini|\d*x?\d+px|(?:alt|link|class|lang|page)=.*)\Z", re.I | re.S)
_LANGUAGE = re.compile(r"[a-z]{2,3}(?:-[a-z]+)?\Z")
_SHIELD = str.maketrans("{}[]<>|'&=!_", "".join(map(chr, range(0xE100, 0xE10C))))
_UNSHIELD = {0xE100 + i: c for i, c in enumerate("{}[]<>|'&=!_")}


def _shown(inner: str) -> str:
    """What a link with this content shows."""
    target, bar, label = inner.partition("|")
    space, colon, _ = target.partition(":")
    if colon and space.strip():
        name = space.strip().casefold()
        if name in _HIDDEN or _LANGUAGE.match(name):
            return ""
        if name in _FILES:
            caption = [p for p in label.split("|") if not _OPTION.match(p.strip())] if bar else []
            return caption[-1] if caption else ""
    if not bar:
        return target.lstrip(":")
    if label:
        return label
    name = target.lstrip(":").rpartition(":")[2].strip()  # the pipe trick
    return name[: name.rfind("(")].rstrip() if name.endswith(")") and "(" in name else name


def _without_templates(t: str) -> str:
    """``t`` without templates and parameters, however deep they nest, in one pass; unmatched braces stay."""
    stack: list[list[int]] = []  # [position, braces] of open runs
    spans: list[tuple[int, int]] = []  # outermost matched spans so far
    for m in _BRACES.finditer(t):
        n = m.end() - m.start()
        if t[m.start()] == "{":
            stack.append([m.start(), n])
            continue
        at = m.start()
        while n >= 2 and stack:
            run = stack[-1]
            take = 3 if n >= 3 and run[1] >= 3 else 2
            run[1] -= take
            n -= take
            at += take
            start = run[0] + run[1]
            while spans and spans[-1][0] >= start:
                spans.pop()
            spans.append((start, at))
            if run[1] < 2:
                stack.pop()
    out, done = [], 0
    for a, e in spans:
        out.append(t[done:a])
        done = e
    out.append(t[done:])
    return "".join(out)


def _with_links_shown(t: str) -> str:
    """``t`` with each link replaced by what it shows, innermost first, in one pass; unmatched brackets stay."""
    stack: list[list[str]] = [[]]
    done = 0
    for m in _BRACKETS.finditer(t):
        stack[-1].append(t[done : m.start()])
        done = m.end()
        if m[0] == "[[":
            stack.append([])
        elif len(stack) > 1:
            inner = "".join(stack.pop())
            stack[-1].append(_shown(inner))
        else:
            stack[-1].append("]]")
    stack[-1].append(t[done:])
    return "[[".join("".join(parts) for parts in stack)


def _entity(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        for n in (name, name.lower(), name.capitalize()):
            if f"{n};" in html.entities.html5:
                return html.entities.html5[f"{n};"]
        return m[0]
    return html.unescape(m[0].lower())


def readable(text: str) -> str:
    """What a reader sees of ``text``. Markup is taken out without parting words; unclosed markup stays as text."""
    t, shielded = text, False
    if "<" in t:
        if "<!--" in t:
            t = _COMMENT.sub("", t)
        low = t.lower()
        if "<nowiki" in low:
            shielded = True
            t = _NOWIKI.sub(lambda m: m[1].translate(_SHIELD), t)
        if "<ref" in low:
            t = _REF.sub("", _REF_EMPTY.sub("", t))
        if "</" in t:
            t = _MATH.sub("", t)
            if "<gallery" in low:
                t = _GALLERY.sub(lambda m: m[1] + _GALLERY_TARGET.sub("", m[2]) + m[3], t)
    if "{{" in t:
        t = _without_templates(t)
    if "{|" in t or "\n|" in t or "\n!" in t or t[:1] in "|!":
        t = _CELL.sub(r"\1 ", _TABLE_LINE.sub("", t))
    if "[[" in t:
        t = _with_links_shown(t)
    if "//" in t and "[" in t:
        t = _EXTERNAL.sub(r"\1", t)
    if "<" in t:
        t = _TAG.sub("", _BREAK.sub(" ", t))
    if "''" in t:
        t = _QUOTES.sub("", t)
    if "__" in t:
        t = _SWITCH.sub("", t)
    if shielded:
        t = t.translate(_UNSHIELD)
    if "&" in t:
        t = _ENTITY.sub(_entity, t)
    return t


#: What a code point folds to: 0 = deleted, else one code point.
WORD, DIGIT = 1, 2


def _fold(ch: str) -> str:
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold())
    return "".join(c for c in s if unicodedata.category(c)[0] != "M" and unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85")


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, dict[int, str], re.Pattern, np.ndarray]:
    """(folded code point or 0, word class, longer foldings, a pattern of the characters that have one, is it a capital)."""
    fold = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    upper = np.zeros(sys.maxunicode + 1, bool)
    longer: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3:  # Hangul syllables stay whole
            kind[cp] = WORD
            continue
        if 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x3FFFF:
            kind[cp] = WORD if unicodedata.category(chr(cp))[0] == "L" else 0
            continue
        c = unicodedata.category(chr(cp))
        if c in ("Cn", "Co", "Cs"):
            continue
        s = _fold(chr(cp))
        if not s:
            fold[cp] = 0
        elif len(s) == 1:
            fold[cp] = ord(s)
        else:
            longer[cp] = s
        if c[0] == "L":
            kind[cp] = WORD
            upper[cp] = c in ("Lu", "Lt")
        elif c[0] == "N":
            kind[cp] = DIGIT
    pattern = re.compile("[" + "".join(re.escape(chr(c)) for c in longer) + "]")
    return fold, kind, longer, pattern, upper


def expand(text: str) -> str:
    """``text`` with the characters that fold to several replaced by those."""
    _, _, longer, pattern, _ = tables()
    if text.isascii() or not pattern.search(text):
        return text
    return pattern.sub(lambda m: longer[ord(m[0])], text)


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, without deleted ones, and the class of each (0: no word character)."""
    return folded_cased(text)[:2]


def folded_cased(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``folded``, and whether each code point was a capital before."""
    fold, kind, _, _, upper = tables()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = fold[raw]
    if (keep := cps != 0).all():
        return cps, kind[cps], upper[raw]
    cps = cps[keep]
    return cps, kind[cps], upper[raw[keep]]


def words(text: str) -> list[str]:
    """The folded words of a readable text: runs of letters and digits."""
    cps, kind = folded(expand(text))
    word = kind > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    s = cps.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [s[a:e] for a, e in zip(edge[::2], edge[1::2])]
