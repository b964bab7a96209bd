"""Text functions without a built-in form, in Arrow batches: NFKC normalisation, stemming, chunking."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Separators of the chunker, from the largest unit to the smallest.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
#: Characters that normalisation maps to a space, a hyphen, and plain quotes.
SPACES = "     ⁠"
HYPHENS = "‐‑‒–—―−"
_SENTENCE_END = re.compile(r"[.!?](?=\s)")
_PLAIN = str.maketrans(
    SPACES + HYPHENS + "‘’“”", " " * len(SPACES) + "-" * len(HYPHENS) + "''\"\""
)


def normalised(text: str | None) -> str:
    """Text for comparison: NFKC, plain spaces, hyphens and quotes, one space a run, lower case."""
    plain = unicodedata.normalize("NFKC", text or "").translate(_PLAIN)
    return re.sub(r"\s+", " ", plain).lower().strip()


@F.pandas_udf(StringType())
def normalise(texts: pd.Series) -> pd.Series:
    return texts.map(normalised, na_action=None)


@F.pandas_udf(ArrayType(StringType()))
def normalise_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: None if texts is None else [normalised(t) for t in texts])


def _packed(text: str, start: int, end: int, mark: str, target: int) -> list[tuple[int, int]]:
    """Spans of a text cut at ``mark``; the whole text where it has none.

    From each cut the furthest one within ``target`` is looked up in the table of cuts; a unit that is too long is a
    span by itself. A span never starts with an empty unit.
    """
    units = text[start:end].split(mark)
    if len(units) == 1:
        return [(start, end)]
    ends = list(accumulate(map(len, units), lambda at, size: at + len(mark) + size, initial=start - len(mark)))[1:]
    begins = [start, *(e + len(mark) for e in ends[:-1])]
    spans, unit = [], 0
    while unit < len(begins):
        last = bisect_right(ends, begins[unit] + target) - 1
        if begins[unit] < ends[unit]:
            first, unit = begins[unit], max(unit, last)
            spans.append((first, ends[unit]))
        unit += 1
    return spans


def split_text(text: str, target: int) -> list[str]:
    """Pieces of at most ``target`` characters, cut at the largest unit that fits; blank pieces go.

    Open spans wait on a stack with the separator they are to be tried with, so no text is too deep. A text without
    any separator is cut by length, and blank pieces of it stay.
    """
    found: list[tuple[int, int]] = []
    open_spans = [(0, len(text), 0)]
    while open_spans:
        start, end, level = open_spans.pop()
        if end - start <= target:
            found.append((start, end))
        elif level == len(SEPARATORS):
            found.extend((at, min(at + target, end)) for at in range(start, end, target))
        else:
            inner = _packed(text, start, end, SEPARATORS[level], target)
            open_spans.extend((a, b, level + 1) for a, b in reversed(inner))
    pieces = [text[a:b] for a, b in found]
    whole = len(text) <= target or not any(mark in text for mark in SEPARATORS)
    return pieces if whole else [p for p in pieces if p.strip()]


def merge_small(pieces: list[str], least: int) -> list[str]:
    """Pieces under ``least`` characters join the one before; a small first piece joins the next."""
    heads = [i for i, piece in enumerate(pieces) if i == 0 or len(piece) >= least]
    if len(heads) > 1 and len("\n".join(pieces[: heads[1]])) < least:
        del heads[1]
    return ["\n".join(pieces[a:b]) for a, b in zip(heads, [*heads[1:], len(pieces)])]


def overlap_tail(before: str, size: int) -> str:
    """The end of a piece that the next one repeats: from a sentence start, else from a word start."""
    tail = before[-size:]
    sentence = _SENTENCE_END.search(tail)
    stop = sentence.start() if sentence else len(tail)
    return tail[stop + 1 if stop < len(tail) - 2 else tail.find(" ") + 1 :].strip()


def chunk_page(text: str | None, target: int = 500, overlap: int = 100, least: int = 80) -> list[str]:
    """Chunks of a page: split, join small ones, repeat tails; blanks at their ends and those under 20 characters go."""
    page = (text or "").strip()
    if not page:
        return []
    bodies = merge_small(split_text(page, target), least)
    tails = [overlap_tail(b, overlap) if overlap > 0 else "" for b in bodies]
    led = (f"{tail} {body}".strip() if tail else body.strip() for tail, body in zip(["", *tails], bodies))
    return [chunk for chunk in led if len(chunk) >= 20]


def chunker(target: int = 500, overlap: int = 100, least: int = 80):
    """Arrow function from arrays of page texts to arrays of each page's chunks."""

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def chunks(documents: pd.Series) -> pd.Series:
        return documents.map(lambda pages: None if pages is None else [chunk_page(p, target, overlap, least) for p in pages])

    return chunks


#: Kinds of letters: v a vowel, c a consonant, y by the letter before.
_KINDS = str.maketrans({chr(c): "v" if chr(c) in "aeiou" else "y" if chr(c) == "y" else "c" for c in range(128)})


def _kinds(word: str) -> str:
    """Of each letter whether it is a vowel (v) or a consonant (c); y is a vowel after a consonant."""
    kinds = word.translate(_KINDS)
    if "y" in kinds:
        known = ""
        for kind in kinds:
            known += kind if kind != "y" else "v" if known.endswith("c") else "c"
        return known
    return kinds


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return _kinds(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


#: Fixed values of Porter's published algorithm, steps 2 to 4.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _longest_first(ends) -> tuple:
    return tuple(sorted(ends, key=len, reverse=True))


#: The ends of a step, the longest first, and what they become.
_ENDS2, _NEW2 = _longest_first(e for e, _ in _STEP2), dict(_STEP2)
_ENDS3, _NEW3 = _longest_first(e for e, _ in _STEP3), dict(_STEP3)
_ENDS4 = _longest_first(_STEP4)


def _replace(word: str, ends: tuple[str, ...], news: dict[str, str], least: int) -> str:
    if not word.endswith(ends):
        return word
    for end in ends:
        if word.endswith(end):
            new = news[end]
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word by Porter's algorithm of 1980."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                base = word[: -len(end)]
                if _has_vowel(base):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz" and _kinds(word)[-1] == "c":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _ENDS2, _NEW2, 0), _ENDS3, _NEW3, 0)
    for end in _ENDS4 if word.endswith(_ENDS4) else ():
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Stems of token arrays, words remembered over the batch."""
    seen: dict[str, str] = {}
    of = lambda w: seen[w] if w in seen else seen.setdefault(w, stem(w))
    return tokens.map(lambda ws: [of(w) for w in ws] if ws is not None else None)
