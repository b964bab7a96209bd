"""Column functions on text: cleaning, identifiers, redaction, facts, model-output parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word boundary of ASCII words: Java's own \b also counts accented letters.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: The same before a letter or digit: Java tests the following character first, which is cheaper.
START = r"(?=[A-Za-z0-9])(?<![A-Za-z0-9_])"

#: Patterns of identifiers, of personal data with their labels (order matters), of checkable facts.
CODE = r"[A-Za-z]{1,4}-[0-9]{3,}"
NUMBER = r"[0-9][0-9,.]*"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
QUOTED = r'"([^"]{1,60})"'
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
PHONE = r"\+?[0-9](?:[ -]?[0-9]){7,13}"
PAN = r"[A-Z]{5}[0-9]{4}[A-Z]"
FACT_NUMBER = r"[0-9][0-9,.:]*"
FACT_CODE = r"[A-Z]{2,}-[0-9]+"
CONFIDENCE = r"(?i)CONFIDENCE:\s*(HIGH|LOW)\s*$"
RETRY_AFTER = r"try again in ([0-9]+(?:\.[0-9]+)?)s"
FENCED = r"(?s)^```(?:json)?\s*\n(.*?)\n?```$"

#: Letters whose upper case is several letters, and the one letter that stands for each: ẞ, a title-case letter, or itself.
_LONG = "".join(c for c in map(chr, range(0x80, 0x20000)) if len(c.upper()) > 1)
_SINGLE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG)

#: Hyphens and quotes that comparison makes plain.
HYPHENS = "‐‑‒–—―−"
QUOTES = "‘’“”"

#: Recorded content keeps this many characters.
CAPTURE_LIMIT = 4000


def trim_all(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often ``body`` names it.

    A column that is used n times is copied n times into the plan, and what it is made of with it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upper_each(c: Column | str) -> Column:
    """Upper case letter by letter, so a text keeps its length: ß becomes ẞ, as in engines with one-to-one case, not SS."""
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(F.translate(x, _LONG, _SINGLE))
    return F.array_join(F.transform(F.split(c, ""), one), "")


def lower_each(c: Column | str) -> Column:
    """Lower case letter by letter, so a text keeps its length: İ becomes i, and Σ becomes σ also where a word ends."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def compared(c: Column | str) -> Column:
    """Text for comparison by columns alone: plain hyphens and quotes, lower case letter by letter, one space a run, no blank ends.

    White space is ASCII's, as in engines whose patterns are; blanks of any width go at the ends.
    """
    plain = lower_each(F.translate(c, HYPHENS + QUOTES, "-" * len(HYPHENS) + "''\"\""))
    return F.regexp_replace(F.regexp_replace(plain, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+$", "")


def clean_text(c: Column | str) -> Column:
    """Extracted text made plain: ligatures, hyphenated line breaks, runs of blanks and line feeds, trailing blanks."""
    out = F.replace(F.replace(F.replace(c if isinstance(c, Column) else F.col(c), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("ﬀ"), F.lit("ff"))
    out = F.regexp_replace(out, r"(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    return trim_all(out)


def _text(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _found(c: Column | str, pattern: str, sign: str) -> Column:
    """All matches; texts without the cheap ``sign`` of one are not searched."""
    every = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(_text(c).isNull(), None).when(_text(c).rlike(sign), every).otherwise(none)


def _replaced(c: Column, pattern: str, label: str, sign: str) -> Column:
    return F.when(c.rlike(sign), F.regexp_replace(c, pattern, label)).otherwise(c)


def identifiers(c: Column | str) -> Column:
    """Sorted distinct lower-cased codes, numbers, e-mail addresses and quoted strings of a text."""
    every = F.concat(
        _found(c, START + CODE + B, "[A-Za-z]-[0-9]{3}"), _found(c, START + NUMBER + B, "[0-9]"), _found(c, B + EMAIL + B, "@"), _found(c, QUOTED, '"')
    )
    return F.array_sort(F.array_distinct(F.transform(every, F.lower)))


def redact(c: Column | str) -> Column:
    """Text with e-mail addresses, card, phone and tax numbers replaced by labels, in this order."""
    out = _replaced(_text(c), B + EMAIL + B, "[email]", "@")
    out = _replaced(out, START + CARD + B, "[card]", "[0-9](?:[ -]?[0-9]){12}")
    out = _replaced(out, PHONE + B, "[phone]", "[0-9](?:[ -]?[0-9]){7}")
    return _replaced(out, START + PAN + B, "[pan]", "[A-Z]{5}[0-9]{4}")


def captured(c: Column, mode: str) -> Column:
    """Content as it may be recorded: nothing (none), capped (full), or capped and redacted (redacted)."""
    if mode == "none":
        return F.lit(None).cast("string")
    capped = F.when(F.length(c) > CAPTURE_LIMIT, F.concat(F.left(c, F.lit(CAPTURE_LIMIT)), F.lit("…[truncated]"))).otherwise(c)
    capped = F.when(F.length(c) > 0, capped)
    return capped if mode == "full" else redact(capped)


def header_key(line: Column) -> Column:
    """A line as it counts for running headers and footers: trimmed, digits as #."""
    return F.regexp_replace(trim_all(line), "[0-9]+", "#")


def edge_lines(page: Column | str) -> Column:
    """Distinct first two and last two non-blank trimmed lines of a page."""
    lines = F.filter(F.transform(F.split(page, "\n"), trim_all), lambda x: x != "")
    last = F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), F.lit(2))
    return F.array_distinct(F.concat(F.slice(lines, 1, 2), last))


def facts(c: Column | str) -> Column:
    """Numbers and codes of an answer that its citations should hold; lower-cased, a last . or , dropped."""
    every = F.concat(_found(c, START + FACT_NUMBER + B, "[0-9]"), _found(c, START + FACT_CODE + B, "[A-Z]-[0-9]"))
    return F.array_distinct(F.transform(every, lambda f: F.regexp_replace(F.lower(f), "[.,]$", "")))


def unsupported_facts(answer_facts: Column, cited: Column) -> Column:
    """Facts that are no substring of the cited text."""
    low = F.lower(cited)
    return F.filter(answer_facts, lambda f: ~F.contains(low, f))


def support_verdict(answer_facts: Column, missing: Column) -> Column:
    return (
        F.when(F.size(answer_facts) == 0, "no_checkable_facts")
        .when(F.size(missing) == 0, "all_facts_appear_in_citations")
        .otherwise("some_facts_not_found_in_citations")
    )


def strip_fences(c: Column | str) -> Column:
    """Model output without the code fence around it."""
    plain = trim_all(c)
    return F.when(plain.rlike(FENCED), F.regexp_extract(plain, FENCED, 1)).otherwise(plain)


def json_payload(c: Column | str) -> Column:
    """The part of a model's output from the first { to the last }, fences gone; the output itself if there is none."""
    plain = strip_fences(c)
    first = F.instr(plain, F.lit("{"))
    last = F.length(plain) - F.instr(F.reverse(plain), F.lit("}")) + 1
    has = (first > 0) & F.contains(plain, F.lit("}")) & (last > first)
    return F.when(has, F.substring(plain, first, last - first + 1)).otherwise(plain)


def split_confidence(c: Column | str) -> Column:
    """struct(answer, confidence, followed_format); without a closing CONFIDENCE line the confidence is LOW."""
    text = F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    found = text.rlike(CONFIDENCE)
    return F.struct(
        trim_all(F.regexp_replace(text, CONFIDENCE, "")).alias("answer"),
        F.when(found, F.upper(F.regexp_extract(text, CONFIDENCE, 1))).otherwise("LOW").alias("confidence"),
        found.alias("followed_format"),
    )


def retry_after_ms(c: Column | str) -> Column:
    """Wait that a rate-limit message asks for, with a cushion of 250 ms; null without one."""
    seconds = F.regexp_extract(c, RETRY_AFTER, 1)
    return F.when(seconds != "", (F.ceil(F.round(seconds.cast("double") * 1000, 6)) + 250).cast("long"))


def preview(c: Column | str, size: int = 140) -> Column:
    return F.left(F.regexp_replace(c, r"\s+", " "), F.lit(size))


def check_strings(text: Column, required: Column, forbidden: Column, plain_required: Column | None = None, plain_forbidden: Column | None = None) -> Column:
    """struct(ok, missing, forbidden, checked): required strings that a text lacks and forbidden ones that it holds.

    Plain substrings, so "5" is in "15". The plain lists are what is looked for, in the form of the text, where that is
    not the lists' own. Null lists ask for nothing.
    """
    every = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    plain = F.coalesce(text, F.lit(""))
    held = lambda c, i, s: F.contains(plain, s if c is None else F.get(c, i))
    missing = F.filter(every(required), lambda s, i: ~held(plain_required, i, s))
    found = F.filter(every(forbidden), lambda s, i: held(plain_forbidden, i, s))
    ok = (F.size(missing) == 0) & (F.size(found) == 0)
    return F.struct(ok.alias("ok"), missing.alias("missing"), found.alias("forbidden"), (F.size(every(required)) + F.size(every(forbidden))).cast("long").alias("checked"))


def safe_filename(c: Column | str) -> Column:
    """A file name without path separators and characters other than word characters, dot, hyphen and space."""
    return F.regexp_replace(F.regexp_replace(c, r"[/\\]", ""), r"[^\w.\- ]", "")


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
