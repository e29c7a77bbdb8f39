"""Text functions as column expressions."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

#: White space as Unicode has it; Java's \\s alone is ASCII.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_SENTENCE = r"[^!?.]+[!?.]?"
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that need no semicolon, the longest first.
_BARE = "|".join(sorted((k for k in html5 if k[-1] != ";"), key=lambda k: (-len(k), k)))
#: Numbers that stand for something else than their character.
_ODD = {str(n): c for n in (*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF))) if (c := html.unescape(f"&#{n};")) != chr(n)}
_LOWERED = {c.lower(): c.casefold() for c in map(chr, range(0x20000)) if c.casefold() != c.lower() and len(c.lower()) == 1}
_ONE = {k: v for k, v in _LOWERED.items() if len(v) == 1}
_MANY = {k: v for k, v in _LOWERED.items() if len(v) > 1}


#: Where the characters are, sharp s aside, that fold to other than their lower case.
_FOLDED = r"[\xB5\x{149}-\x{3FF}\x{587}\x{13A0}-\x{13FF}\x{1C80}-\x{1C8F}\x{1E90}-\x{1FFF}\x{AB70}-\x{ABBF}\x{FB00}-\x{FB17}]"


def _class(chars: dict[str, str]) -> str:
    """A class of few ranges that holds the characters, and some between."""
    ends: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ends and c - ends[-1][1] < 8:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ends) + "]"


def _table(of: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(of)), "map<string,string>")


def substituted(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """The text with `by` of each match of the pattern in its place; a text without a match costs a search."""
    pieces, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(pieces, found, lambda p, f: F.concat(p, F.coalesce(by(f), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(both, "")).otherwise(text)


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.btrim(text), r" +([,.!?;:])", "$1")


def normalize(text: Column) -> Column:
    """White space runs as one space, none at the ends and none before a sign of punctuation."""
    return _tidy(F.regexp_replace(text, f"{SPACE}+", " "))


def casefold(text: Column) -> Column:
    """Text as it compares without regard to case."""
    low = F.lower(text)
    full = substituted(F.translate(low, "".join(_ONE), "".join(_ONE.values())), _class(_MANY), lambda c: F.coalesce(F.element_at(_table(_MANY), c), c))
    return F.when(low.rlike(_FOLDED), full).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))


def sentences(text: Column) -> Column:
    """Runs up to and with a full stop, question or exclamation mark."""
    return F.transform(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", ""))


_PART, _LOOSE = re.compile(_SENTENCE), re.compile(r" +([,.!?;:])")


def once(text: str | None) -> str | None:
    """What drop_repeated_sentences makes of one text."""
    if text is None:
        return None
    flat = " ".join(text.split())
    if text and (text[0].isspace() or text[-1].isspace()):  # a blank at either end is a sentence of nothing, or the beginning of one
        flat = f" {flat}" if not flat else " " * text[0].isspace() + flat + " " * text[-1].isspace()
    parts = _PART.findall(flat)
    loose = _LOOSE.search(flat) is not None
    out, last = [], None
    for part in parts:
        part = part.strip(" ")
        key = part.casefold()
        key = (_LOOSE.sub(r"\1", key) if loose else key).strip(".!?")
        if not key or key != last:
            out.append(part)
        last = key
    return _LOOSE.sub(r"\1", " ".join(" ".join(out if parts else [flat]).split()))


def drop_repeated_sentences(text: Column) -> Column:
    """The text without sentences equal to the one before, case and end marks aside.

    A sentence without anything but marks is never dropped, and is not what the next is compared with unless it is the one before. A Python
    function of a text, as expressions that take one apart and compare its pieces cost several times as much; rows are pickled 100 at a time,
    whereas an Arrow batch of 10,000, however long, would be held several times over.
    """
    return F.udf(once, "string", useArrow=False)(text)


def references(text: Column) -> Column:
    """Character references of HTML, by name or number, as characters, as Python's html.unescape has them; all within the JVM."""

    def one(t: Column) -> Column:
        name = F.substring(t, 2, 40)
        hexa, deci = F.regexp_extract(t, r"^&#[xX]0*([0-9a-fA-F]*)", 1), F.regexp_extract(t, r"^&#0*([0-9]*)", 1)
        n = F.when(F.substring(t, 3, 1).isin("x", "X"), F.when(F.length(hexa) < 8, F.conv(F.concat(F.lit("0"), hexa), 16, 10))).otherwise(F.when(F.length(deci) < 9, F.concat(F.lit("0"), deci))).cast("bigint")
        wrong = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, 0).otherwise(n)), 8, "0")), "UTF-32")
        number = F.coalesce(F.element_at(_table(_ODD), n.cast("string")), F.when(wrong, "\ufffd").otherwise(sign))
        bare = F.regexp_extract(name, f"^(?:{_BARE})", 0)
        part = F.when(bare != "", F.concat(F.element_at(_table(html5), bare), F.substr(name, F.length(bare) + 1)))
        return F.when(F.startswith(t, F.lit("&#")), number).otherwise(F.coalesce(F.element_at(_table(html5), name), part, t))

    return let(text, lambda x: substituted(x, _REFERENCE, one))


def clean_markup(text: Column, references: Callable[[Column], Column] = references) -> Column:
    """Tags out, speaker marks (two or more >) as a space, then character references, then white space. Escaped marks survive."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), ">>+", " ")
    return normalize(references(bare))


def safe_id(value: Column) -> Column:
    """At most 100 of letters, digits, dot, underscore and hyphen; a hash where nothing is left."""
    clean = F.btrim(F.regexp_replace(value, "[^0-9A-Za-z._-]+", "_"), F.lit("._-"))
    return F.when(clean != "", F.substring(clean, 1, 100)).otherwise(F.substring(F.sha1(F.encode(value, "utf-8")), 1, 16))


def slug(name: Column) -> Column:
    """Lower case with hyphens, for a folder's name; `unknown` where nothing is left."""
    clean = F.btrim(F.regexp_replace(F.lower(F.btrim(name)), "[^0-9a-z._-]+", "-"), F.lit("-._"))
    return F.when(F.coalesce(clean, F.lit("")) != "", clean).otherwise("unknown")


def seconds(stamp: Column, *, strict: bool = False) -> Column:
    """Seconds of HH:MM:SS.mmm (or a comma); hours may be left out unless strict. No match is an error when strict, else null."""
    pattern = r"(\d{2}):(\d{2}):(\d{2})[.,](\d{3})" if strict else r"(?:(\d{2,}):)?(\d{2}):(\d{2})[.,](\d{3})"
    part = lambda i: F.coalesce(F.regexp_extract(stamp, pattern, i).try_cast("double"), F.lit(0.0))
    value = part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000
    bad = F.raise_error(F.concat(F.lit("no time in: "), F.coalesce(stamp, F.lit("null")))).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.regexp_extract(stamp, pattern, 0) != "", value).otherwise(bad)


def source_mode(line: Column) -> Column:
    """video or playlist where the line begins so, else auto."""
    first = F.lower(F.regexp_extract(line, r"^\s*(\S+)\s+\S", 1))
    return F.when(first.isin("video", "playlist"), first).otherwise("auto")


def source_url(line: Column) -> Column:
    """The line without its mode."""
    return F.btrim(F.regexp_replace(F.btrim(line), r"(?i)^(video|playlist)\s+", ""))


def is_playlist(mode: Column, url: Column) -> Column:
    return (mode == "playlist") | ((mode == "auto") & (url.contains("list=") | url.contains("/playlist")))


def wanted_statuses(text: Column | str) -> Column:
    """The valid ones of a comma-separated list, in its order; an error where none is."""
    text = F.lit(text) if isinstance(text, str) else text
    got = F.filter(F.transform(F.split(text, ","), lambda s: F.btrim(s)), lambda s: s.isin("accepted", "review", "rejected"))
    return F.when(F.size(got) > 0, got).otherwise(F.raise_error(F.lit("no valid status")).cast("array<string>"))
