"""Column functions that clean a block's text (Unicode-aware where Python is, ASCII where the rules are)."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: What Python's str.strip() and \\s take as white space.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
FOREIGN = re.compile(r"[^\x00-\x7f]+")
# Fixed value: a date of numbers.
DATE = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(strip(text), rf"{SPACE}+", " ")


# Marks that are noise before a text, and marks that are written once at its end.
LEADING, ENDING = r"[:\-•·●▪]", r"[.,;:!?]"


def strip_edge_noise(text: Column) -> Column:
    """Without leading bullets, colons and dashes; a repeated final mark once."""
    bare = F.regexp_replace(text, rf"^(?:{LEADING}|{SPACE})+", "")
    return strip(F.regexp_replace(bare, rf"({ENDING})\1+(?=\n?\z)", "$1"))


def normalise_dates(text: Column) -> Column:
    """Separators of d/m/y numbers become slashes; no calendar check."""
    return F.regexp_replace(text, "(?U)" + DATE, "$1/$2/$3")


def reread(run: str) -> str:
    """A run of characters that is UTF-8 read as cp1252, read properly; any other run as it is."""
    try:
        return run.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return run


def mend(text: str) -> str:
    """HTML entities, text that was read as cp1252 instead of UTF-8, control characters, NFKC."""
    if "&" in text and "<" not in text:
        text = html.unescape(text)
    text = FOREIGN.sub(lambda m: reread(m[0]), text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = "".join(c for c in text if c in "\n\t" or unicodedata.category(c) != "Cc")
    return unicodedata.normalize("NFKC", text)


@F.pandas_udf(StringType())
def _mend(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t if t.isascii() and "&" not in t and t.isprintable() else mend(t))


def normalise_unicode(text: Column) -> Column:
    """A documented part of what a text-fixing library does; see ``mend``."""
    return _mend(text)


def symbol_only(text: Column) -> Column:
    """Empty, or one or two characters of which none is an ASCII letter or digit."""
    bare = strip(text)
    return (bare == "") | bare.rlike(r"^[^A-Za-z0-9]{1,2}\z")


def colour_band(percent: Column) -> Column:
    """Colour of an accuracy's bar."""
    return F.when(percent >= 80, "high").when(percent >= 55, "mid").otherwise("low")


def confidence_tier(confidence: Column, high: float = 0.90, medium: float = 0.70) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")


def code_like(text: Column) -> Column:
    """Letters and digits both, joined by single dashes, slashes or dots."""
    return strip(text).rlike(r"^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9]+([\-/.][A-Za-z0-9]+)*\z")


def without_fence(reply: Column) -> Column:
    """A reply without its Markdown code fence."""
    bare = strip(reply)
    lines = F.split(bare, "\n", -1)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    last = F.when(F.size(body) > 0, F.element_at(body, -1)).otherwise("")
    body = F.when(F.startswith(last, F.lit("```")), F.slice(body, 1, F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    return F.when(F.startswith(bare, F.lit("```")), strip(F.array_join(body, "\n"))).otherwise(bare)
