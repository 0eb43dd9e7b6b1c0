"""Document type by keyword rules, and from a model's reply."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from foliate.config import CLASS_RULES, CLASSIFY_CHARS
from foliate.functions.text import without_fence

TYPES = ("car", "life", "health", "property", "travel")


def keyword_type(text: Column, rules=CLASS_RULES, chars: int = CLASSIFY_CHARS) -> Column:
    """First rule, in order, with enough distinct pattern hits in the first ``chars`` characters; else empty."""
    low = F.lower(F.substring(text, 1, chars))
    out = F.lit("")
    for kind, needed, patterns in reversed(rules):
        hits = sum((F.when(low.rlike("(?U)" + p), 1).otherwise(0) for p in patterns), F.lit(0))
        out = F.when(hits >= needed, kind).otherwise(out)
    return out


def reply_type(reply: Column, text: Column) -> Column:
    """The type a model's reply names: its JSON, else the first type it mentions, else keywords, else ``life``."""
    bare = without_fence(reply)
    said = F.lower(F.btrim(F.get_json_object(bare, "$.doc_type")))
    named = F.when(said.isin(*TYPES), said)
    word = F.regexp_extract(F.lower(bare), rf"\b({'|'.join(map(re.escape, TYPES))})\b", 1)
    return F.coalesce(named, F.nullif(word, F.lit("")), F.nullif(keyword_type(text), F.lit("")), F.lit("life"))
