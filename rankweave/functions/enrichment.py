"""Reducing a nested enrichment payload to keywords, characters and director."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.scalars import filled, no_strings

MAX_KEYWORDS = 15
MAX_CAST = 8
BLANKS = " \\t\\n\\r\\x00\\x0B"


def keywords(payload: Column) -> Column:
    """Names first, then the first fifteen."""
    named = F.filter(payload["keywords"]["keywords"], lambda k: k["name"].isNotNull())
    return F.coalesce(F.slice(F.transform(named, lambda k: k["name"]), 1, MAX_KEYWORDS), no_strings())


def clean_role(role: Column) -> Column:
    """Role without its parenthesised notes and the blanks around them; null if
    what is left is shorter than two bytes."""
    bare = F.regexp_replace(role, "\\s*\\([^)]*\\)\\s*", "")
    bare = F.regexp_replace(bare, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return F.when(filled(role) & (F.octet_length(bare) > 1), bare)


def characters(payload: Column) -> Column:
    """First eight cast members: actor, then role; repeats dropped."""
    first = F.slice(payload["credits"]["cast"], 1, MAX_CAST)
    names = F.transform(first, lambda c: F.array(F.when(filled(c["name"]), c["name"]), clean_role(c["character"])))
    kept = F.filter(F.flatten(names), lambda n: n.isNotNull())
    return F.coalesce(F.array_distinct(kept), no_strings())


def director(payload: Column) -> Column:
    """Name of the first crew member with that job, null when it has no name."""
    directors = F.filter(payload["credits"]["crew"], lambda m: m["job"] == "Director")
    return F.get(directors, 0)["name"]
