"""Canonical forms of text and JSON for comparison without formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What formatting may add or drop. Unicode categories P and Z, and white space outside Z.
FORMATTING = r"[\p{P}\p{Z}\s\u0085\u001c-\u001f]+"


def unformatted(text: Column) -> Column:
    """``text`` without letter case, white space and punctuation; null becomes ''.

    Upper case first makes the one-to-many folds (sharp s) equal to their written-out form; the
    pattern stands between the two, since Catalyst would drop the inner of two adjacent conversions.
    """
    return F.lower(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), FORMATTING, ""))


def unformatted_json(text: Column) -> Column:
    """Names and values of a JSON object as a sorted array of canonical entries.

    Null and '' give an empty array; text that is no JSON object gives one entry, its canonical form.
    Nested values compare by their JSON text. The entry separator is a control character that
    :func:`unformatted` removes from names and values, so entries cannot run together.
    """
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    entries = F.transform(F.map_entries(parsed), lambda e: F.concat(unformatted(e["key"]), F.lit("\u001f"), unformatted(e["value"])))
    plain = unformatted(text)
    return F.array_sort(F.coalesce(entries, F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array(plain))))
