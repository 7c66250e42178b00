"""Names made from labels: tags, file names, links, front matter values, repo names and digests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What file systems and links do not allow in a name, and how link aliases write what would end them.
_NOT_IN_NAMES = r'[\\/*?:"<>|#^\[\]\x00-\x1f\x7f\x{85}\x{2028}\x{2029}]'
_ALIAS = {"]]": "] ]", "|": "-"}
#: Words, first characters and inner characters that YAML reads as something else than text.
_YAML_WORDS = ["yes", "no", "true", "false", "null", "on", "off", "~"]
_YAML_FIRST, _YAML_INNER = r"^[-?!&*|>%@`]", r"[:#\[\]{},]"
_YAML_NUMBER = r"^(?:[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|0x[0-9a-fA-F]+|0o[0-7]+|\.\w+)$"

#: Words that show what a question asks for.
_SUMMARIZE = r"(?i)\b(?:what'?s in|overview of|summarize)\b"
_CONNECT = r"(?i)\b(?:connects?|relates?|between|path|from\s+.+\s+to)\b"


def hyphened(text: Column) -> Column:
    """Lower case, each run of other characters than ASCII letters and figures as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tag(text: Column) -> Column:
    """A tag; one that would begin with a figure gets an x before it, an empty one is 'community'."""
    name = hyphened(text)
    return F.when(name == "", "community").when(name.rlike("^[0-9]"), F.concat(F.lit("x"), name)).otherwise(name)


def shortened(name: Column, most: int, joint: str) -> Column:
    """``name``, or if it is longer its beginning with eight digits of its digest, ``most`` characters in all."""
    cut = F.concat(F.substring(name, 1, most - 9), F.lit(joint), F.substring(F.sha2(name, 256), 1, 8))
    return F.when(F.length(name) > most, cut).otherwise(name)


def file_name(label: Column, most: int = 200) -> Column:
    """A file name without forbidden characters; 'unnamed' where nothing is left. Composed and decomposed letters stay as they are."""
    name = F.regexp_replace(F.regexp_replace(label, _NOT_IN_NAMES, ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return shortened(F.when(name == "", "unnamed").otherwise(name), most, "_")


def wikilink(label: Column) -> Column:
    """[[file name|label]], the label without what would end the link."""
    alias = label
    for bad, good in _ALIAS.items():
        alias = F.replace(alias, F.lit(bad), F.lit(good))
    return F.concat(F.lit("[["), file_name(label), F.lit("|"), F.regexp_replace(alias, r"[\x00-\x1f\x7f]", " "), F.lit("]]"))


def front_matter_value(text: Column) -> Column:
    """One line of YAML, in double quotes where YAML would read it as something else than text."""
    line = F.regexp_replace(F.regexp_replace(text, r"[\n\r]", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{85}\x{2028}\x{2029}]", "")
    quoted = line.rlike(_YAML_INNER) | line.rlike(_YAML_FIRST) | F.lower(line).isin(_YAML_WORDS) | line.rlike(_YAML_NUMBER)
    return F.when(quoted, F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(line)


def repo_name(text: Column, most: int = 80) -> Column:
    """A short name for a repo; null where it holds a path, 'repo' where nothing is left."""
    name = hyphened(F.trim(text))
    return F.when(text.rlike(r"[/\\]|\.\."), F.lit(None)).when(name == "", "repo").otherwise(shortened(name, most, "-"))


def content_digest(path: Column, content: Column) -> Column:
    """The digest of a file's content and path."""
    return F.sha2(F.concat(F.coalesce(content, F.lit("")), F.lit("\x00"), F.coalesce(path, F.lit(""))), 256)


def intent(question: Column) -> Column:
    """What a question asks for: summarize before connect before explore."""
    return F.when(question.rlike(_SUMMARIZE), "summarize").when(question.rlike(_CONNECT), "connect").otherwise("explore")
