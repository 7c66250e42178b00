"""Cleaning, redaction and simple reading of text, as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secrets by name and pattern, in the order they are removed; later patterns see the cleaned text.
SECRETS = {
    "aws_access_key": r"(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA|AIPA)[0-9A-Z]{16}",
    "github_pat": r"ghp_[A-Za-z0-9]{36}",
    "openai_api_key": r"\b(?:sk-proj-[A-Za-z0-9_-]{64,}|sk-[A-Za-z0-9]{48,})\b",
    "slack_token": r"xox[baprs]-[A-Za-z0-9-]+",
    "bearer_token": r"Bearer\s+[A-Za-z0-9._-]{20,}",
    "pem_private_key": r"(?s)-----BEGIN[ A-Z]+PRIVATE KEY-----.*?-----END[ A-Z]+PRIVATE KEY-----",
    "email_credential": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+:[A-Za-z0-9@#$%^&*()_+=!\-]{8,}",
}
#: Lines and phrases that try to steer a reader of the text (a fence, a system tag, an order, a role).
GADGETS = [
    r"(?md)^-{3,}\s*$",
    r"(?i)<\s*/?\s*system\s*>",
    r"(?i)\bignore\s+(?:all\s+)?(?:prior\s+)?instructions\b",
    r"(?imd)^\s*(?:system|assistant|user)\s*:\s*$",
]
#: Signs of a paper; three of them make one. They are sought in the whole text.
PAPER_SIGNS = [
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{",
    r"\[\d+\]", r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
]
STOP_WORDS = ["the", "and", "for", "that", "with", "this", "from", "are", "was", "how", "what", "does"]


def clean_label(text: Column, most: int = 256) -> Column:
    """Without control characters, at most ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""), 1, most)


def slug(*parts: Column) -> Column:
    """Lower case, every run of other characters than ASCII letters and figures as one underscore, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.concat_ws("_", *parts), "[^a-zA-Z0-9]+", "_")), "^_+|_+$", "")


def redacted(text: Column) -> Column:
    for pattern in SECRETS.values():
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def secret_names(text: Column) -> Column:
    """Names of the secrets that redaction removes, in order; each is sought in the text as cleaned so far."""
    found = []
    for name, pattern in SECRETS.items():
        found.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return F.array_compact(F.array(*found))


def disarmed(text: Column) -> Column:
    for pattern in GADGETS:
        text = F.regexp_replace(text, pattern, "[stripped]")
    return text


def paper_signs(text: Column) -> Column:
    """How many signs of a paper the text shows."""
    return sum([text.rlike(p).cast("int") for p in PAPER_SIGNS[1:]], text.rlike(PAPER_SIGNS[0]).cast("int"))


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\r\n]+")))


def terms(query: Column) -> Column:
    """Lower-case words of three characters or more without stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def html_text(html: Column, most: int = 8000) -> Column:
    """Text of a page: scripts and styles dropped, tags as spaces, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, most)


#: Hosts of known kinds of page, and suffixes of a path that show its kind; the first that fits counts.
URL_HOSTS = {"tweet": ["twitter.com", "x.com"], "arxiv": ["arxiv.org"], "github": ["github.com"], "youtube": ["youtube.com", "youtu.be"]}
URL_SUFFIXES = {"pdf": ["pdf"], "image": ["png", "jpg", "jpeg", "gif", "webp", "svg"]}


def url_kind(url: Column) -> Column:
    """Kind of page by host (subdomains too), else by the path's suffix, else webpage."""
    parts = F.lower(url)
    host, suffix = F.regexp_extract(parts, r"^[a-z]+://([^/?#:]*)", 1), F.regexp_extract(parts, r"^[a-z]+://[^?#]*\.([a-z0-9]+)(?:[?#]|$)", 1)
    by_host = [F.when(reduce(Column.__or__, [(host == h) | host.endswith(f".{h}") for h in hosts]), kind) for kind, hosts in URL_HOSTS.items()]
    return F.coalesce(*by_host, *[F.when(suffix.isin(known), kind) for kind, known in URL_SUFFIXES.items()], F.lit("webpage"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0, "low")


#: Tags of file suffixes.
TECH_TAGS = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "cpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "sql": "sql", "sh": "shell"}


def element_id(key: Column) -> Column:
    """Sixteen digits of the key's digest, for drawings."""
    return F.substring(F.sha2(key, 256), 1, 16)


def cypher_text(text: Column) -> Column:
    """Backslashes and single quotes escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def markdown_text(text: Column) -> Column:
    """Backticks as apostrophes, angle brackets as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("`"), F.lit("'")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sentence_count(text: Column) -> Column:
    """Sentences by their ends: full stop, exclamation or question mark before white space; blank texts have none."""
    bare = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(r"[.!?][ \t\r\n]+")) + 1)


def tech_tag(path: Column) -> Column:
    """The technology that a path's suffix shows, null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(suffix == s, F.lit(tag)) for s, tag in TECH_TAGS.items()])


def sentences(text: Column) -> Column:
    """The text's sentences, trimmed; blank ones are left out."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """ASCII words in lower case, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def capped(text: Column, most_tokens: int = 500) -> Column:
    """The text's first whole sentences within a number of tokens, four characters each; a first sentence beyond it is cut between words.

    What was cut ends in an ellipsis. A text that fits stays as it is.
    """
    most = most_tokens * 4
    parts = sentences(text)
    ends = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"), F.lit(True).alias("open")), lambda acc, s: F.struct(
        (acc["n"] + F.when(acc["open"] & (acc["total"] + F.length(s) + 1 <= most), 1).otherwise(0)).alias("n"),
        (acc["total"] + F.when(acc["open"] & (acc["total"] + F.length(s) + 1 <= most), F.length(s) + 1).otherwise(0)).alias("total"),
        (acc["open"] & (acc["total"] + F.length(s) + 1 <= most)).alias("open"),
    ))
    n = ends["n"]
    head = F.substring(F.coalesce(F.get(parts, F.lit(0)), text), 1, most)
    first = F.concat(F.regexp_replace(F.regexp_replace(head, r"(?s) [^ ]*$", ""), r"[.!?,; ]+$", ""), F.lit("…"))
    whole = F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))), " ")
    return F.when(F.length(text) <= most, text).when(n == 0, first).when(n < F.size(parts), F.concat(F.regexp_replace(whole, r"[.!?]+$", ""), F.lit("…"))).otherwise(whole)


def body(text: Column) -> Column:
    """The text without the front matter that it may begin with."""
    return F.regexp_replace(text, r"\A---\n(?s:.*?)\n---[ \t]*\n?", "")


def front_matter_fields(text: Column) -> Column:
    """How many fields the text's front matter has; 0 without any."""
    inner = F.regexp_extract(text, r"\A---\n((?s:.*?))\n---[ \t]*(?:\n|\z)", 1)
    return F.regexp_count(inner, F.lit(r"(?m)^[A-Za-z_][A-Za-z0-9_-]*:"))
