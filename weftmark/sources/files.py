"""Files of a corpus folder: listing, kinds, and what is new since a manifest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of each kind, folders never read, and names of files that hold secrets.
KINDS = {
    "code": "py js jsx ts tsx vue svelte java c h cpp cc cxx hpp rb cs kt kts scala php lua toc swift jl go rs zig ps1 m mm ex exs".split(),
    "document": "md txt rst html docx xlsx".split(),
    "paper": ["pdf"],
    "image": "png jpg jpeg gif webp svg".split(),
    "video": "mp4 mov webm mkv mp3 wav m4a".split(),
}
NOISE = "node_modules .git __pycache__ .venv venv dist build target .tox .mypy_cache .pytest_cache".split()
SENSITIVE = r"(?i)(?:^|/)(?:\.env(?:\..*)?|id_rsa.*|.*\.pem|.*\.key|credentials.*|secrets?\..*)$"


def file_kind(path: Column) -> Column:
    """Kind by suffix, null where none fits; a blade template is code."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.when(F.lower(path).endswith(".blade.php"), "code")
    for name, suffixes in KINDS.items():
        kind = kind.when(ext.isin(suffixes), name)
    return kind


def skip_reason(path: Column) -> Column:
    """Why a file is not read: noise folder, secret name, unknown kind; null where it is."""
    parts = F.split(path, "/")
    noisy = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(NOISE))
    return F.when(noisy, "noise-dir").when(path.rlike(SENSITIVE), "sensitive").when(file_kind(path).isNull(), "unknown-kind")


def _glob(pattern: str) -> str:
    """A pattern of names as a regular expression: * any characters, ? one, [...] one of several."""
    parts = {"*": ".*", "?": "."}
    return "".join(parts.get(c, c if c in "[]" else re.escape(c)) for c in pattern.replace("[!", "[^")).replace(r"\^", "^")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern fits the whole path, one of its names, or its beginning up to a name; slashes around a pattern do not count."""
    globs = [_glob(p.strip("/")) for p in patterns if p.strip("/")]
    if not globs:
        return F.lit(False)
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    fits = f"^(?s:{'|'.join(globs)})$"
    return F.exists(F.concat(parts, heads), lambda x: x.rlike(fits))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_at, size, kind, skip_reason) of all files under a folder; contents stay unread until asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), file_kind(F.col("path")).alias("kind"), skip_reason(F.col("path")).alias("skip_reason"))


def changed_since(files: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """Files against a manifest of (key, modified_at): status new, modified, unchanged or deleted."""
    old = manifest.groupBy(*key).agg(F.max("modified_at").alias("old_at"))
    new = files.groupBy(*key).agg(F.max("modified_at").alias("new_at"))
    status = F.when(F.col("old_at").isNull(), "new").when(F.col("new_at").isNull(), "deleted").when(F.col("new_at") > F.col("old_at"), "modified").otherwise("unchanged")
    return new.join(old, key, "full_outer").select(*key, status.alias("status"))
