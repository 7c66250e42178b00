"""Symbols and imports of source files in many languages, by patterns over lines.

Each line is matched once against its language's patterns, JVM-side; files are never passed whole to
a Python function. Patterns see single lines only, so declarations that are broken over lines are
not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each suffix the patterns of classes, functions and imports, group 1 being the name.
PATTERNS: dict[str, tuple[str, str, str]] = {
    "py": (r"^\s*class\s+(\w+)", r"^\s*(?:async\s+)?def\s+(\w+)", r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"),
    "js": (r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?\()", r"(?:from\s+|require\()[\"']([^\"']+)[\"']"),
    "java": (r"^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface)\s+(\w+)", r"^\s+(?:public|private|protected|static|final|\s)*[\w<>\[\]]+\s+(\w+)\s*\([^;]*(?:\{|;)\s*$", r"^\s*import\s+([\w.]+)"),
    "go": (r"^type\s+(\w+)", r"^func\s+(?:\([^)]*\)\s*)?(\w+)", r"^\s*(?:import\s+)?\"([\w./]+)\"\s*$"),
    "rs": (r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", r"^\s*(?:pub\s+)?fn\s+(\w+)", r"^\s*use\s+([\w:]+)"),
    "c": (r"^\s*struct\s+(\w+)\s*\{", r"^(?:static\s+)?[\w\s*]+?\b(\w+)\s*\([^;]*\)\s*\{?\s*$", r"^\s*#include\s+[<\"]([^>\"]+)[>\"]"),
    "rb": (r"^\s*(?:class|module)\s+(\w+)", r"^\s*def\s+(?:self\.)?(\w+)", r"^\s*require(?:_relative)?\s+[\"']([^\"']+)[\"']"),
    "cs": (r"^\s*(?:\w+\s+)*(?:class|interface)\s+(\w+)", r"^\s+(?:public|private|protected|internal|static)\s[\w<>\[\] ]*?(\w+)\s*\(", r"^\s*using\s+([\w.]+)"),
    "kt": (r"^\s*(?:\w+\s+)*(?:class|object)\s+(\w+)", r"^\s*(?:\w+\s+)*fun\s+(\w+)", r"^\s*import\s+([\w.]+)"),
    "scala": (r"^\s*(?:case\s+)?(?:class|object|trait)\s+(\w+)", r"^\s*(?:override\s+)?def\s+(\w+)", r"^\s*import\s+([\w.]+)"),
    "php": (r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+(\w+)", r"^\s*use\s+([\w\\]+)"),
    "lua": (r"^(?!)()", r"^\s*(?:local\s+)?function\s+([\w.:]+)", r"require\s*\(?[\"']([^\"']+)[\"']"),
    "swift": (r"^\s*(?:\w+\s+)*(?:class|struct|protocol|enum)\s+(\w+)", r"^\s*(?:\w+\s+)*func\s+(\w+)", r"^\s*import\s+(\w+)"),
    "jl": (r"^\s*(?:mutable\s+)?(?:struct|module)\s+(\w+)", r"^\s*function\s+([\w.!]+)", r"^\s*(?:using|import)\s+([\w.]+)"),
    "zig": (r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:struct|enum|union)", r"^\s*(?:pub\s+)?fn\s+(\w+)", r"@import\(\"([^\"]+)\"\)"),
    "ps1": (r"^\s*class\s+(\w+)", r"^\s*function\s+([\w-]+)", r"^\s*using\s+\w+\s+(\S+)"),
    "m": (r"^\s*@(?:interface|protocol)\s+(\w+)", r"^\s*[-+]\s*\([^)]*\)\s*(\w+)", r"^\s*#import\s+[<\"]([^>\"]+)[>\"]"),
    "ex": (r"^\s*defmodule\s+([\w.]+)", r"^\s*defp?\s+(\w+)", r"^\s*(?:import|alias|use|require)\s+([\w.]+)"),
}
ALIASES = {"ts": "js", "tsx": "js", "jsx": "js", "vue": "js", "svelte": "js", "h": "c", "cpp": "c", "cc": "c", "cxx": "c", "hpp": "c", "kts": "kt", "mm": "m", "exs": "ex", "toc": "lua"}
KEYWORDS = ["if", "for", "while", "switch", "return", "catch", "else", "sizeof"]


def _name(line: Column, pattern: str) -> Column:
    groups = max(1, pattern.count("(") - pattern.count("(?") - pattern.count(r"\("))
    found = [F.regexp_extract(line, pattern, i + 1) for i in range(groups)]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def symbols(files: DataFrame) -> DataFrame:
    """(repo, source_file, line_no, kind, name): classes, functions and imports of files (repo, source_file, file_text)."""
    ext = F.lower(F.regexp_extract("source_file", r"\.([^./]+)$", 1))
    language = F.coalesce(*[F.when(ext == a, F.lit(b)) for a, b in ALIASES.items()], ext)
    lines = files.where("file_text is not null").select("repo", "source_file", language.alias("language"), F.posexplode(F.split("file_text", r"\r\n|\n|\r")).alias("pos", "line"))
    by_kind = []
    for kind, at in (("class", 0), ("function", 1), ("import", 2)):
        name = F.coalesce(*[F.when(F.col("language") == suffix, _name(F.col("line"), patterns[at])) for suffix, patterns in PATTERNS.items()])
        by_kind.append(F.when(name.isNotNull() & ~name.isin(KEYWORDS), F.struct(F.lit(kind).alias("kind"), name.alias("name"))))
    return lines.select("repo", "source_file", (F.col("pos") + 1).alias("line_no"), F.explode(F.array_compact(F.array(*by_kind))).alias("s")).select("repo", "source_file", "line_no", "s.kind", "s.name")


def symbol_graph(files: DataFrame) -> DataFrame:
    """Links from each file to what it defines (contains) and imports: (repo, source, target, relation)."""
    target = F.when(F.col("kind") == "import", F.col("name")).otherwise(F.concat("source_file", F.lit("#"), "name"))
    return symbols(files).select("repo", F.col("source_file").alias("source"), target.alias("target"), F.when(F.col("kind") == "import", "imports").otherwise("contains").alias("relation")).distinct()


#: Marks of comments that give a reason.
RATIONALE_MARKS = ["NOTE", "IMPORTANT", "HACK", "WHY", "RATIONALE", "TODO", "FIXME"]


def _lines(files: DataFrame) -> DataFrame:
    return files.where("file_text is not null").select("repo", "source_file", F.posexplode(F.split("file_text", r"\r\n|\n|\r")).alias("pos", "line"))


def rationales(files: DataFrame) -> DataFrame:
    """Comment lines of Python files that begin with a mark: (repo, source_file, line_no, mark, note)."""
    shape = rf"^\s*# ({'|'.join(RATIONALE_MARKS)}):\s*(.*?)\s*$"
    lines = _lines(files.where(F.lower("source_file").endswith(".py"))).where(F.col("line").rlike(shape))
    return lines.select("repo", "source_file", (F.col("pos") + 1).alias("line_no"), F.regexp_extract("line", shape, 1).alias("mark"), F.regexp_extract("line", shape, 2).alias("note"))


def stem(path: Column) -> Column:
    """The file's name without folders and last suffix."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def resolved_imports(files: DataFrame) -> DataFrame:
    """Names that Python files import from files of their repo: (repo, source_file, name, target_file, defined).

    ``from x import A, B as C`` names A and B of every file x.py of the repo; ``defined`` says whether a class
    or function of that name is declared there. Imports of modules that the repo lacks give no row.
    """
    python = files.where(F.lower("source_file").endswith(".py"))
    shape = r"^\s*from\s+\.*([\w.]+)\s+import\s+\(?([^#)]+)"
    found = _lines(python).where(F.col("line").rlike(shape)).select("repo", "source_file", F.regexp_extract("line", shape, 1).alias("module"), F.split(F.regexp_extract("line", shape, 2), ",").alias("names"))
    names = found.select("repo", "source_file", F.element_at(F.split("module", r"\."), -1).alias("stem"), F.explode("names").alias("name"))
    names = names.withColumn("name", F.regexp_extract("name", r"^\s*(\w+)", 1)).where("name <> ''").distinct()
    targets = python.select("repo", F.col("source_file").alias("target_file"), stem(F.col("source_file")).alias("stem")).distinct()
    declared = symbols(python).where("kind <> 'import'").select("repo", F.col("source_file").alias("target_file"), "name").distinct().withColumn("defined", F.lit(True))
    placed = names.join(targets, ["repo", "stem"]).where("source_file <> target_file").join(declared, ["repo", "target_file", "name"], "left")
    return placed.select("repo", "source_file", "name", "target_file", F.coalesce("defined", F.lit(False)).alias("defined"))
