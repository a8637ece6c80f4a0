"""Path, glob and language functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language badges by file extension, and the names a query may use for them.
BADGES = {
    "ts": "TS", "mts": "TS", "cts": "TS", "tsx": "TX", "js": "JS", "mjs": "JS", "cjs": "JS", "jsx": "JS", "py": "PY", "rs": "RS", "go": "GO",
    "java": "JV", "kt": "KT", "kts": "KT", "scala": "SC", "sc": "SC", "cs": "C#", "fs": "F#", "fsx": "F#", "cpp": "C+", "cc": "C+", "cxx": "C+",
    "hpp": "C+", "hh": "C+", "hxx": "C+", "c": "C", "h": "C", "m": "OC", "mm": "OC",
    "swift": "SW", "zig": "ZG", "hs": "HS", "rb": "RB", "php": "PH", "sh": "SH", "bash": "SH", "lua": "LU", "dart": "DT", "jl": "JL", "ml": "ML",
    "nix": "NX", "r": "R", "sql": "SQ", "json": "{}", "jsonc": "{}", "wat": "WA", "vue": "VU", "svelte": "SV",
}
LANGUAGE_NAMES = {
    "rust": "RS", "typescript": "TS", "ts": "TS", "tsx": "TX", "javascript": "JS", "js": "JS", "python": "PY", "py": "PY", "go": "GO", "golang": "GO",
    "java": "JV", "kotlin": "KT", "scala": "SC", "csharp": "C#", "c#": "C#", "fsharp": "F#", "f#": "F#", "cpp": "C+", "c++": "C+", "c": "C",
    "objc": "OC", "objective-c": "OC", "swift": "SW", "zig": "ZG", "haskell": "HS", "ruby": "RB", "rb": "RB", "php": "PH", "bash": "SH",
    "shell": "SH", "sh": "SH", "bash": "SH", "lua": "LU", "dart": "DT", "julia": "JL", "jl": "JL", "ocaml": "ML", "ml": "ML", "nix": "NX", "r": "R",
    "sql": "SQ", "json": "{}", "wasm": "WA", "wat": "WA", "vue": "VU", "svelte": "SV",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def language(path: Column) -> Column:
    badges = F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv])
    return F.coalesce(F.try_element_at(badges, extension(path)), F.lit("other"))


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def top_folder(path: Column, kind: Column | None = None) -> Column:
    out = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("/")
    return out if kind is None else F.when(kind == "external", "«external»").otherwise(out)


def dir_prefixes(path: Column) -> Column:
    """All directories a file is in, outermost first."""
    parts = F.split(dir_of(path), "/")
    every = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    return F.when(F.contains(path, F.lit("/")), every).otherwise(F.array().cast("array<string>"))


def query_glob(glob: str) -> str:
    """The query language's dialect, for lower-cased paths: ** any, * and ? within a segment."""
    parts = re.split(r"(\*\*|\*|\?)", glob.replace("\\", "/").lower())
    known = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return r"\A" + "".join(known.get(p) or re.escape(p) for p in parts) + r"\z"


def rule_glob(glob: str) -> str:
    """The rules' dialect, case-sensitive: a/**/b matches a/b too."""
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return r"\A" + "".join(known.get(p) or re.escape(p) for p in parts) + r"\z"
