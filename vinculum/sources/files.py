"""Source trees, links in pages, and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders never scanned, and the largest file read.
IGNORED = (
    "node_modules", ".git", ".next", "dist", "build", "out", "coverage", ".turbo", ".cache", "target", ".venv", "venv", "__pycache__", "vendor",
    "bin", "obj", ".gradle", "Pods", ".dart_tool", ".svelte-kit", ".nuxt", ".idea", ".vscode",
)
SOURCE_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs", "vue", "svelte", "py", "java", "kt", "kts", "rs", "go", "scala", "sc", "cs", "fs", "fsx",
    "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "m", "mm", "ml", "swift", "zig", "hs", "rb", "php", "sh", "bash", "lua", "dart", "jl", "r",
    "nix", "sql", "json", "jsonc", "wat",
)
MAX_BYTES = 1_000_000
#: What a module specifier may leave out, files before index files.
SUFFIXES = ["", ".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json", ".vue", ".svelte"]
INDEXES = ["/index.ts", "/index.tsx", "/index.d.ts", "/index.mts", "/index.cts", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"]


def is_source_path(path: Column) -> Column:
    """A known extension, in any case, and no ignored folder on the way, with either slash."""
    folders = "|".join(x.replace(".", r"\.") for x in IGNORED)
    return path.rlike(r"(?i)\.(?:" + "|".join(SOURCE_EXTENSIONS) + r")\z") & ~path.rlike(r"(?:\A|[\\/])(?:" + folders + r")(?:[\\/]|\z)")


def scan_directory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below root), text of the files of a tree; large files and ignored folders are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    inside = F.regexp_replace(F.col("path"), r"\A(?:[a-z]+:)?/*\Q" + root.strip("/") + r"\E/*", "")
    out = raw.filter(F.col("length") <= MAX_BYTES).select(inside.alias("path"), F.decode("content", "utf-8").alias("text"))
    return out.filter(is_source_path(F.col("path")))


#: What precedes a module specifier: from clauses, side-effect imports, dynamic imports and requires; quotes of three kinds.
_STATIC = r"""\b(?:import|export)\b[^"'`;]*?\bfrom\s*["'`]([^"'`]+)["'`]|\bimport\s*["'`]([^"'`]+)["'`]"""
_DYNAMIC = r"""\b(?:import|require)\s*\(\s*["']([^"']+)["']"""


def import_specifiers(files: DataFrame, dynamic: bool = True) -> DataFrame:
    """path, specifier of ES imports and re-exports and, with ``dynamic``, of import() and require()."""
    groups = [F.regexp_extract_all("text", F.lit(_STATIC), F.lit(i)) for i in (1, 2)]
    if dynamic:
        groups.append(F.regexp_extract_all("text", F.lit(_DYNAMIC), F.lit(1)))
    return files.select("path", F.explode(F.array_distinct(F.filter(F.concat(*groups), lambda x: x != ""))).alias("specifier"))


def is_project_specifier(specifier: Column) -> Column:
    """Relative, absolute, or below one of the two root aliases."""
    return specifier.rlike(r"\A(?:\./|\.\./|/|@/|~/)")


def module_base(path: Column, specifier: Column) -> Column:
    """Where a project specifier points, before a suffix is tried: no query or hash, no . and .. left."""
    clean = F.regexp_replace(specifier, r"[?#].*\z", "")
    below = F.when(clean.rlike(r"\A[@~]/"), F.substr(clean, F.lit(3))).when(clean.startswith("/"), F.substr(clean, F.lit(2)))
    parts = F.split(F.coalesce(below, F.concat(F.regexp_replace(path, r"[^/]*\z", ""), clean)), "/")

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x.isin(".", ""), acc).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved_imports(files: DataFrame, dynamic: bool = True) -> DataFrame:
    """path, specifier, target: project specifiers with the first candidate that is a file, null where none is.

    The candidates are exploded and met by one join on the path.
    """
    s = import_specifiers(files, dynamic).filter(is_project_specifier(F.col("specifier")))
    s = s.select("path", "specifier", module_base(F.col("path"), F.col("specifier")).alias("base"))
    tried = s.select("path", "specifier", F.posexplode(F.array(*[F.when(F.col("base") != "", F.concat("base", F.lit(x))) for x in SUFFIXES + INDEXES])).alias("pos", "target"))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("known"))
    return tried.join(known, "target", "left").groupBy("path", "specifier").agg(F.min_by("target", F.when(F.col("known"), F.col("pos"))).alias("target"))


def resolve_imports(files: DataFrame) -> DataFrame:
    """source, target: import edges between files; a file does not import itself."""
    found = resolved_imports(files).filter("target IS NOT NULL AND target <> path")
    return found.select(F.col("path").alias("source"), "target").distinct()


def unresolved_imports(files: DataFrame) -> DataFrame:
    """path, specifier: project specifiers of static imports that point to no file."""
    return resolved_imports(files, dynamic=False).filter("target IS NULL").select("path", "specifier")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href, n: links of raw pages."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", hrefs.alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))
