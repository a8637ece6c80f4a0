"""Package manifests of six ecosystems, as columns over files (path, text); no Python on the executors.

Each parser gives a row per manifest: id, name, ecosystem, dir, manifestPath, is_root and
declared, an array of (name, version, type).  TOML is read leniently, line by line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions import paths

_DEPS = "array<struct<name:string,version:string,type:string>>"
_NPM = {"dependencies": "dependency", "devDependencies": "devDependency", "peerDependencies": "peerDependency", "optionalDependencies": "optionalDependency"}
_CARGO = {"dependencies": "dependency", "dev-dependencies": "devDependency", "build-dependencies": "dependency"}


def _none() -> Column:
    return F.array().cast(_DEPS)


def _dep(name: Column, version: Column, kind: str) -> Column:
    return F.struct(name.alias("name"), version.cast("string").alias("version"), F.lit(kind).alias("type"))


def _of_entry(kind: str):
    return lambda e: _dep(e["key"], e["value"], kind)


def _cargo_section(section: str, kind: str) -> list[Column]:
    """A section's inline entries, those below a target, and its own tables."""

    def version(e: Column) -> Column:
        return F.coalesce(_text(e["value"]), F.nullif(F.regexp_extract(e["value"], r"""\bversion\s*=\s*["']([^"']*)["']""", 1), F.lit("")))

    def of_table(name: Column) -> Column:
        own = F.filter("toml", lambda e: (e["section"] == F.concat(F.lit(f"{section}."), name)) & (e["key"] == "version"))
        return _dep(name, _text(F.get(own, F.lit(0))["value"]), kind)

    inline = F.filter("toml", lambda e: (e["section"] == section) | e["section"].rlike(r"\Atarget\..+\." + section + r"\z"))
    tables = F.regexp_extract_all("text", F.lit(r"""(?m)^\s*\[""" + section + r"""\.["']?([A-Za-z0-9_-]+)"""), F.lit(1))
    return [F.transform(inline, lambda e: _dep(e["key"], version(e), kind)), F.transform(tables, of_table)]


def _named(files: DataFrame, base: str) -> DataFrame:
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    own = files.select(path.alias("manifestPath"), "text").withColumn("dir", paths.dir_of(F.col("manifestPath")))
    own = own.withColumn("last", F.when(F.col("dir") == "", "root").otherwise(F.substring_index("dir", "/", -1)))
    return own.filter(F.substring_index("manifestPath", "/", -1).rlike(base))


def _row(df: DataFrame, ecosystem: str, name: Column, is_root: Column, declared: Column) -> DataFrame:
    known = F.coalesce(F.when(name != "", name), F.col("last"))
    return df.select(
        F.concat(F.lit(f"{ecosystem}:"), known).alias("id"), known.alias("name"), F.lit(ecosystem).alias("ecosystem"), "dir", "manifestPath",
        is_root.alias("is_root"), F.coalesce(declared.cast(_DEPS), _none()).alias("declared"),
    )


def npm(files: DataFrame) -> DataFrame:
    """Four sections in order; ``workspaces`` makes a workspace root; text that is no JSON object gives no row."""
    df = _named(files, r"\Apackage\.json\z").filter(F.get_json_object("text", "$").startswith("{"))
    parts = []
    for section, kind in _NPM.items():
        held = F.from_json(F.get_json_object("text", f"$.{section}"), "map<string,string>")
        parts.append(F.coalesce(F.transform(F.map_entries(held), _of_entry(kind)), _none()))
    return _row(df, "npm", F.get_json_object("text", "$.name"), F.get_json_object("text", "$.workspaces").isNotNull(), F.concat(*parts))


def toml_entries(text: Column) -> Column:
    """(section, key, value) of each ``key = value`` line; comments and what is neither header nor entry are skipped."""
    lines = F.split(text, r"\r?\n")
    head, entry = r"\A\s*\[+\s*([^\]]+?)\s*\]+\s*(?:#.*)?\z", r"""\A\s*["']?([A-Za-z0-9_.-]+?)["']?\s*=\s*(.+?)\s*\z"""
    kind = "array<struct<section:string,key:string,value:string>>"

    def step(acc: Column, line: Column) -> Column:
        own = F.struct(acc["at"].alias("section"), F.regexp_extract(line, entry, 1).alias("key"), F.regexp_extract(line, entry, 2).alias("value"))
        told = F.when(line.rlike(entry) & ~line.rlike(head), F.concat(acc["out"], F.array(own))).otherwise(acc["out"])
        return F.struct(F.when(line.rlike(head), F.regexp_replace(F.regexp_extract(line, head, 1), "[\"']", "")).otherwise(acc["at"]).alias("at"), told.alias("out"))

    return F.aggregate(lines, F.struct(F.lit("").alias("at"), F.array().cast(kind).alias("out")), step)["out"]


def _text(value: Column) -> Column:
    """A TOML string's content, null for other values."""
    return F.nullif(F.regexp_extract(value, r"""\A["']([^"']*)["']""", 1), F.lit(""))


def _first(section: str, key: str) -> Column:
    return _text(F.get(F.filter("toml", lambda e: (e["section"] == section) & (e["key"] == key)), F.lit(0))["value"])


def cargo(files: DataFrame) -> DataFrame:
    """Dependencies, dev and build ones, also below ``target.<cfg>``; a [workspace] makes a root; without it a [package] is needed."""
    df = _named(files, r"\ACargo\.toml\z").withColumn("toml", toml_entries(F.col("text")))
    is_root = F.col("text").rlike(r"(?m)^\s*\[workspace[\].]")
    parts = []
    for section, kind in _CARGO.items():
        parts += _cargo_section(section, kind)
    return _row(df.filter(is_root | F.col("text").rlike(r"(?m)^\s*\[package\]")), "cargo", _first("package", "name"), is_root, F.concat(*parts))


def go(files: DataFrame) -> DataFrame:
    """The module line, require blocks and single requires; comments go first."""
    df = _named(files, r"\Ago\.mod\z").withColumn("text", F.regexp_replace("text", r"(?m)//.*$", ""))
    blocks = F.array_join(F.regexp_extract_all("text", F.lit(r"(?ms)^\s*require \(\s*$(.*?)^\s*\)\s*$"), F.lit(1)), "\n")
    line = r"(?m)^\s*(\S+)\s+(\S+)"
    both = lambda text, pattern: F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda n, v: _dep(n, v, "dependency"))
    singles = both(F.col("text"), r"(?m)^\s*require\s+([^\s(]\S*)\s+(\S+)")
    return _row(df, "go", F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1), F.lit(False), F.concat(both(blocks, line), singles))


def python(files: DataFrame) -> DataFrame:
    """PEP 621 dependencies by their names, then poetry's (python itself left out)."""
    df = _named(files, r"\Apyproject\.toml\z").withColumn("toml", toml_entries(F.col("text")))
    listed = F.regexp_extract("text", r"(?ms)^\[project\][^\[]*?^\s*dependencies\s*=\s*\[(.*?)^?\s*\]\s*$", 1)
    names = F.filter(F.transform(F.regexp_extract_all(listed, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), lambda r: F.regexp_extract(F.trim(r), r"\A[A-Za-z0-9._-]+", 0)), lambda n: n != "")
    poetry = F.filter("toml", lambda e: (e["section"] == "tool.poetry.dependencies") & (F.lower(e["key"]) != "python"))
    declared = F.concat(F.transform(names, lambda n: _dep(n, F.lit(None), "dependency")), F.transform(poetry, lambda e: _dep(e["key"], F.lit(None), "dependency")))
    return _row(df, "python", F.coalesce(_first("project", "name"), _first("tool.poetry", "name")), F.lit(False), declared)


def maven(files: DataFrame) -> DataFrame:
    """The artifact outside <parent>; the first <dependencies> block."""
    df = _named(files, r"\Apom\.xml\z")
    tag = lambda xml, name: F.nullif(F.trim(F.regexp_extract(xml, f"<{name}>([^<]+)</{name}>", 1)), F.lit(""))
    block = F.regexp_extract("text", r"(?s)<dependencies>(.*?)</dependencies>", 1)
    each = F.regexp_extract_all(block, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    declared = F.transform(F.filter(each, lambda x: tag(x, "artifactId").isNotNull()), lambda x: _dep(tag(x, "artifactId"), tag(x, "version"), "dependency"))
    return _row(df, "maven", tag(F.regexp_replace("text", r"(?s)<parent>.*?</parent>", ""), "artifactId"), F.lit(False), declared)


def gradle(files: DataFrame) -> DataFrame:
    """The root project's name; always a workspace root."""
    df = _named(files, r"\Asettings\.gradle(\.kts)?\z")
    return _row(df, "gradle", F.regexp_extract("text", r"""rootProject\.name\s*=\s*['"]([^'"]+)['"]""", 1), F.lit(True), _none())


#: The registry: one more ecosystem is one more function from files to manifests.
PROVIDERS = [npm, cargo, go, python, maven, gradle]


def discover(files: DataFrame, providers=None) -> DataFrame:
    """All manifests with ``workspace``: the name of the deepest other root whose directory encloses theirs, else their own if they are roots.

    A manifest's directories are exploded and meet the roots' by equality.
    """
    found = reduce(DataFrame.unionByName, [p(files) for p in providers or PROVIDERS])
    above = F.concat(F.array(F.lit("")), paths.dir_prefixes(F.concat("dir", F.lit("/x"))))
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(above)
    roots = found.filter("is_root").select(F.col("dir").alias("at"), F.col("name").alias("root"), F.col("manifestPath").alias("root_path"))
    near = found.select("manifestPath", "dir", F.explode(above).alias("at")).join(roots, "at")
    # the root folder encloses others but not its own manifests
    near = near.filter("root_path <> manifestPath AND (at <> '' OR dir <> '')")
    best = near.groupBy("manifestPath").agg(F.max_by("root", F.struct(F.length("at"), "root_path")).alias("deepest"))
    out = found.join(best, "manifestPath", "left")
    return out.withColumn("workspace", F.coalesce("deepest", F.when(F.col("is_root"), F.col("name")))).drop("deepest")


def package_deps(files: DataFrame) -> DataFrame:
    """name, version, type of the root package.json; a later section overwrites."""
    own = npm(files.filter("path = 'package.json'")).select(F.posexplode("declared").alias("pos", "d"))
    last = own.groupBy(F.col("d.name").alias("name")).agg(F.max_by("d", "pos").alias("d"))
    return last.select("name", "d.version", "d.type")
