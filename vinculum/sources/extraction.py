"""Files to a graph: definitions, references and imports by line patterns, resolved by joins.

``files`` is (path, text).  A language pack is a row of line patterns for an extension; texts
are exploded into lines and each line meets the patterns of its own language.  Names are
resolved as joins: the file's own symbols first, then the only file that defines the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.functions.storage import store
from vinculum.model import Graph, edge_id, symbol_id
from vinculum.sources import files as tree

_ID = r"([A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:export|default|declare|abstract|async|public|private|protected|internal|static|final|sealed|open|data|pub(?:\([^)]*\))?|partial|inline|override|unsafe|extern|readonly|const)\s+)*"
#: Packs, extension -> [(kind, pattern whose first group is the name)]; patterns hold for a line.
PACKS: dict[str, list[tuple[str, str]]] = {
    "ts": [("class", rf"^{_MODS}class\s+{_ID}"), ("interface", rf"^{_MODS}interface\s+{_ID}"), ("type", rf"^{_MODS}type\s+{_ID}\b[^=]*="), ("enum", rf"^{_MODS}enum\s+{_ID}"), ("function", rf"^{_MODS}function\s*\*?\s*{_ID}"), ("variable", rf"^export\s+(?:const|let|var)\s+{_ID}")],
    "py": [("class", rf"^\s*class\s+{_ID}"), ("function", rf"^(?:async\s+)?def\s+{_ID}")],
    "go": [("struct", rf"^type\s+{_ID}\s+struct\b"), ("interface", rf"^type\s+{_ID}\s+interface\b"), ("type", rf"^type\s+{_ID}\s*="), ("function", rf"^func\s+{_ID}"), ("method", rf"^func\s*\([^)]*\)\s*{_ID}"), ("constant", rf"^const\s+{_ID}"), ("variable", rf"^var\s+{_ID}")],
    "rs": [("struct", rf"^\s*{_MODS}struct\s+{_ID}"), ("enum", rf"^\s*{_MODS}enum\s+{_ID}"), ("trait", rf"^\s*{_MODS}trait\s+{_ID}"), ("function", rf"^{_MODS}fn\s+{_ID}"), ("type", rf"^{_MODS}type\s+{_ID}"), ("union", rf"^\s*{_MODS}union\s+{_ID}"), ("module", rf"^\s*{_MODS}mod\s+{_ID}"), ("macro", rf"^\s*macro_rules!\s*{_ID}"), ("constant", rf"^{_MODS}(?:const|static)\s+{_ID}\s*:")],
    "java": [("class", rf"^\s*{_MODS}class\s+{_ID}"), ("interface", rf"^\s*{_MODS}interface\s+{_ID}"), ("enum", rf"^\s*{_MODS}enum\s+{_ID}"), ("record", rf"^\s*{_MODS}record\s+{_ID}"), ("annotation", rf"^\s*{_MODS}@interface\s+{_ID}")],
    "kt": [("class", rf"^\s*{_MODS}(?:interface|class)\s+{_ID}"), ("object", rf"^\s*{_MODS}object\s+{_ID}"), ("function", rf"^{_MODS}fun\s+(?:<[^>]*>\s*)?{_ID}"), ("property", rf"^{_MODS}va[lr]\s+{_ID}")],
    "scala": [("class", rf"^\s*(?:case\s+)?{_MODS}class\s+{_ID}"), ("object", rf"^\s*(?:case\s+)?object\s+{_ID}"), ("trait", rf"^\s*{_MODS}trait\s+{_ID}"), ("function", rf"^\s*{_MODS}def\s+{_ID}"), ("type", rf"^\s*type\s+{_ID}")],
    "cs": [("class", rf"^\s*{_MODS}class\s+{_ID}"), ("interface", rf"^\s*{_MODS}interface\s+{_ID}"), ("struct", rf"^\s*{_MODS}struct\s+{_ID}"), ("enum", rf"^\s*{_MODS}enum\s+{_ID}"), ("record", rf"^\s*{_MODS}record\s+{_ID}"), ("namespace", r"^\s*namespace\s+([\w.]+)")],
    "c": [("struct", rf"^\s*(?:typedef\s+)?struct\s+{_ID}\s*\{{?"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+{_ID}"), ("union", rf"^\s*(?:typedef\s+)?union\s+{_ID}"), ("type", rf"^typedef\s+[^;{{]*?\b{_ID};"), ("function", rf"^[A-Za-z_][\w\s*]*?\b{_ID}\s*\([^;]*\)\s*\{{?\s*$")],
    "cpp": [("class", rf"^\s*class\s+{_ID}"), ("struct", rf"^\s*struct\s+{_ID}"), ("enum", rf"^\s*enum\s+(?:class\s+)?{_ID}"), ("union", rf"^\s*union\s+{_ID}"), ("namespace", rf"^\s*namespace\s+{_ID}"), ("type", rf"^\s*using\s+{_ID}\s*="), ("function", rf"^[A-Za-z_][\w\s*&:<>,]*?\b{_ID}\s*\([^;]*\)\s*\{{?\s*$")],
    "m": [("class", rf"^@interface\s+{_ID}"), ("protocol", rf"^@protocol\s+{_ID}")],
    "swift": [("class", rf"^\s*{_MODS}class\s+{_ID}"), ("struct", rf"^\s*{_MODS}struct\s+{_ID}"), ("enum", rf"^\s*{_MODS}enum\s+{_ID}"), ("protocol", rf"^\s*{_MODS}protocol\s+{_ID}"), ("function", rf"^{_MODS}func\s+{_ID}")],
    "zig": [("struct", rf"^\s*(?:pub\s+)?const\s+{_ID}\s*=\s*struct\b"), ("enum", rf"^\s*(?:pub\s+)?const\s+{_ID}\s*=\s*enum\b"), ("function", rf"^\s*(?:pub\s+)?fn\s+{_ID}")],
    "hs": [("type", rf"^(?:data|newtype|type)\s+{_ID}"), ("interface", rf"^class\s+(?:.*=>\s*)?{_ID}"), ("function", rf"^{_ID}\s*::")],
    "rb": [("class", rf"^\s*class\s+{_ID}"), ("module", rf"^\s*module\s+{_ID}"), ("method", rf"^\s*def\s+(?:self\.)?{_ID}")],
    "php": [("class", rf"^\s*{_MODS}class\s+{_ID}"), ("interface", rf"^\s*interface\s+{_ID}"), ("trait", rf"^\s*trait\s+{_ID}"), ("enum", rf"^\s*enum\s+{_ID}"), ("namespace", r"^\s*namespace\s+([\w\\]+)"), ("function", rf"^function\s+{_ID}"), ("method", rf"^\s+{_MODS}function\s+{_ID}")],
    "sh": [("function", rf"^\s*(?:function\s+)?{_ID}\s*\(\)")],
    "lua": [("function", rf"^\s*(?:local\s+)?function\s+(?:\w+[.:])*{_ID}")],
    "dart": [("class", rf"^\s*{_MODS}(?:mixin|class)\s+{_ID}"), ("enum", rf"^\s*enum\s+{_ID}"), ("function", rf"^[A-Za-z_][\w<>?]*\s+{_ID}\s*\([^;]*\)\s*(?:async\s*)?[{{=]")],
    "jl": [("module", rf"^\s*module\s+{_ID}"), ("struct", rf"^\s*(?:mutable\s+)?struct\s+{_ID}"), ("function", rf"^\s*function\s+{_ID}")],
    "ml": [("module", rf"^\s*module\s+{_ID}"), ("type", rf"^\s*type\s+(?:'\w+\s+)?{_ID}")],
    "fs": [("module", rf"^\s*module\s+{_ID}"), ("type", rf"^\s*type\s+{_ID}"), ("function", rf"^\s*let\s+(?:rec\s+)?{_ID}\s+\w")],
    "nix": [("property", r"^\s*([A-Za-z_][\w'-]*)\s*=")],
    "r": [("function", r"^\s*([A-Za-z_.][\w.]*)\s*(?:<-|=)\s*function\b")],
    "sql": [("struct", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?(\w+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?function\s+(\w+)"), ("type", r"(?i)^\s*create\s+type\s+(\w+)")],
    "json": [("property", r"""^  "([^"]+)"\s*:""")],
    "wat": [("function", r"\(func\s+\$(\w+)"), ("type", r"\(type\s+\$(\w+)"), ("variable", r"\(global\s+\$(\w+)")],
}
#: Extensions that share a pack.
ALIASES = {"tsx": "ts", "js": "ts", "jsx": "ts", "mts": "ts", "cts": "ts", "mjs": "ts", "cjs": "ts", "vue": "ts", "svelte": "ts", "kts": "kt", "sc": "scala", "fsx": "fs", "h": "c", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "mm": "m", "bash": "sh", "jsonc": "json"}
#: Kinds that a nested definition keeps; others are symbols at the top level alone.
FREE = ("function", "variable", "constant")
#: Words that look like calls.
_NOT_CALLS = ("if", "for", "while", "switch", "return", "catch", "function", "def", "fn", "func", "class", "new", "match", "with", "and", "or", "not", "in", "super", "import", "require", "constructor", "typeof", "await", "elif", "until", "print", "type", "struct")
_REFERENCES = {
    "extends": rf"\b(?:extends|class\s+\w+\s*[:<(])\s*{_ID}", "implements": rf"\bimplements\s+{_ID}", "instantiates": rf"\bnew\s+{_ID}",
    "call": rf"(?<!new )(?<![\w$]){_ID}\s*\(",
}


def language_of(path: Column) -> Column:
    """The pack of a path's extension, null for none."""
    pairs = F.create_map(*[F.lit(x) for kv in ({k: k for k in PACKS} | ALIASES).items() for x in kv])
    return F.try_element_at(pairs, paths.extension(path))


def script_of(path: Column, text: Column) -> Column:
    """Of a component file only its <script> blocks, line breaks between them."""
    blocks = F.array_join(F.regexp_extract_all(text, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    return F.when(path.rlike(r"\.(?:vue|svelte)\z"), blocks).otherwise(text)


def lines(files: DataFrame) -> DataFrame:
    """path, pack, line (from 1), code."""
    own = files.select("path", language_of(F.col("path")).alias("pack"), script_of(F.col("path"), F.col("text")).alias("text")).filter("pack IS NOT NULL")
    return own.select("path", "pack", F.posexplode(F.split("text", r"\r?\n")).alias("at", "code")).select("path", "pack", (F.col("at") + 1).alias("line"), "code")


def definitions(code: DataFrame) -> DataFrame:
    """path, line, kind, name of each definition in :func:`lines`; of equal names in a file the first."""
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for pack, patterns in PACKS.items():
        here = F.lit(None).cast("struct<kind:string,name:string>")
        for kind, pattern in reversed(patterns):
            here = F.when(F.col("code").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("code", pattern, 1).alias("name"))).otherwise(here)
        found = F.when(F.col("pack") == pack, here).otherwise(found)
    every = code.withColumn("d", found).filter("d.name <> ''").select("path", "line", "d.kind", "d.name")
    first = every.groupBy("path", "name").agg(F.min(F.struct("line", "kind")).alias("x"))
    return first.select("path", "x.line", "x.kind", "name")


def references(code: DataFrame, defined: DataFrame) -> DataFrame:
    """path, line, relation, name of calls, instantiations and supertypes; a definition's own name is none."""
    def of_kind(relation: str, pattern: str) -> Column:
        names = F.array_distinct(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)))
        return F.transform(names, lambda n: F.struct(F.lit(relation).alias("relation"), n.alias("name")))

    each = F.flatten(F.array(*[of_kind(k, p) for k, p in _REFERENCES.items()]))
    plain = code.filter(~F.col("code").rlike(r"^\s*(?:import|from|use|package|#include|//|#|\*)\b"))
    found = plain.select("path", "line", F.explode(each).alias("r")).select("path", "line", "r.relation", "r.name").filter(~F.col("name").isin(*_NOT_CALLS))
    return found.join(defined.select("path", "line", "name"), ["path", "line", "name"], "left_anti").distinct()


def unique_definers(defined: DataFrame) -> DataFrame:
    """pack, name, file: names that one file of a language alone defines."""
    own = defined.withColumn("pack", language_of(F.col("path")))
    return own.groupBy("pack", "name").agg(F.min("path").alias("file"), F.max("path").alias("last")).filter("file = last").select("pack", "name", "file")


def python_modules(files: DataFrame) -> DataFrame:
    """path, module, name, target of Python imports that are files: ``a/b.py`` before ``a/b/__init__.py``; leading dots climb."""
    code = lines(files.filter(F.lower("path").endswith(".py")))
    from_, plain = r"^\s*from\s+([.\w]+)\s+import\s+(.+?)\s*$", r"^\s*import\s+([\w.]+)(?:\s+as\s+\w+)?\s*$"
    named = F.transform(F.split(F.regexp_replace(F.regexp_extract("code", from_, 2), r"[()]", ""), r"\s*,\s*"), lambda n: F.regexp_extract(n, r"(\w+|\*)\s*\z", 1))
    rows = code.filter(F.col("code").rlike(from_)).select("path", F.regexp_extract("code", from_, 1).alias("module"), F.explode(named).alias("name"))
    rows = rows.union(code.filter(F.col("code").rlike(plain)).select("path", F.regexp_extract("code", plain, 1), F.lit(None).cast("string"))).distinct()
    dots = F.length(F.regexp_extract("module", r"\A\.*", 0))
    here = F.filter(F.split(paths.dir_of(F.col("path")), "/"), lambda x: x != "")
    up = F.slice(here, F.lit(1), F.greatest(F.size(here) - dots + 1, F.lit(0)))
    rest = F.filter(F.split("module", r"\."), lambda x: x != "")
    base = F.array_join(F.concat(F.when(dots > 0, up).otherwise(F.array().cast("array<string>")), rest), "/")
    tried = rows.select("path", "module", "name", F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("pos", "target"))
    found = tried.join(files.select(F.col("path").alias("target")), "target")
    return found.groupBy("path", "module", "name").agg(F.min_by("target", "pos").alias("target"))


def named_imports(files: DataFrame, definers: DataFrame) -> DataFrame:
    """path, target: imports by name (Java, Kotlin, Scala, Rust): the only file that defines the last segment."""
    code = lines(files).filter(F.col("pack").isin("java", "kt", "scala", "rs"))
    module = F.regexp_extract("code", r"^\s*(?:import|use)\s+(?:static\s+)?([\w.:]+)", 1)
    last = F.try_element_at(F.filter(F.split(module, r"[.:/]"), lambda x: x != ""), F.lit(-1))
    rows = code.filter(module != "").select("path", "pack", last.alias("name")).distinct()
    return rows.join(definers, ["pack", "name"]).select("path", F.col("file").alias("target")).filter("path <> target")


def analyze(files: DataFrame) -> Graph:
    """Nodes of files and symbols; edges of imports (count 1) and of references, with their number.

    A reference stands in the last symbol that begins at or above its line, else in the file.
    Edges to the source itself and to what is unknown are left out.
    """
    files = files.filter(language_of(F.col("path")).isNotNull())
    code = store(lines(files))
    defined = store(definitions(code))
    definers = unique_definers(defined)
    base = F.substring_index("path", "/", -1)
    none = F.lit("feature")
    nodes = files.select(F.col("path").alias("id"), F.lit("file").alias("kind"), base.alias("label"), F.col("path").alias("filePath"), F.lit(0).alias("line"), F.col("path").alias("parentFile"), none.alias("category"))
    symbols = defined.select(symbol_id(F.col("path"), F.col("name")).alias("id"), "kind", F.col("name").alias("label"), F.col("path").alias("filePath"), "line", F.col("path").alias("parentFile"), none.alias("category"))
    links = tree.resolve_imports(files).toDF("path", "target").union(python_modules(files).select("path", "target")).union(named_imports(files, definers))
    imports = links.distinct().select(F.col("path").alias("source"), "target", F.lit("import").alias("kind"), F.lit(1).cast("long").alias("count"))

    refs = references(code, defined).withColumnRenamed("name", "used")
    starts = defined.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("starts"))
    refs = refs.join(starts, "path", "left")
    holder = F.try_element_at(F.filter("starts", lambda s: s["line"] <= F.col("line")), F.lit(-1))["name"]
    refs = refs.select("path", "relation", "used", F.when(F.size(F.filter("starts", lambda s: s["line"] <= F.col("line"))) > 0, symbol_id(F.col("path"), holder)).otherwise(F.col("path")).alias("source"))
    own = defined.select("path", F.col("name").alias("used"), F.lit(True).alias("local"))
    refs = refs.withColumn("pack", language_of(F.col("path")))
    refs = refs.join(own, ["path", "used"], "left").join(definers.toDF("pack", "used", "file"), ["pack", "used"], "left")
    target = F.when(F.col("local"), symbol_id(F.col("path"), F.col("used"))).when(F.col("file").isNotNull(), symbol_id(F.col("file"), F.col("used")))
    found = refs.select("source", target.alias("target"), F.col("relation").alias("kind")).filter("target IS NOT NULL AND target <> source")
    found = found.groupBy("source", "target", "kind").agg(F.count("*").alias("count"))
    edges = imports.union(found)
    return Graph(store(nodes.union(symbols)), store(edges.select(edge_id(F.col("source"), F.col("target"), F.col("kind")).alias("id"), "source", "target", "kind", "count")))


# --- externals, facets and roles -------------------------------------------------------------

#: Built-in modules of one runtime, and globals that tell a runtime.
NODE_BUILTINS = ("assert", "async_hooks", "buffer", "child_process", "cluster", "crypto", "dgram", "dns", "events", "fs", "http", "http2", "https", "module", "net", "os", "path", "perf_hooks", "process", "querystring", "readline", "stream", "tls", "url", "util", "vm", "worker_threads", "zlib")
RUNTIME_GLOBALS = {"Bun": "bun", "Deno": "deno", "process": "node", "Buffer": "node", "__dirname": "node", "__filename": "node", "require": "node"}
#: Roles by decorator, by factory and by framework import.
DECORATORS = {"Component": "angular-component", "Directive": "angular-directive", "Pipe": "angular-pipe", "Injectable": "angular-service", "NgModule": "angular-module", "component": "ecs-component", "system": "ecs-system", "entity": "ecs-entity"}


def module_kind(specifier: Column) -> Column:
    """npm, node, deno or bun."""
    out = F.when((specifier == "bun") | specifier.startswith("bun:"), "bun").when(specifier.startswith("node:") | specifier.isin(*NODE_BUILTINS), "node")
    return out.when(specifier.rlike(r"\A(?:https://|jsr:|deno:)"), "deno").otherwise("npm")


def package_name(specifier: Column) -> Column:
    """Two segments of a scoped specifier, else one."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def external_imports(files: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """path, id, label, externalKind, version, dependencyType of bare specifiers; npm packages not in ``deps`` (name, version, type) are undeclared."""
    s = tree.import_specifiers(files, dynamic=False).filter(~F.col("specifier").rlike(r"\A[./]"))
    s = s.filter(~tree.is_project_specifier(F.col("specifier")))
    s = s.select("path", module_kind(F.col("specifier")).alias("externalKind"), "specifier")
    label = F.when(F.col("externalKind") == "npm", package_name(F.col("specifier"))).otherwise(F.col("specifier"))
    s = s.select("path", F.concat(F.lit("external:module:"), label).alias("id"), label.alias("label"), "externalKind").distinct()
    if deps is None:
        return s.select("*", F.lit(None).cast("string").alias("version"), F.when(F.col("externalKind") == "npm", "undeclared").alias("dependencyType"))
    known = s.join(deps.toDF("label", "v", "t"), "label", "left")
    is_npm = F.col("externalKind") == "npm"
    return known.select("path", "id", "label", "externalKind", F.when(is_npm, F.col("v")).alias("version"), F.when(is_npm, F.coalesce("t", F.lit("undeclared"))).alias("dependencyType"))


def facets(files: DataFrame) -> DataFrame:
    """path, environment (a leading directive), runtimes (in order), has_jsx."""
    directive = F.nullif(F.regexp_extract("text", r"""\A(?:\s*(?:"[^"]*"|'[^']*')\s*;?)*?\s*["']use (client|server)["']""", 1), F.lit(""))
    modules = tree.import_specifiers(files, dynamic=False).select("path", module_kind(F.col("specifier")).alias("r")).filter("r IN ('node', 'bun')")
    modules = modules.groupBy("path").agg(F.collect_set("r").alias("used"))
    code = F.regexp_replace("text", r"""(?s)//[^\n]*|/\*.*?\*/|"[^"\n]*"|'[^'\n]*'""", " ")
    names = F.regexp_extract_all(code, F.lit(r"(?<![.\w$])(" + "|".join(RUNTIME_GLOBALS) + r")\b(?!\s*\??:)"), F.lit(1))
    by = F.create_map(*[F.lit(x) for kv in RUNTIME_GLOBALS.items() for x in kv])
    out = files.select("path", directive.alias("environment"), F.transform(names, lambda n: by[n]).alias("globals"), F.col("text").rlike(r"<[A-Z]\w*[\s/>]|</[a-z]|<>").alias("has_jsx"))
    none = F.array().cast("array<string>")
    return out.join(modules, "path", "left").select("path", "environment", F.array_sort(F.array_distinct(F.concat("globals", F.coalesce("used", none)))).alias("runtimes"), "has_jsx")


def frameworks(files: DataFrame) -> DataFrame:
    """path, framework: by extension, then by the first import that tells one; null for none."""
    s = F.regexp_extract_all("text", F.lit(r"""\bimport\b[^"'`;]*?["']([^"']+)["']"""), F.lit(1))

    def of(spec: Column) -> Column:
        out = F.when(spec.rlike(r"\A@angular/"), "angular").when(spec.rlike(r"\A(?:vue|vue-router|@vue/.*)\z"), "vue").when(spec.rlike(r"\Asvelte(?:/.*)?\z"), "svelte")
        return out.when(spec.isin("bitecs", "becsy", "ape-ecs"), "ecs").when(spec.isin("react", "react-dom"), "react")

    first = F.get(F.filter(F.transform(s, of), lambda x: x.isNotNull()), F.lit(0))
    ext = paths.extension(F.col("path"))
    return files.select("path", F.when(ext == "vue", "vue").when(ext == "svelte", "svelte").otherwise(first).alias("framework"))


def name_role(name: Column, framework: Column) -> Column:
    """System, Entity and Component suffixes of capitalised names; a framework claims its components."""
    component = F.when(framework == "angular", "angular-component").when(framework == "vue", "vue-component").otherwise("ecs-component")
    return F.when(name.rlike(r"\A[A-Z].+System\z"), "ecs-system").when(name.rlike(r"\A[A-Z].+Entity\z"), "ecs-entity").when(name.rlike(r"\A[A-Z].+Component\z"), component)


def roles(files: DataFrame, defined: DataFrame) -> DataFrame:
    """path, name, role of definitions: the decorator on the line before, else the name."""
    code = lines(files).select("path", (F.col("line") + 1).alias("line"), F.regexp_extract("code", r"^\s*@(\w+)", 1).alias("decorator"))
    by = F.create_map(*[F.lit(x) for kv in DECORATORS.items() for x in kv])
    out = defined.join(code, ["path", "line"], "left").join(frameworks(files), "path", "left")
    told = F.coalesce(F.try_element_at(by, F.col("decorator")), F.try_element_at(by, F.lower("decorator")))
    return out.select("path", "name", F.coalesce(told, name_role(F.col("name"), F.col("framework"))).alias("role")).filter("role IS NOT NULL")
