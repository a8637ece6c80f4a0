import subprocess

import pytest
from pyspark.sql import functions as F

from vinculum import __main__ as cli
from vinculum.model import Graph
from vinculum.operators import analysis, scene, traversal, views
from vinculum.plans import config
from vinculum.sources import exports, extraction, files, manifests, revisions
from vinculum.streaming import telemetry


def tree(spark, **texts):
    return spark.createDataFrame(list(texts.items()) or None, "path string, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def small(spark, edges):
    ids = sorted({x for e in edges for x in e})
    n = spark.createDataFrame([(i, "file", i, i, 0, i) for i in ids], "id string, kind string, label string, filePath string, line int, parentFile string")
    e = spark.createDataFrame([(f"{a}->{b}:import", a, b, "import", 1) for a, b in edges], "id string, source string, target string, kind string, count long")
    return Graph(n, e)


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("g", "a"), ("h", "h"), ("x", "y")]


def test_one_task_and_rounds_agree(spark, monkeypatch):
    g = small(spark, EDGES)
    start = spark.createDataFrame([("a",), ("x",)], "id string")

    def answers():
        return (
            rows(traversal.scc(g)), rows(traversal.longest_chain(g)), rows(traversal.reach(g, start), "id", "depth"),
            rows(traversal.reach(g, start, False, 1), "id"), rows(traversal.reached_by_each(g, g.nodes)),
        )

    local = answers()
    monkeypatch.setattr(traversal, "LOCAL", -1)
    assert answers() == local
    assert local[0][:3] == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3)] and ("h", "h", 1) in local[0]


def test_import_resolution(spark):
    f = tree(spark, **{
        "src/a.ts": 'import x from "./b";\nimport "@/lib/c?raw";\nexport * from `../other`;\nimport y from "react";\nconst z = require("./gone")\nimport("./d.json")',
        "src/b.tsx": 'import "./b"; import "./missing"', "lib/c.mts": "", "other/index.cjs": "", "src/d.json": "{}",
    })
    assert rows(files.resolve_imports(f)) == [("src/a.ts", "lib/c.mts"), ("src/a.ts", "other/index.cjs"), ("src/a.ts", "src/b.tsx"), ("src/a.ts", "src/d.json")]
    assert rows(files.unresolved_imports(f)) == [("src/b.tsx", "./missing")]


def test_source_paths(spark):
    names = ["a.ts", "A.PY", "x/node_modules/a.ts", "dist/a.ts", "adist/a.ts", "a.txt", "w\\Pods\\a.m", ".idea/x.json", "pods/a.m"]
    f = spark.createDataFrame([(x,) for x in names], "path string").filter(files.is_source_path(F.col("path")))
    assert [r[0] for r in rows(f)] == ["A.PY", "a.ts", "adist/a.ts", "pods/a.m"]


def test_python_modules_and_definers(spark):
    f = tree(spark, **{"pkg/a.py": "from .b import f, g as h\nfrom ..top import *\nimport pkg.c\nclass A(Base):\n    def m(self):\n        f()\n", "pkg/b.py": "def f():\n    pass\ndef g(): pass\n",
                       "pkg/c/__init__.py": "class Base: pass\n", "top.py": "", "x/A.java": "import y.B;\nclass A extends B { }", "y/B.java": "public class B { }"})
    assert rows(extraction.python_modules(f).filter("name IS NOT NULL")) == [("pkg/a.py", "..top", "*", "top.py"), ("pkg/a.py", ".b", "f", "pkg/b.py"), ("pkg/a.py", ".b", "h", "pkg/b.py")]
    g = extraction.analyze(f)
    found = rows(g.edges, "source", "target", "kind")
    assert {("pkg/a.py", "pkg/b.py", "import"), ("pkg/a.py", "pkg/c/__init__.py", "import"), ("x/A.java", "y/B.java", "import"), ("x/A.java#A", "y/B.java#B", "extends"),
            ("pkg/a.py#A", "pkg/c/__init__.py#Base", "extends"), ("pkg/a.py#A", "pkg/b.py#f", "call")} <= set(found)
    assert ("pkg/a.py#m",) not in rows(g.nodes, "id") and extraction.analyze(f.limit(0)).nodes.count() == 0


@pytest.mark.parametrize(("path", "code", "kind", "name"), [
    ("a.rs", "pub(crate) fn run() {", "function", "run"), ("a.rs", "macro_rules! m {", "macro", "m"), ("a.go", "func (s *S) Do() {", "method", "Do"), ("a.kt", "data class P(val x: Int)", "class", "P"),
    ("a.cs", "public interface I {", "interface", "I"), ("a.h", "struct s {", "struct", "s"), ("a.cpp", "namespace n {", "namespace", "n"), ("a.rb", "  def self.go", "method", "go"), ("a.php", "trait T {", "trait", "T"),
    ("a.swift", "protocol Q {", "protocol", "Q"), ("a.lua", "local function f()", "function", "f"), ("a.jl", "mutable struct W", "struct", "W"), ("a.sql", "CREATE TABLE t (", "struct", "t"), ("a.sh", "go() {", "function", "go"),
    ("a.hs", "data D = X", "type", "D"), ("a.zig", "pub fn main() void {", "function", "main"), ("a.wat", "(func $f", "function", "f"), ("a.r", "f <- function(x)", "function", "f"), ("a.ml", "module M = struct", "module", "M"),
    ("a.vue", "<script>\nexport class V {\n</script>", "class", "V"), ("a.dart", "class K {", "class", "K"), ("a.scala", "object O {", "object", "O"), ("a.fs", "type U = A", "type", "U"), ("a.nix", "  p = 1;", "property", "p"), ("a.m", "@protocol R", "protocol", "R"),
])
def test_packs(spark, path, code, kind, name):
    assert (kind, name) in rows(extraction.definitions(extraction.lines(tree(spark, **{path: code}))), "kind", "name")


def test_manifests_edge_cases(spark):
    f = tree(spark, **{
        "package.json": '{"workspaces": [], "dependencies": {"a": "1"}}', "bad/package.json": "{nope", "w/Cargo.toml": "[workspace]\nmembers = []\n",
        "w/x/Cargo.toml": "[package]\nname = 'x' # c\n[dependencies]\na = \"1\"\n[dependencies.b]\nversion = \"2\"\n[target.'cfg(unix)'.dev-dependencies]\nc = { path = \"..\", version = '3' }\n",
        "n/Cargo.toml": "# nothing\n", "g/go.mod": "module ex.org/g\nrequire a.b/c v1\nrequire (\n  d.e/f v2 // indirect\n)\n",
        "p/pyproject.toml": "[tool.poetry]\nname = \"p\"\n[tool.poetry.dependencies]\npython = \"^3\"\nreq = \"*\"\n", "s/settings.gradle.kts": "// none",
    })
    out = {r["manifestPath"]: r for r in manifests.discover(f).collect()}
    deps = lambda p: [(d["name"], d["version"], d["type"]) for d in out[p]["declared"]]
    assert set(out) == {"package.json", "w/Cargo.toml", "w/x/Cargo.toml", "g/go.mod", "p/pyproject.toml", "s/settings.gradle.kts"}
    assert out["package.json"]["name"] == "root" and out["package.json"]["workspace"] == "root"
    assert sorted(deps("w/x/Cargo.toml")) == [("a", "1", "dependency"), ("b", "2", "dependency"), ("c", "3", "devDependency")]
    assert out["w/x/Cargo.toml"]["workspace"] == "w" and out["w/Cargo.toml"]["workspace"] == "root" and out["s/settings.gradle.kts"]["name"] == "s"
    assert sorted(deps("g/go.mod")) == [("a.b/c", "v1", "dependency"), ("d.e/f", "v2", "dependency")] and deps("p/pyproject.toml") == [("req", None, "dependency")]
    assert manifests.discover(f.limit(0)).count() == 0


def test_facets_and_roles(spark):
    f = tree(spark, **{"a.tsx": "'use strict'\n'use client'\nconst x = <Foo a={1} />; Bun.serve()", "b.ts": 'import "fs";\nconst o = { process: 1 }; o.Deno', "c.ts": "import {Component} from '@angular/core'\n@Component()\nexport class XView {}\nexport class YyComponent {}"})
    assert rows(extraction.facets(f)) == [("a.tsx", "client", ["bun"], True), ("b.ts", None, ["node"], False), ("c.ts", None, [], False)]
    assert rows(extraction.roles(f, extraction.definitions(extraction.lines(f)))) == [("c.ts", "XView", "angular-component"), ("c.ts", "YyComponent", "angular-component")]
    assert rows(extraction.frameworks(f)) == [("a.tsx", None), ("b.ts", None), ("c.ts", "angular")]


@pytest.mark.parametrize("doc", [{"x": 1}, {"rules": 3}, {"rules": [{}]}, {"rules": [{"name": "n"}]}, {"rules": [{"name": "n", "cycles": "bad"}]}, {"rules": [{"name": "n", "from": {}, "disallow": "a"}]},
                                 {"rules": [{"name": "n", "from": {"kind": "nope"}, "disallow": "a"}]}, {"thresholds": {"maxFanOut": -1}}, {"thresholds": {"y": 1}}, [1]])
def test_config_errors(doc):
    with pytest.raises(config.ConfigError):
        config.parse_config(doc)


def test_check_and_diff_of_a_repository(spark, tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    (tmp_path / "domain").mkdir()
    (tmp_path / "ui").mkdir()
    (tmp_path / "ui/view.ts").write_text("export function show() {}\n")
    (tmp_path / "domain/model.ts").write_text("export class Model {}\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "domain/model.ts").write_text('import { show } from "../ui/view";\nexport class Model {\n  show();\n}\n')
    rule = tmp_path / "rules.yml"
    rule.write_text("rules:\n  - name: layers\n    from: domain/**\n    disallow: ui/**\n")
    assert cli.main(["check", str(tmp_path), "--config", str(rule)]) == 1
    assert "✗ layers (error) — 1 violation" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path), "--config", str(rule), "--baseline", "HEAD", "--format", "sarif"]) == 1
    assert '"ruleId": "layers"' in capsys.readouterr().out
    assert cli.main(["diff", str(tmp_path), "HEAD"]) == 0
    assert "+ 2 relationships" in capsys.readouterr().out
    assert cli.main(["diff", str(tmp_path), "HEAD", "HEAD"]) == 0 and "No structural changes." in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path), "--config", "nowhere.yml"]) == 2 and cli.main(["check"]) == 2 and cli.main(["--version"]) == 0 and cli.main(["help"]) == 0
    with pytest.raises(ValueError):
        revisions.resolve_revision(str(tmp_path), "nothing")


def test_cut_opens_the_heaviest_first(spark):
    paths = [f"a/b/f{i}" for i in range(5)] + [f"a/c/f{i}" for i in range(3)] + ["d/x"]
    n = spark.createDataFrame([(p, "file", p, p, 0, p) for p in paths], "id string, kind string, label string, filePath string, line int, parentFile string")
    g = Graph(n, spark.createDataFrame([], "id string, source string, target string, kind string, count long"))
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 100.0), ("a/b", 0.0, 0.0, 10.0, 50.0), ("a/c", 0.0, 50.0, 10.0, 20.0), ("d", 500.0, 0.0, 10.0, 100.0)], "dir string, x double, y double, width double, height double")
    cut = lambda most, **k: rows(scene.lod_cut(g, boxes, (0.0, 0.0, 1.0), 200.0, 200.0, 24.0, most, **k))
    assert cut(100) == [("a", "open", "opened"), ("a/b", "open", "opened"), ("a/c", "collapse", "too-small"), ("d", "collapse", "off-screen")]
    assert cut(4) == [("a", "open", "opened"), ("a/b", "collapse", "budget"), ("a/c", "collapse", "too-small"), ("d", "collapse", "off-screen")]
    # what was open before stays open down to four fifths of the height
    assert ("a/c", "open", "opened") in cut(100, previous=spark.createDataFrame([("d",)], "dir string"), hysteresis=0.8)


def test_reports_and_rings(spark, tmp_path):
    g = small(spark, EDGES)
    counts = views.summary(g).filter("what = 'node'").select("what", F.col("name").alias("kind"), "n")
    page = exports.html_report("<t>", counts, analysis.insights(g))
    assert "&lt;t&gt;" in page and "Circular dependency (3 nodes)" in page
    placed = scene.grid_positions(g, 3).select("id", "x", "y", F.lit(10.0).alias("width"), F.lit(5.0).alias("height"), F.lit("#fff").alias("color"), F.col("id").alias("label"))
    drawing = exports.svg(placed, g.edges.select("source", "target", F.lit("#000").alias("color")))
    assert drawing.count("<rect") == 10 and drawing.count("<line") == len(EDGES)
    events = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i), i) for i in range(40)], "event_id long, event_type string, value double, ts long")
    events.write.parquet(f"{tmp_path}/in")
    stream = telemetry.stream_ring(spark, f"{tmp_path}/in", "event_id long, event_type string, value double, ts long", 5)
    q = stream.writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("ring"), "name", "n", "min", "max", "p50") == [("a", 5, 31.0, 39.0, 35.0), ("b", 5, 30.0, 38.0, 34.0)]
    with telemetry.timed("x", samples := []):
        pass
    assert samples[0][0] == "x" and samples[0][1] >= 0
