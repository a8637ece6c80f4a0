"""Files of a working tree or of a revision in a version-control repository, and their graph."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from vinculum.model import Graph
from vinculum.operators.scene import OVERSIZE_FILES
from vinculum.sources import extraction, files

#: How many files one ``git cat-file`` process is asked for.
BATCH = 256


def resolve_revision(root: str, revision: str) -> str:
    """The full commit id; an unknown revision is an error."""
    if revision.startswith("-"):
        raise ValueError(f"Not a revision: {revision}")
    done = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}"], capture_output=True, text=True, check=False)
    if done.returncode:
        raise ValueError(f"Unknown revision: {revision}")
    return done.stdout.strip()


def read_revision(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """path, text of a revision's source files.

    Names are listed at the driver; contents are read by tasks, in batches, which must see the
    repository at ``root``.
    """
    sha = resolve_revision(root, revision)
    listed = subprocess.run(["git", "-C", root, "ls-tree", "-r", "-z", "-l", sha], capture_output=True, check=True).stdout.decode().split("\0")
    rows = []
    for entry in filter(None, listed):
        meta, path = entry.split("\t", 1)
        _, kind, blob, size = meta.split()
        if kind == "blob" and int(size) <= files.MAX_BYTES:
            rows.append((path, blob))
    names = spark.createDataFrame(rows, "path string, blob string")
    names = names.filter(files.is_source_path(names.path) | names.path.rlike(r"(?:\A|/)(?:package\.json|Cargo\.toml|go\.mod|pyproject\.toml|pom\.xml|settings\.gradle(?:\.kts)?)\z"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                ask = "".join(f"{b}\n" for b in some.column(1).to_pylist()).encode()
                data = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=ask, capture_output=True, check=True).stdout
                texts, place = [], 0
                for _ in range(some.num_rows):
                    end = data.index(b"\n", place)
                    size = int(data[place:end].split()[2])
                    texts.append(data[end + 1 : end + 1 + size].decode("utf-8", "replace"))
                    place = end + size + 2
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return names.repartition(max(1, min(200, len(rows) // BATCH + 1))).mapInArrow(run, "path string, text string")


class Oversize(ValueError):
    """More files than a scan takes without force."""


def scan(spark: SparkSession, root: str, revision: str | None = None, force: bool = False) -> tuple[Graph, DataFrame]:
    """The graph and the files of a tree, or of a revision of it; beyond ``OVERSIZE_FILES`` files only with ``force``."""
    found = read_revision(spark, root, revision) if revision else files.scan_directory(spark, root)
    if not force and (n := found.filter(files.is_source_path(found.path)).count()) > OVERSIZE_FILES:
        raise Oversize(f"{n} files; more than {OVERSIZE_FILES} are scanned with force only")
    return extraction.analyze(found), found


def analyze_texts(spark: SparkSession, texts: dict[str, str]) -> Graph:
    """The graph of files held in memory, by path."""
    return extraction.analyze(spark.createDataFrame(sorted(texts.items()), "path string, text string"))
