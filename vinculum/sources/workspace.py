"""Saved views of a graph: what is open, filtered and laid out, as JSON and as a table; and pieces of source files."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The format's version, its lists of switches, and its other fields with their types.
VERSION = 1
SWITCHES = ("enabledEdgeKinds", "enabledNodeKinds", "enabledCategories", "enabledEnvironments", "enabledRuntimes", "enabledFolders", "enabledLanguages")
LAYOUT = {"algorithm": str, "direction": str, "groupBy": str, "edgeRouting": str, "density": float, "communityCollapse": bool}
_TYPE_NAMES = {str: "a string", float: "a number", bool: "a boolean", list: "a string array"}
STORE_SCHEMA = "name string, savedAt long, workspace string"


def _is(value: Any, kind: type) -> bool:
    if kind is list:
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    if kind is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, kind)


def _need(where: dict, key: str, kind: type, prefix: str = "") -> None:
    if not _is(where.get(key), kind):
        raise ValueError(f"{prefix}{key} must be {_TYPE_NAMES[kind]}")


def capture(state: dict[str, Any]) -> dict[str, Any]:
    """A document of a live state, whose sets become sorted lists; a camera and pinned nodes go along where set."""
    focus = state.get("focusedIds")
    out = {
        "version": VERSION, "projectPath": state["projectPath"], "selectedNode": state.get("selectedId"), "expandedFiles": sorted(state["expanded"]),
        "collapsedClusters": sorted(state["collapsedClusters"]), "focusedIds": None if focus is None else sorted(focus),
        "filters": {"showExternal": state["showExternal"], "search": state["search"], **{k: sorted(state[k]) for k in SWITCHES}},
        "layout": {k: state[k] for k in LAYOUT},
    }
    return out | {k: state[k] for k in ("camera", "pinnedNodes") if state.get(k)}


def restore(doc: dict[str, Any]) -> dict[str, Any]:
    """The live state of a document: the inverse of :func:`capture`."""
    f, focus = doc["filters"], doc["focusedIds"]
    state = {
        "projectPath": doc["projectPath"], "selectedId": doc["selectedNode"], "expanded": set(doc["expandedFiles"]), "collapsedClusters": set(doc["collapsedClusters"]),
        "focusedIds": None if focus is None else set(focus), "showExternal": f["showExternal"], "search": f["search"],
    }
    return state | {k: set(f[k]) for k in SWITCHES} | {k: doc["layout"][k] for k in LAYOUT} | {k: doc[k] for k in ("camera", "pinnedNodes") if doc.get(k)}


def to_json(doc: dict[str, Any]) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"


def parse(text: str) -> dict[str, Any]:
    """The document in ``text``; ValueError says what is wrong with it."""
    try:
        doc = json.loads(text)
    except ValueError:
        raise ValueError("Not valid JSON") from None
    if not isinstance(doc, dict):
        raise ValueError("Workspace must be an object")
    version = doc.get("version")
    if not _is(version, float):
        raise ValueError("Missing workspace version")
    if version > VERSION:
        raise ValueError(f"Workspace version {version} is newer than supported ({VERSION})")
    for part in ("filters", "layout"):
        if not isinstance(doc.get(part), dict):
            raise ValueError(f"Workspace.{part} is missing")
    _need(doc["filters"], "showExternal", bool, "filters.")
    _need(doc["filters"], "search", str, "filters.")
    for key in SWITCHES:
        _need(doc["filters"], key, list, "filters.")
    for key, kind in LAYOUT.items():
        _need(doc["layout"], key, kind, "layout.")
    _need(doc, "expandedFiles", list)
    _need(doc, "collapsedClusters", list)
    if doc.get("focusedIds", "") is not None and not _is(doc.get("focusedIds"), list):
        raise ValueError("focusedIds must be a string array or null")
    return doc


# --- the store: an append-only table, of whose rows the newest of each name counts --------------


def save(spark: SparkSession, path: str, name: str, doc: dict[str, Any] | None, now: int) -> None:
    """Adds a version; without a document, ``name`` is gone from then on."""
    row = [(name, now, None if doc is None else json.dumps(doc, ensure_ascii=False))]
    spark.createDataFrame(row, STORE_SCHEMA).coalesce(1).write.mode("append").json(path, ignoreNullFields=False)


def newest(versions: DataFrame) -> DataFrame:
    """name, savedAt, workspace: the last version of each name that is not gone (equal times: the greater document)."""
    last = F.row_number().over(W.partitionBy("name").orderBy(F.desc("savedAt"), F.desc_nulls_first("workspace")))
    return versions.withColumn("__last", last).filter("__last = 1 AND workspace IS NOT NULL").drop("__last")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """All saved workspaces, the newest first."""
    return newest(spark.read.schema(STORE_SCHEMA).json(path)).orderBy(F.desc("savedAt"), "name")


def load(spark: SparkSession, path: str, name: str) -> dict[str, Any] | None:
    found = newest(spark.read.schema(STORE_SCHEMA).json(path).filter(F.col("name") == name)).first()
    return json.loads(found["workspace"]) if found else None


# --- pieces of sources and what to call them ----------------------------------------------------


def source_slice(text: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last`` (from 1, both included) of a text, joined by newlines; empty where there are none."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", ""), r"\r?\n")
    first = max(first, 1)
    return F.array_join(F.slice(lines, first, max(last - first + 1, 0)), "\n")


def symbol_path(kind: Column, path: Column, label: Column) -> Column:
    return F.when(kind == "file", path).otherwise(F.concat(path, F.lit("#"), label))


def file_location(path: Column, line: Column) -> Column:
    return F.when(line > 0, F.concat(path, F.lit(":"), line.cast("string"))).otherwise(path)


def absolute(root: str, path: Column, windows: bool = False) -> Column:
    """``path`` below ``root`` with the platform's separator, repeated ones as one."""
    mark = "\\\\" if windows else "/"
    return F.regexp_replace(F.concat(F.lit(root.rstrip("/\\") + "/"), path), r"[\\/]+", mark)
