"""Rules from a file: a mapping of ``rules`` and ``thresholds``, as JSON or a plain subset of YAML."""

from __future__ import annotations

import json
import re
from typing import Any

from vinculum.operators.analysis import Rules, Selector

#: What a selector's facets may be.
KINDS = (
    "file", "class", "interface", "struct", "trait", "protocol", "enum", "union", "record", "object", "type", "namespace", "module", "function", "method",
    "constructor", "accessor", "component", "macro", "variable", "constant", "field", "property", "annotation", "external",
)
ENVIRONMENTS = ("client", "server")
_FACETS = {"path": "path", "paths": "path", "kind": "kind", "kinds": "kind", "role": "role", "roles": "role", "environment": "environment", "environments": "environment", "category": "category", "categories": "category"}
_ENUMS = {"kind": KINDS, "environment": ENVIRONMENTS}


class ConfigError(ValueError):
    pass


def _strings(value: Any, where: str) -> tuple[str, ...]:
    items = [value] if isinstance(value, str) else value
    if not isinstance(items, list) or not all(isinstance(x, str) for x in items):
        raise ConfigError(f"{where}: expected a string or a list of strings")
    return tuple(items)


def parse_selector(value: Any, where: str) -> Selector:
    """A glob, a list of globs, or a mapping of facets, each a string or a list; at least one must be given."""
    if isinstance(value, (str, list)):
        value = {"path": value}
    if not isinstance(value, dict):
        raise ConfigError(f"{where}: expected a glob string, list, or selector object")
    facets: dict[str, tuple[str, ...]] = {}
    for key, held in value.items():
        if key not in _FACETS:
            raise ConfigError(f'{where}.{key}: unknown selector field "{key}"')
        facet, items = _FACETS[key], _strings(held, f"{where}.{key}")
        for x in items:
            if facet in _ENUMS and x not in _ENUMS[facet]:
                raise ConfigError(f'{where}.{key}: unknown value "{x}"')
        facets[facet] = items
    if not any(facets.values()):
        raise ConfigError(f"{where}: selector matches nothing (no facets given)")
    return Selector(**facets)


def _severity(value: Any, where: str, default: str) -> str:
    if value is None:
        return default
    if value not in ("error", "warning"):
        raise ConfigError(f'{where}: severity must be "error" or "warning", got {json.dumps(value)}')
    return value


def parse_config(doc: Any) -> Rules:
    """Rules of a decoded document; unknown fields are errors, an empty document has no rule."""
    if doc is None:
        return Rules(severity="error")
    if not isinstance(doc, dict):
        raise ConfigError("Top level of config must be a mapping")
    for key in doc:
        if key not in ("rules", "thresholds"):
            raise ConfigError(f'Unknown top-level field "{key}" (expected "rules" or "thresholds")')
    dependency, cycle = [], []
    rules = doc.get("rules", [])
    if not isinstance(rules, list):
        raise ConfigError('"rules" must be a list')
    for i, raw in enumerate(rules):
        where = f"rules[{i}]"
        if not isinstance(raw, dict):
            raise ConfigError(f"{where}: expected a mapping")
        name = raw["name"].strip() if isinstance(raw.get("name"), str) else ""
        if not name:
            raise ConfigError(f'{where}: a "name" is required')
        if "cycles" in raw:
            scope = parse_selector(raw["scope"], f"{where}.scope") if raw.get("scope") is not None else None
            cycle.append((name, _severity(raw["cycles"], f"{where}.cycles", "error"), scope))
        elif raw.get("from") is None or raw.get("disallow") is None:
            raise ConfigError(f'{where} ("{name}"): a rule needs either "cycles", or both "from" and "disallow"')
        else:
            ends = (parse_selector(raw[k], f"{where}.{k}") for k in ("from", "disallow"))
            dependency.append((name, _severity(raw.get("severity"), f"{where}.severity", "error"), *ends))
    limits = {"severity": "error"}
    thresholds = doc.get("thresholds")
    if thresholds is not None:
        if not isinstance(thresholds, dict):
            raise ConfigError("thresholds: expected a mapping")
        for key, value in thresholds.items():
            if key == "severity":
                limits["severity"] = _severity(value, "thresholds.severity", "error")
            elif key not in ("maxFanOut", "maxDependencyDepth"):
                raise ConfigError(f'thresholds: unknown field "{key}"')
            elif isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < float("inf"):
                raise ConfigError(f"thresholds.{key}: expected a non-negative number, got {json.dumps(value)}")
            else:
                limits["max_fan_out" if key == "maxFanOut" else "max_depth"] = value
    return Rules(tuple(dependency), tuple(cycle), **limits)


def _scalar(text: str) -> Any:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r""""[^"]*"|'[^']*'|[^,\s][^,]*""", text[1:-1])]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else int(text) if re.fullmatch(r"-?\d+", text) else text


def plain_yaml(text: str) -> Any:
    """Block mappings and lists, flow lists and scalars: what rule files are made of."""
    rows = []
    for raw in text.split("\n"):
        line = re.sub(r"""(?:^|\s)#(?=(?:[^"']|"[^"]*"|'[^']*')*$).*""", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            rows.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, depth: int) -> tuple[Any, int]:
        out: Any = [] if rows[at][1].startswith("- ") or rows[at][1] == "-" else {}
        while at < len(rows) and rows[at][0] == depth:
            line = rows[at][1]
            if isinstance(out, list):
                if not (line.startswith("- ") or line == "-"):
                    break
                rest = line[1:].strip()
                if re.match(r"""(?:"[^"]*"|'[^']*'|[\w-]+):(?:\s|$)""", rest):  # a mapping that begins behind the dash
                    inner = depth + len(line) - len(rest)
                    rows[at] = (inner, rest)
                    value, at = block(at, inner)
                elif rest:
                    value, at = _scalar(rest), at + 1
                else:
                    value, at = block(at + 1, rows[at + 1][0])
                out.append(value)
            else:
                m = re.match(r"""("[^"]*"|'[^']*'|[^:]+?)\s*:(?:\s+(.*))?$""", line)
                if not m:
                    raise ConfigError(f"cannot read the line {line!r}")
                key, rest = _scalar(m[1]), (m[2] or "").strip()
                if rest:
                    out[key], at = _scalar(rest), at + 1
                elif at + 1 < len(rows) and (rows[at + 1][0] > depth or rows[at + 1][0] == depth and rows[at + 1][1].startswith("-")):
                    out[key], at = block(at + 1, rows[at + 1][0])
                else:
                    out[key], at = None, at + 1
        return out, at

    if not rows:
        return None
    out, at = block(0, rows[0][0])
    if at < len(rows):
        raise ConfigError(f"cannot read the line {rows[at][1]!r}")
    return out


def load_config(path: str) -> Rules:
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        raise ConfigError(f"Config file not found: {path}") from None
    return parse_config(json.loads(text) if text.lstrip().startswith("{") else plain_yaml(text))
