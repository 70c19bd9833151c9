"""OpenAPI and Swagger descriptions, in JSON or YAML."""

from __future__ import annotations

import json

from .model import Outline, Parsed, ParseError, Section, fallback_title, utf8

# The methods that a path may have.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ParseError("YAML can't be read here") from e
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ParseError("neither JSON nor YAML") from e


def pointer(*keys: str) -> str:
    return "#/" + "/".join(k.replace("~", "~0").replace("/", "~1") for k in keys)


def _described(node: dict, names: tuple[str, ...] = ("summary", "description")) -> str:
    return "\n\n".join(str(node[k]) for k in names if node.get(k))


def parse_openapi(data: bytes, source: str, metadata: dict[str, str]) -> Parsed:
    root = load(utf8(data))
    if not isinstance(root, dict) or not ("openapi" in root or "swagger" in root):
        raise ParseError("no OpenAPI or Swagger version")
    info = root.get("info") or {}
    title = str(info.get("title") or fallback_title(metadata, source))
    outline, out = Outline(), []

    def add(name: str, level: int, content: str, at: str) -> None:
        section_id, parent = outline.add(name, level)
        out.append(Section(section_id, parent, name, level, content, at))

    add("Overview", 1, _described(info, ("title", "version", "description")), pointer("info"))
    for path, item in sorted((root.get("paths") or {}).items()):
        item = item if isinstance(item, dict) else {}
        add(path, 1, _described(item), pointer("paths", path))
        for method in METHODS:
            if isinstance(op := item.get(method), dict):
                add(f"{method.upper()} {path}", 2, "\n\n".join(x for x in (_described(op), json.dumps(op, indent=2, sort_keys=True, default=str)) if x), pointer("paths", path, method))
    where = ("components", "schemas") if "components" in root else ("definitions",)
    schemas = root
    for k in where:
        schemas = (schemas or {}).get(k) or {}
    if schemas:
        add("Schemas", 1, "", pointer(*where))
        for name, schema in sorted(schemas.items()):
            add(name, 2, json.dumps(schema, indent=2, sort_keys=True, default=str), pointer(*where, name))
    return Parsed(title, out)
