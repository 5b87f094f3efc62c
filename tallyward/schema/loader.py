"""Sets of schema files: what they are, how they refer to each other, and which one is the root."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

UPLOAD_BASE = "set://upload/"
MAX_FILES, MAX_DEPTH = 64, 8
DRAFTS = {"2020-12": "2020-12", "2019-09": "2019-09", "draft-07": "draft-07"}
#: Keys that make a JSON object look like a schema.
MARKERS = frozenset("$schema $id $ref $defs definitions type properties items allOf anyOf oneOf enum const if required pattern".split())
_TYPES = frozenset("array boolean integer null number object string".split())
_SEVERITY = {"E": "fatal", "W": "warning", "I": "info"}


@dataclass(frozen=True)
class LoadIssue:
    code: str
    message: str
    file_id: str | None = None

    @property
    def severity(self) -> str:
        return "warning" if self.code == "E_MIXED_DRAFT" else _SEVERITY[self.code[0]]


@dataclass
class SchemaFile:
    file_id: str
    path: str
    uri: str
    raw: str
    json: Any
    draft: str = "unknown"
    #: schema, non-schema or invalid-json
    kind: str = "schema"
    declared_id: str | None = None
    #: (pointer, text, file referred to, pointer in it)
    refs: list[tuple[str, str, str | None, str]] = field(default_factory=list)

    @property
    def base(self) -> str:
        return self.declared_id or self.uri


@dataclass(frozen=True)
class Site:
    """A place in a schema file."""

    file: SchemaFile
    pointer: str
    node: Any

    def child(self, *path: str | int) -> Site:
        node, pointer = self.node, self.pointer
        for p in path:
            node = node[p]
            pointer += "/" + str(p).replace("~", "~0").replace("/", "~1")
        return Site(self.file, pointer, node)


def at_pointer(doc: Any, pointer: str) -> tuple[bool, Any]:
    node = doc
    for part in pointer.split("/")[1:] if pointer else []:
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        if isinstance(node, dict) and part in node:
            node = node[part]
        elif isinstance(node, list) and part.isdigit() and int(part) < len(node):
            node = node[int(part)]
        else:
            return False, None
    return True, node


@dataclass
class SchemaSet:
    set_id: str
    origin: str
    files: list[SchemaFile]
    schemas: list[SchemaFile]
    #: auto, auto-preferred, ambiguous, none or error
    root_status: str
    candidates: list[SchemaFile]
    issues: list[LoadIssue]
    root: SchemaFile | None = None
    index_id: str | None = None

    def resolve(self, site: Site) -> Site | None:
        """The target of the $ref at a site."""
        for pointer, _, target, fragment in site.file.refs:
            if pointer == site.pointer and target is not None:
                file = next(f for f in self.files if f.file_id == target)
                found, node = at_pointer(file.json, fragment)
                return Site(file, fragment, node) if found else None
        return None

    @property
    def fatal(self) -> list[LoadIssue]:
        return [i for i in self.issues if i.severity == "fatal"]


def _draft(doc: Any) -> str:
    text = doc.get("$schema") if isinstance(doc, dict) else None
    return next((d for d in DRAFTS if isinstance(text, str) and d in text), "unknown")


def _strip_root(paths: list[str]) -> list[str]:
    """Without the folder that all of them share."""
    heads = {p.split("/", 1)[0] for p in paths}
    if paths and all("/" in p for p in paths) and len(heads) == 1:
        return [p.split("/", 1)[1] for p in paths]
    return paths


def _walk(node: Any, pointer: str = "", base: str = "") -> Iterator[tuple[str, str, str]]:
    """(pointer, reference, base) of every $ref, with the base that $id keywords above it set."""
    if isinstance(node, dict):
        if pointer and isinstance(node.get("$id"), str) and not node["$id"].startswith("#"):
            base = urljoin(base, node["$id"])
        for key, value in node.items():
            if key == "$ref" and isinstance(value, str):
                yield pointer, value, base
            elif key not in ("enum", "const", "examples", "default"):
                yield from _walk(value, pointer + "/" + key.replace("~", "~0").replace("/", "~1"), base)
    elif isinstance(node, list):
        for i, value in enumerate(node):
            yield from _walk(value, f"{pointer}/{i}", base)


def _anchors(node: Any, pointer: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(node, dict):
        for key in ("$anchor", "$dynamicAnchor"):
            if isinstance(node.get(key), str):
                yield node[key], pointer
        if isinstance(node.get("$id"), str) and node["$id"].startswith("#"):
            yield node["$id"][1:], pointer
        for key, value in node.items():
            if key not in ("enum", "const", "examples", "default"):
                yield from _anchors(value, pointer + "/" + key.replace("~", "~0").replace("/", "~1"))
    elif isinstance(node, list):
        for i, value in enumerate(node):
            yield from _anchors(value, f"{pointer}/{i}")


def array_of_objects(doc: Any) -> bool:
    return isinstance(doc, dict) and (doc.get("type") == "array" or "type" not in doc and "items" in doc) and isinstance(doc.get("items"), dict)


def _intake(path: str, raw: str, address: str | None, origin: str, files: list[SchemaFile], issues: list[LoadIssue]) -> SchemaFile | None:
    if address is None and not path.lower().endswith(".json"):
        return None
    uri = address or urljoin(UPLOAD_BASE, path.replace(" ", "%20"))
    file_id = uri if origin == "url" else path
    try:
        doc = json.loads(raw.removeprefix("﻿"))
    except ValueError as e:
        reason, _, place = str(e).partition(": line")
        m = re.search(r"char (\d+)", place)
        issues.append(LoadIssue("E_PARSE", f"`{file_id}` is not valid JSON: {reason}" + (f" (near position {m[1]})." if m else "."), file_id))
        file = SchemaFile(file_id, path, uri, raw, None, kind="invalid-json")
        files.append(file)
        return file
    looks = isinstance(doc, bool) or isinstance(doc, dict) and bool(MARKERS & doc.keys())
    file = SchemaFile(file_id, path, uri, raw, doc, _draft(doc), "schema" if looks else "non-schema")
    if isinstance(doc, dict) and isinstance(doc.get("$id"), str):
        file.declared_id = urldefrag(urljoin(uri, doc["$id"]))[0]
        other = next((f for f in files if f.declared_id == file.declared_id), None)
        if other:
            issues.append(LoadIssue("E_DUP_ID", f"Two files declare the same `$id` `{file.declared_id}`: `{other.path}` and `{path}`. Each schema file needs a unique `$id`.", file_id))
    files.append(file)
    return file


def _link(files: list[SchemaFile], issues: list[LoadIssue], origin: str, fetch: Callable[[str], str] | None) -> None:
    """Resolve every reference: by declared id, by path, by where the file came from, by fetching."""
    depth = {f.file_id: 0 for f in files}
    todo = [f for f in files if f.kind != "invalid-json"]
    while todo:
        file = todo.pop(0)
        for pointer, text, base in _walk(file.json, "", file.base):
            target_uri, fragment = urldefrag(urljoin(base, text))
            target = None
            if target_uri in (file.base, file.uri) or not target_uri:
                target = file
            target = target or next((f for f in files if f.declared_id == target_uri), None) or next((f for f in files if f.uri == target_uri), None)
            if target is None:
                fallback = urldefrag(urljoin(file.uri, text))[0]
                target = next((f for f in files if f.uri == fallback), None)
                if target is not None:
                    issues.append(LoadIssue("W_RETRIEVAL_FALLBACK", f"`{file.path}` resolved `{text}` by file location, not by `$id` — the target's `$id` may be stale.", file.file_id))
                elif fetch and origin == "url" and re.match(r"https?://", fallback) and len(files) < MAX_FILES and depth[file.file_id] < MAX_DEPTH:
                    try:
                        target = _intake(fallback, fetch(fallback), fallback, origin, files, issues)
                        depth[target.file_id] = depth[file.file_id] + 1
                        todo.append(target)
                    except Exception:
                        issues.append(LoadIssue("E_FETCH", f"Couldn't fetch `{fallback}`.", file.file_id))
            if target is None:
                issues.append(LoadIssue("E_UNRESOLVED_REF", f"`{file.path}` references `{text}` (at {pointer}), but no loaded file matches. Upload the folder containing `{target_uri.rsplit('/', 1)[-1]}`, or check the reference.", file.file_id))
                file.refs.append((pointer, text, None, ""))
                continue
            place = unquote(fragment)
            if place and not place.startswith("/"):
                place = dict(_anchors(target.json)).get(place, "\0")
            if place == "\0" or not at_pointer(target.json, place)[0]:
                issues.append(LoadIssue("E_BAD_FRAGMENT", f"`{file.path}` references `{text}`, but `#{fragment}` does not exist in `{target.path}`.", file.file_id))
                file.refs.append((pointer, text, None, ""))
                continue
            file.refs.append((pointer, text, target.file_id, place))


def _meta_faults(node: Any, pointer: str = "") -> Iterator[tuple[str, str]]:
    """What is malformed about keywords themselves."""
    if isinstance(node, bool):
        return
    if not isinstance(node, dict):
        yield pointer, "must be object,boolean"
        return
    kinds = node.get("type")
    for kind in kinds if isinstance(kinds, list) else [kinds] if "type" in node else []:
        if kind not in _TYPES:
            yield f"{pointer}/type", "must be equal to one of the allowed values"
    checks = {
        "enum": (list, "array"), "required": (list, "array"), "properties": (dict, "object"), "patternProperties": (dict, "object"), "allOf": (list, "array"), "anyOf": (list, "array"),
        "oneOf": (list, "array"), "pattern": (str, "string"), "format": (str, "string"), "title": (str, "string"), "description": (str, "string"), "$ref": (str, "string"), "$comment": (str, "string"), "uniqueItems": (bool, "boolean"),
    }
    for key, (kind, word) in checks.items():
        if key in node and not isinstance(node[key], kind):
            yield f"{pointer}/{key}", f"must be {word}"
    for key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
        if key in node and (isinstance(node[key], bool) or not isinstance(node[key], (int, float))):
            yield f"{pointer}/{key}", "must be number"
    for key in ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"):
        if key in node and (isinstance(node[key], bool) or not isinstance(node[key], int) or node[key] < 0):
            yield f"{pointer}/{key}", "must be integer"
    if isinstance(node.get("pattern"), str):
        try:
            re.compile(node["pattern"])
        except re.error:
            yield f"{pointer}/pattern", 'must match format "regex"'
    for key in ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas"):
        if isinstance(node.get(key), dict):
            for name, sub in node[key].items():
                yield from _meta_faults(sub, f"{pointer}/{key}/{name}")
    for key in ("allOf", "anyOf", "oneOf", "prefixItems"):
        if isinstance(node.get(key), list):
            for i, sub in enumerate(node[key]):
                yield from _meta_faults(sub, f"{pointer}/{key}/{i}")
    for key in ("not", "if", "then", "else", "additionalProperties", "unevaluatedProperties", "contains", "propertyNames"):
        if key in node:
            yield from _meta_faults(node[key], f"{pointer}/{key}")
    if isinstance(node.get("items"), (dict, bool)):
        yield from _meta_faults(node["items"], f"{pointer}/items")


def select_root(found: SchemaSet, file: SchemaFile) -> SchemaSet:
    """Make a file the root; one that is no table is reported."""
    found.issues[:] = [i for i in found.issues if i.code not in ("W_ROOT_NOT_ARRAY", "E_ROOT_NOT_TABULAR")]
    if not array_of_objects(file.json):
        if isinstance(file.json, dict) and "items" in file.json:
            found.issues.append(LoadIssue("W_ROOT_NOT_ARRAY", f'The index schema `{file.path}` is not an array-of-objects schema; a table is expected (`type: "array"` with object `items`).', file.file_id))
        else:
            found.issues.append(LoadIssue("E_ROOT_NOT_TABULAR", f'The index schema `{file.path}` does not describe a table (expected `type: "array"` with `items`).', file.file_id))
    found.root = file
    found.index_id = file.declared_id or (file.file_id if found.origin == "url" else file.path)
    return found


def match_index(found: SchemaSet, wanted: str) -> tuple[SchemaFile | None, LoadIssue | None]:
    """A root by declared id, address, path or, if only one has it, file name."""
    for key in (lambda f: f.declared_id, lambda f: f.uri, lambda f: f.file_id, lambda f: f.path):
        for f in found.schemas:
            if key(f) == wanted:
                return f, None
    named = [f for f in found.schemas if f.path.rsplit("/", 1)[-1] == wanted]
    if len(named) == 1:
        return named[0], LoadIssue("W_INDEX_BASENAME", f"The shared index reference `{wanted}` matched `{named[0].path}` by file name only.", named[0].file_id)
    return None, LoadIssue("W_INDEX_NO_MATCH", "The shared index reference didn't match any loaded file.")


def build_schema_set(entries: Sequence[tuple[str, str, str | None]], origin: str = "upload", index: str | None = None, fetch: Callable[[str], str] | None = None) -> SchemaSet:
    """A set from (path, text, address) entries. All that is wrong is collected; nothing is raised."""
    files: list[SchemaFile] = []
    issues: list[LoadIssue] = []
    paths = [re.sub(r"/+", "/", p.replace("\\", "/")).removeprefix("./") if origin == "upload" else p for p, _, _ in entries]
    paths = _strip_root(paths) if origin == "upload" else paths
    for path, (_, raw, address) in sorted(zip(paths, entries), key=lambda x: x[0]):
        _intake(path, raw, address, origin, files, issues)
    _link(files, issues, origin, fetch)
    referred = {t for f in files for _, _, t, _ in f.refs if t is not None}
    schemas = [f for f in files if f.kind == "schema" or f.kind == "non-schema" and f.file_id in referred]
    hints = [str(v) for f in files if f.kind == "non-schema" and isinstance(f.json, dict) for v in f.json.values() if isinstance(v, str)]
    for f in files:
        if f.kind == "non-schema" and f not in schemas:
            issues.append(LoadIssue("I_NON_SCHEMA_IGNORED", f"`{f.path}` doesn't look like a JSON Schema and was ignored.", f.file_id))
    digest = hashlib.sha256(json.dumps(sorted((f.path, f.raw) for f in files)).encode()).hexdigest()[:16]
    found = SchemaSet(digest, origin, files, schemas, "error", [], issues)
    own = {f.file_id for f in schemas}
    aimed = {t for f in schemas for _, _, t, _ in f.refs if t in own and t != f.file_id}
    order = lambda fs: sorted(fs, key=lambda f: (next((i for i, h in enumerate(hints) if h in (f.path, f.path.rsplit("/", 1)[-1])), len(hints)), not array_of_objects(f.json), f.path))
    free = [f for f in schemas if f.file_id not in aimed]
    tables = [f for f in free if array_of_objects(f.json)]
    chosen = None
    if not schemas:
        issues.append(LoadIssue("E_NO_SCHEMAS", "None of the loaded files look like JSON Schemas. Keys like `$schema`, `type`, or `properties` were looked for."))
    elif len(free) == 1:
        found.root_status, found.candidates, chosen = "auto", free, free[0]
    elif not free:
        found.root_status, found.candidates = "none", order(schemas)
    elif len(tables) == 1:
        found.root_status, found.candidates, chosen = "auto-preferred", order(free), tables[0]
        others = ", ".join(f"`{f.path}`" for f in free if f is not chosen)
        issues.append(LoadIssue("I_AUTO_PREFERRED", f"Using `{chosen.path}` as the index; {others} {'is' if len(free) == 2 else 'are'} also unreferenced.", chosen.file_id))
    else:
        found.root_status, found.candidates = "ambiguous", order(free)
    if index is not None:
        match, issue = match_index(found, index)
        if issue:
            issues.append(issue)
        chosen = match or chosen
    if chosen is not None:
        select_root(found, chosen)
    for f in schemas:
        for place, fault in _meta_faults(f.json):
            draft = "2020-12" if f.draft == "unknown" else f.draft
            issues.append(LoadIssue("E_META", f"`{f.path}` is not a valid {draft} schema: {fault} at `{place}`.", f.file_id))
            break
    drafts = list(dict.fromkeys(f.draft for f in schemas if f.draft != "unknown"))
    if len(drafts) > 1:
        root_draft = found.root.draft if found.root and found.root.draft != "unknown" else "2020-12"
        issues.append(LoadIssue("E_MIXED_DRAFT", f"Files use different JSON Schema drafts ({', '.join(drafts)}); validation uses the index file's draft ({root_draft})."))
    return found
