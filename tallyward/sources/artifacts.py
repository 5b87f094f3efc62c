"""Rule files and schema files, from paths or web addresses."""

from __future__ import annotations

import os
import re
import urllib.request
from collections.abc import Sequence

from tallyward.sources.dataset import InputError

TIMEOUT_S = 30


def is_url(text: str) -> bool:
    return re.match(r"(?i)https?://", text) is not None


def fetch(url: str, timeout: float = TIMEOUT_S) -> str:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as f:  # noqa: S310  web addresses only, checked by callers
            return f.read().decode("utf-8-sig", "replace")
    except Exception as e:
        raise InputError(f"Couldn't fetch `{url}`.") from e


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8-sig", errors="replace", newline="") as f:
            return f.read()
    except OSError as e:
        raise InputError(f"'{path}' cannot be read.") from e


def read_rule_files(paths: Sequence[str]) -> list[tuple[str, str]]:
    """(name, text) in the order given, which is the order of corrections; paths and web addresses may be mixed."""
    return [(re.split(r"[/\\]", p)[-1], fetch(p) if is_url(p) else _read(p)) for p in paths]


def read_schema_entries(paths: Sequence[str]) -> tuple[str, list[tuple[str, str, str | None]]]:
    """(origin, [(relative path, text, address)]): files, folders (whole, sorted, without dot files) or web addresses, never a mix."""
    kinds = {is_url(p) for p in paths}
    if len(kinds) > 1:
        raise InputError("Schema files must be all paths or all web addresses.")
    if kinds == {True}:
        return "url", [(p, fetch(p), p) for p in paths]
    out = []
    for p in paths:
        if os.path.isdir(p):
            for folder, folders, names in os.walk(p):
                folders[:] = sorted(d for d in folders if not d.startswith("."))
                for name in sorted(names):
                    if not name.startswith("."):
                        full = os.path.join(folder, name)
                        out.append((os.path.join(os.path.basename(p.rstrip("/")), os.path.relpath(full, p)).replace(os.sep, "/"), _read(full), None))
        elif os.path.isfile(p):
            out.append((os.path.basename(p), _read(p), None))
        else:
            raise InputError(f"'{p}' does not exist.")
    return "upload", out
