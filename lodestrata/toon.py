"""Compact table text: a declared header, then one line per row."""

from __future__ import annotations

import re

_PLAIN = re.compile(r"[A-Za-z_][\w ./:<>()@+-]*")


def _scalar(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value)
    if _PLAIN.fullmatch(text) and text == text.strip() and text not in ("null", "true", "false"):
        return text
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def dumps(value: object, indent: int = 0, key: str = "") -> str:
    """Encode scalars, dicts, lists of scalars and lists of equal dicts."""
    pad = "  " * indent
    head = f"{pad}{key}"
    if isinstance(value, dict):
        body = "\n".join(dumps(v, indent + bool(key), k) for k, v in value.items())
        return f"{head}:\n{body}" if key else body
    if isinstance(value, (list, tuple)):
        rows = list(value)
        if rows and all(isinstance(r, dict) and list(r) == list(rows[0]) and not any(isinstance(x, (dict, list)) for x in r.values()) for r in rows):
            lines = [f"{head}[{len(rows)}]{{{','.join(rows[0])}}}:"]
            return "\n".join(lines + [f"{pad}  {','.join(map(_scalar, r.values()))}" for r in rows])
        if all(not isinstance(r, (dict, list)) for r in rows):
            return f"{head}[{len(rows)}]: {','.join(map(_scalar, rows))}"
        return "\n".join([f"{head}[{len(rows)}]:", *(f"{pad}  - {dumps(r, 0).strip()}" for r in rows)])
    return f"{head}: {_scalar(value)}" if key else f"{pad}{_scalar(value)}"
