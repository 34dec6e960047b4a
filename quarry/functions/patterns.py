"""Path patterns as regular expressions that the JVM's and DuckDB's engines read alike."""

from __future__ import annotations

import re
from dataclasses import dataclass


def _component(glob: str, escapes: bool = False) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "\\" and escapes and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """A glob matches from the right, component by component; an absolute one matches the whole path."""
    parts = [_component(p) for p in pattern.strip("/").split("/")]
    return ("^/" if pattern.startswith("/") else "^(?:.*/)?") + "/".join(parts) + "$"


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    negate: bool
    dir_only: bool


def ignore_rule(line: str) -> IgnoreRule | None:
    """One line of an ignore file, or None for blank lines and comments."""
    text = line.rstrip("\r\n")
    bare = text.rstrip(" \t")
    kept = (len(bare) - len(bare.rstrip("\\"))) % 2  # a blank after a backslash is part of the pattern
    text = text[: len(bare) + kept]
    if not text or text.startswith("#"):
        return None
    negate = text.startswith("!")
    text = text[1:] if negate else text
    dir_only, anchored = text.endswith("/"), "/" in text.strip("/") or text.startswith("/")
    parts = text.strip("/").split("/")
    out = "^" if anchored else "^(?:.*/)?"
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _component(p, True) + ("" if last else "/")
    return IgnoreRule(out + "$", negate, dir_only)
