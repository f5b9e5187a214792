"""Globs compiled, on the driver, to regular expressions that whole strings must match."""

from __future__ import annotations

import re


def _piece(glob: str, any_char: str) -> str:
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out.append(f"{any_char}*")
        elif c == "?":
            out.append(any_char)
        elif c == "[" and (end := glob.find("]", at + 2)) > 0:
            body = glob[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            at = end
        else:
            out.append(re.escape(c))
        at += 1
    return "".join(out)


def filename_regex(glob: str) -> str:
    """For base names; ``*`` matches anything."""
    return f"^(?s:{_piece(glob, '.')})$"


def segments_regex(glob: str) -> str:
    """For paths of as many segments as the pattern has."""
    parts = glob.replace("\\", "/").rstrip("/").split("/")
    return "^" + "/".join(_piece(p, "[^/]") for p in parts) + "$"


def path_regex(glob: str) -> str:
    """For paths; a ``**`` segment stands for any number of segments, none included."""
    parts = glob.replace("\\", "/").strip("/").split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+(?:/|$))*" if last else "(?:[^/]+/)*"
        else:
            out += _piece(part, "[^/]") + ("" if last else "/")
    return f"^{out}$"
