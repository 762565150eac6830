"""Braces, ranges and globs in addresses."""

from __future__ import annotations

import re

_BRACES = re.compile(r"\{([^{}]*)\}")
_MAGIC = re.compile(r"[*?\[{]")


def _range(body: str) -> list[str] | None:
    m = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", body)
    if m:
        a, b = int(m[1]), int(m[2])
        width = max(len(m[1]), len(m[2])) if any(x.lstrip("-").startswith("0") and len(x.lstrip("-")) > 1 for x in m.groups()) else 0
        return [str(x).zfill(width) for x in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
    m = re.fullmatch(r"([a-zA-Z])\.\.([a-zA-Z])", body)
    if m:
        a, b = ord(m[1]), ord(m[2])
        return [chr(x) for x in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
    return None


def expand_braces(uri: str) -> list[str]:
    """``{a,b}`` and ``{1..5}`` to all their combinations, in order, once each."""
    m = _BRACES.search(uri)
    if not m:
        return [uri]
    body = m.group(1)
    choices = body.split(",") if "," in body else _range(body)
    if choices is None:
        choices = [body]
    out = [x for c in choices for x in expand_braces(uri[: m.start()] + c + uri[m.end() :])]
    return list(dict.fromkeys(out))


def split_pattern(uri: str) -> tuple[str, str | None]:
    """The longest folder without magic, and the pattern below it."""
    m = _MAGIC.search(uri)
    if not m:
        return uri.rstrip("/"), None
    cut = uri.rfind("/", 0, m.start())
    if cut < 0 or "://" in uri and cut < uri.index("://") + 3:
        raise ValueError(f"{uri!r}: a bucket's name can't be a pattern")
    return uri[:cut], uri[cut + 1 :]


def pattern_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` don't."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            end = pattern.find("]", i + 2) if c == "[" else -1
            if c == "*":
                out.append("[^/]*")
            elif c == "?":
                out.append("[^/]")
            elif end > 0:
                out.append("[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("!", "^", 1) + "]")
                i = end
            else:
                out.append(re.sub(r"([^\w\s/])", r"\\\1", c))
            i += 1
    return r"\A" + "".join(out) + r"\z"


def needs_recursion(pattern: str | None) -> bool:
    return bool(pattern) and ("**" in pattern or "/" in pattern)
