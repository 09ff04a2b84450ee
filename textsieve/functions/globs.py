"""Globs and ignore rules as regular expressions over relative paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c


def glob_regex(glob: str) -> str:
    """A regex, in both Java's and Python's dialect, of a glob with ``* ** ? [..] {a,b}``; dot files match too."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            negate = body[0] in "!^"
            out += "[" + ("^/" if negate else "") + "".join(x if x == "-" or x.isalnum() else "\\" + x for x in body[negate:]) + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += _literal(glob[i])
        else:
            out += _literal(c)
        i += 1
    return f"^{out}$"


def glob_filter(path: Column, globs: list[str] | None) -> Column:
    """Whether a path matches any glob; no globs keep every path."""
    if not globs:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [path.rlike("(?s)" + glob_regex(g)) for g in globs])


class IgnoreRules:
    """Rules of an ignore file: later ones win, ``!`` takes back, a folder's rule holds for all below it."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in lines:
            line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            rule = line[1:] if back else line
            rule = rule[1:] if rule[:2] in ("\\#", "\\!") else rule
            folder = rule.endswith("/")
            rule = rule.rstrip("/")
            anchored = "/" in rule
            rule = rule.lstrip("/")
            if rule:
                self.rules.append((back, folder, re.compile("(?s)" + glob_regex(rule if anchored else f"**/{rule}"))))

    def ignores(self, path: str) -> bool:
        """Whether a relative file path is ignored, itself or through a folder above it."""
        parts = path.split("/")
        for depth in range(1, len(parts) + 1):
            name, gone = "/".join(parts[:depth]), False
            for back, folder, rule in self.rules:
                if (depth < len(parts) or not folder) and rule.match(name):
                    gone = not back
            if gone:
                return True
        return False
