"""Ignore files: patterns as git knows them, in every folder of a tree, with negation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from corpusmill.functions import patterns as P


def glob_regex(glob: str) -> str:
    """A glob over a relative path: * and ? stay within a name, ** crosses folders, [...] is a set of characters."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Rule:
    """One line of an ignore file."""

    __slots__ = ("folders_only", "keep", "pattern")

    def __init__(self, line: str):
        self.keep = line.startswith("!")
        line = line[1:] if self.keep else line
        self.folders_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        self.pattern = re.compile(("" if anchored else "(?:.*/)?") + glob_regex(line.removeprefix("/")), re.DOTALL)

    @classmethod
    def lines(cls, text: str) -> list[Rule]:
        out = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\) +$", "", line)
            if line.strip("/!") and not line.startswith("#"):
                try:
                    out.append(cls(line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line))
                except re.error:
                    continue  # a set of characters that is none matches nothing
        return out


class IgnoreRules:
    """The rules of all ignore files of a tree. Folders are relative to its root; those above it begin with ``../``.

    For each kind of ignore file the nearest folder with a rule for a path decides, and in a file its last such rule;
    kinds come in the order of P.IGNORE_FILES. What lies in an ignored folder is ignored, whatever later rules say.
    """

    def __init__(self, files: Iterable[tuple[str, str, str]], kinds: tuple[str, ...] = P.IGNORE_FILES, above: tuple[str, ...] = ()):
        """``files``: folder (relative, "" for the root), name and text; ``above``: names of the root's ancestors, nearest last."""
        self.rules = {(folder, name): found for folder, name, text in files if (found := Rule.lines(text))}
        self.kinds, self.above = kinds, above
        self.ignored = lru_cache(maxsize=100_000)(self._ignored) if self.rules else lru_cache(maxsize=1)(lambda path, folder=False: False)

    def _verdict(self, path: str, folder: bool) -> bool:
        names = [*self.above, *path.split("/")]
        for kind in self.kinds:
            for depth in range(len(names) - 1, -1, -1):
                up = len(self.above) - depth
                at = "/".join([".."] * up) if up > 0 else "/".join(names[len(self.above) : depth])
                below = "/".join(names[depth:])
                for rule in reversed(self.rules.get((at, kind), ())):
                    if (folder or not rule.folders_only) and rule.pattern.fullmatch(below):
                        if rule.keep:
                            return False
                        return True
        return False

    def _ignored(self, path: str, folder: bool = False) -> bool:
        parent = path.rpartition("/")[0]
        return bool(parent) and self.ignored(parent, True) or self._verdict(path, folder)

