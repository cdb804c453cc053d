"""Search keywords: taking them from a query, and the filters and file types they stand for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import re2
from ..functions.text import extension, package_of

_WORD = r"(-?(?:filetype|package|pkg|path|file)):(\S+)"
_SIDES = (re.compile(rf"\s*{_WORD}\s+", re.IGNORECASE | re.ASCII), re.compile(rf"\s+{_WORD}\s*\Z", re.IGNORECASE | re.ASCII))

_TYPES: dict[str, dict[str, float]] = {
    "c": dict.fromkeys((".c", ".h"), 0.75),
    "objc": dict.fromkeys((".c", ".h", ".m"), 0.75),
    "objc++": dict.fromkeys((".h", ".cc", ".cpp", ".mm"), 0.75),
    "c++": dict.fromkeys((".h", ".hpp", ".hxx", ".cpp", ".cxx"), 0.75) | {".c": 0.55},
    "perl": {".t": 0.8, ".pl": 0.75, ".pm": 0.75},
    "shell": dict.fromkeys((".bash", ".sh", ".zsh"), 0.75),
    "vala": dict.fromkeys((".vapi", ".vala"), 0.75),
} | {name: {suffix: 0.75} for suffix, names in {".php": "php", ".py": "python", ".go": "go golang", ".java": "java", ".rb": "ruby", ".erl": "erlang", ".js": "js javascript", ".json": "json"}.items() for name in names.split()}


@dataclass
class Search:
    """A query without its keywords, and these by kind in the order found; a leading n negates."""

    query: str
    keywords: dict[str, list[str]] = field(default_factory=dict)

    def get(self, kind: str) -> list[str]:
        return self.keywords.get(kind, [])


def rewrite(query: str) -> Search:
    """Take keywords off the front, then off the end, as long as something is left beside them."""
    out = Search(query)
    for side in _SIDES:
        while found := (side.match if side is _SIDES[0] else side.search)(out.query):
            kind, value = found[1].lower().replace("pkg", "package"), found[2]
            kind = {"-file": "npath", "file": "path"}.get(kind, "n" + kind[1:] if kind[0] == "-" else kind)
            out.keywords.setdefault(kind, []).append(value.lower() if kind.endswith("filetype") else value)
            out.query = out.query[: found.start()] + out.query[found.end() :]
    return out


def suffixes(types: list[str]) -> dict[str, float]:
    """Suffixes of file types with their weights; unknown types add none, later ones win."""
    return reduce(lambda a, b: a | b, (_TYPES.get(t, {}) for t in types), {})


def matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?s)" + re2.java(re2.parse(pattern)))


def file_filter(search: Search, path: Column) -> Column:
    """All keyword filters on a path: the first package counts, all others must hold; file types with a known suffix only."""
    package = package_of(path)
    tests = [matches(package, p) for p in search.get("package")[:1]]
    tests += [~matches(package, p) for p in search.get("npackage")]
    tests += [matches(path, p) for p in search.get("path")]
    tests += [~matches(path, p) for p in search.get("npath")]
    if wanted := suffixes(search.get("filetype")):
        tests.append(extension(path).isin(*wanted))
    if unwanted := suffixes(search.get("nfiletype")):
        tests.append(~extension(path).isin(*unwanted))
    return reduce(and_, tests, F.lit(True))


def suffix_weight(search: Search, path: Column) -> Column:
    wanted = suffixes(search.get("filetype"))
    if not wanted:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[extension(path)], F.lit(0.0))
