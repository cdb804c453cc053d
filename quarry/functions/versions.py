"""Package versions [epoch:]upstream[-revision] and their order."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import total_ordering

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALID = r"(?:([0-9]{1,18}):|(?!.*:))([0-9][A-Za-z0-9.+~:\-]*(?=-[^-]*$)|[0-9][A-Za-z0-9.+~:]*|(?=-))(?:-([A-Za-z0-9.+~]*))?"
#: The same for Columns; the last hyphen begins the revision.
_JVM = f"^{_VALID}$"
#: Digits that a number in a version is padded to in sort keys.
DIGITS = 20


@total_ordering
@dataclass(frozen=True)
class Version:
    epoch: int
    upstream: str
    revision: str

    def __str__(self) -> str:
        return f"{self.epoch}:" * bool(self.epoch) + self.upstream + f"-{self.revision}" * bool(self.revision)

    def key(self) -> tuple:
        return self.epoch, _order(self.upstream), _order(self.revision)

    def __eq__(self, other) -> bool:
        return self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())

    def __lt__(self, other) -> bool:
        return self.key() < other.key()


def _order(part: str) -> tuple:
    """Runs of other characters and of digits in turn; ~ sorts before the end, the end before letters, letters before all else."""
    out = []
    for text, number in re.findall(r"([^0-9]*)([0-9]*)", part):
        weights = [0 if c == "~" else 2 + ord(c) + 256 * (not c.isalpha()) for c in text]
        out.append((tuple([*weights, 1]), int(number or 0)))
    while out and out[-1] == ((1,), 0):
        out.pop()
    return (*out, ((1,), 0), ((1,), 0))


def parse(text: str) -> Version:
    """ValueError for what isn't a version."""
    body = text.strip()
    found = re.fullmatch(_VALID, body)
    if not body or not found:
        raise ValueError(f"not a version: {text!r}")
    return Version(int(found[1] or 0), found[2], found[3] or "")


def _part_key(part: Column) -> Column:
    """A string that sorts, byte by byte, as the part does.

    Numbers are padded and follow the run before them, which ends with "1"; a tilde is
    "0", a letter "2" and itself, any other character "3" and itself. A part that ends
    compares as one followed by empty runs and zeros; only a first run can be empty, so
    two of them suffice.
    """
    zero = "0" * DIGITS
    runs = F.regexp_extract_all(part, F.lit(r"([^0-9]*)([0-9]*)"), F.lit(0))

    def run(x: Column) -> Column:
        text, number = F.regexp_extract(x, r"^([^0-9]*)", 1), F.regexp_extract(x, r"([0-9]*)$", 1)
        marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([^A-Za-z~])", "\u0003$1"), r"([A-Za-z])", "\u0002$1"), "~", "\u0000")
        return F.concat(marks, F.lit("\u0001"), F.lpad(F.regexp_replace(number, "^0+", ""), DIGITS, "0"))

    joined = F.array_join(F.transform(F.filter(runs, lambda x: x != ""), run), "")
    return F.concat(F.regexp_replace(joined, f"(\u0001{zero})+$", ""), F.lit(f"\u0001{zero}" * 2))


def version_struct(text: Column) -> Column:
    """STRUCT<epoch, version, revision>, null for what isn't a version."""
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    epoch = F.regexp_extract(body, _JVM, 1)
    return F.when(
        (body != "") & body.rlike(_JVM),
        F.struct(F.coalesce(F.nullif(epoch, F.lit("")).cast("bigint"), F.lit(0)).alias("epoch"), F.regexp_extract(body, _JVM, 2).alias("version"), F.regexp_extract(body, _JVM, 3).alias("revision")),
    )


def sort_key(text: Column) -> Column:
    """STRUCT that orders, equals and groups as the versions do; null for what isn't one, and exact for numbers of up to DIGITS digits."""
    v = version_struct(text)
    return F.when(v.isNotNull(), F.struct(v["epoch"].alias("epoch"), _part_key(v["version"]).alias("upstream"), _part_key(v["revision"]).alias("revision")))


def version_text(v: Column) -> Column:
    """The text of a version struct; an epoch of 0 and an empty revision are left out."""
    return F.concat(F.when(v["epoch"] > 0, F.concat(v["epoch"].cast("string"), F.lit(":"))).otherwise(""), v["version"], F.when(v["revision"] != "", F.concat(F.lit("-"), v["revision"])).otherwise(""))
