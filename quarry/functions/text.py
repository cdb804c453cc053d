"""Scalar functions on paths, lines and sizes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_escape(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def extension(path: Column) -> Column:
    """The last suffix of the file name with its dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def package_of(path: Column) -> Column:
    """What stands before the first underscore; null without one."""
    return F.when(F.instr(path, "_") > 1, F.substring_index(path, "_", 1))


def release_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def is_tar(name: Column) -> Column:
    """A top-level archive; of several ".tar." the first counts."""
    return name.rlike(r"^(?:(?!\.tar\.)[^\n])*\.tar\.(?:gz|lz|bz2|xz)$")


def pool_folder(source: Column) -> Column:
    return F.when(source.startswith("lib"), F.substring(source, 1, 4)).otherwise(F.substring(source, 1, 1))


def human_bytes(n: Column) -> Column:
    value = n.cast("double")
    out = F.when(value < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("K", "M", "G"), 1):
        scaled = F.format_string(f"%.1f {unit}", F.bround(value / float(1024**power), 1))
        out = out.when(value < float(1024 ** (power + 1)), scaled) if unit != "G" else out.otherwise(scaled)
    return out


def leading_spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"(?U)^\s+", ""))


def fnv1_64(data: bytes) -> int:
    """FNV-1 of a query's text, its public id; on the driver only."""
    h = 0xCBF29CE484222325
    for b in data:
        h = h * 0x100000001B3 % (1 << 64) ^ b
    return h
