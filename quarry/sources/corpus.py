"""Corpora: where files come from, and which are admitted to the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED_DIRS = (".pc", ".git", "libtool.m4")
SKIPPED_NAMES = (
    "aclocal.m4", "ltmain.sh", "depcomp", "libtool.m4", "config.sub", "config.guess", "Makefile.in", ".gitignore",
    "COPYING", "LICENSE", "NEWS", "CHANGES", "57712_init_values.c", "57711_init_values.c", "57710_init_values.c",
)
SKIPPED_SUFFIXES = ("symbols", "sgml", "xsl", "xml", "dic")
SMALL_SUFFIXES = tuple(
    "html pamphlet lla test decTest stp csv vtk dmp tmp stl tei F90 pass sym eps ipp acc ppd svg json ucm map UPF ovp tom pao ps afm def rst out S result ref".split()
)
MOST_BYTES, MOST_SMALL, LEAST_BYTES, MOST_LINE, MOST_TRIGRAMS = 1 << 30, 65 * 1024, 3, 2000, 20_000

#: Over bytes read as Latin-1: a byte that UTF-8 never has, a continuation after no first byte, a first byte before no continuation.
_ILLEGAL_PAIR = r"[\xf8-\xff]|(?:^|[\x00-\x7f])[\x80-\xbf]|[\xc0-\xf7](?=[^\x80-\xbf])"

_EXTENSIONS = {"en": ".c", "de": ".py", "fr": ".pl", "es": ".go"}


def from_documents(docs: DataFrame) -> DataFrame:
    """The corpus of the table ``documents``: (docid, package, version, path, content, size), a package for each source."""
    extension = F.coalesce(F.create_map(*[F.lit(x) for kv in _EXTENSIONS.items() for x in kv])[F.col("lang")], F.lit(".txt"))
    version = F.concat(F.lit("1."), F.col("doc_id") % 3, F.lit("-1"))
    path = F.concat("source", F.lit("_"), version, F.lit("/"), "lang", F.lit("/doc"), "doc_id", extension)
    return docs.select(F.col("doc_id").alias("docid"), F.col("source").alias("package"), version.alias("version"), path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("bigint").alias("size"))


def from_tree(spark: SparkSession, folder: str, trim: str = "", ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, content BINARY, size) of all regular files below a folder, ``trim`` taken off the paths; contents are read only if used.

    Whole subtrees of the ``ignored`` folder names are skipped: the condition is on the path, which the source filters before it opens a file.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", r"^file:/*", "/")
    path = F.when(path.startswith(trim), F.substr(path, F.lit(len(trim) + 1))).otherwise(path) if trim else path
    if ignored:
        found = found.where(~F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, ignored))))
    return found.select(path.alias("path"), "content", F.col("length").alias("size"))


def admitted(files: DataFrame, n_trigrams: Column) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected with their ``rejection``) of files with path, content and size."""
    judged = files.withColumn("rejection", F.coalesce(path_rejection(F.col("path"), F.col("size")), content_rejection(F.col("content"), n_trigrams)))
    return judged.where("rejection IS NULL").drop("rejection"), judged.where("rejection IS NOT NULL")


def packages(files: DataFrame) -> DataFrame:
    """(release): the sorted list of what the corpus holds, without unfinished uploads (.tmp)."""
    release = F.substring_index("path", "/", 1)
    return files.where(~release.endswith(".tmp")).select(release.alias("release")).distinct().orderBy("release")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_rejection(path: Column, size: Column) -> Column:
    """Why a file isn't admitted by its path and size, null if it is."""
    name = file_name(path)
    suffix = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return (
        F.when(~F.is_valid_utf8(path), "illegal UTF-8")
        .when(F.instr(path, "\n") > 0, "newline in path")
        .when(F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS))), "directory")
        .when(size > MOST_BYTES, "too large")
        .when(name.isin(*SKIPPED_NAMES), "file name")
        .when(name.rlike(r"^.+\.[0-9]$"), "manual page")
        .when(suffix.isin(*SKIPPED_SUFFIXES) & ~F.lower(name).startswith("cmakelists.txt"), "suffix")
        .when((size > MOST_SMALL) & suffix.isin(*SMALL_SUFFIXES), "large for its suffix")
    )


def content_rejection(content: Column, n_trigrams: Column) -> Column:
    """Why a text isn't admitted by its content, null if it is; a line's length counts its newline."""
    lines = F.split(content, "\n")
    last = F.octet_length(F.element_at(lines, -1))
    inner = F.array_max(F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.octet_length))
    return (
        F.when(F.octet_length(content) < LEAST_BYTES, "too short")
        .when(F.octet_length(content) > MOST_BYTES, "too large")
        .when((F.coalesce(inner, F.lit(0)) + 1 > MOST_LINE) | (last > MOST_LINE), "long line")
        .when(F.decode(content.cast("binary"), "ISO-8859-1").rlike(_ILLEGAL_PAIR), "illegal UTF-8")
        .when(n_trigrams > MOST_TRIGRAMS, "too many trigrams")
    )


def shard_of(package: Column, shards: int) -> Column:
    """The shard of a package: the first 48 bits of its MD5, modulo."""
    return (F.conv(F.substring(F.md5(package), 1, 12), 16, 10).cast("bigint") % shards).cast("int")


def fed(package: Column) -> Column:
    """Whether a package is worth feeding; data packages aren't."""
    return ~(package.endswith("-data") | (package == "kicad-packages3d") | package.startswith("sagemath-database-"))
