"""The engine's queries over the driver's tables, each with its DuckDB twin.

The corpus is the table ``documents`` (see :func:`quarry.sources.corpus.from_documents`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.versions import sort_key, version_struct, version_text
from .operators import grep as G
from .operators import lifecycle, popularity, postings, ranking, results, store
from .plans.keywords import Search, file_filter, rewrite
from .search import plan, search
from .sources import control, corpus

#: Expressions that the queries use.
WORD, CLASS, FOLDED, LITERAL, REGEXP = "thing", r"[aeiou]nth\b", "(?i)THING", "attion th", "th(ing|tion) .*ble"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_documents(table(spark, sf_dir, "documents"))


def package_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for the tables of installations and dependencies: (package, inst, rdep), from the documents' own counts."""
    counted = corpus_files(spark, sf_dir).groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    inst = popularity.normalised(counted, "package", "n")
    return inst.join(counted, "package").select("package", "inst", F.round(popularity.dependence(F.col("n")), 6).alias("rdep"))


_FILES = """files AS (
  SELECT doc_id AS docid, source AS package, '1.' || (doc_id % 3) || '-1' AS version, text AS content, strlen(text) AS size,
         source || '_1.' || (doc_id % 3) || '-1/' || lang || '/doc' || doc_id || CASE lang WHEN 'en' THEN '.c' WHEN 'de' THEN '.py' WHEN 'fr' THEN '.pl' WHEN 'es' THEN '.go' ELSE '.txt' END AS path
  FROM documents WHERE text IS NOT NULL)"""
_LINES = """parts AS (
  SELECT docid, path, content, unnest(string_split(content, chr(10))) AS context, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files),
lines AS (
  SELECT docid, path, line, context, coalesce(lag(context, 2) OVER w, '') AS ctxp2, coalesce(lag(context) OVER w, '') AS ctxp1,
         coalesce(lead(context) OVER w, '') AS ctxn1, coalesce(lead(context, 2) OVER w, '') AS ctxn2
  FROM (SELECT *, count(*) OVER (PARTITION BY docid) AS n FROM parts) WHERE NOT (context = '' AND line = n AND n > 1)
  WINDOW w AS (PARTITION BY docid ORDER BY line))"""
_GREP_COLUMNS = "docid, path, line::INT AS line, ctxp2, ctxp1, context, ctxn1, ctxn2"
_POSTINGS = """bytes AS (SELECT docid, unnest(h) AS b, (generate_subscripts(h, 1) - 1)::INT AS pos FROM (SELECT docid, regexp_extract_all(hex(encode(content)), '..') AS h FROM files)),
places AS (SELECT * FROM (SELECT docid, pos, b || lead(b) OVER w || lead(b, 2) OVER w AS t FROM bytes WINDOW w AS (PARTITION BY docid ORDER BY pos)) WHERE t IS NOT NULL)"""


def _hex(text: str) -> str:
    return text.encode().hex().upper()


def _code(t: str) -> str:
    return f"('0x' || {t})::INT"


def _filters(name: str, keyword: str, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = corpus_files(spark, sf_dir)
        return files.where(file_filter(rewrite(f"x {keyword}"), F.col("path"))).select("docid", "path")

    run.__name__ = name
    query(f"WITH {_FILES} SELECT docid, path FROM files WHERE {condition}")(run)


# --- lines -------------------------------------------------------------------


def _grep_query(name: str, pattern: str, condition: str, literal: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return G.grep(corpus_files(spark, sf_dir).select("docid", "path", "content"), pattern, literal)

    run.__name__ = name
    query(f"WITH {_FILES}, {_LINES} SELECT {_GREP_COLUMNS} FROM lines WHERE {condition}")(run)


_grep_query("grep_regexp", CLASS, f"regexp_matches(context, '{CLASS}')")
_grep_query("grep_literal", LITERAL, f"contains(context, '{LITERAL}')", literal=True)
_grep_query("grep_ignorecase", FOLDED, f"regexp_matches(context, '{FOLDED}')")
_grep_query("grep_text_start", r"^[A-Z]\w+ ", r"line = 1 AND regexp_matches(context, '^[A-Z]\w+ ')")
_grep_query("grep_line_anchors", r"(?m)^\w+$", r"regexp_matches(context, '^\w+$')")


@query(f"WITH {_FILES}, {_LINES} SELECT line::INT AS line, context AS text FROM lines WHERE path = (SELECT min(path) FROM files)")
def show_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir)
    first = files.agg(F.min("path")).first()[0]
    return G.show_file(files, first)


@query(f"""WITH {_FILES}, {_LINES} SELECT docid, line::INT AS line, replace(replace(replace(replace(replace(context, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&#39;'), '"', '&#34;') AS escaped FROM lines""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_files(spark, sf_dir).where("content IS NOT NULL").select("docid", F.posexplode(G.text_lines(F.col("content"))).alias("i", "context"))
    return rows.select("docid", (F.col("i") + 1).alias("line"), T.html_escape(F.col("context")).alias("escaped"))


# --- filters -------------------------------------------------------------------

_filters("filter_package", "package:1$", "regexp_matches(package, '1$')")
_filters("filter_npackage", "-package:[02468]$", "NOT regexp_matches(package, '[02468]$')")
_filters("filter_path", "path:/de/", "contains(path, '/de/')")
_filters("filter_npath", "-path:doc[0-4]", "NOT regexp_matches(path, 'doc[0-4]')")
_filters("filter_nfile", "-file:/en/.*7", "NOT regexp_matches(path, '/en/.*7')")
_filters("filter_filetype", "filetype:perl", "regexp_matches(path, '[.](pl|pm|t)$')")
_filters("filter_nfiletype", "-filetype:python", "NOT regexp_matches(path, '[.]py$')")

_PATH_REASON = """CASE WHEN size > 66560 AND regexp_matches(path, '[.](html|json|csv)$') THEN 'large for its suffix' END"""


@query(
    f"""WITH {_FILES}, {_LINES}, {_POSTINGS},
longest AS (SELECT docid, max(strlen(context) + (line < n)::INT) AS longest FROM (SELECT *, count(*) OVER (PARTITION BY docid) AS n FROM parts) GROUP BY docid),
distinct_t AS (SELECT docid, count(DISTINCT t) AS n FROM places GROUP BY docid)
SELECT docid, path, CASE WHEN size < 3 THEN 'too short' WHEN longest > 2000 THEN 'long line' WHEN n > 20000 THEN 'too many trigrams' END AS rejection
FROM files JOIN longest USING (docid) LEFT JOIN distinct_t USING (docid)"""
)
def admission_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir).where("content IS NOT NULL")
    files = files.join(postings.distinct_trigrams(files), "docid")
    by_path = corpus.path_rejection(F.col("path"), F.col("size"))
    return files.select("docid", "path", F.coalesce(by_path, corpus.content_rejection(F.col("content"), F.col("n_trigrams"))).alias("rejection"))


@query(f"""WITH {_FILES} SELECT docid, path, (('0x' || substring(md5(package), 1, 12))::BIGINT % 6)::INT AS shard FROM files""")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_files(spark, sf_dir).where("content IS NOT NULL").select("docid", "path", corpus.shard_of(F.col("package"), 6).alias("shard"))


@query(f"""WITH {_FILES} SELECT (('0x' || substring(md5(package), 1, 12))::BIGINT % 6)::INT AS shard, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1""")
def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir).where("content IS NOT NULL").withColumn("shard", corpus.shard_of(F.col("package"), 6))
    return lifecycle.index_sizes(files, "shard")


# --- the index -------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str, positions: bool = True, wanted: list[bytes] | None = None) -> DataFrame:
    return postings.postings(corpus_files(spark, sf_dir), positions=positions, wanted=wanted)


def _lists(spark: SparkSession, sf_dir: str, positions: bool = True) -> postings.Index:
    """Extracts the trigrams that a query asks for."""
    return lambda wanted: _index(spark, sf_dir, positions, wanted)


def _published(spark: SparkSession, files: DataFrame, name: str) -> str:
    """The folder of an index that is published for this session."""
    folder = f"{store.shared_folder(spark)}/quarry-index/{spark.sparkContext.applicationId}/{name}"
    store.publish_index(files.where("content IS NOT NULL"), folder)
    return folder


@query(f"WITH {_FILES}, {_POSTINGS} SELECT docid, count(DISTINCT t) AS n_trigrams FROM files LEFT JOIN places USING (docid) GROUP BY docid")
def distinct_trigrams_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.distinct_trigrams(corpus_files(spark, sf_dir).where("content IS NOT NULL"))


@query(f"WITH {_FILES}, {_POSTINGS} SELECT {_code('t')} AS trigram, count(DISTINCT docid) AS n_docs, count(*) AS n_pos FROM places GROUP BY t")
def trigram_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.trigram_meta(_index(spark, sf_dir, positions=False))


def _has(text: str) -> str:
    return f"contains(content, '{text}')"


@query(f"WITH {_FILES} SELECT docid FROM files WHERE {_has('ing')}")
def posting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.posting_list(_index(spark, sf_dir, False, [b"ing"]), b"ing")


@query(f"WITH {_FILES} SELECT docid, (docid - coalesce(lag(docid) OVER (ORDER BY docid), 0))::BIGINT AS delta FROM files WHERE {_has('ing')}")
def posting_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.posting_deltas(_index(spark, sf_dir, False, [b"ing"]), b"ing")


@query(f"WITH {_FILES} SELECT docid FROM files WHERE {_has('ing')}")
def posting_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = postings.posting_deltas(_index(spark, sf_dir, False, [b"ing"]), b"ing").withColumnRenamed("docid", "place")
    return postings.decode_deltas(deltas, "place").select("docid")


@query(f"WITH {_FILES}, {_POSTINGS} SELECT docid, pos, pos = min(pos) OVER (PARTITION BY docid) AS new_doc FROM places WHERE t = '{_hex('ing')}'")
def posting_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.positions_of(_index(spark, sf_dir, wanted=[b"ing"]), b"ing")


def _candidate_query(name: str, pattern: str, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = corpus_files(spark, sf_dir).where("content IS NOT NULL")
        return postings.candidates(_lists(spark, sf_dir, False), plan(pattern)[2], files)

    run.__name__ = name
    query(f"WITH {_FILES} SELECT docid FROM files WHERE {condition}")(run)


_candidate_query("posting_and", "thing", f"{_has('thi')} AND {_has('hin')} AND {_has('ing')}")
_candidate_query("posting_or", "(ich|ing)", f"{_has('ich')} OR {_has('ing')}")
_candidate_query("posting_nested", "the.*(ich|ion.*ble)", f"{_has('the')} AND ({_has('ich')} OR ({_has('ion')} AND {_has('ble')}))")
_candidate_query("posting_all", "a.c", "true")
_candidate_query("posting_none", r"[^\s\S]", "false")


@query(f"WITH {_FILES}, {_POSTINGS}, whole AS (SELECT docid, pos, b || {' || '.join(f'lead(b, {k}) OVER w' for k in range(1, len(LITERAL)))} AS t FROM bytes WINDOW w AS (PARTITION BY docid ORDER BY pos)) SELECT docid, pos FROM whole WHERE t = '{_hex(LITERAL)}'")
def positional_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.phrase_positions(_lists(spark, sf_dir), LITERAL.encode())
    return postings.verified(found, corpus_files(spark, sf_dir), LITERAL.encode())


@query(f"WITH {_FILES}, {_LINES} SELECT docid, line::INT AS line, ctxp2, ctxp1, context, ctxn1, ctxn2 FROM lines WHERE {_has(LITERAL).replace('content', 'context')}")
def positional_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_context(positional_phrase(spark, sf_dir), corpus_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT docid, path FROM files WHERE {_has('ing')}")
def docid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.lookup(corpus_files(spark, sf_dir), posting_list(spark, sf_dir))


@query(
    f"""WITH {_FILES}, local AS (SELECT package, content, row_number() OVER (PARTITION BY package ORDER BY docid) - 1 AS docid FROM files),
bases AS (SELECT package, coalesce(sum(count(*)) OVER (ORDER BY package ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM files GROUP BY package)
SELECT (docid + base)::BIGINT AS docid FROM local JOIN bases USING (package) WHERE {_has('ing')}"""
)
def concat_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    files = corpus_files(spark, sf_dir).where("content IS NOT NULL")
    local = files.withColumn("docid", F.row_number().over(Window.partitionBy("package").orderBy("docid")) - 1)
    key = F.struct("package", "docid")
    index = postings.postings(local.select(key.alias("docid"), "content"), positions=False, wanted=[b"ing"]).select(F.col("docid.package").alias("source"), "trigram", F.col("docid.docid").alias("docid"))
    sizes = files.groupBy(F.col("package").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    return postings.concatenate(index.where(F.col("trigram") == postings.trigram_code(b"ing")), sizes).select("docid")


@query(f"""WITH {_FILES} SELECT path, 'new' AS origin FROM files WHERE docid % 3 = 0 UNION ALL SELECT path, 'old' FROM files WHERE docid % 3 <> 0 AND NOT contains(path, '_1.1-1/de')""")
def merge_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All German files of one version are owned by the newer index, which has none of them."""
    files = corpus_files(spark, sf_dir).where("content IS NOT NULL").select("docid", "path", "package")
    roots = files.select(F.explode(F.array(F.concat("package", F.lit("_1.1-1/de")), F.concat("package", F.lit("_1.0-1/")))).alias("root"))
    older, newer = files.select("path", F.lit("old").alias("origin")), files.where("docid % 3 = 0").select("path", F.lit("new").alias("origin"))
    return postings.override(older, newer, roots)


@query(f"WITH {_FILES}, {_POSTINGS} SELECT {_code('t')} AS trigram, list_sort(list(DISTINCT package)) AS sources FROM places JOIN files USING (docid) GROUP BY t")
def trigram_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir).select(F.struct(F.col("docid"), F.col("package")).alias("docid"), "content")
    return postings.sources_of(postings.postings(files, positions=False).select("trigram", F.col("docid.package").alias("source")))


# --- ranking and results -------------------------------------------------------------------

_POPULARITY = """counted AS (SELECT source AS package, count(*) AS n FROM documents GROUP BY source),
popularity AS (SELECT package, round(n / (sum(n) OVER ()) * 1000, 6) AS inst, round(1 - 1 / (n + 1), 6) AS rdep FROM counted)"""


def _name_match(text: str, word: str) -> str:
    before = lambda p: f"strlen(regexp_extract({text}, '(?i)^(.*?){p}', 1)) / greatest(strlen({text}), 1)"
    return f"""(CASE WHEN regexp_matches({text}, '(?i)\\b{word}\\b') THEN 0.75 + 0.25 * (1 - {before(f"{chr(92)}b{word}{chr(92)}b")})
      WHEN regexp_matches({text}, '(?i){word}') THEN 0.5 + 0.25 * (1 - {before(word)}) ELSE 0.5 END)::DOUBLE"""


def _ranked(word: str, condition: str, weight: str = "0", files: str = "true") -> str:
    line = rf"""(CASE WHEN regexp_matches(context, '(?i)\b{word}\b') THEN 0.75 + 0.25 * (1 - strlen(regexp_extract(context, '(?i)^(.*?)\b{word}\b', 1)) / greatest(strlen(context), 1)) ELSE 0.5 END)::DOUBLE"""
    spaces = r"length(regexp_extract(context, '^[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*'))"
    return f"""{_FILES}, {_LINES}, {_POPULARITY},
found AS (SELECT l.*, split_part(path, '_', 1) AS package FROM lines l WHERE ({condition}) AND ({files})),
by_file AS (SELECT f.*, round(1 + {weight} + 0.3840 * coalesce(inst, 0) + 0.3427 * coalesce(rdep, 0) + 0.1460 * {_name_match("path", word)} + 0.0008 * {_name_match("f.package", word)}, 6) AS pathrank,
                   round((1 - {spaces} / 100) * {line}, 6) AS ranking FROM found f LEFT JOIN popularity p ON p.package = f.package),
ranked AS (SELECT *, round(pathrank + (max(pathrank) OVER ()) * 0.1 * ranking, 6) AS rank FROM by_file)"""


_ORDER = "rank DESC, md5(path) DESC, path, line"
_RESULT = "docid, path, line::INT AS line, ctxp2, ctxp1, context, ctxn1, ctxn2, pathrank, ranking, rank"


def _search(spark: SparkSession, sf_dir: str, text: str = WORD, **options) -> DataFrame:
    files = corpus_files(spark, sf_dir)
    return search(files, text, popularity=package_popularity(spark, sf_dir), **options)


def _shown(line: str) -> str:
    return rf"repeat('    ', length(regexp_extract({line}, '^\t*'))) || substring({line}, length(regexp_extract({line}, '^\t*')) + 1)"


def _shown_list(*lines: str) -> str:
    return f"list_filter([{', '.join(f'CASE WHEN trim({x}, chr(32) || chr(9) || chr(13)) <> {chr(39) * 2} THEN {_shown(x)} END' for x in lines)}], lambda x: x IS NOT NULL)"


_HITS = _ranked(WORD, f"contains(context, '{WORD}')")


@query(f"WITH {_HITS} SELECT {_RESULT} FROM ranked")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, index=_lists(spark, sf_dir))


@query(f"WITH {_ranked(WORD, f'''contains(context, '{WORD}')''', weight='0.75', files='''regexp_matches(path, '[.](c|h)$') AND NOT contains(path, '/doc1')''')} SELECT {_RESULT} FROM ranked")
def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, f"filetype:c {WORD} -path:/doc1")


@query(f"WITH {_ranked('zzzz', f'''regexp_matches(context, '{REGEXP}')''')} SELECT docid, line::INT AS line, context FROM ranked")
def search_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, REGEXP, index=_lists(spark, sf_dir, False)).select("docid", "line", "context")


@query(f"WITH {_HITS} SELECT {_RESULT} FROM ranked ORDER BY {_ORDER} LIMIT 10")
def ranked_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.top(_search(spark, sf_dir))


@query(f"WITH {_HITS} SELECT {_RESULT} FROM ranked ORDER BY {_ORDER} LIMIT 10 OFFSET 20")
def page_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.page(_search(spark, sf_dir), 2)


@query(f"WITH {_HITS} SELECT {_RESULT} FROM ranked ORDER BY {_ORDER} LIMIT 10 OFFSET (SELECT (count(*) - 1) // 10 * 10 FROM ranked)")
def page_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page; the one after it is empty, and those beyond raise."""
    ranked = _search(spark, sf_dir)
    with results.places(ranked) as counts:
        end = results.pages(counts)
        for number in (-1, end + 1):
            try:
                results.checked_page(ranked, number, counts=counts)
            except results.NoSuchPage:
                continue
            raise AssertionError(f"there is a page {number}")
        empty = results.checked_page(ranked, end, counts=counts)
        return results.checked_page(ranked, end - 1, counts=counts).unionByName(empty) if end else empty


@query(f"WITH {_HITS} SELECT path, line::INT AS line, {_shown('context')} AS context, {_shown_list('ctxp2', 'ctxp1')} AS before, {_shown_list('ctxn1', 'ctxn2')} AS after FROM ranked")
def shown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.shown_lines(_search(spark, sf_dir))


@query(f"WITH {_HITS} SELECT DISTINCT split_part(path, '/', 1) AS package FROM ranked ORDER BY 1 LIMIT 100")
def first_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.shown_packages(_search(spark, sf_dir))


@query(f"WITH {_HITS} SELECT {_RESULT} FROM ranked")
def search_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search, by an index that is written and published first."""
    folder = _published(spark, corpus_files(spark, sf_dir), "search")
    return _search(spark, sf_dir, index=store.index(spark, folder))


@query(f"WITH {_FILES} SELECT docid, docid % 2 = 0 AS before FROM files WHERE {_has('ing')}")
def index_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of half of the files is published, opened, and replaced by one of them all: the reader that has it open sees its files still, a new one all."""
    files = corpus_files(spark, sf_dir)
    folder = _published(spark, files.where("docid % 2 = 0"), "swap")
    before = postings.posting_list(store.index(spark, folder), b"ing")
    _published(spark, files, "swap")
    after = postings.posting_list(store.index(spark, folder), b"ing")
    return after.join(before.withColumn("before", F.lit(True)), "docid", "left").select("docid", F.coalesce("before", F.lit(False)).alias("before"))


@query(f"WITH {_HITS} SELECT count(*) AS results, ceil(count(*) / 10)::BIGINT AS pages, count(DISTINCT split_part(path, '/', 1)) AS packages, ceil(count(DISTINCT split_part(path, '/', 1)) / 5)::BIGINT AS package_pages FROM ranked")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.page_counts(_search(spark, sf_dir))


@query(f"WITH {_HITS} SELECT split_part(path, '/', 1) AS package, path, line::INT AS line, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY {_ORDER}) <= 2")
def per_package_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.per_package(_search(spark, sf_dir)).select("package", F.inline("results")).select("package", "path", "line", "rank")


@query(f"WITH {_HITS} SELECT split_part(path, '/', 1) AS package, max(rank) AS best FROM ranked GROUP BY 1 ORDER BY best DESC, package LIMIT 5 OFFSET 5")
def package_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.package_page(_search(spark, sf_dir), 1).select("package", "best")


@query(f"WITH {_HITS} SELECT DISTINCT split_part(path, '/', 1) AS package FROM ranked")
def packages_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.packages_with_results(_search(spark, sf_dir))


@query(f"WITH {_HITS} SELECT path, count(*) AS n FROM ranked GROUP BY path")
def occurrences_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.occurrences(_search(spark, sf_dir))


@query(f"WITH {_HITS} SELECT split_part(path, '/', 1) AS package, path, line::INT AS line, list_filter([ctxp2, ctxp1], lambda x: x <> '') AS context_before, context, list_filter([ctxn1, ctxn2], lambda x: x <> '') AS context_after FROM ranked")
def api_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.api_rows(_search(spark, sf_dir))


@query(f"WITH {_FILES} SELECT package, max(version) AS version FROM files GROUP BY package")
def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.newest_versions(corpus_files(spark, sf_dir).where("content IS NOT NULL"))


@query("""WITH v AS (SELECT source, doc_id % 13 AS minor, doc_id % 5 = 0 AS early FROM documents)
SELECT source AS package, '1.' || minor || CASE WHEN early THEN '~rc1' ELSE '' END || '-1' AS version FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY minor DESC, early) = 1""")
def newest_numeric_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.12 is newer than 1.9, and than 1.12~rc1."""
    version = F.concat(F.lit("1."), F.col("doc_id") % 13, F.when(F.col("doc_id") % 5 == 0, "~rc1").otherwise(""), F.lit("-1"))
    return results.newest_versions(table(spark, sf_dir, "documents").select(F.col("source").alias("package"), version.alias("version")))


@query(f"WITH {_HITS} SELECT docid, line::INT AS line FROM ranked r JOIN (SELECT package, max(version) AS version FROM files GROUP BY package) v ON r.path LIKE v.package || '@_' || v.version || '/%' ESCAPE '@'")
def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir).where("content IS NOT NULL")
    return results.newest_only(_search(spark, sf_dir), files).select("docid", "line")


_VERSION = "(doc_id % 3) || ':' || (doc_id % 7) || '.0' || (doc_id % 5) || CASE WHEN doc_id % 2 = 0 THEN '-' || (doc_id % 4) ELSE '' END"


@query(
    f"""WITH v AS (SELECT doc_id % 3 AS e, doc_id % 7 AS a, doc_id % 5 AS b, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 ELSE 0 END AS r, CASE WHEN doc_id % 2 = 0 THEN '-' || (doc_id % 4) ELSE '' END AS rev, doc_id FROM documents)
SELECT doc_id, e AS epoch, a || '.0' || b AS version, ltrim(rev, '-') AS revision, CASE WHEN e > 0 THEN e || ':' ELSE '' END || a || '.0' || b || rev AS shown,
       dense_rank() OVER (ORDER BY e, a, b, r)::INT AS place FROM v"""
)
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions made of ids, parsed, shown and put in order by distinct key."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_VERSION).alias("text"))
    rows = rows.withColumn("v", version_struct(F.col("text"))).withColumn("key", sort_key(F.col("text")))
    order = rows.select("key").distinct().withColumn("place", F.rank().over(Window.partitionBy().orderBy("key")))
    return rows.join(order, "key").select("doc_id", "v.epoch", "v.version", "v.revision", version_text(F.col("v")).alias("shown"), "place")


_PATHRANK = f"round(1 + 0.3840 * coalesce(inst, 0) + 0.3427 * coalesce(rdep, 0) + 0.1460 * {_name_match('path', WORD)} + 0.0008 * {_name_match('f.package', WORD)}, 6)"


@query(f"WITH {_FILES}, {_POPULARITY} SELECT docid, {_PATHRANK} AS pathrank FROM files f LEFT JOIN popularity p ON p.package = f.package")
def rank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir).where("content IS NOT NULL").select("docid", "path")
    return ranking.rank_files(files, package_popularity(spark, sf_dir), rewrite(WORD)).select("docid", "pathrank")


@query(f"WITH {_FILES}, {_POPULARITY} SELECT docid, path, {_PATHRANK} AS pathrank FROM files f LEFT JOIN popularity p ON p.package = f.package WHERE {_has('thi')} AND {_has('hin')} AND {_has('ing')} ORDER BY pathrank DESC, path DESC LIMIT 50")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty candidates that are read first."""
    files = corpus_files(spark, sf_dir).select("docid", "path")
    found = postings.candidates(_lists(spark, sf_dir, False), plan(WORD)[2], files)
    ranked = ranking.rank_files(files.join(found, "docid", "left_semi"), package_popularity(spark, sf_dir), rewrite(WORD))
    return ranked.orderBy(*ranking.candidate_order()).limit(50)


@query(f"WITH {_FILES} SELECT docid, round({_name_match('path', 'doc1')}, 6) AS m FROM files")
def path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_files(spark, sf_dir).where("content IS NOT NULL")
    return files.select("docid", F.round(ranking.name_match("doc1", F.col("path")), 6).alias("m"))


@query("SELECT upper(event_type) AS source, round(count(*) / (SELECT count(*) FROM events WHERE event_type > (SELECT min(event_type) FROM events)) * 1000, 6) AS inst FROM events WHERE event_type > (SELECT min(event_type) FROM events) GROUP BY event_type")
def install_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as binaries; the least has no source package and is dropped before the total."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("binary"), F.lit(1).alias("n")).where("binary IS NOT NULL")
    kinds = events.select("binary").distinct()
    owners = kinds.crossJoin(kinds.agg(F.min("binary").alias("least"))).where("binary > least").select("binary", F.upper("binary").alias("source"))
    return popularity.installations(events, owners)


@query("""WITH named AS (SELECT DISTINCT l_orderkey, 'p' || l_partkey AS name FROM lineitem UNION SELECT DISTINCT l_orderkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber = 1)
SELECT name, count(*) AS n, round(1 - 1 / (count(*) + 1), 6) AS rdep FROM named GROUP BY name""")
def reverse_dep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a package: its parts in Depends and again in Recommends, as alternatives, its first supplier in Suggests, nothing in Enhances."""
    part, supplier = F.concat(F.lit(" p"), "l_partkey", F.lit(" (>= 1)")), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("s"), "l_suppkey", F.lit(":any")))
    lists = [F.array_join(F.collect_list(part), ",").alias("Depends"), F.array_join(F.collect_list(part), " |").alias("Recommends"), F.array_join(F.collect_list(supplier), ", ").alias("Suggests")]
    packages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*lists).withColumn("Enhances", F.lit(None).cast("string"))
    return popularity.reverse_dependencies(packages).withColumn("rdep", F.round(popularity.dependence(F.col("n")), 6))


@query("""WITH orders_of AS (SELECT c_nationkey, c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer),
owned AS (SELECT c_nationkey AS k, c_custkey % 7 AS n FROM customer WHERE c_custkey % 3 <> 0),
inst AS (SELECT k, sum(n) / (SELECT sum(n) FROM owned) * 1000 AS inst FROM owned GROUP BY k),
rdep AS (SELECT c_nationkey AS k, sum(n) AS n FROM orders_of GROUP BY 1)
SELECT n_name AS package, round(coalesce(inst, 0), 6) AS inst, round(1 - 1 / (coalesce(rdep.n, 0) + 1), 6) AS rdep
FROM nation LEFT JOIN inst ON inst.k = n_nationkey LEFT JOIN rdep ON rdep.k = n_nationkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def package_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as source packages, customers as their binaries, orders as what depends on them; one customer of three has no owner."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    binary = F.concat(F.lit("c"), "c_custkey")
    sources = customers.groupBy(F.col("n_name").alias("package")).agg(F.array_join(F.collect_list(binary), ", ").alias("binaries"))
    inst = popularity.installations(customers.select(binary.alias("binary"), (F.col("c_custkey") % 7).alias("n")), customers.where("c_custkey % 3 <> 0").select(binary.alias("binary"), F.col("n_name").alias("source")))
    reverse = popularity.reverse_dependencies(table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey", F.lit(" [amd64]")).alias("Depends")), ("Depends",))
    return popularity.package_ranking(sources, inst, reverse)


@query(f"WITH {_POPULARITY} SELECT package, inst, rdep FROM popularity")
def ranking_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking table written twice, the second time whole, and read as it is published."""
    folder, ranking_table = f"{store.shared_folder(spark)}/quarry-ranking/{spark.sparkContext.applicationId}", package_popularity(spark, sf_dir)
    popularity.write_ranking(ranking_table.limit(1), folder)
    popularity.write_ranking(ranking_table, folder)
    return popularity.read_ranking(spark, folder)


@query("SELECT 's' || s_suppkey AS package, s_name AS maintainer, 'n' || s_nationkey || ', base (>= 1)' AS depends, count(*) OVER () AS paragraphs FROM supplier")
def control_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as paragraphs of a control file, with a continued line, a comment of other case and blank paragraphs, and parsed."""
    text = F.concat(F.lit("Package: s"), "s_suppkey", F.lit("\nMaintainer:  "), "s_name", F.lit("\nDepends: n"), "s_nationkey", F.lit(",\n base (>= 1)\n"))
    rows = table(spark, sf_dir, "supplier").select(F.explode(F.array(text, F.lit(""), F.lit("\n"))).alias("value"))
    fields = control.parse_paragraphs(rows).select(*[F.col("fields")[n].alias(n.lower()) for n in ("Package", "Maintainer", "Depends")])
    total = fields.agg(F.count(F.lit(1)).alias("paragraphs"))
    return fields.select("package", "maintainer", F.regexp_replace("depends", r"\s+", " ").alias("depends")).crossJoin(F.broadcast(total))


@query("SELECT 'p' || (p_partkey % 50) AS binary, sum(p_size + 3)::BIGINT AS n FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1")
def install_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of installation counts, some for an architecture; one of five is no such line, in four ways."""
    name = F.concat(F.lit("p"), F.col("p_partkey") % 50)
    good = F.concat(F.lit("Package: "), name, F.when(F.col("p_partkey") % 2 == 0, ":amd64").otherwise(""), F.lit("   "), "p_size", F.lit(" 1 1 1 "))
    bad = F.element_at(F.array(F.concat(F.lit("Vendor: "), name, F.lit(" 1 1 1 1")), F.concat(F.lit("Package: "), name, F.lit(" 1 1")), F.concat(F.lit("Package: !"), name, F.lit(" 1 1 1 1")), F.concat(F.lit("Package: "), name, F.lit(" x 1 1 1"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return control.installation_counts(table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 != 0, good).otherwise(bad).alias("value")))


_NAMED = """CASE doc_id % 6 WHEN 0 THEN 'pkg' || doc_id || '-data' WHEN 1 THEN 'lib' || source WHEN 2 THEN 'sagemath-database-' || doc_id WHEN 3 THEN 'kicad-packages3d' WHEN 4 THEN 'kicad-packages3d-' || doc_id ELSE source END"""


@query(f"SELECT doc_id, {_NAMED} AS package, doc_id % 6 NOT IN (0, 2, 3) AS fed FROM documents")
def feed_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_NAMED).alias("package"))
    return rows.select("doc_id", "package", corpus.fed(F.col("package")).alias("fed"))


@query(f"SELECT doc_id, CASE WHEN starts_with(p, 'lib') THEN substring(p, 1, 4) ELSE substring(p, 1, 1) END || '/' || p AS folder FROM (SELECT doc_id, {_NAMED} AS p FROM documents)")
def pool_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_NAMED).alias("p"))
    return rows.select("doc_id", F.concat(T.pool_folder(F.col("p")), F.lit("/"), "p").alias("folder"))


_ARCHIVES = ("a.tar.gz", "b.tar.xz", "c.tar.bz2", "d.tar.lz", "e.tar.gz.asc", "f.tgz", "g.tar.Z", "h.tar.xz.tar.gz", "tar.gz", "i.tar.")
_PATHS = ("src/a.c", "a\nb.c", ".git/x.c", "x/.pc/y.c", "COPYING", "doc/foo.1", "po/x.dic", "CMakeLists.txt.xml", "y.xml", "big.json", "small.json", "libtool.m4/z.c")
_REASONS = (None, "newline in path", "directory", "directory", "file name", "manual page", "suffix", None, "suffix", "large for its suffix", None, "directory")


def _choice(values: tuple, sql: bool) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values]
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


@query(f"SELECT doc_id, {_choice(_ARCHIVES, True)} AS name, doc_id % {len(_ARCHIVES)} < 4 AS archive FROM documents")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_choice(_ARCHIVES, False)).alias("name"))
    return rows.select("doc_id", "name", T.is_tar(F.col("name")).alias("archive"))


@query(f"SELECT doc_id, {_choice(_REASONS, True)} AS rejection FROM documents")
def admission_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reason for which a path isn't admitted, and near misses."""
    path = F.expr(_choice(_PATHS, False))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.when(F.col("doc_id") % len(_PATHS) == 9, 70_000).otherwise(10).alias("size"))
    return rows.select("doc_id", corpus.path_rejection(F.col("path"), F.col("size")).alias("rejection"))


@query(f"WITH {_FILES} SELECT DISTINCT split_part(path, '/', 1) AS release FROM files")
def package_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.packages(corpus_files(spark, sf_dir).where("content IS NOT NULL"))


@query("SELECT human, count(*) AS n FROM (SELECT CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f K', n / 1024) END AS human FROM (SELECT strlen(text) AS n FROM documents WHERE text IS NOT NULL)) GROUP BY human")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(T.human_bytes(F.octet_length("text")).alias("human")).agg(F.count(F.lit(1)).alias("n"))


# --- lifecycle -------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def reconcile_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def reconcile_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.confirmed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def reconcile_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "documents").where("lang = 'en'")
    return lifecycle.garbage(table(spark, sf_dir, "labels").select("doc_id"), wanted, "doc_id")


@query(
    """WITH RECURSIVE r AS (SELECT event_type AS shard, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
walk AS (
  SELECT shard, n, ts, ts AS began FROM r WHERE n = 1
  UNION ALL
  SELECT r.shard, r.n, r.ts, CASE WHEN r.ts - w.ts >= INTERVAL 120 SECONDS OR r.ts - w.began >= INTERVAL 600 SECONDS THEN r.ts ELSE w.began END
  FROM walk w JOIN r ON r.shard = w.shard AND r.n = w.n + 1)
SELECT shard, count(*) AS requests, began AS first, max(ts) AS last, least(max(ts) + INTERVAL 120 SECONDS, began + INTERVAL 600 SECONDS) AS fires FROM walk GROUP BY shard, began"""
)
def merge_trigger_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.merge_triggers(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_events(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS seq FROM events")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "seq")


_BOUNDS = " ".join(f"WHEN v <= {b} THEN {i}" for i, b in enumerate(lifecycle.BUCKETS))


@query(f"SELECT (CASE {_BOUNDS} ELSE {len(lifecycle.BUCKETS)} END)::INT AS bucket, count(*) AS n, round(sum(v), 3) AS total FROM (SELECT value AS v FROM events WHERE value IS NOT NULL) GROUP BY 1")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.histogram(table(spark, sf_dir, "events"), "value")
