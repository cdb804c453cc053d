import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import grep as G
from quarry.operators import lifecycle, popularity, postings, ranking, results
from quarry.plans.keywords import Search, file_filter, rewrite
from quarry.search import plan, search
from quarry.sources import control, corpus

FILES = "docid bigint, path string, content string"


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        (0, "alpha_1.0-1/main.c", "int main() {\n  return zero;\n}\n"), (1, "alpha_1.1-1/main.c", "int main() {\n  return some_zero;\n}"),
        (2, "beta_2.0-1/lib/zero.py", "def zero():\n    return 0\n\nprint(zero())\n"), (3, "gamma_0.1-1/x.txt", ""), (4, "gamma_0.1-1/y.txt", "ab"),
        (5, "beta_2.0-1/uni.py", "größe = 'zero é'\r\nzero"), (6, "delta_1.0-1/n.c", None),
    ]
    return spark.createDataFrame(rows, FILES).cache()


def _ids(df):
    return sorted(r.docid for r in df.collect())


def test_context(spark):
    text = "one\ntwo\nthree\nfour\nfive"
    rows = {r.line: r for r in G.grep(spark.createDataFrame([(1, text)], "docid bigint, content string"), "o").collect()}
    assert [rows[1][c] for c in ("ctxp2", "ctxp1", "context", "ctxn1", "ctxn2")] == ["", "", "one", "two", "three"]
    assert [rows[4][c] for c in ("ctxp2", "ctxp1", "context", "ctxn1", "ctxn2")] == ["two", "three", "four", "five", ""]


def test_context_of_long_lines(spark):
    text = ("x" * 1000 + "\n") * 2000 + "needle"
    row = G.grep(spark.createDataFrame([(1, text)], "docid bigint, content string"), "needle").first()
    assert (row.line, row.context, row.ctxn1, len(row.ctxp1)) == (2001, "needle", "", 1000)


def test_grep_counts_a_line_once(files):
    rows = G.grep(files, "zero").collect()
    assert sorted((r.docid, r.line) for r in rows) == [(0, 2), (1, 2), (2, 1), (2, 4), (5, 1), (5, 2)]


def test_search_is_the_same_with_an_index(files):
    index = postings.postings(files)
    for text, literal in (("zero", False), ("zero", True), ("z[a-e]ro", False), ("ret.*zero", False), ("(?i)ZERO filetype:python", False), ("ab", True), ("größe", True), ("zero -path:lib", False), ("nothing", False)):
        a = search(files, text, literal=literal).orderBy(*ranking.total_order()).collect()
        b = search(files, text, literal=literal, index=index).orderBy(*ranking.total_order()).collect()
        assert a == b, text


def test_candidates_are_a_superset_of_hits(files):
    index = postings.postings(files)
    for text in ("zero", "ret.*zero", "(int|def) \\w+", "(?i)PRINT"):
        node, trigrams = plan(text)[1:]
        assert set(_ids(G.grep(files, text))) <= set(_ids(postings.candidates(index, trigrams, files)))


def test_postings(spark):
    rows = [(0, ""), (1, "abcabc"), (2, "größer"), (3, None), (4, "ab"), (None, "abcd")]
    found = {(r.docid, r.trigram): r.positions for r in postings.postings(spark.createDataFrame(rows, "docid bigint, content string")).collect()}
    want = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 2):
            if i is not None:
                want.setdefault((i, postings.trigram_code(raw[p : p + 3])), []).append(p)
    assert found == want


def test_posting_sets(spark):
    names = ["", "Source Code Search", "Source Code Project Hosting", "Source Web Search"]
    index = postings.postings(spark.createDataFrame(list(enumerate(names)), "docid bigint, content string"))
    assert _ids(postings.posting_list(index, b"Sea")) == [1, 3] and _ids(postings.posting_list(index, b"Sou")) == [1, 2, 3]
    deltas = postings.posting_deltas(index, b"Sou").orderBy("docid").collect()
    assert [r.delta for r in deltas] == [1, 1, 1]
    every = spark.createDataFrame(list(enumerate(names)), "docid bigint, content string")
    assert _ids(postings.candidates(index, plan("Sea.*(Web|Pro)")[2], every)) == [3]


def test_phrases_across_sources(spark):
    sources = [("s1", ["abc def ghi", "abc jkl mno"]), ("s2", ["pqr stu abc def", "vwx yz ghi"]), ("s3", ["abc def ghi jkl"])]
    rows = [(s, i, t) for s, texts in sources for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "source string, docid bigint, content string")
    local = postings.postings(files.select(F.struct("source", "docid").alias("docid"), "content"))
    local = local.select(F.col("docid.source").alias("source"), "trigram", F.col("docid.docid").alias("docid"), "n", "positions")
    sizes = spark.createDataFrame([("s0", 0), *((s, len(t)) for s, t in sources)], "source string, n_docs bigint")
    index = postings.concatenate(local, sizes).cache()
    place = lambda q: sorted((r.docid, r.pos) for r in postings.phrase_positions(index, q).collect())
    assert place(b"abc ") == [(0, 0), (1, 0), (2, 8), (4, 0)] and place(b" def") == [(0, 3), (2, 11), (4, 3)]


def test_positions_skip_blanks(spark):
    index = postings.postings(spark.createDataFrame([(1, "a   b")], "docid bigint, content string"))
    assert postings.positions_of(index, b"   ").count() == 0 and postings.positions_of(index, b"a  ").count() == 1


def test_verified_positions(spark):
    files = spark.createDataFrame([(1, "abcXXXxyz abcdefxyz"), (2, "éabcdefxyz")], "docid bigint, content string")
    found = postings.verified(postings.phrase_positions(postings.postings(files), b"abcdefxyz"), files, b"abcdefxyz")
    assert sorted(map(tuple, found.collect())) == [(1, 10), (2, 2)]
    assert [r.line for r in G.with_context(found.where("docid = 1"), files).collect()] == [1]


def test_override(spark):
    old = spark.createDataFrame([(p, "old") for p in ("/a/x", "/a/y", "/b/xx", "/b/z", "/c/ab")], "path string, origin string")
    new = spark.createDataFrame([(p, "new") for p in ("/b/www", "/b/xx", "/cc")], "path string, origin string")
    merged = postings.override(old, new, spark.createDataFrame([("/b",), ("/cc",)], "root string"))
    assert sorted(map(tuple, merged.collect())) == [("/a/x", "old"), ("/a/y", "old"), ("/b/www", "new"), ("/b/xx", "new"), ("/c/ab", "old"), ("/cc", "new")]


def test_admission(spark):
    cases = {
        "p_1/a.c": None, "p_1/.git/a.c": "directory", "p_1/NEWS": "file name", "p_1/x.1": "manual page", "p_1/x.xml": "suffix", "p_1/CMakeLists.txt.xml": None,
        "p_1/b\n.c": "newline in path", "p_1/d.json": None, "p_1/.1": None,
    }
    rows = spark.createDataFrame([(p, 10) for p in cases], "path string, size bigint").select("path", corpus.path_rejection(F.col("path"), F.col("size")).alias("r")).collect()
    assert {r.path: r.r for r in rows} == cases
    big = spark.createDataFrame([("a/d.json", 70_000), ("a/d.c", 70_000), ("a/d.c2", 2 << 30)], "path string, size bigint").select(corpus.path_rejection(F.col("path"), F.col("size")).alias("r")).collect()
    assert [r.r for r in big] == ["large for its suffix", None, "too large"]
    texts = {"ab": "too short", "abc": None, "x" * 2000: None, "x" * 2000 + "\n": "long line", "x" * 1999 + "\n": None, "x" * 2001: "long line"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corpus.content_rejection(F.col("t"), F.lit(5)).alias("r")).collect()
    assert {r.t: r.r for r in rows} == texts


def test_filters(spark, files):
    kept = lambda q: _ids(files.where(file_filter(rewrite(q), F.col("path"))))
    assert kept("x package:alpha") == [0, 1] and kept("x package:^beta$ filetype:python") == [2, 5] and kept("x filetype:unknown") == [0, 1, 2, 3, 4, 5, 6]
    assert kept("x -filetype:c -package:beta") == [3, 4] and kept("x path:zero") == [2]
    with pytest.raises(ValueError):
        kept("x package:(")


def test_ranks(spark):
    row = spark.createDataFrame([("alpha_1/zero.c", "    zero = 1")], "path string, line string")
    m = row.select(ranking.name_match("zero", F.col("path")).alias("p"), ranking.line_match("zero", F.col("line")).alias("l"), ranking.name_match("lph", F.col("path")).alias("q"), ranking.name_match("no", F.col("path")).alias("n")).first()
    assert m.p == pytest.approx(0.75 + 0.25 * (1 - 8 / 14)) and m.l == pytest.approx(0.96 * (0.75 + 0.25 * (1 - 4 / 12)))
    assert m.q == pytest.approx(0.5 + 0.25 * (1 - 1 / 14)) and m.n == 0.5


def test_pages_and_groups(spark, files):
    ranked = search(files, "zero").cache()
    assert results.page(ranked, 1, 4).count() == 2 and results.page(ranked, 2, 4).count() == 0
    assert [r.asDict() for r in results.page_counts(ranked).collect()] == [{"results": 6, "pages": 1, "packages": 3, "package_pages": 1}]
    groups = results.per_package(ranked).collect()
    assert all(len(g.results) <= 2 and [x.rank for x in g.results] == sorted((x.rank for x in g.results), reverse=True) for g in groups)
    newest = results.newest_only(ranked, files.withColumn("package", T.package_of(F.col("path"))).withColumn("version", F.regexp_extract("path", "_([^/]*)/", 1)))
    assert _ids(newest) == [1, 2, 2, 5, 5]
    assert {r.value[:11] for r in results.as_json(results.api_rows(ranked)).collect()} == {'{"package":'}
    assert results.top(ranked).count() == 6


def test_late_pages(spark):
    """A late page is what a sort of all gives, whatever ties; its plan sorts only what shares its place."""
    rows = [(f"p_{i % 7}/f{i // 3}" if i % 50 else None, i % 3, "c", None if i % 97 == 0 else float(i % 4 if i < 400 else i % 90)) for i in range(1000)]
    ranked = spark.createDataFrame(rows, "path string, line int, context string, rank double").repartition(4).cache()
    want = [tuple(r) for r in ranked.orderBy(*ranking.total_order()).collect()]
    for size, numbers in ((10, (0, 9, 10, 11, 37, 98, 99, 100)), (333, (0, 1, 3)), (7, (142, 143))):
        for number in numbers:
            assert [tuple(r) for r in results.page(ranked, number, size).collect()] == want[number * size : number * size + size]
    with results.places(ranked) as counts:
        assert results.pages(counts) == 100 and results.page(ranked, 500, counts=counts).count() == 0
        plan = results.page(ranked, 99, counts=counts)._jdf.queryExecution().optimizedPlan().toString()
        skipped = [int(n) for n in re.findall(r"Offset (\d+)", plan)]
        assert all(n < 50 for n in skipped) and "rank" in plan.split("Filter")[1]
    none = ranked.where("line > 5")
    assert results.checked_page(none, 0).count() == 0


def test_hits_are_not_gathered_by_package(spark, files):
    popular = spark.range(3).select(F.concat(F.lit("p"), "id").alias("package"), F.lit(1.0).alias("inst"), F.lit(0.5).alias("rdep"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = ranking.rank_files(files.select("docid", "path"), popular.groupBy("package").agg(F.max("inst").alias("inst"), F.max("rdep").alias("rdep")), rewrite("zero"))
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scalar_functions(spark):
    row = spark.createDataFrame([("<a href='x'>&\"", "a.tar.gz", "x.tar.gz.asc", "libfoo")], "h string, t string, u string, s string")
    out = row.select(T.html_escape(F.col("h")).alias("h"), T.is_tar(F.col("t")).alias("t"), T.is_tar(F.col("u")).alias("u"), T.pool_folder(F.col("s")).alias("s"), T.extension(F.lit("a.b/c.PY")).alias("e"), T.human_bytes(F.lit(1536)).alias("k"), T.human_bytes(F.lit(5 << 40)).alias("g"), T.leading_spaces(F.lit("\t  x")).alias("n")).first()
    assert tuple(out) == ("&lt;a href=&#39;x&#39;&gt;&amp;&#34;", True, False, "libf", ".py", "1.5 K", "5120.0 G", 3)


def test_popularity(spark):
    lines = spark.createDataFrame([("Package: foo 1 2 3 4",), ("Package: foo:amd64 1 1 1 1",), ("Package: bar 1 0 0 0",), ("Vendor: x 1 1 1 1",), ("Package: b!d 1 1 1 1",), ("Package: short 1",)], "value string")
    counts = control.installation_counts(lines)
    assert sorted(map(tuple, counts.collect())) == [("bar", 1), ("foo", 14)]
    owners = spark.createDataFrame([("foo", "src-foo")], "binary string, source string")
    inst = popularity.installations(counts, owners)
    assert [tuple(r) for r in inst.collect()] == [("src-foo", 1000.0)]
    texts = spark.createDataFrame([("Package: a\nDepends: foo (>= 1), bar | foo:any,\n baz\nX: 1",), ("Package: b\nSuggests: foo",), ("",)], "value string")
    packages = control.parse_paragraphs(texts).select(*[F.col("fields")[n].alias(n) for n in ("Package", *popularity.DEPENDENCIES)])
    reverse = popularity.reverse_dependencies(packages)
    assert sorted(map(tuple, reverse.collect())) == [("bar", 1), ("baz", 1), ("foo", 2)]
    sources = spark.createDataFrame([("src-foo", "foo, other"), ("src-none", "none")], "package string, binaries string")
    assert sorted(map(tuple, popularity.package_ranking(sources, inst, reverse).collect())) == [("src-foo", 1000.0, round(1 - 1 / 3, 6)), ("src-none", 0.0, 0.0)]


def test_reconciliation(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("abc", "bcd"))
    keys = lambda df: sorted(r.k for r in df.collect())
    assert keys(lifecycle.missing(a, b, "k")) == ["a"] and keys(lifecycle.confirmed(a, b, "k")) == ["b", "c"] and keys(lifecycle.garbage(b, a, "k")) == ["d"]


def test_merge_triggers(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s)) for s in (0, 60, 119, 300)] + [("b", start + dt.timedelta(seconds=90 * i)) for i in range(10)]
    out = lifecycle.merge_triggers(spark.createDataFrame(rows, "shard string, ts timestamp"))
    assert sorted((r.shard, r.requests, (r.fires - start).seconds) for r in out.collect()) == [("a", 1, 420), ("a", 3, 239), ("b", 3, 930), ("b", 7, 600)]


def test_tree_source(spark, tmp_path):
    (tmp_path / "p_1" / "sub").mkdir(parents=True)
    (tmp_path / "p_1" / "sub" / "a.c").write_bytes(b"int x;\n")
    rows = corpus.from_tree(spark, str(tmp_path), trim=f"{tmp_path}/").collect()
    assert [(r.path, bytes(r.content), r.size) for r in rows] == [("p_1/sub/a.c", b"int x;\n", 7)]


def test_written_index(spark, files, tmp_path):
    postings.write_index(files, str(tmp_path / "ix"), 2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "ix")).collect())) == sorted(map(tuple, postings.postings(files).collect()))


def test_an_index_is_written_without_moving_it(spark, files, tmp_path):
    """In runs that are sorted by trigram and hold the same postings, wherever batches end; the plan has no exchange."""
    many = spark.createDataFrame([(i, None if i % 40 == 7 else ("", "a", "ab", "abc é", "zero " * 30, "x" * 700)[i % 6] + str(i)[: i % 3]) for i in range(300)], "docid bigint, content string")
    want = sorted(map(tuple, postings.postings(many).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (1, 500, 5000, postings.RUN):
            assert sorted(map(tuple, postings.runs(many.coalesce(1), most).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = [(r.trigram, r.docid) for r in postings.runs(many.coalesce(1)).collect()]
    assert keys == sorted(keys)
    assert "Exchange" not in postings.runs(many)._jdf.queryExecution().executedPlan().toString()
    postings.write_index(files, str(tmp_path / "ix"))
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = {store.apply(i).executionId(): store.apply(i).physicalPlanDescription() for i in range(store.size())}
    assert "parquet" in plans[max(plans)].lower() and "Exchange" not in plans[max(plans)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "ix")).collect())) == sorted(map(tuple, postings.postings(files).collect()))


def test_streams(spark, files, tmp_path):
    from quarry.streaming import ingest

    files.where("content IS NOT NULL").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "ix")).collect())) == sorted(map(tuple, postings.postings(files).collect()))

    start = dt.datetime(2024, 1, 1)
    for i, seconds in enumerate(((0, 60), (400, 1000), (5000,))):
        spark.createDataFrame([("a", start + dt.timedelta(seconds=s)) for s in seconds], "shard string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("shard string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    q = ingest.merge_triggers(events).writeStream.format("memory").queryName("merges").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.requests, (r["first"] - start).seconds) for r in spark.table("merges").collect()) == [(1, 400), (1, 1000), (2, 0)]


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], FILES)
    assert search(none, "abc").count() == 0 and postings.postings(none).count() == 0
    null = spark.createDataFrame([(1, None, "abc"), (2, "a_1/x", None)], FILES)
    assert search(null, "abc").count() == 1 and Search("x").get("path") == []


def test_queries_have_sql():
    import __spark_entry__ as entry

    from quarry.queries import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
