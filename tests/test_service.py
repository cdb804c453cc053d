"""Published indexes, the session of searches, and the command line."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from quarry import __main__ as cli
from quarry.functions import re2
from quarry.operators import grep as G
from quarry.operators import lifecycle, popularity, postings, results, store
from quarry.session import Running, Session, Throttle
from quarry.sources import corpus
from quarry.streaming.ingest import joined

FILES = "docid bigint, path string, content string"


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, f"alpha_{i % 2}/f{i}.c", f"int zero_{i};\n\tfind me {i}\n") for i in range(20)]
    return spark.createDataFrame(rows, FILES).cache()


def test_a_failed_publication_leaves_the_former_version(spark, files, tmp_path):
    folder = str(tmp_path / "ix")
    with pytest.raises(FileNotFoundError):
        store.current(spark, folder)
    first = store.publish_index(files.where("docid < 5"), folder, 1)
    reader = store.index(spark, folder)

    def fail(path):
        files.write.parquet(f"{path}/files")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.publish(spark, folder, fail)
    assert store.current(spark, folder) == first and store.files(spark, folder).count() == 5
    second = store.publish_index(files, folder, 1)
    assert store.current(spark, folder) == second and store.files(spark, folder).count() == 20
    assert reader.select("docid").distinct().count() == 5  # what was open before the swap is still there
    store.publish_index(files, folder, 1)
    assert first not in {f"{folder}/{v}" for v in store._versions(spark, folder)} and len(store._versions(spark, folder)) == 2
    sizes = store.sizes(spark, folder).collect()
    assert sum(r.current for r in sizes) == 2 and all(r.bytes > 0 for r in sizes)


def test_a_written_index_is_sorted_and_pruned(spark, files, tmp_path):
    folder = str(tmp_path / "ix")
    store.publish_index(files, folder, 1)
    rows = [(r.trigram, r.docid) for r in store.index(spark, folder).select("trigram", "docid").collect()]
    assert rows == sorted(rows)
    plan = postings.listed(store.index(spark, folder), [b"zer", b"ero"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(trigram" in plan
    alone = postings.listed(lambda wanted: postings.postings(files, wanted=wanted), [b"zer"])
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, postings.listed(postings.postings(files), [b"zer"]).collect()))


def test_a_search_by_a_published_index_moves_no_postings(spark, files, tmp_path):
    from quarry.search import search

    store_of = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = {store_of().apply(i).executionId() for i in range(store_of().size())}
    store.publish_index(files, str(tmp_path / "ix"))
    found = search(files, "zero_1", index=store.index(spark, str(tmp_path / "ix"))).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, search(files, "zero_1").collect())) and len(found) == 11
    runs = [store_of().apply(i) for i in range(store_of().size())]
    plans = [x.physicalPlanDescription() for x in runs if x.executionId() not in before]
    assert plans and not any("rangepartitioning" in p for p in plans)


def test_ranking_table(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5, 0.25), ("b", 0.0, 0.5)], "package string, inst double, rdep double")
    popularity.write_ranking(table, str(tmp_path / "r"))
    assert sorted(map(tuple, popularity.read_ranking(spark, str(tmp_path / "r")).collect())) == [("a", 1.5, 0.25), ("b", 0.0, 0.5)]


def test_pages_beyond_the_last(files):
    from quarry.search import search

    ranked = search(files, "zero_1")
    assert results.checked_page(ranked, 1).count() == 1 and results.checked_page(ranked, 2).count() == 0
    for number in (-1, 3):
        with pytest.raises(results.NoSuchPage):
            results.checked_page(ranked, number)
    assert {r.before[-1][:8] for r in results.shown_lines(search(files, "zero_2").withColumn("ctxp1", F.lit("\t\tx\ty"))).collect()} == {"        "}
    assert results.shown_packages(ranked, 1).count() == 1


def test_grep_with_clashing_columns(spark, files):
    clash = files.withColumns({"lines": F.lit(1), "ended": F.lit(2), "line": F.lit(3), "row": F.lit(4)})
    rows = G.grep(clash, "find me 7").collect()
    assert [(r.line, r["lines"], r["ended"], r["row"]) for r in rows] == [(2, 1, 2, 4)] and G.grep(clash, "zero").columns.count("line") == 1
    for path in ("/etc/passwd", "alpha_0/../../x"):
        with pytest.raises(ValueError):
            G.show_file(files, path)


def test_session(spark, files):
    now = [0.0]
    session = Session(files, index=postings.postings(files), keep=100, most=2, clock=lambda: now[0])
    a = session.ask("zero_1").wait(120)
    assert a.found == 11 and a.error is None and session.ask("zero_1") is a and a.page(0).count() == 10
    now[0] = 101
    b = session.ask("zero_1").wait(120)
    assert b is not a and b.found == 11
    session.ask("zero_2").wait(120)
    session.ask("zero_3").wait(120)
    assert len(session.known) <= 2
    with pytest.raises(ValueError):
        session.ask("a")
    seen = []
    session.ask("find").watch(lambda done, total: seen.append((done, total)), throttle=Throttle(least=0, jitter=0))
    assert seen and seen[-1][0] == seen[-1][1]


def test_cancelled_searches(spark):
    slow = spark.range(1 << 40).where("id % 7 = 8")
    running = Running(slow, "slow", lambda: 0.0)
    threading.Event().wait(3)
    running.cancel()
    running.wait(60)
    assert running.error is not None and running.found is None
    running.drop()


def test_throttle():
    now = [0.0]
    t = Throttle(2, 0, lambda: now[0])
    assert t.due(0, 9) and not t.due(1, 9) and t.due(9, 9)
    now[0] = 2.5
    assert t.due(2, 9) and not t.due(3, 9)


def test_command_line(spark, tmp_path, capsys):
    for name, text in (("one_1/a.c", "int zero;\nzero again\n"), ("one_1/.git/b.c", "zero"), ("two_1/c.c", "no match"), ("two_1/COPYING", "zero")):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    tree, ix, other = str(tmp_path / "tree"), str(tmp_path / "ix"), str(tmp_path / "other")

    def run(*args):
        assert cli.main(list(args), spark) == 0
        return [line.split("\t") for line in capsys.readouterr().out.splitlines()]

    run("create", ix, tree)
    assert sorted(r[1] for r in run("docids", ix)) == ["one_1/a.c", "two_1/c.c"]
    assert run("trigram", ix, "zer")[0][1:] == ["1", "2"] and len(run("posting", ix, "zer")) == 1
    assert run("matches", ix, "zer") == [["one_1/a.c", "4"], ["one_1/a.c", "10"]]
    assert [r[:2] for r in run("search", ix, tree, "zero")] == [["one_1/a.c", "1"], ["one_1/a.c", "2"]] or len(run("search", ix, tree, "zero")) == 2
    (tmp_path / "more" / "three_1").mkdir(parents=True)
    (tmp_path / "more" / "three_1" / "z.c").write_text("zero three\n")
    run("create", other, str(tmp_path / "more"))
    run("merge", str(tmp_path / "both"), ix, other)
    both = run("docids", str(tmp_path / "both"))
    assert len(both) == 3 and len({r[0] for r in both}) == 3
    assert sorted(run("matches", str(tmp_path / "both"), "zer")) == [["one_1/a.c", "10"], ["one_1/a.c", "4"], ["three_1/z.c", "0"]]
    assert len(run("du", ix)) == 2
    (tmp_path / "log").write_text("zero\nnothing\n")
    assert cli.main(["replay", ix, tree, str(tmp_path / "log")], spark) == 0
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert [(r["query"], r["files"], r["matches"]) for r in rows] == [("zero", 1, 2), ("nothing", 0, 0)]
    with pytest.raises(SystemExit):
        cli.main(["search", ix], spark)


def test_tree_skips_ignored_folders(spark, tmp_path):
    for name in ("p_1/.pc/x.c", "p_1/src/.git/y.c", "p_1/src/z.c"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    rows = corpus.from_tree(spark, str(tmp_path), trim=f"{tmp_path}/", ignored=corpus.SKIPPED_DIRS).collect()
    assert [r.path for r in rows] == ["p_1/src/z.c"]


def test_scripts():
    latin, greek = re2._property("Latin"), re2._property("Greek")
    has = lambda ranges, c: any(a <= ord(c) <= b for a, b in ranges)
    assert all(has(latin, c) for c in "aZªＡéß") and not has(latin, "1") and has(greek, "Ω") and has(re2._property("Thai"), "ก")
    with pytest.raises(re2.PatternError):
        re2._property("Klingon")


def greedy(times, idle, latest):
    out = []
    for t in times:
        if out and t - out[-1][1] < idle and t - out[-1][0] < latest:
            out[-1] = [out[-1][0], t, out[-1][2] + 1]
        else:
            out.append([t, t, 1])
    return out


def test_merges_against_a_loop(spark):
    import random

    r = random.Random(3)
    start, rows, want = dt.datetime(2024, 1, 1), [], []
    for shard in range(12):
        times = sorted(r.choices(range(0, 6000, 10), k=r.randrange(1, 120)))
        rows += [(shard, start + dt.timedelta(seconds=t)) for t in times]
        want += [(shard, n, a, b, min(b + 120, a + 600)) for a, b, n in greedy(times, 120, 600)]
        assert joined([[t, t, 1] for t in times], 120, 600) == greedy(times, 120, 600)
    got = lifecycle.merge_triggers(spark.createDataFrame(rows, "shard int, ts timestamp")).collect()
    seconds = lambda t: int((t - start).total_seconds())
    assert sorted((x.shard, x.requests, seconds(x["first"]), seconds(x["last"]), seconds(x.fires)) for x in got) == sorted(want)
    assert lifecycle.retry_times() == [8, 16, 32, 64, 128, 256, 512] and sum(lifecycle.retry_times()) < 1500


def test_a_busy_shard_is_cut_into_parts(spark, monkeypatch):
    """Merges that go on over many parts, pauses just below, at and above the limit, equal times, times before 1970; no task has a shard's requests."""
    import random

    r = random.Random(5)
    monkeypatch.setattr(lifecycle, "SPAN", 3)
    monkeypatch.setattr(lifecycle, "TOGETHER", 50)
    for idle, latest, steps in ((120, 600, (1, 30, 119, 120, 121)), (120, 600, (0, 1, 7, 61)), (50, 10, (1, 9, 10, 49, 50)), (10, 0, (0, 1, 11)), (0, 10, (0, 3))):
        rows, want = [], []
        for shard in range(4):
            times, t = [], r.randrange(-9000, 9000)
            for _ in range(300 if shard else 1):
                t += r.choice(steps)
                times.append(t)
            rows += [(str(shard), t) for t in times]
            distinct = sorted(set(times))
            found = [[a, b, sum(a <= t <= b for t in times)] for a, b, _ in greedy(distinct, idle, latest)]
            want += [(str(shard), n, a * 10**6, b * 10**6, min(b + idle, a + latest) * 10**6) for a, b, n in found]
        requests = spark.createDataFrame(rows, "shard string, t bigint").select("shard", F.timestamp_seconds("t").alias("ts"))
        out = lifecycle.merge_triggers(requests, idle=idle, latest=latest)
        got = out.select("shard", "requests", *[F.unix_micros(c) for c in ("first", "last", "fires")]).collect()
        assert sorted(map(tuple, got)) == sorted(want), (idle, latest, steps)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert lifecycle.merge_triggers(spark.createDataFrame([(None, None)], "shard string, ts timestamp")).count() == 0


def test_click_log(spark):
    rows = spark.createDataFrame([("a/b", 3, "x"), ("", 3, "x"), (None, 3, "x"), ("a", None, "x"), ("é" * 3000, 1, "y")], "path string, line int, query string")
    lines = [r.value for r in lifecycle.clicks(rows).collect()]
    assert len(lines) == 2 and json.loads(lines[0]) == {"path": "a/b", "line": 3, "query": "x"} and 4000 < len(lines[1].encode()) <= 4099
