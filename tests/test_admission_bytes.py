from pyspark.sql import functions as F

from quarry.sources import corpus


def test_illegal_utf8(spark, tmp_path):
    contents = {
        "ok": "aé日😀\nb".encode(), "cut": "abcé".encode()[:-1], "latin": b"caf\xe9 au lait", "first": b"\x80abc", "after": b"abc\x80",
        "never": b"ab\xff\xfe", "null": b"a\x00bc", "pairs": b"ab\xc3\n\xa9",
    }
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    files = corpus.from_tree(spark, str(tmp_path), trim=f"{tmp_path}/")
    got = {r.path: r.r for r in files.select("path", corpus.content_rejection(F.col("content"), F.lit(5)).alias("r")).collect()}
    # as the reference, by pairs: a first byte at the very end has no second one to be wrong
    assert got == {n: None if n in ("ok", "cut", "null") else "illegal UTF-8" for n in contents}
    paths = spark.createDataFrame([(b"p_1/a\xeen.c",), (b"p_1/a.c",)], "raw binary").select(F.col("raw").cast("string").alias("path"))
    assert [r[0] for r in paths.select(corpus.path_rejection(F.col("path"), F.lit(9))).collect()] == ["illegal UTF-8", None]
