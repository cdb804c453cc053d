import re

import pytest

from quarry.functions import re2
from quarry.functions.text import fnv1_64
from quarry.functions.versions import parse
from quarry.plans.keywords import rewrite, suffixes
from quarry.plans.trigrams import implies, trigram_query
from quarry.search import RefusedQuery, plan, query_id, validate

# expression => trigram query; + is everything, - nothing
TRIGRAMS = r"""
wxyz => "wxy" "xyz"
(wxy)(zab) => "wxy" "xyz" "yza" "zab"
Wxyzab => "Wxy" "xyz" "yza" "zab"
wxy.*(stu|klm) => "wxy" ("klm"|"stu")
wxy(zab|klm) => "wxy" ("xyk" "ykl" "klm")|("xyz" "yza" "zab")
x+hello => "ell" "hel" "llo" "xhe"
(x+hello|y+world) => ("ell" "hel" "llo" "xhe")|("orl" "rld" "wor" "ywo")
x*yyy => "yyy"
x?yyy => "yyy"
(yyy)x? => "yyy"
(yyy)x* => "yyy"
^wxy => "wxy"
wxy$ => "wxy"
wx[pqr]s => ("wxp" "xps")|("wxq" "xqs")|("wxr" "xrs")
wx[^pqr]s => +
wx.s => +
() => +
. => +
(?s). => +
[^\d\D] => -
(wxy|wxy) => "wxy"
(wx|wx)y => "wxy"
wx(yab|yat) => "wxy" "xya" ("yab"|"yat")
[pq][rs][tu] => ("prt"|"pru"|"pst"|"psu"|"qrt"|"qru"|"qst"|"qsu")
wx[pq]r => ("wxp" "xpr")|("wxq" "xqr")
(p|q|r|s)(tu|v|wx|y) => +
(?i)p~~ => ("P~~"|"p~~")
(?i)pq~ => ("PQ~"|"Pq~"|"pQ~"|"pq~")
(?i)abe|abe => ("ABE"|"ABe"|"AbE"|"Abe"|"aBE"|"aBe"|"abE"|"abe")
\bwxy => "wxy"
\Bwxy => "wxy"
wxy\b => "wxy"
wx\by => "wxy"
\b => +
"""


def _canonical(text):
    """Operands of a query may come in any order."""
    return sorted(re.findall(r'"[^"]*"|[|()+-]', text))


@pytest.mark.parametrize("case", [line for line in TRIGRAMS.split("\n") if line])
def test_trigram_queries(case):
    pattern, _, want = case.partition(" => ")
    assert _canonical(str(trigram_query(re2.parse(pattern)))) == _canonical(want)


def test_trigram_query_texts():
    assert str(trigram_query(re2.parse("wxyz"))) == '"wxy" "xyz"'
    assert str(trigram_query(re2.parse("wxy(stu|klm)"))).startswith('"wxy" ')
    assert implies(trigram_query(re2.parse("wxyz")), trigram_query(re2.parse("wxy")))


# what is matched line by line, as (expression, text, matching lines)
LINES = [
    ("b+", "abc\nded\nbib\n", [1, 3]), ("", "x", [1]), ("^ab", "ab\ncab", [1]), ("ab$", "cab\nab\n", []), ("(?m)ab$", "cab\nab\n", [1, 2]),
    ("[^\\n]+", "ab\n", [1]), ("[語本]+", "日本", [1]), ("(?i)k", "K", [1]), ("(?i)^[α]+$", "αΑ", [1]), ("\\bword", "éword\nsword", [1]),
    ("a\\sb", "a\x0bb\na b", [2]), ("[[:upper:]]x", "Ax\nax", [1]), ("(?P<n>a)(?:b)", "ab", [1]), ("\\Qa.b\\E+", "a.bb\nacb", [1]),
    ("a.b", "a\rb", [1]), ("[^\\S\\s]", "abc", []), ("(?i)\\W", "k\ns", []), ("\\pL+", "é\n1", [1]), ("x{0}", "q", [1]), ("\\x41\\x{42}", "AB", [1]),
    ("(?s)a.*b", "a\nb", []), ("(?-i)A(?i)b", "AB\nab", [1]), ("[a\\-\\]z]+", "]", [1]), ("\\B", "x\nxx", [2]), ("a|b|", "zz", [1]),
]


def test_grep_dialect(spark):
    from quarry.operators.grep import grep

    for pattern, text, want in LINES:
        files = spark.createDataFrame([(1, text)], "docid bigint, content string")
        assert sorted(r.line for r in grep(files, pattern).collect()) == want, pattern


@pytest.mark.parametrize("pattern", ["(", ")", "[a", "*a", "a**", r"\1", "(?=a)", "(?<!a)", "a{2,1}", r"\y", "[b-a]", "(?>a)", "a{1001}"])
def test_refused_expressions(pattern):
    with pytest.raises(re2.PatternError):
        re2.parse(pattern)


def test_search_refuses_queries_without_trigrams():
    for text in ("ab", ".*", r"[^\s\S]"):
        with pytest.raises(RefusedQuery):
            validate(text)
    validate("ab", literal=True)
    validate("abc")
    assert plan("a.c", literal=True)[1].kind == "literal"


def test_query_identity():
    assert fnv1_64(b"") == 0xCBF29CE484222325
    assert query_id("abc") == query_id("abc") != query_id("abc", literal=True)


# query => what is left, keywords
KEYWORDS = [
    ("term", "term", {}), ("package:foo  term", "term", {"package": ["foo"]}), ("package:foo two  terms", "two  terms", {"package": ["foo"]}),
    ("term filetype:C", "term", {"filetype": ["c"]}), ("term PKG:i3-WM", "term", {"package": ["i3-WM"]}), ("term -pkg:X", "term", {"npackage": ["X"]}),
    ("term -file:foo", "term", {"npath": ["foo"]}), ("term file:foo", "term", {"path": ["foo"]}), ("term path:a package:b", "term", {"package": ["b"], "path": ["a"]}),
    ("term -package:a -package:b", "term", {"npackage": ["b", "a"]}), ("package:x", "package:x", {}), ("a package:x b", "a package:x b", {}), ("term -filetype:Perl", "term", {"nfiletype": ["perl"]}),
]


@pytest.mark.parametrize(("text", "left", "keywords"), KEYWORDS)
def test_keywords(text, left, keywords):
    found = rewrite(text)
    assert (found.query, found.keywords) == (left, keywords)


def test_suffixes():
    assert suffixes(["c++"])[".c"] == 0.55 and suffixes(["c++", "c"])[".c"] == 0.75
    assert suffixes(["perl"])[".t"] == 0.8 and suffixes(["cobol"]) == {} and suffixes(["golang"]) == suffixes(["go"])


ASCENDING = "0~~ 0~ 0 0.1~rc1 0.1 0.1a 0.1+b 0.2-1~ 0.2-1 0.2-1.1 0.2-2 0.10 1.0~a 1.0 1:0~ 1:0.1 2:0".split()


def test_version_order(spark):
    from pyspark.sql import functions as F

    from quarry.functions.versions import sort_key

    assert sorted(ASCENDING[::-1], key=lambda v: parse(v).key()) == ASCENDING
    rows = spark.createDataFrame([(v,) for v in ASCENDING[::-1]], "v string").orderBy(sort_key(F.col("v"))).collect()
    assert [r.v for r in rows] == ASCENDING
    assert parse("0-0") == parse("0-00") == parse("0:0") and str(parse("0:1.2-3")) == "1.2-3" and str(parse("1:2")) == "1:2"
    same = spark.createDataFrame([("0-0", "0"), ("1.02", "1.2"), ("0:1", "1")], "a string, b string").select((sort_key(F.col("a")) == sort_key(F.col("b"))).alias("same"))
    assert all(r.same for r in same.collect())


BAD = ["", " ", "0:", "0:0 0", "-1:0", "a:0", "99999999999999999999:0", "a1", "0:0-1:2", "1_2", "1-2_", "é"]


def test_bad_versions(spark):
    from pyspark.sql import functions as F

    from quarry.functions.versions import sort_key, version_struct

    for text in BAD:
        with pytest.raises(ValueError):
            parse(text)
    rows = spark.createDataFrame([(v,) for v in [*BAD, None]], "v string").select(version_struct(F.col("v")).alias("v"), sort_key(F.col("v")).alias("k")).collect()
    assert all(r.v is None and r.k is None for r in rows)
