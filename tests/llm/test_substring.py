"""Operator 3 against a loop over all spans."""

import random
import re

import pytest
from fixtures import DOCS, prose

from quarry.llm import substring_dedup as S


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def sentences_of(text):
    parts = re.sub(r"([.!?,;:])([ \t\n\r])|([^ \t\n\r])([ \t\r]*\n|[ \t\r]+\Z)", lambda m: (m[1] or m[3]) + "\x01" + (m[2] or m[4]), text).split("\x01")
    return parts[:-1] if len(parts) > 1 and not parts[-1].strip(" \t\n\r") else parts, parts


def brute(texts, least=S.SENTENCES, words=S.WORDS):
    seen, out = set(), []
    for text in texts:
        found, parts = sentences_of(text)
        bare = [p.strip(" \t\n\r") for p in found]
        gone = set()
        for i in range(len(bare)):
            j = i
            while j < len(bare) and (j - i < least or sum(len(b.split()) for b in bare[i:j]) < words):
                j += 1
            if j - i < least or sum(len(b.split()) for b in bare[i:j]) < words:
                if i:
                    continue
            span = tuple(bare[i:j])
            if any(span):
                if span in seen:
                    gone |= set(range(i, j))
                seen.add(span)
        out.append(("".join(p for i, p in enumerate(parts) if i not in gone), len(gone)))
    return out


def test_against_all_spans(spark):
    r = random.Random(8)

    def text(n):
        marks = [". ", ", ", "! ", "? ", "\n", " \n", ".\r\n", "; ", " ", "  "]
        return "".join(w + r.choice(marks) for w in prose(r.random(), n).split())

    shared = [text(n) for n in (26, 40, 55, 55, 90, 120)]
    texts = ["", " ", "\n", "Hm", "Hm", "Hm ", "Yes. No.", "Yes. No.", "Yes. No. Then more", ". . .", text(3000)]
    for i in range(60):
        texts.append(text(r.randrange(60)) + r.choice(["", " ", "."]).join(r.sample(shared, r.randrange(4))) + r.choice(["", " ", "x "]) + text(r.randrange(60)))
    texts += [texts[20], texts[21] + " tail", shared[3] * 3]
    got = {x.doc_id: (x.text, x.removed_sentences) for x in S.substring_dedup(docs_of(spark, texts)).collect()}
    want = brute(texts)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]
    assert sum(n > 0 for _, n in want) > 20


def test_passages_glued_on_both_sides(spark):
    passage = prose("a", 18) + ", " + prose("b", 20) + ". " + prose("c", 17)
    texts = [prose("p", 9) + " " + passage + " " + prose("q", 9), prose("r", 30) + " " + passage + " " + prose("s", 30), "One sentence of " + prose("long", 60), prose("alone", 40) + ". " + prose("also", 20) + "."]
    assert [r.removed_sentences for r in S.substring_dedup(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 0, 0, 0]  # of the passage's pieces only one is whole
    passage = ", ".join(prose(x, 9) for x in "abcdefg")
    texts[:2] = [prose("p", 9) + " " + passage + " " + prose("q", 9), prose("r", 30) + " " + passage + " " + prose("s", 30)]
    assert [r.removed_sentences for r in S.substring_dedup(docs_of(spark, texts)).orderBy("doc_id").collect()] == [0, 5, 0, 0]


def test_odd_rows(spark, odd_docs, no_docs):
    out = S.substring_dedup(odd_docs)
    assert out.columns == [*odd_docs.columns, "removed_sentences"] and out.count() == odd_docs.count()
    rows = {(r.doc_id, r.source): r for r in out.collect()}
    assert rows[2, "b"].text == "" and rows[3, "a"].text is None and rows[4, "a"].text == "" and rows[7, "a"].removed_sentences == 0 and rows[6, "b"].text == "\n \n"
    assert all(r.removed_sentences == 0 for r in out.where("doc_id = 1").collect())
    assert S.substring_dedup(no_docs).count() == 0
    clash = odd_docs.selectExpr("cast(doc_id as string) AS h", "text AS b0", "source AS row", "1 AS rep", "n_chars AS removed_sentences")
    got = S.substring_dedup(clash, "h", "b0")
    assert got.columns == ["h", "b0", "row", "rep", "removed_sentences"] and got.where("removed_sentences > 0").count() == 1


@pytest.mark.parametrize("copies", [1, 400])
def test_the_first_of_a_hot_span_stays(spark, copies):
    text = ". ".join(prose(i, 12) for i in range(4)) + "."
    rows = [(i, text, "en", "s", 0) for i in range(copies)] + [(None, text, "en", "s", 0)]
    out = S.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.doc_id for r in out if r.text] == [0] and sum(r.removed_sentences for r in out) == 4 * copies
