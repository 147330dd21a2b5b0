"""Licence texts that begin with a key phrase: the template's optional leading words are then before the text."""

import duckdb
import pytest

from barloom.llm import licenses


def test_a_text_may_begin_with_the_key_words(spark):
    rows = [(n, " ".join(t.words[t.key_places[0]:]), t) for n, t in enumerate(licenses.TEMPLATES)]
    rows += [(100 + n, "filler words " + text, t) for n, text, t in rows]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for n, _, t in rows:
        assert t.label in got[n].labels.split(","), (n, t.label)
    for n, text, t in rows[:len(licenses.TEMPLATES)]:
        assert got[n].labels == got[100 + n].labels and got[n].score >= len(text.split()) / len(t.words)
        assert got[n].first_word is None or got[n].first_word >= 0


@pytest.mark.parametrize("text, label, score", [
    ("MIT License Copyright", "mit", 2 / 5), ("Apache License Version 2.0, January 2004", "apache-2.0", 5 / 8),
    ("Mozilla Public License v. 2.0", "mpl-2.0", 6 / 12), ("the mit", "", 0.0), ("License", "", 0.0)])
def test_first_lines_of_licence_files(spark, text, label, score):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.score) == (label, pytest.approx(score))


def test_sql_agrees_on_texts_that_begin_with_the_key_phrase(spark):
    texts = [" ".join(t.words[t.key_places[0]:]) for t in licenses.TEMPLATES] + [t.text for t in licenses.TEMPLATES] + [
        "MIT License Copyright", "Apache License Version 2.0", "x CC BY-NC 4.0", "CC BY-NC-SA", "version 2", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cur = con.execute(licenses.scan_sql())
    names = [d[0] for d in cur.description]
    got = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in licenses.scan(docs).select(*names).collect())
    assert got == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in cur.fetchall())
