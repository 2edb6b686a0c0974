"""Licence scans against plain searches, changed notices, and SQL on awkward rows."""

import re

import duckdb
import pyarrow as pa
import pytest

from kinloom.llm import licenses

LONG = " ".join(f"w{i % 977}" for i in range(30_000)) + " Apache License " + "x " * 5_000
MIT = " ".join(licenses.NOTICES["mit"].split())
CHANGED = MIT.replace("free of charge", "entirely free of any charge").replace("without limitation the rights to", "the right to")
NC = licenses.NOTICES["cc-by-nc"]
ROWS = [
    (1, "Released under the MIT License.", "clash", "c"),
    (1, "Released under the MIT License.", "clash", "c"),
    (1, "another text with the same id: GNU General  Public, License", None, None),
    (2, None, None, None),
    (3, "", None, None),
    (4, LONG, None, None),
    (None, "the apache license, mit license and General Public License general public MIT LICENSE", "x", "y"),
    (5, "mit licenses submit license public license general public licence MİT License ümit license mit-license", "x", "y"),
    (6, f"start {MIT} end", "x", "y"),
    (7, f"intro words {CHANGED} and so on", "x", "y"),
    (8, " ".join(reversed(MIT.split())), "x", "y"),
    (9, " ".join([NC] * 5), "x", "y"),
    (10, f"{MIT} {licenses.NOTICES['bsd']} {MIT}", "x", "y"),
    (11, "of the software and the license of the software " * 200, "x", "y"),
]
SCHEMA = "doc_id long, text string, labels string, score string"


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _base(text):
    w = _words(text)
    hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


@pytest.fixture(scope="module")
def found(spark):
    return licenses.report(spark.createDataFrame(ROWS, SCHEMA)).collect()


def test_base_places(found):
    assert len(found) == len(ROWS)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=repr)
    assert got == sorted(((i, *_base(t)) for i, t, *_ in ROWS), key=repr)
    assert all({*filter(None, r.base_labels.split(","))} <= {*filter(None, r.labels.split(","))} and 0 <= r.score <= 1 for r in found)


def test_notices(found):
    by = {r.doc_id: r for r in found}
    assert (by[6].labels, by[6].score) == ("mit", 1.0)
    assert by[7].labels == "mit" and 0.8 < by[7].score < 1
    assert by[8].labels == "" and by[8].score == 0 and by[11].labels == ""
    assert (by[9].labels, by[9].score) == ("cc-by-nc", 1.0)
    assert by[10].labels == "bsd,mit"


def test_spans(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = [(r.start, r.stop) for r in licenses.scan(docs).where("doc = 10").orderBy("start").collect()]
    m, b = len(_words(MIT)), len(_words(licenses.NOTICES["bsd"]))
    assert got == [(0, m), (m, m + b), (m + b, 2 * m + b)]
    assert licenses.scan(docs).where("doc = 9").count() == 5
    moved = licenses.scan(docs).where("doc = 7").collect()  # diagonals apart by words put in and left out, one span
    assert len(moved) == 1 and (moved[0].start, moved[0].stop) == (2, 2 + len(_words(CHANGED)))


def test_sql_and_plan(spark, found):
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in ROWS], pa.int64()), "text": pa.array([r[1] for r in ROWS], pa.string())})  # noqa: F841
    con.register("documents", documents)
    key = lambda rows: sorted((tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert key(map(tuple, found)) == key(con.sql(licenses.oracle()).fetchall())
    plan = licenses.report(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


def test_other_libraries(spark):
    """A library too large to be broadcast gives the same; a template without words or with one has no grams."""
    library = [*licenses.LIBRARY, licenses.Template("none", "", False), licenses.Template("one", "word", True)]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted(map(tuple, licenses.report(docs, library).collect()), key=repr)
    most, licenses.BROADCAST_GRAMS = licenses.BROADCAST_GRAMS, 0
    try:
        assert sorted(map(tuple, licenses.report(docs, library).collect()), key=repr) == want
    finally:
        licenses.BROADCAST_GRAMS = most
    assert licenses.report(docs.where("false")).count() == 0
