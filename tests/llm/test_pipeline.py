"""The corpus pipeline at sf0.001: every stage's decisions on its own input, against brute force or labels."""

import re

import duckdb

import corpus_pipeline
from kinloom.llm import mixing
from kinloom.llm.common import stored
from test_operators import _brute, _contaminated

SF = "/root/testdata/sf0.001"


def _language(spark, before, after):
    clear = {r.doc_id for r in before if r.lang and len((r.text or "").split()) >= 20}
    blank = {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")}
    assert not blank & after.keys() and len(clear & after.keys()) >= 0.98 * len(clear)


def _toxicity(spark, before, after):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bad, good = ({r.doc_id for r in before if toxic.get(r.doc_id) == k} for k in (1, 0))
    assert len(bad - after.keys()) >= 0.8 * len(bad) and len(good & after.keys()) >= 0.95 * len(good)


def _near_duplicates(spark, before, after):
    kept = {i for i, _, _, k in map(eval, _brute([(r.doc_id, r.text) for r in before], 5)) if k}
    assert after.keys() == kept


def _decontamination(spark, before, after):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert after.keys() == {r[0] for r in _contaminated([(r.doc_id, r.text) for r in before], items) if not r[-1]}


def _mixing(spark, before, after):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in before])
    assert {i: r.taken for i, r in after.items()} == dict(con.sql(mixing.oracle(select="doc_id, taken") + " WHERE taken > 0").fetchall())


CHECKS = {"language": _language, "toxicity": _toxicity, "near_duplicates": _near_duplicates, "decontamination": _decontamination, "mixing": _mixing}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF))
        after = docs.collect()
        assert len(after) == len({r.doc_id for r in after}), name
        assert docs.columns == (columns if name != "mixing" else [*columns, "taken"])
        CHECKS[name](spark, before, {r.doc_id: r for r in after})
    assert docs.count() > 100
