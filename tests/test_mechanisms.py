"""What single mechanisms promise: maximal matchings, blocking without a shuffle of pairs, bounds, edit bands, scans that skip, types, zips, jobs, manifests, promotion."""

import collections
import json
import os
import random
import re
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.operators import linkage, scoring, split
from kinloom.plans import programs, registry
from kinloom.sources import tables as io

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _check_matching(rows, pairs, whole=True):
    at = collections.defaultdict(set)
    for f, p in rows:
        if f is not None and p is not None:
            at[p].add(f)
    used = [x for pair in pairs for x in pair]
    assert len(used) == len(set(used)) and all(a < b and at[a] & at[b] for a, b in pairs)
    if whole:
        free = collections.Counter(f for p, fs in at.items() if p not in set(used) for f in fs)
        assert all(n < 2 for n in free.values()), free


@pytest.mark.parametrize("rows_a_task", [split.PAIR_ROWS, 7])
def test_matching_is_maximal(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(split, "PAIR_ROWS", rows_a_task)
    draw = random.Random(4)
    rows = [(draw.choice([1, 1, 1, 2, 3]), draw.randrange(60)) for _ in range(120)] + [(None, 1), (1, None), (9, 500), (9, 501), (10, 501), (10, 502), (11, 600), (1, 3), (1, 3)]
    df = spark.createDataFrame(rows, "facility_id int, patient_id int")
    found = [(r.source_patient_id, r.target_patient_id) for r in split.maximal_matching(df).collect()]
    _check_matching(rows, found)
    n = len(found)
    some = [(r.source_patient_id, r.target_patient_id) for r in split.confusable_pairs(df, n).collect()]
    assert sorted(some) == sorted(found)
    few = [(r.source_patient_id, r.target_patient_id) for r in split.confusable_pairs(df, 5).collect()]
    assert len(few) == 5 and set(few) <= set(found)
    with pytest.warns(UserWarning, match="pairs"):
        assert split.confusable_pairs(df, n + 100).count() == n
    assert split.maximal_matching(df.where("false")).count() == 0


def test_blocking_shuffles_no_pairs(spark):
    """Precedence instead of a distinct: records are shuffled by each rule's keys, and nothing after a join is."""
    records = registry.linkage_records(spark, SF)
    blocked = linkage.block(records)
    plan = _plan(blocked)
    for join in re.split(r"\n", plan):
        assert "Aggregate" not in join, join
    joins = plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin")
    assert len(linkage.RULES) - len(linkage.IMPLIED) <= joins <= len(linkage.RULES)  # a rule that an earlier one implies is empty, which the optimizer sees
    compared = linkage.compare_blocks(records, linkage.RULES, registry.PRODUCTION)
    frequencies = sum(c.term_frequency for c in registry.PRODUCTION)
    assert _plan(compared).count("Join") <= (1 + 4 * frequencies) * len(linkage.RULES)  # no join of pairs to values
    got = {(r[0], r[1]): r[2] for r in blocked.select("record_id_l", "record_id_r", "match_key").collect()}
    assert len(got) == blocked.count()
    given = linkage.compare(blocked, records, registry.PRODUCTION, keep=False)
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, compared.select(*given.columns).collect()))


def test_similarity_bound(spark):
    """No similarity exceeds its bound, and of compared names few are left to the worker."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdeéAB 1-𝒳ß") for _ in range(draw.randint(0, 14)))
    pairs = [(a, a[: draw.randint(0, 14)] + b if draw.random() < 0.4 else b) for a, b in ((word(), word()) for _ in range(4000))] + [("", ""), ("a" * 40, "a" * 39), (None, "x"), ("a" * 300, "b" * 300)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"x": text.letter_counts(F.col("a")), "y": text.letter_counts(F.col("b"))})
    bound = text.winkler_bound(F.col("a"), F.col("b"), text.jaro_bound(F.col("a"), F.col("b"), text.common_letters(F.col("x"), F.col("y"))))
    rows = df.select(bound.alias("bound"), text.jaro_winkler(F.col("a"), F.col("b")).alias("jw"), "a", "b").collect()
    assert all(r.a == r.b or r.bound >= r.jw - 1e-12 for r in rows if r.jw is not None) and sum(r.bound is None for r in rows) == 1
    people = registry.persons(spark, "/root/testdata/sf0.01")
    first = registry.COMPARISONS[0]
    side = people.withColumn("letters_first_name", text.letter_counts(F.col("first_name")))
    names = linkage.block(side, [("zip",)], carry=("first_name", "letters_first_name"))
    sent, n = first.bounded(names).agg(F.count(F.when(F.col("open_first_name"), 1)), F.count(F.lit(1))).first()
    assert n > 50_000 and sent < 0.25 * n, (sent, n)


def test_edit_distances():
    con, draw = duckdb.connect(), random.Random(2)
    a = ["".join(draw.choice("abcé") for _ in range(draw.randint(0, 11))) for _ in range(1500)] + ["ca", "x" * 300, ""]
    b = ["".join(draw.sample(x, len(x))) if draw.random() < 0.4 else x[: draw.randint(0, len(x))] + draw.choice(["", "a", "bc"]) + x[draw.randint(0, len(x)) :] for x in a[:-3]] + ["abc", "y" + "x" * 299, ""]
    con.execute("CREATE TABLE p (i INTEGER, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", [(i, x, y) for i, (x, y) in enumerate(zip(a, b))])
    want = np.array([r[0] for r in con.sql("SELECT damerau_levenshtein(a, b) FROM p ORDER BY i").fetchall()])
    left, right = [x.encode() for x in a], [x.encode() for x in b]
    assert (text.edit_distances(left, right) == want).all()
    for most in (0, 1, 2, 4, 20):
        assert (text.edit_distances(left, right, most) == np.minimum(want, most + 1)).all()
    assert len(text.edit_distances([], [])) == 0


def test_edits_as_columns(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("ab", "ba"), ("x", "x"), (None, "x"), ("", "long text"), ("abcdef", "abcfed")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(text.damerau_levenshtein(a, b), text.damerau_levenshtein(a, b, 1), linkage.within_edits(2)(a, b)).collect()
    assert [tuple(r) for r in got] == [(3, 2, False), (1, 1, True), (0, 0, True), (None, None, None), (9, 2, False), (2, 2, True)]


def _scanned(df):
    """Rows that the file scans of a collected frame read."""
    df.collect()
    seen, todo, rows = [], [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            rows += node.metrics().apply("numOutputRows").value()
            seen.append(node.toString())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return rows, seen


def test_ids_reach_the_scan(spark, tmp_path):
    n = 200_000
    table = spark.range(n).select(F.format_string("p%07d", F.col("id")).alias("PATIENT"), F.col("id").alias("v"))
    path = f"file://{tmp_path}/t.parquet"
    table.coalesce(1).write.option("parquet.block.size", 64 << 10).option("parquet.page.row.count.limit", 1000).parquet(path)
    table = spark.read.parquet(path)
    ids = spark.createDataFrame([(f"p{i:07d}",) for i in [*range(100, 120), *range(150_000, 150_010)]] + [("p0000100",), (None,), ("nobody",)], "PATIENT string")
    got = io.rows_of(table, ids, "PATIENT")
    plain = table.join(ids.distinct(), "PATIENT", "left_semi")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 30
    (rows, scans), (every, _) = _scanned(got), _scanned(plain)
    assert every >= n and rows < n / 4, (rows, every)
    assert any("PushedFilters: [Or(" in s or "GreaterThanOrEqual(PATIENT" in s for s in scans)
    assert io.rows_of(table, ids.where("false"), "PATIENT").count() == 0
    assert len(io.id_ranges(ids, "PATIENT", 4)) <= 4


def test_types_of_columns(spark, tmp_path):
    rows = {
        "whole": ["1", "-20", "0", ""], "code": ["02115", "12345", "1", "2"], "number": ["1", "2.5", "-1e3", ".5"], "late": ["1", "2", "3", "x"], "flag": ["true", "False", "", "TRUE"], "day": ["2020-02-29", "1999-12-31", "", "2001-01-01"],
        "wrong_day": ["2020-02-30", "1999-12-31", "", "2001-01-01"], "moment": ["2020-01-02", "2020-01-02T03:04:05Z", "2020-01-02 03:04:05.5", ""], "none": ["", "", "", ""], "huge": ["1", "99999999999999999999", "3", "4"], "sp ace": ["1", "2", "3", "4"],
    }
    want = dict(whole="bigint", code="string", number="double", late="string", flag="boolean", day="date", wrong_day="string", moment="timestamp", none="string", huge="double") | {"sp ace": "bigint"}
    lines = list(zip(*rows.values()))
    for k in range(4):  # a file a row: types are merged over files
        (tmp_path / f"t.csv{k}").mkdir()
    (tmp_path / "t.csv").mkdir()
    for k, line in enumerate(lines):
        (tmp_path / "t.csv" / f"{k}.csv").write_text(",".join(rows) + "\n" + ",".join(line) + "\n")
    df = io.read_csv(spark, f"file://{tmp_path}/t.csv")
    assert dict(df.dtypes) == want
    assert {str(r["day"]) for r in df.collect()} == {"2020-02-29", "1999-12-31", "2001-01-01", "None"} and {r.code for r in df.collect()} == set(rows["code"])
    texts = spark.read.option("header", True).csv(f"file://{tmp_path}/t.csv")
    assert all(kind == "string" for _, kind in io.read_csv(spark, f"file://{tmp_path}/t.csv", infer=False).dtypes) and io.infer_types(texts.select()) == {}
    assert io.infer_types(texts.where("false")) == dict.fromkeys(texts.columns, "string")


def test_zip_has_no_single_task(spark):
    rows = [(i * 7 % 1000, f"a{i}", f"b{i}") for i in range(1000)]
    pairs = spark.createDataFrame(rows, "ord int, record_id_1 string, record_id_2 string")
    predictions = spark.createDataFrame([(i, i % 2, i / 1000) for i in range(1000)], "ord int, prediction int, confidence double").repartition(7)
    got = linkage.zipped(pairs, predictions)
    assert sorted((r.ord, r.record_id_1, r.confidence) for r in got.collect()) == [(k + 1, a, k / 1000) for k, a, _ in sorted(rows)]
    assert "SinglePartition" not in _plan(got)


def _counting(path):
    """A scorer that notes each text it is given, in a file of its own a task."""

    def make():
        def judge(texts):
            with open(os.path.join(path, f"{os.getpid()}-{threading.get_ident()}"), "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return np.array([[0.0, len(t) - 5] for t in texts])

        return judge

    return make


def _failing(path, bad):
    inner = _counting(path)

    def make():
        judge = inner()

        def run(texts):
            if bad in texts:
                raise RuntimeError("lost")
            return judge(texts)

        return run

    return make


def test_scoring_job_is_resumed(spark, tmp_path):
    seen, out = tmp_path / "seen", f"file://{tmp_path}/out"
    seen.mkdir()
    texts = spark.createDataFrame([(f"r{i}", f"s{i}", "x" * (i % 11) + f" {i}") for i in range(200)], "record_id_1 string, record_id_2 string, text string")
    noted = lambda: collections.Counter(line for f in seen.iterdir() for line in f.read_text().splitlines())
    scoring.score_job(texts, out, _counting(str(seen)), rows=40, most=2)
    half = noted()
    assert 0 < len(half) < 200
    with pytest.raises(Exception, match="lost"):
        scoring.score_job(texts, out, _failing(str(seen), next(r.text for r in texts.collect() if r.text not in half)), rows=300)
    committed = scoring.score_job(texts, out, _counting(str(seen)), rows=40, most=0).count()
    assert committed == len(half)  # the lost batch left nothing behind
    for f in seen.iterdir():
        f.unlink()
    all_ = scoring.score_job(texts, out, _counting(str(seen)), rows=40)
    assert not half.keys() & noted().keys() and set(noted().values()) == {1} and len(half) + len(noted()) == 200
    once = scoring.score_job(texts, f"file://{tmp_path}/once", _counting(str(seen)))
    assert sorted(map(tuple, all_.collect())) == sorted(map(tuple, once.collect())) and all_.count() == 200
    more = texts.unionByName(spark.createDataFrame([("new", "new", "y"), ("new", "new", "y")], texts.schema))
    assert scoring.score_job(more, out, _counting(str(seen)), rows=40).count() == 201
    assert scoring.score_job(texts.where("false"), f"file://{tmp_path}/none", _counting(str(seen))).count() == 0


def test_unchanged_tables_are_referred_to(spark, tmp_path):
    run, out, third = (f"file://{tmp_path}/{x}" for x in ("run", "out", "third"))
    people = registry.demographics(spark, SF)
    io.write_facilities(people, run, "patients")
    visits = people.select("facility_id", F.col("Id").alias("PATIENT"), F.concat(F.lit("e"), "Id").alias("Id"), F.lit("2020-01-01").alias("START"))
    io.write_facilities(visits, run, "encounters")
    io.write_facilities(visits.select("facility_id", F.col("Id").alias("ENCOUNTER"), "PATIENT"), run, "devices")
    assert programs.inject(spark, run, out) == []
    assert sorted(p.name for p in (tmp_path / "out/facilities").iterdir()) == ["patients.parquet"]
    assert io.manifest(spark, out) == {"encounters": run, "devices": run}
    assert io.facility_table(spark, out, "encounters").count() == visits.count() and io.tables_of(spark, out) == ["patients", "encounters", "devices"]
    ids = people.limit(3).select(F.col("Id").alias("PATIENT"))
    assert {t: df.count() for t, df in io.medical_records(spark, out, ids).items()} == {"encounters": 3, "devices": 3}
    assert programs.inject(spark, out, third) == []
    assert io.manifest(spark, third) == {"encounters": run, "devices": run}  # where they are, not where they are referred to
    io.write_facilities(visits.limit(1), third, "devices")  # a table of its own comes first
    assert io.facility_table(spark, third, "devices").count() == 1


def test_promotions_at_once(spark, tmp_path):
    registry_path = f"file://{tmp_path}/models"
    scores, said, lock = [0.5, 0.9, 0.7, 0.9, 0.6, 0.8], [], threading.Lock()
    gate = threading.Barrier(len(scores))

    def run(x):
        gate.wait()
        d = scoring.promote({"eval_f1": x, "eval_loss": 1 - x, "other": 1}, registry_path)
        with lock:
            said.append((x, d))

    threads = [threading.Thread(target=run, args=(x,)) for x in scores]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(d["model_version"] for _, d in said) == [1, 2, 3, 4, 5, 6]
    files = sorted(p.name for p in (tmp_path / "models").iterdir() if not p.name.startswith("."))
    assert files == [f"version_{k:06d}.json" for k in range(1, 7)]
    best = None
    for k, name in enumerate(files, 1):  # as if one after the other
        entry = json.loads((tmp_path / "models" / name).read_text())
        x, d = next((x, d) for x, d in said if d["model_version"] == k)
        assert entry["metrics"] == {"eval_f1": x, "eval_loss": 1 - x} and d["champion"] == (None if best is None else best[0])
        if best is None or x >= best[0]:
            best = (x, k)
        assert entry["champion"] == best[1]
    top = scoring.champion(spark, registry_path)
    assert top["metrics"]["eval_f1"] == 0.9 and scoring.champion(spark, f"file://{tmp_path}/none") is None
    assert io.create_text(spark, f"{registry_path}/version_000001.json", "x") is False
