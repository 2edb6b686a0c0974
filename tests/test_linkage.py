"""Run folders from end to end, and values and rules that no SQL compares."""

import collections
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom import config
from kinloom.functions import text
from kinloom.operators import dataset, errors, evaluate, golden, linkage, scoring, split, standardize, validate
from kinloom.operators.graph import delete_scratch, scratch_path
from kinloom.plans import programs
from kinloom.plans.registry import PRODUCTION
from kinloom.sources import tables as io

PEOPLE = {
    "uuid-A": ("John", "Smith", "", "1980-01-15", "123-45-6789", "123 Main St", "Boston", "MA", "02115", "M"),
    "uuid-B": ("Jane", "Doe", "Taylor", "1990-06-20", "234-56-7890", "456 Oak Ave", "Cambridge", "MA", "02139", "F"),
    "uuid-C": ("Bob", "Jones", "", "1975-03-10", "345-67-8901", "789 Pine Rd", "Springfield", "MA", "01101", "M"),
}
AT = {"facility_001": ["uuid-A", "uuid-B"], "facility_002": ["uuid-A", "uuid-C"], "facility_003": ["uuid-B"]}
COLUMNS = "Id string, FIRST string, LAST string, MAIDEN string, BIRTHDATE string, SSN string, ADDRESS string, CITY string, STATE string, ZIP string, GENDER string"


@pytest.fixture(scope="module", params=["own", "by facility"])
def run(spark, request):
    """Three people, five records, three facilities, two true pairs; in either layout."""
    where = scratch_path(spark)
    rows = [(f, i, *PEOPLE[i]) for f, ids in AT.items() for i in ids]
    people = spark.createDataFrame(rows, f"facility_id string, {COLUMNS}")
    who = people.select("facility_id", F.col("Id").alias("PATIENT"))
    tables = {
        "patients": people,
        "encounters": who.select("*", F.concat("PATIENT", F.lit("-"), "facility_id").alias("Id"), F.lit("2020-03-15T10:00:00Z").alias("START")),
        "conditions": who.select("*", F.lit("2020-03-15").alias("START"), F.lit("").alias("STOP"), F.lit("Essential hypertension").alias("DESCRIPTION")),
        "allergies": who.select("*", F.lit("Pollen").alias("DESCRIPTION")),
    }
    for name, df in tables.items():
        if request.param == "own":
            io.write_facilities(df, where, name)
        else:
            for f in AT:
                df.where(F.col("facility_id") == f).drop("facility_id").write.parquet(f"{where}/facilities/{f}/{name}.parquet")
    truth = people.select(F.col("Id").alias("original_patient_uuid"), F.substring("facility_id", -1, 1).cast("long").alias("facility_id"))
    io.write_truth(truth, where)
    return where


def test_resolve_and_golden_records(spark, run):
    out = scratch_path(spark)
    settings = config.build(config.Matching, config.merged(config.PUBLISHED, {"tiers": {"auto_match_probability": 0.9}}))
    found = programs.resolve(spark, run, out, settings, linkage.Model(PRODUCTION, 0.1))
    assert {(r.record_id_1, r.record_id_2) for r in found["auto_matches"].collect()} == {("facility_001_uuid-A", "facility_002_uuid-A"), ("facility_001_uuid-B", "facility_003_uuid-B")}
    predictions = found["gray_zone_pairs"].select("record_id_1", "record_id_2", F.lit(0).alias("prediction"), F.lit(0.99).alias("confidence"))
    made = programs.golden_records(spark, run, found["auto_matches"], predictions, out, settings, found["features"])
    golden_rows = sorted(made["golden_records"].collect(), key=lambda r: r.golden_id)
    assert [(r.golden_id, r.num_records, r.num_facilities, r.facilities) for r in golden_rows] == [("golden_000000", 2, 2, "facility_001,facility_002"), ("golden_000001", 2, 2, "facility_001,facility_003"), ("golden_000002", 1, 1, "facility_002")]
    assert [(r.first_name, r.ssn) for r in golden_rows] == [("John", "123456789"), ("Jane", "234567890"), ("Bob", "345678901")]
    row = made["metrics"].first()
    assert (row.f1, row.n_clusters, row.purity, row.completeness, row.count_accuracy) == (1.0, 3, 1.0, 1.0, True)
    base = {r.scenario: r for r in programs.baselines(spark, run, found["features"], out, settings).collect()}
    assert base["auto_match_only"].f1 == base["best_f1"].f1 == 1.0
    assert json.loads("".join(r[0] for r in spark.read.text(f"{out}/baseline_comparison.json").collect()))["scenarios"].keys() == {"auto_match_only", "best_f1"}


def test_trained_model_finds_the_matches(spark, run):
    out = scratch_path(spark)
    found = programs.resolve(spark, run, out, config.build(config.Matching, {"tiers": {"predict_threshold": 0.0001, "auto_match_probability": 0.9, "auto_reject_probability": 0.01}}))
    assert {(r.record_id_1, r.record_id_2) for r in found["features"].where("match_probability > 0.9").collect()} == {("facility_001_uuid-A", "facility_002_uuid-A"), ("facility_001_uuid-B", "facility_003_uuid-B")}


def test_prepare_dataset(spark, run):
    rows = programs.prepare_dataset(spark, run, scratch_path(spark)).collect()
    assert collections.Counter(r.label for r in rows) == {0: 2, 1: 2} and all(r.messages[1]["content"] == ("True" if r.label else "False") for r in rows)
    assert all("Essential hypertension *" in r.messages[0]["content"] for r in rows)


def test_segment_and_inject(spark):
    source, run, out = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    n = 60
    people = spark.range(n).select(F.concat(F.lit("p"), "id").alias("Id"), F.lit("WILLIAM").alias("FIRST"), F.lit("Smith").alias("LAST"), F.lit("Jones").alias("MAIDEN"), F.lit("1980-01-05").alias("BIRTHDATE"), F.lit("123-45-6789").alias("SSN"), F.concat("id", F.lit(" Oak Street")).alias("ADDRESS"), F.lit("Boston").alias("CITY"), F.lit("MA").alias("STATE"), F.lit("02115").alias("ZIP"), F.lit("M").alias("GENDER"))
    visits = spark.range(n * 10).select(F.concat(F.lit("e"), "id").alias("Id"), F.concat(F.lit("p"), (F.col("id") % n).cast("string")).alias("PATIENT"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("START"))
    hung = visits.select(F.col("Id").alias("ENCOUNTER"), "PATIENT", F.lit("d").alias("DESCRIPTION"))
    claims = visits.select(F.concat(F.lit("c"), "Id").alias("Id"), F.col("Id").alias("APPOINTMENTID"), F.col("PATIENT").alias("PATIENTID"))
    tables = {
        "patients": people, "encounters": visits, "conditions": hung, "claims": claims, "claims_transactions": claims.select(F.concat(F.lit("t"), "Id").alias("Id"), F.col("Id").alias("CLAIMID")),
        "payer_transitions": people.select(F.col("Id").alias("PATIENT"), F.lit("2019-01-01").cast("timestamp").alias("START_DATE"), F.lit(None).cast("timestamp").alias("END_DATE")),
        "organizations": spark.createDataFrame([("o", "1 A St", "Boston", "MA", "02115", 1.0, 2.0)], "Id string, ADDRESS string, CITY string, STATE string, ZIP string, LAT double, LON double"), "devices": hung.limit(0),
    }
    for name, df in tables.items():
        df.write.parquet(f"{source}/{name}.parquet")
    settings = config.load(config.Augmentation, facility_distribution={"num_facilities": 5}, confusable_groups={"percent": 20}, error_injection={"global_error_rate": 1.0})
    made = programs.segment(spark, source, run, settings)
    assert [made[t].count() for t in ("encounters", "conditions", "claims", "claims_transactions", "devices")] == [600, 600, 600, 600, 0]
    assert made["organizations"].count() == made["patients"].select("facility_id").distinct().count()
    assert not validate.validate_tables({t: made[t] for t in tables if t not in ("organizations",)})
    assert spark.read.parquet(f"{run}/metadata/confusable_pairs.parquet").count() == 12
    with_errors = config.load(config.Augmentation, error_injection={"global_error_rate": 1.0, "min_errors": 2, "max_errors": 3})
    assert programs.inject(spark, run, out, with_errors) == []
    truth = io.ground_truth(spark, out)
    assert truth.count() == made["patients"].count() and truth.agg(F.sum("num_encounters")).first()[0] == 600
    log = spark.read.json(f"{out}/metadata/error_log.jsonl")
    assert set(log.columns) == {"patient_uuid", "facility_id", "field", "error_type", "original", "errored", "timestamp"}
    assert log.count() > truth.count()
    lost = {**{t: made[t] for t in ("encounters", "claims_transactions")}, "patients": made["patients"].where("Id <> 'p1'")}
    said = validate.validate_tables(lost)
    assert any("claims missing" in x for x in said) and any("invalid PATIENT" in x for x in said)


def test_neighbours_are_the_fixed_ones(spark):
    assert errors.NEIGHBOURS["A"] == "QSZ" and errors.NEIGHBOURS["P"] == "OL" and len(errors.NEIGHBOURS) == 26 and len(errors.STREETS) == 20
    draws = spark.range(400).withColumn("v", F.lit("Margaret"))
    draw = lambda k: F.conv(F.substring(F.md5(F.concat("id", F.lit(f"-{k}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    got = draws.select(errors.many_typos(F.col("v"), draw, []).alias("m"), errors.name_typo(F.col("v"), draw, []).alias("t"), errors.many_typos(F.lit("abc"), draw, []).alias("s")).collect()
    differ = collections.Counter(sum(a != b for a, b in zip("Margaret", r.m)) for r in got)
    assert set(differ) == {2, 3} and min(differ.values()) > 100 and all(len(r.m) == 8 and r.m[0] == "M" for r in got)
    assert all(sum(a != b for a, b in zip("Margaret", r.t)) == 1 and r.t[0] == "M" for r in got) and all(r.s == "abc" for r in got)


def test_unregistered_errors_can_be_added(spark):
    df = spark.createDataFrame([(str(i), "S1234567", "X99", "1 Oak St") for i in range(50)], "Id string, DRIVERS string, PASSPORT string, ADDRESS string")
    out = errors.inject(df, least=1, most=1, several=1.0, weights={"document": 1.0}, extra={"document": errors.EXTRA})
    log = collections.Counter((r.error_type, r.field) for r in errors.error_statistics(out).collect() for _ in range(r.n))
    assert set(log) == {("drivers_license_error", "DRIVERS"), ("passport_error", "PASSPORT"), ("missing_whitespace", "ADDRESS")}
    total = {(r.statistic, r.key): r.n for r in errors.all_statistics(out).collect()}
    assert total["total_errors", None] == 50


def test_confusable_groups_share_their_columns(spark):
    columns = "Id string, FIRST string, LAST string, MAIDEN string, BIRTHDATE date, ADDRESS string, CITY string, ZIP string, GENDER string, STATE string, LAT double, LON double, RACE string, SSN string"
    row = lambda i, g: (i, f"f{i}", f"l{i}", f"m{i}", "2000-02-29", f"a{i}", f"c{i}", f"z{i}", g, f"s{i}", float(ord(i)), 1.0, f"r{i}", f"n{i}")
    df = spark.createDataFrame([row(i, "M") for i in "ACEG"] + [row(i, "F") for i in "BDF"], columns.replace("date", "string")).withColumn("BIRTHDATE", F.col("BIRTHDATE").cast("date")).withColumn("LAST", F.when(F.col("Id") != "C", F.col("LAST")))
    pairs = spark.createDataFrame([("A", "B", "twin"), ("C", "D", "parent_child"), ("E", "F", "sibling")], "source_patient_id string, target_patient_id string, group_type string")
    got = {r.Id: r for r in split.overwrite_confusable(df, pairs).collect()}
    b, d, f = got["B"], got["D"], got["F"]
    assert (b.LAST, b.GENDER, b.LAT, b.FIRST, b.MAIDEN, b.RACE, b.SSN, str(b.BIRTHDATE)) == ("lA", "M", 65.0, "fB", "mB", "rB", "nB", "2000-02-29")
    assert (d.FIRST, d.LAST, d.GENDER, d.MAIDEN) == ("fC", None, "F", "mD") and 25 <= d.BIRTHDATE.year - 2000 <= 30 and (d.BIRTHDATE.month, d.BIRTHDATE.day) in ((2, 28), (2, 29))
    assert (f.LAST, f.FIRST, f.GENDER) == ("lE", "fF", "F") and 1 <= abs(f.BIRTHDATE.year - 2000) <= 5
    assert {r.group_type: r.fields_copied for r in split.copied_fields(pairs).collect()}["sibling"] == "LAST,ADDRESS,CITY,ZIP,STATE,LAT,LON,BIRTHDATE"


def test_config_is_checked():
    for wrong in ({"facility_distribution": {"facility_count_weights": {1: 0.5}}}, {"facility_distribution": {"num_facilities": 3}}, {"error_injection": {"min_errors": 6}}, {"nonsense": 1}, {"facility_distribution": {"facility_count_weights": {0: 1.0}}}):
        with pytest.raises(ValueError):
            config.load(config.Augmentation, **wrong)
    assert config.build(config.Matching, config.PUBLISHED).gray_zone.threshold == -5.5


def test_config_files(tmp_path):
    settings = config.load(config.Augmentation, error_injection={"max_errors": 9})
    for name in ("a.yaml", "a.json"):
        config.dump(settings, str(tmp_path / name))
        assert config.load(config.Augmentation, str(tmp_path / name)) == settings
        assert config.load(config.Augmentation, str(tmp_path / name), random_seed=7).random_seed == 7


def test_names_and_keys(spark):
    df = spark.createDataFrame([("o'brien", "Ashcraft"), ("mary-jane", "Tymczak"), ("a1b", "Pfister"), ("", ""), (None, None)], "n string, s string")
    got = [tuple(r) for r in df.select(text.title_case(F.col("n")), text.sound_key(F.col("s")), text.canonical_first_name(F.lit(" bill "))).collect()]
    assert got[:3] == [("O'Brien", "A261", "WILLIAM"), ("Mary-Jane", "T522", "WILLIAM"), ("A1B", "P236", "WILLIAM")] and got[3][1] is got[4][1] is None
    out = standardize.prepare_linkage(spark.createDataFrame([("r", " ", "000000000", "1990-01-02")], "record_id string, first_name string, ssn string, birthdate string").withColumn("birthdate", F.to_date("birthdate"))).first()
    assert (out.first_name, out.ssn, out.birthdate, out.birth_year, out.soundex_first_name) == (None, None, "1990-01-02", 1990, None)


def test_csv_and_discovery(spark, tmp_path):
    (tmp_path / "patients.csv").write_text("Id,FIRST,ZIP,LAT,BIRTHDATE\np1,Ann12 Lee3,02115,1.5,1980-01-02\np2,,bad,x,nonsense\n")
    assert io.convert_csv(spark, f"file://{tmp_path}", f"file://{tmp_path}/out") == ["patients"]
    got = sorted(map(tuple, io.read_table(spark, f"file://{tmp_path}/out", "patients").withColumn("BIRTHDATE", F.col("BIRTHDATE").cast("string")).collect()))
    assert got[0] == ("p1", "Ann Lee", "02115", 1.5, "1980-01-02 00:00:00") and got[1][3:] == (None, None)
    for f in (lambda: io.run_folder(spark, f"file://{tmp_path}"), lambda: io.read_table(spark, f"file://{tmp_path}/out", "claims")):
        with pytest.raises(FileNotFoundError):
            f()


def test_zipped_predictions_and_guards(spark):
    pairs = spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(4)], "ord int, record_id_1 string, record_id_2 string")
    predictions = spark.createDataFrame([(i, i % 2, 0.9) for i in range(3)], "ord int, prediction int, confidence double")
    with pytest.warns(UserWarning):
        got = linkage.zipped(pairs, predictions)
    assert sorted((r.record_id_1, r.prediction) for r in got.collect()) == [("a0", 0), ("a1", 1), ("a2", 0)]
    assert dataset.shortfall(95, 100) == 5 and dataset.truth_loss(spark.createDataFrame([("a",), (None,)], "record_id string"), 0.6) == 0.5
    for f in (lambda: dataset.shortfall(80, 100), lambda: dataset.truth_loss(spark.createDataFrame([(None,)], "record_id string"))):
        with pytest.raises(ValueError):
            f()
    assert validate.validate_predictions(pairs, 3) == ["column prediction is missing", "column confidence is missing", "expected 3 rows, got 4"]


def test_scoring_and_promotion(spark, tmp_path):
    chat = spark.createDataFrame([("same words here", 1), ("none", 0)], "t string, l int").select(dataset.chat(F.concat("t", F.lit("\n\nRecord B:\n"), F.when(F.col("l") == 1, F.col("t")).otherwise("other")), F.col("l")).alias("messages"))
    found = scoring.evaluate_chat(chat, scoring.word_overlap)
    assert found["metrics"].first().f1 == 1.0 and found["errors"].first().errors == 0 and {r.correct for r in found["rows"].collect()} == {1}
    path = str(tmp_path / "registry.json")
    decisions = [scoring.promote({"eval_f1": x, "other": 1}, path) for x in (0.8, 0.7, 0.9)]
    assert [d["promoted"] for d in decisions] == [True, False, True] and decisions[2]["champion"] == 0.8 and decisions[2]["champion_version"] == 1
    assert scoring.throughput(10, 4.0, 2)["throughput"] == 2.5


def test_merge_warns_of_an_unknown_strategy(spark):
    df = spark.createDataFrame([("c", "r1", 1, "x"), ("c", "r2", 2, "y"), ("c", "r3", 3, "y")], "cluster string, record_id string, ord int, city string")
    with pytest.warns(UserWarning):
        assert golden.merge(df, "newest", ("city",), provenance=False).first().asDict() == {"cluster": "c", "num_records": 3, "num_facilities": 3, "city": "y"}


def test_sweep_of_the_baseline_grid(spark):
    rng = np.random.default_rng(3)
    p = [*rng.random(300).tolist(), *evaluate.BASELINE_GRID[:40], *evaluate.GRID[:40]]
    rows = [(i, i + 1, x) for i, x in enumerate(p)]
    scored, truth = spark.createDataFrame(rows, "record_id_1 int, record_id_2 int, p double"), spark.createDataFrame([(i, i + 1) for i in range(0, 380, 3)], "record_id_1 int, record_id_2 int")
    for grid in (evaluate.GRID, evaluate.BASELINE_GRID):
        got = {r.threshold: (r.tp, r.fp) for r in evaluate.threshold_sweep(scored, truth, grid).collect()}
        assert got == {t: (sum(x >= t and i % 3 == 0 for i, _, x in rows), sum(x >= t and i % 3 != 0 for i, _, x in rows)) for t in grid}


def test_jaro_winkler_of_bytes():
    one = lambda a, b: float(text.jaro_winkler_bytes([a.encode()], [b.encode()])[0])
    assert one("MARTHA", "MARHTA") == pytest.approx(0.9611111) and one("", "") == 0 and one("x", "x") == 1 and one("Xiao", "Xuwo") == pytest.approx(2 / 3)
    assert one("José", "Jose") == pytest.approx(0.8483, abs=1e-4) and math.isclose(one("DIXON", "DICKSONX"), 0.8133333, abs_tol=1e-6)


def test_scratch_is_deleted(spark):
    path = scratch_path(spark)
    spark.range(3).write.parquet(path)
    assert delete_scratch(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
