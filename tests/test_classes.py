"""Pairs counted and listed by classes of equal values, against pairs of records."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.operators import dataset, linkage, split
from kinloom.operators.graph import connected_components
from kinloom.plans import registry


@pytest.fixture(scope="module")
def records(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice(["ann", "anne", "bob", None]), draw.choice(["lee", "leigh"]), draw.choice(["1", "2", None]), draw.choice([1, 2, 9, None])) for k in range(120)]
    return spark.createDataFrame(rows, "record_id long, first_name string, last_name string, zip string, birth_year int").cache()


def test_classes_count_every_pair(records):
    keys = [f"gamma_{c.name}" for c in registry.COMPARISONS]
    plain = linkage.compare_blocks(records, registry.RULES, registry.COMPARISONS)
    classes = linkage.compare_classes(records, registry.RULES, registry.COMPARISONS)
    rows = lambda df, n: sorted((tuple(r) for r in df.groupBy(*keys, "match_key", "tf_first_name_l").agg(n.alias("n")).collect()), key=repr)
    by_class = classes.withColumn("tf_first_name_l", F.greatest("tf_first_name_l", "tf_first_name_r"))
    assert rows(by_class, F.sum("n")) == rows(plain.withColumn("tf_first_name_l", F.greatest("tf_first_name_l", "tf_first_name_r")), F.count(F.lit(1)))
    copies = records.unionByName(records.withColumn("record_id", F.col("record_id") + 1000))
    assert linkage.compare_classes(copies, registry.RULES, registry.COMPARISONS).where("record_id_l <> record_id_r").count() == classes.where("record_id_l <> record_id_r").count()


@pytest.mark.parametrize("rows_a_piece", [3, 1000])
def test_classes_expand_to_every_pair(records, monkeypatch, rows_a_piece):
    monkeypatch.setattr(linkage, "CLASS_ROWS", rows_a_piece)
    pairs = linkage.compare_classes(records, registry.RULES, []).select("record_id_l", "record_id_r", "match_key")
    got = linkage.expand(pairs, records, linkage.value_classes(records, registry.RULES, [])).select("record_id_l", "record_id_r", "match_key")
    want = linkage.block(records, registry.RULES).select("record_id_l", "record_id_r", "match_key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_links_follow_records_not_pairs(spark, tmp_path):
    """300 copies of three years and one of a far year: links are not the 45,000 pairs, and components are theirs."""
    years = [10, 12, 17] * 100 + [40]
    spark.createDataFrame([(k, "ann lee", "c", "z", y) for k, y in enumerate(years)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    links = registry.matches(spark, str(tmp_path))
    assert links.count() < 310
    found = connected_components(links, "record_id_1", "record_id_2").collect()
    assert {r.node for r in found} == set(range(300)) and {r.component for r in found} == {0}


def test_similarity_is_symmetric():
    draw = random.Random(5)
    words = [bytes(draw.choice(b"aab") for _ in range(draw.randrange(12))) for _ in range(4000)]
    a, b = words[:2000], words[2000:]
    assert (text.jaro_winkler_bytes(a, b) == text.jaro_winkler_bytes(b, a)).all()


@pytest.mark.parametrize("rows_a_task", [7, 50_000])
def test_proposals_do_not_depend_on_cuts(spark, monkeypatch, rows_a_task):
    free = spark.range(101).select((F.col("id") % 2).alias("facility_id"), F.col("id").alias("patient_id"))
    want = {r.patient_id: r.h for r in free.select("patient_id", split.hashed(42, F.lit(0), F.col("patient_id")).alias("h")).collect()}
    pairs = set()
    for f in (0, 1):
        own = sorted((k for k in want if k % 2 == f), key=want.get)
        pairs |= {tuple(sorted(own[i : i + 2])) for i in range(0, len(own) - 1, 2)}
    monkeypatch.setattr(split, "PAIR_ROWS", rows_a_task)
    assert {tuple(r[:2]) for r in split._proposals(free, 42, 0).collect()} == pairs


def test_places_follow_ids(spark):
    people = spark.range(150_000).select((F.col("id") * 3).alias("record_id"), F.lit("x").alias("true_patient_id"))
    assert dataset._indexed(people).where("i <> record_id DIV 3").count() == 0


def test_cuts_copy_no_square(spark):
    """Blocks of 50 times the bound are cut into 50 at most, but into no more than the partitions need, and every pair stays."""
    people = spark.range(800).select(F.col("id").alias("record_id"), (F.col("id") % 8).alias("zip"))
    hot, _, blocks = linkage._hot_blocks(people.select(F.col("zip").alias("q0")), {0: ["q0"]}, 2)
    assert blocks == 8 and hot.agg(F.max("cuts")).first()[0] <= 8
    assert linkage.block(people, [("zip",)], hot_block=2).distinct().count() == 8 * 100 * 99 // 2


def test_reaching_keeps_every_pair_that_scores(spark):
    """All pairs at the threshold stay, with nulls, other alphabets and dates that are none; of the others most go before similarities."""
    draw = random.Random(7)
    some = lambda *v: draw.choice([*v, None])
    rows = [(f"r{k}", some("Anna", "Hanna", "Ána", "Bob", ""), some("Lee", "Leigh", "Smith", "Smyth"), f"{k // 2} Oak " + draw.choice(["St", "Street"]), some("Boston", "Bostom", "Lynn"), some("1", "2"), some(f"{k // 2}", "7"), some(f"1980-01-{k % 28 + 1:02d}", "1980-10-01", "1980-02-30", "then"), draw.choice("MF")) for k in range(150)]
    people = spark.createDataFrame(rows, "record_id string, first_name string, last_name string, address string, city string, zip string, ssn string, birthdate string, gender string")
    rules, model = [("zip",), ("gender",), ("last_name",)], linkage.Model(registry.PRODUCTION, 0.001)
    plain = linkage.score(linkage.compare_blocks(people, rules, model.comparisons), model).where("match_probability >= 0.01")
    want = {(r.record_id_l, r.record_id_r, r.match_key): r.match_weight for r in plain.collect()}
    kept = {tuple(r) for r in linkage.reaching(people, model, 0.01, rules).collect()}
    assert want and set(want) <= kept and len(kept) < 0.5 * linkage.block(people, rules).count()
    found = linkage.predict(people, model, 0.01, rules)
    assert {(r.record_id_1, r.record_id_2, r.match_key): r.match_weight for r in found.collect()} == pytest.approx(want)


def test_hints_bound_similarity(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("aAbé1 -") for _ in range(draw.randrange(9)))
    pairs = [(word(), word()) for _ in range(1500)] + [(w + "x" * 70_000, w) for w in ("ab", "b")]
    true = text.jaro_winkler_bytes([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs])
    df = spark.createDataFrame([(*p, float(s)) for p, s in zip(pairs, true)], "a string, b string, s double").withColumns({"x": text.letter_hints(F.col("a")), "y": text.letter_hints(F.col("b"))})
    for t in (0.5, 0.7, 0.8, 0.92):
        can = text.similar_reach(*((F.col(f"x.{k}"), F.col(f"y.{k}")) for k in ("low", "high", "size")), t)
        assert df.where((F.col("s") >= t) & ~can).count() == 0
    assert df.where(~can).count() > 500


def test_dates_that_one_edit_can_reach(spark):
    dates = [f"19{y}-0{m}-{d:02d}" for y in (80, 81, 8) for m in (1, 2) for d in (1, 10, 12, 21)] + ["", "none at all"]
    df = spark.createDataFrame([(a, b) for a in dates for b in dates], "a string, b string")
    can = text.one_edit_reach(text.date_digits(F.col("a")), text.date_digits(F.col("b")))
    assert df.where(text.one_edit_date(F.col("a"), F.col("b")) & ~F.coalesce(can, F.lit(False))).count() == 0
    assert df.where(can).count() < 0.7 * len(dates) ** 2


def test_errors_are_dealt_over_tasks(spark):
    """Patients of one split of a file become work for several tasks, with the same errors."""
    from kinloom.operators import errors

    people = spark.range(200).select(F.col("id").cast("string").alias("Id"), F.lit("02115").alias("ZIP")).coalesce(1)
    made = errors.inject(people, most=1, weights={"missing_data": 1.0})
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert made.where("ZIP IS NULL AND size(error_log) = 1").count() == 200
    assert registry.error_values(spark, "/root/testdata/sf0.001").where("error = 'missing_whitespace'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_components_with_leaves(spark, monkeypatch):
    """Leaves hang on their only neighbour after the rounds, which see the other edges alone; components are those of a plain search."""
    from kinloom.operators import graph

    rnd = random.Random(3)
    links = [(7, 1000 + i) for i in range(500)] + [(i + 1, i) for i in range(40, 80)] + [(2000 + i, 3000 - i) for i in range(50)] + [(5, 5), (9, None), (3100, 3101), (3101, 3100)]
    links += [(4000 + rnd.randrange(300), 4000 + rnd.randrange(300)) for _ in range(180)] + [(6000 + i, 5000) for i in range(5)] + [(4900, 5000)]
    parent = {x: x for a, b in links if b is not None and a != b for x in (a, b)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    rows, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: rows.append((out := plain(df)).count()) or out)
    found = [tuple(r) for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(found) == sorted((x, root(x)) for x in parent)
    assert sum(n >= 500 for n in rows) == 2  # the edges and the leaves, whatever the rounds


def test_partitions_follow_pairs(spark, monkeypatch):
    """One block's pairs are dealt over partitions of a bounded number of pairs, each pair once, the smaller id first; nulls find nothing."""
    monkeypatch.setattr(linkage, "PAIRS_A_PARTITION", 10_000)
    people = spark.range(900).select(F.col("id").cast("string").alias("record_id"), F.when(F.col("id") < 800, 0).alias("zip"), (F.col("id") % 2).alias("half"))
    pairs = linkage.block(people, [("zip", "half"), ("half",), ("zip",)], carry=("half",)).select("*", F.spark_partition_id().alias("p")).cache()
    assert pairs.count() == pairs.select("record_id_l", "record_id_r").distinct().count() == 800 * 799 // 2 + 2 * (450 * 449 - 400 * 399) // 2
    assert pairs.where("record_id_l >= record_id_r OR half_l <> record_id_l % 2 OR half_r <> record_id_r % 2").isEmpty()
    assert pairs.groupBy("match_key", "p").count().agg(F.max("count")).first()[0] < 60_000
    assert linkage.block(people, [("zip",)], carry=("half",), where=F.col("half_l") != F.col("half_r")).count() == 400 * 400
