"""The entry programs: build a test bed, link records, make golden records, make training pairs, compare baselines."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom import config
from kinloom.operators import dataset, errors, evaluate, golden, linkage, split, standardize, summarize, validate
from kinloom.operators.graph import materialize
from kinloom.sources import tables as io

KEYS = ["record_id_1", "record_id_2"]


def segment(spark: SparkSession, source: str, run: str, settings: config.Augmentation = config.Augmentation()) -> dict[str, DataFrame]:
    """Deals the source tables (Parquet) to facilities and writes a run folder."""
    places, seed = settings.facility_distribution, settings.random_seed
    tables = {t: io.read_table(spark, source, t) for t in io.SOURCE if io._paths(spark, f"{source}/{t}.parquet")}
    people = tables["patients"]
    who = people.select(F.col("Id").alias("patient_id")).distinct()
    assignment = materialize(split.assign_facilities(who, places.num_facilities, places.facility_count_weights, seed))
    visits = tables["encounters"].select(F.col("Id").alias("encounter_id"), F.col("PATIENT").alias("patient_id"), F.col("START").alias("start"))
    at = materialize(split.encounter_facilities(visits, assignment, places.primary_facility_weight))
    n = split.pair_count(who.count(), settings.confusable_groups.total_pairs, settings.confusable_groups.percent)
    pairs = materialize(split.confusable_pairs(assignment, n, seed)) if n else None
    if pairs is not None:
        tables["patients"] = split.overwrite_confusable(people, pairs, seed)
        split.copied_fields(pairs).write.mode("overwrite").parquet(f"{run}/metadata/confusable_pairs.parquet")
    named = F.format_string("facility_%03d", "facility_id")
    out = {t: df.withColumn("facility_id", named) for t, df in split.split_tables(tables, assignment, at).items()}
    for name, df in out.items():
        io.write_facilities(df, run, name)
    if "organizations" in tables:
        io.write_csv(io.generate_facilities(tables["organizations"], places.num_facilities, seed), f"{run}/metadata/facilities.csv")
    statistics = materialize(split.all_statistics(assignment, at))
    if settings.validate_output:
        said = validate.validate_distribution(statistics, who.count(), visits.join(assignment, "patient_id", "left_semi").count(), places.facility_count_weights)
        io.write_metrics({"warnings": said}, f"{run}/metadata/distribution.json", spark)
    return {t: io.facility_table(spark, run, t) for t in out} | {"statistics": statistics}


def inject(spark: SparkSession, run: str, out: str, settings: config.Augmentation = config.Augmentation()) -> list[str]:
    """Writes a run folder with errors in its patients, its truth and the log of errors; the manifest refers to all other tables where they are. What validation says of it."""
    rule = settings.error_injection
    raw = io.facility_table(spark, run, "patients").drop("ord")
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("BIRTHDATE",) if dict(raw.dtypes).get(c, "string") != "string"}
    wrong = errors.inject(raw.withColumns(dates), rule.global_error_rate, rule.min_errors, rule.max_errors, rule.multiple_errors_probability, rule.error_type_weights, settings.random_seed)
    wrong = materialize(wrong)
    visits = io.facility_table(spark, run, "encounters").select("facility_id", F.col("PATIENT").alias("patient_id"))
    truth = errors.truth_of(wrong.join(raw.select("Id", "facility_id"), ["Id", "facility_id"], "left_semi"), visits)
    io.write_facilities(wrong.drop("error_log"), out, "patients")
    there = io.tables_of(spark, run, tuple(t for t in io.SOURCE if t != "patients"))
    io.pass_through(spark, run, out, there)
    io.write_truth(truth.withColumn("facility_id", F.regexp_extract("facility_id", r"(\d+)", 1).cast("long")), out)
    io.write_error_log(wrong, f"{out}/metadata/error_log.jsonl")
    n = wrong.agg(F.sum(F.size("error_log"))).first()[0] or 0
    io.write_metrics(errors.truth_statistics(truth, n), f"{out}/metadata/statistics.json")
    io.write_text(spark, f"{out}/metadata/run_config.json", io.json.dumps(asdict(settings), indent=2))
    said = validate.validate_tables({t: io.facility_table(spark, out, t) for t in [*there, "patients"]}) if settings.validate_output else []
    return said[:10]


def _linkage_records(spark: SparkSession, run: str) -> tuple[DataFrame, DataFrame]:
    people = materialize(io.patients(spark, run))
    return people, materialize(standardize.prepare_linkage(people))


def resolve(spark: SparkSession, run: str, out: str, settings: config.Matching = config.Matching(), model: linkage.Model | None = None) -> dict[str, DataFrame]:
    """Links the records of a run folder: writes features, auto matches, texts of gray-zone pairs and metrics, and returns them. model is trained if not given."""
    people, records = _linkage_records(spark, run)
    truth = io.truth_with_records(io.ground_truth(spark, run), people)
    present = [c for c in linkage.COMPARISONS if c.name in records.columns]
    rules = [r for r in linkage.RULES if all((k if isinstance(k, str) else k[0]) in records.columns for k in r)]
    model = model or linkage.train(records, linkage.Model(list(present)))
    tiers = settings.tiers
    features = linkage.predict(records, model, tiers.predict_threshold, rules).withColumn("total_score", F.col("match_probability"))
    features = features.withColumn("tier", linkage.tier(F.col("match_probability"), tiers.auto_match_probability, tiers.auto_reject_probability))
    features.write.mode("overwrite").parquet(f"{out}/features.parquet")
    features = spark.read.schema(features.schema).parquet(f"{out}/features.parquet")
    auto = features.where("tier = 'auto_match'").select(*KEYS, "total_score")
    auto.write.mode("overwrite").parquet(f"{out}/auto_matches.parquet")
    gray = gray_zone_texts(features.where("tier = 'gray_zone'"), people, io.medical_records(spark, run, tables=tuple(io.SUMMARY_COLUMNS), columns=io.SUMMARY_COLUMNS))
    gray.write.mode("overwrite").parquet(f"{out}/gray_zone_pairs.parquet")
    pairs = materialize(evaluate.truth_pairs(truth.select("record_id", "true_patient_id")))
    scored = features.select(*KEYS, F.col("match_probability").alias("p"))
    best = evaluate.best_threshold(evaluate.threshold_sweep(scored, pairs))
    sizes = people.agg(F.count(F.lit(1)).alias("num_records"), F.countDistinct("facility_id").alias("num_facilities"))
    row = sizes.crossJoin(evaluate.tier_counts(features)).crossJoin(evaluate.blocking_recall(features, pairs).select("blocking_recall", "true_pairs"))
    row = row.crossJoin(evaluate.metrics(evaluate.confusion(auto, pairs)).select(*(F.col(c).alias(f"auto_{c}") for c in ("tp", "fp", "fn", "precision", "recall", "f1"))))
    row = row.crossJoin(best.select(*(F.col(c).alias(f"best_{c}") for c in ("threshold", "precision", "recall", "f1"))))
    io.write_metrics({**io.write_metrics(row, f"{out}/resolve_metrics.json"), **asdict(tiers)}, f"{out}/resolve_metrics.json", spark)
    return {"features": features, "auto_matches": spark.read.parquet(f"{out}/auto_matches.parquet"), "gray_zone_pairs": spark.read.parquet(f"{out}/gray_zone_pairs.parquet"), "metrics": row}


def record_summaries(people: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """record_id, summary of each record's clinical history at its facility."""
    keyed = {t: df.withColumn("record_id", F.concat_ws("_", "facility_id", "PATIENT")) for t, df in tables.items()}
    return summarize.summaries(people.select("record_id"), keyed, "record_id")


def gray_zone_texts(pairs: DataFrame, people: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """record_id_1, record_id_2, total_score, text of pairs; each record is summarised once, and pairs with an unknown record are left out."""
    wanted = pairs.select(F.explode(F.array(*KEYS)).alias("record_id")).distinct()
    texts = materialize(record_summaries(people.join(wanted, "record_id", "left_semi"), tables))
    both = pairs
    for k, side in zip("ab", KEYS):
        both = both.join(texts.select(F.col("record_id").alias(side), F.col("summary").alias(k)), side)
    return both.select(*KEYS, "total_score", summarize.prompt(F.col("a"), F.col("b")).alias("text"))


def golden_records(
    spark: SparkSession, run: str, auto_matches: DataFrame, predictions: DataFrame, out: str, settings: config.Matching = config.Matching(),
    features: DataFrame | None = None, gray_zone_pairs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Fuses a text classifier's predictions with the model's probabilities, clusters all matches and merges the records: writes golden records, matches and metrics, and returns them."""
    people = materialize(io.patients(spark, run))
    truth = materialize(io.truth_with_records(io.ground_truth(spark, run), people).select("record_id", "true_patient_id"))
    if not set(KEYS) <= set(predictions.columns):
        if gray_zone_pairs is None:
            raise ValueError("predictions without record ids need gray_zone_pairs")
        predictions = linkage.zipped(gray_zone_pairs, predictions)
    judged = materialize(linkage.verdict(linkage.with_features(predictions, features), settings.gray_zone))
    text = judged.where("verdict = 'accepted'").select(*KEYS, F.col("confidence").alias("llm_confidence"))
    auto = auto_matches.select(F.least(*KEYS).alias(KEYS[0]), F.greatest(*KEYS).alias(KEYS[1]), "total_score").groupBy(*KEYS).agg(F.max("total_score").alias("total_score"))
    matches = materialize(linkage.union_with_source(auto, text).select(*KEYS, "source", "total_score", "llm_confidence"))
    made = merged_records(people, matches, settings)
    made.orderBy("golden_id").write.mode("overwrite").parquet(f"{out}/golden_records.parquet")
    matches.orderBy(*KEYS).write.mode("overwrite").parquet(f"{out}/all_matches.parquet")
    row = scenario_metrics(made, matches, truth, people).crossJoin(linkage.verdict_counts(judged))
    io.write_metrics(row, f"{out}/evaluation_metrics.json")
    return {"golden_records": made, "all_matches": matches, "judged": judged, "metrics": row}


def merged_records(people: DataFrame, matches: DataFrame, settings: config.Matching) -> DataFrame:
    numbered = golden.placed(people, "ord").drop("ord").withColumnRenamed("place", "ord")
    made = golden.merge(golden.assign_clusters(numbered, matches), settings.golden_record.conflict_resolution)
    numbered = materialize(golden.number(made))
    return numbered if settings.golden_record.include_provenance else numbered.drop("facilities")


def scenario_metrics(made: DataFrame, matches: DataFrame, truth: DataFrame, people: DataFrame) -> DataFrame:
    """One row of pair, golden-record and cluster metrics."""
    pairs = evaluate.match_metrics(matches, evaluate.truth_pairs(truth))
    clusters = golden.cluster_quality(golden.listed_records(made), truth.dropna())
    return pairs.crossJoin(evaluate.golden_counts(made, truth)).crossJoin(clusters)


def baselines(spark: SparkSession, run: str, features: DataFrame, out: str, settings: config.Matching = config.Matching(), other: dict | None = None) -> DataFrame:
    """scenario, threshold and all metrics of the model's auto matches and of its best threshold, beside metrics that are given; written with the best threshold's golden records."""
    people = materialize(io.patients(spark, run))
    truth = materialize(io.truth_with_records(io.ground_truth(spark, run), people).select("record_id", "true_patient_id"))
    scored = features.select(*KEYS, F.col("match_probability").alias("p"))
    sweep = evaluate.threshold_sweep(scored, evaluate.truth_pairs(truth), evaluate.BASELINE_GRID)
    best = round(evaluate.best_threshold(sweep).first()["threshold"], 2)
    rows = None
    for name, threshold in (("auto_match_only", settings.tiers.auto_match_probability), ("best_f1", best)):
        matches = materialize(evaluate.matches_at(scored, threshold))
        made = merged_records(people, matches, settings)
        if name == "best_f1":
            made.write.mode("overwrite").parquet(f"{out}/best_f1_golden_records.parquet")
        row = scenario_metrics(made, matches, truth, people).select(F.lit(name).alias("scenario"), F.lit(float(threshold)).alias("threshold"), "*")
        rows = row if rows is None else rows.unionByName(row)
    rows = materialize(rows)
    scenarios = {r["scenario"]: r.asDict() for r in rows.collect()} | ({"fused": other} if other else {})
    io.write_metrics({"scenarios": scenarios}, f"{out}/baseline_comparison.json", spark)
    return rows


def prepare_dataset(spark: SparkSession, run: str, out: str, seed: int = 42, longest: int = 0, length=F.length) -> DataFrame:
    """Training pairs as chat rows: all true pairs and as many others, as prompts of both summaries, no longer than longest (0: any) by length, in balanced splits by hash. messages, label, split; statistics are written beside them."""
    people = materialize(io.patients(spark, run))
    truth = io.truth_with_records(io.ground_truth(spark, run), people).select("record_id", "true_patient_id")
    lost = dataset.truth_loss(truth)
    known = materialize(truth.dropna())
    true = materialize(evaluate.truth_pairs(known))
    target = true.count()
    false = materialize(dataset.negatives(known, target, seed))
    short = dataset.shortfall(false.count(), target)
    pairs = true.withColumn("label", F.lit(1)).unionByName(false.withColumn("label", F.lit(0))).withColumn("total_score", F.col("label").cast("double"))
    texts = gray_zone_texts(pairs, people, io.medical_records(spark, run, tables=tuple(io.SUMMARY_COLUMNS), columns=io.SUMMARY_COLUMNS))
    rows = texts.withColumn("label", F.col("total_score").cast("int"))
    rows = materialize(rows.where(length(F.col("text")) <= longest) if longest else rows)
    dealt = dataset.split(rows, "label", split.hashed(seed, *(F.col(k) for k in KEYS)))
    made = dealt.select(*KEYS, dataset.chat(F.col("text"), F.col("label")).alias("messages"), "label", "split")
    made.write.mode("overwrite").partitionBy("split").parquet(f"{out}/pairs.parquet")
    stats = dataset.length_statistics(rows, length(F.col("text"))).first().asDict()
    io.write_metrics({"true_pairs": target, "shortfall": short, "truth_lost": lost, "length": stats, "seed": seed}, f"{out}/dataset_info.json", spark)
    return made
