"""Reading and writing run folders: CSV to Parquet, facility tables, clinical tables, truth, pair files.

A run folder has ``facilities`` and ``metadata``. A facility table is one dataset,
``facilities/<table>.parquet`` in partitions by facility_id, as this package writes
it, or one file or folder a facility, ``facilities/facility_NNN/<table>.parquet``.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.text import strip_digits
from kinloom.operators.split import ENCOUNTER_LINKED
from kinloom.operators.standardize import create_record_id, standardize_columns

CLINICAL = ("encounters", *ENCOUNTER_LINKED)
# The source tables, and of those that a summary reads, the columns.
SOURCE = (
    "patients", "encounters", "conditions", "medications", "observations", "procedures", "immunizations", "allergies", "careplans", "imaging_studies",
    "devices", "supplies", "claims", "claims_transactions", "payer_transitions", "organizations", "providers", "payers",
)
SUMMARY_COLUMNS = {
    "conditions": ("PATIENT", "START", "STOP", "DESCRIPTION"),
    "medications": ("PATIENT", "START", "STOP", "DESCRIPTION"),
    "allergies": ("PATIENT", "DESCRIPTION"),
    "observations": ("PATIENT", "DATE", "DESCRIPTION", "VALUE", "UNITS"),
    "procedures": ("PATIENT", "START", "DESCRIPTION"),
}
#: Columns read as timestamps, by table, and as numbers in any table; all others are strings.
STAMPS = {"encounters": ("START", "STOP"), "payer_transitions": ("START_DATE", "END_DATE"), "patients": ("BIRTHDATE", "DEATHDATE")}
NUMBERS = ("LAT", "LON", "BASE_ENCOUNTER_COST", "TOTAL_CLAIM_COST", "PAYER_COVERAGE", "BASE_COST", "TOTALCOST", "DISPENSES")


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order, on any file system that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


# How a column's texts are spelt in each of the lattice's types. A whole number has no leading zero, so that codes stay texts.
SPELLINGS = {
    "boolean": r"^(?i:true|false)$",
    "bigint": r"^(0|-?[1-9][0-9]{0,17})$",
    "double": r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[-+][0-9]{2}:?[0-9]{2})?)?$",
}
#: Types from narrow to wide in which a column may end: the first whose spelling all its values have. Whatever conflicts is a string.
LATTICE = ("boolean", "bigint", "double", "date", "timestamp")


def infer_types(texts: DataFrame) -> dict[str, str]:
    """The narrowest type of each string column that holds all its values, read back as they are; string for mixed ones and for those without values.

    A partial result is one set of types a column that all values so far fit. Sets are intersected, in any order, so partitions of one file
    or of many files are merged by one aggregation over all rows, and no part of them is sampled.
    """
    def fits(c: str, kind: str) -> Column:
        value = F.col(f"`{c}`")
        ok = value.rlike(SPELLINGS[kind])
        if kind == "double":  # codes such as 02115 are no numbers
            ok = ok & ~value.rlike(r"^-?0[0-9]")
        if kind in ("date", "timestamp"):  # no February 30
            ok = ok & (value.isNull() | F.expr(f"try_cast(`{c}` AS {kind})").isNotNull())
        return ok

    tests = [F.struct(F.count(f"`{c}`").alias("n"), *(F.coalesce(F.bool_and(fits(c, kind)), F.lit(True)).alias(kind) for kind in LATTICE)).alias(f"c{k}") for k, c in enumerate(texts.columns)]
    if not tests:
        return {}
    row = texts.agg(*tests).first()
    return {c: next((kind for kind in LATTICE if row[k]["n"] and row[k][kind]), "string") for k, c in enumerate(texts.columns)}


def typed(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns as the given types; what does not fit is null."""
    return texts.select(*(F.expr(f"try_cast(`{c}` AS {types[c]})").alias(c) if types.get(c, "string") != "string" else F.col(f"`{c}`") for c in texts.columns))


def read_csv(spark: SparkSession, path: str, table: str = "", infer: bool = True) -> DataFrame:
    """The table's timestamps in either of two formats, and numbers; what is no number or date there is null. All other columns have the type that fits all their values (infer), or are strings. Digits leave patients' names; ZIPs keep their zeros."""
    df = spark.read.option("header", True).csv(path)
    stamps, names = STAMPS.get(table, ()), ("FIRST", "LAST", "MAIDEN") if table == "patients" else ()
    fixed = {c for c in df.columns if c in stamps or c in NUMBERS or c in names}
    if infer:
        df = typed(df, infer_types(df.select(*(F.col(f"`{c}`") for c in df.columns if c not in fixed))))
    for c in stamps:
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))
    df = df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in NUMBERS if c in df.columns})
    return df.withColumns({c: strip_digits(F.col(c)) for c in names if c in df.columns})


def convert_csv(spark: SparkSession, source: str, target: str, tables: tuple[str, ...] = SOURCE) -> list[str]:
    """Every table of a folder of CSV files as Parquet; absent ones are skipped. The tables written."""
    done = [t for t in tables if _paths(spark, f"{source}/{t}.csv")]
    for t in done:
        read_csv(spark, f"{source}/{t}.csv", t).write.mode("overwrite").parquet(f"{target}/{t}.parquet")
    return done


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, from any file system that Spark knows."""
    return spark.read.text(path, wholetext=True).first()[0]


MANIFEST = "metadata/manifest.json"


def manifest(spark: SparkSession, run: str) -> dict[str, str]:
    """Tables that a run folder does not hold itself, and the run folders that do."""
    return json.loads(read_text(spark, f"{run}/{MANIFEST}"))["tables"] if _exists(spark, f"{run}/{MANIFEST}") else {}


def home_of(spark: SparkSession, run: str, table: str) -> str:
    """The run folder whose files hold a table: its own files come first, then the manifest's folder, whose own manifest counts no more."""
    if _paths(spark, f"{run}/facilities/{table}.parquet") or _paths(spark, f"{run}/facilities/facility_*/{table}.parquet"):
        return run
    return manifest(spark, run).get(table, run)


def pass_through(spark: SparkSession, run: str, out: str, tables: list[str]) -> dict[str, str]:
    """Lets the run folder out refer to tables of run instead of copying them; a table that run itself refers to is referred to where it is. What the manifest says now."""
    known = {t: home_of(spark, run, t) for t in tables}
    write_text(spark, f"{out}/{MANIFEST}", json.dumps({"tables": dict(sorted(known.items()))}, indent=2) + "\n")
    return known


def tables_of(spark: SparkSession, run: str, tables: tuple[str, ...] = SOURCE) -> list[str]:
    """Those tables that a run folder holds or refers to."""
    referred = manifest(spark, run)
    return [t for t in tables if t in referred or home_of(spark, run, t) == run and (_paths(spark, f"{run}/facilities/{t}.parquet") or _paths(spark, f"{run}/facilities/facility_*/{t}.parquet"))]


def read_table(spark: SparkSession, folder: str, table: str, columns: list[str] | None = None) -> DataFrame:
    if not _paths(spark, f"{folder}/{table}.parquet"):
        raise FileNotFoundError(f"{folder}/{table}.parquet")
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)


def run_folder(spark: SparkSession, path: str) -> str:
    """path, if it is a run folder."""
    if not _paths(spark, f"{path.rstrip('/')}/facilities"):
        raise FileNotFoundError(f"{path} has no facilities")
    return path.rstrip("/")


def facility_name(number: int | str) -> str:
    return number if isinstance(number, str) else f"facility_{number:03d}"


def facility_table(spark: SparkSession, run: str, table: str, columns: list[str] | None = None, facility: int | str | None = None) -> DataFrame:
    """A table of all facilities, or of one, with facility_id, and ord, the rows' order."""
    top = f"{home_of(spark, run_folder(spark, run), table)}/facilities"
    where = [p for p in _paths(spark, f"{top}/facility_*/{table}.parquet") if re.search(r"/facility_\d+/[^/]*$", p)]
    if _paths(spark, f"{top}/{table}.parquet"):
        df = spark.read.parquet(f"{top}/{table}.parquet")
    elif where:
        df = spark.read.option("mergeSchema", True).parquet(*where)
        df = df.withColumn("facility_id", F.regexp_extract(F.col("_metadata.file_path"), r"(facility_\d+)/[^/]*\.parquet", 1))
        absent = {re.search(r"facility_\d+", p)[0] for p in _paths(spark, f"{top}/facility_*") if re.search(r"facility_\d+$", p)} - {re.search(r"(facility_\d+)/[^/]*$", p)[1] for p in where}
        if absent and table == "patients":
            warnings.warn(f"no {table} at {', '.join(sorted(absent))}", stacklevel=2)
    else:
        raise FileNotFoundError(f"{top} has no {table}")
    if facility is not None:
        df = df.where(F.col("facility_id") == facility_name(facility))
    ord_ = F.struct("facility_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias("ord")
    kept = [c for c in (columns or df.columns) if c in df.columns and c != "facility_id"]
    return df.select(*kept, "facility_id", ord_)


def patients(spark: SparkSession, run: str, compat: bool = False) -> DataFrame:
    """Standardised patients of all facilities, with record_id and ord."""
    raw = facility_table(spark, run, "patients")
    if not raw.take(1):
        raise ValueError(f"{run} has no patients")
    order = raw.schema["ord"].dataType.fieldNames()
    flat = raw.select("*", *(F.col(f"ord.{n}").alias(f"_{n}") for n in order)).drop("ord")
    out = create_record_id(standardize_columns(flat, compat))
    return out.withColumn("ord", F.struct(*(F.col(f"_{n}").alias(n) for n in order))).drop(*(f"_{n}" for n in order))


#: Ranges of ids that a scan is given, at most.
ID_RANGES = 32


def id_ranges(ids: DataFrame, key: str, most: int = ID_RANGES) -> list[tuple]:
    """At most so many ranges (first, last) that hold all ids, none null. Ids are dealt by their order, so that a range is what one task has; the ranges alone meet on the driver."""
    dealt = ids.select(F.col(key).alias("k")).dropna().distinct().repartitionByRange(most, "k")
    found = dealt.groupBy(F.spark_partition_id()).agg(F.min("k").alias("a"), F.max("k").alias("b")).select("a", "b").collect()
    return sorted(map(tuple, found))


def rows_of(table: DataFrame, ids: DataFrame, key: str, most: int = ID_RANGES) -> DataFrame:
    """table's rows whose key is among ids, exactly, each once. The ids' ranges are a filter that reaches the scan, where files and row groups that hold none of them are skipped; write_facilities orders files by patient for that. The semi-join after it decides."""
    ranges = id_ranges(ids, key, most)
    if not ranges:
        return table.where("false")
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col(key).between(F.lit(a), F.lit(b))
    return table.where(inside).join(ids.select(key).distinct(), key, "left_semi").select(*table.columns)


def medical_records(spark: SparkSession, run: str, ids: DataFrame | None = None, tables: tuple[str, ...] = CLINICAL, columns: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """Clinical tables that are there, with the given columns only, and of the given patients (PATIENT) only."""
    out = {t: facility_table(spark, run, t, list((columns or {}).get(t, ())) or None) for t in tables_of(spark, run_folder(spark, run), tables)}
    return {t: rows_of(df, ids, "PATIENT") for t, df in out.items()} if ids is not None else out


def ground_truth(spark: SparkSession, run: str) -> DataFrame:
    df = spark.read.parquet(f"{run}/metadata/ground_truth.parquet")
    if dict(df.dtypes)["facility_id"] != "string":
        df = df.withColumn("facility_id", F.format_string("facility_%03d", F.col("facility_id").cast("int")))
    return df


def truth_with_records(truth: DataFrame, people: DataFrame) -> DataFrame:
    """Truth with record_id, null where no patient has the row's facility and id, and true_patient_id."""
    if "true_patient_id" in truth.columns and "record_id" in truth.columns:
        return truth
    ids = people.select("facility_id", F.col("id").alias("original_patient_uuid"), "record_id")
    return truth.join(ids, ["facility_id", "original_patient_uuid"], "left").withColumnRenamed("original_patient_uuid", "true_patient_id")


def generate_facilities(organizations: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """facility_id, name, address, city, state, zip, lat, lon, type of n facilities, each at the place of an organization that a hash picks."""
    from kinloom.functions.draws import pick, uniform

    # Kinds of facilities and patterns of their names.
    kinds = ["Hospital", "Medical Center", "Health Clinic", "Community Hospital", "Regional Medical Center"]
    patterns = ["{city} {type}", "{city} General {type}", "St. {name}'s {type}", "{name} Memorial {type}", "{city} Community {type}"]
    saints = ["Mary", "Joseph", "Luke", "Anne", "Vincent", "Francis", "Clare", "Martin"]
    spark = organizations.sparkSession
    own = spark.range(1, n + 1).select(F.col("id").cast("int").alias("facility_id"))  # n facilities
    picked = organizations.crossJoin(F.broadcast(own)).withColumn("u", uniform(seed, F.col("Id"), F.col("facility_id")))
    place = picked.groupBy("facility_id").agg(F.min_by(F.struct(*(F.col(c).cast("string").alias(c) for c in ("ADDRESS", "CITY", "STATE", "ZIP", "LAT", "LON"))), "u").alias("o"))
    who = F.col("facility_id")
    name = F.replace(F.replace(F.replace(pick(uniform(seed, who, "pattern"), patterns), F.lit("{city}"), F.coalesce("o.CITY", F.lit(""))), F.lit("{name}"), pick(uniform(seed, who, "name"), saints)), F.lit("{type}"), pick(uniform(seed, who, "kind"), kinds))
    return place.select(
        "facility_id", name.alias("name"), F.col("o.ADDRESS").alias("address"), F.col("o.CITY").alias("city"), F.coalesce("o.STATE", F.lit("MA")).alias("state"), F.col("o.ZIP").alias("zip"),
        F.col("o.LAT").cast("double").alias("lat"), F.col("o.LON").cast("double").alias("lon"), pick(uniform(seed, who, "type"), kinds).alias("type"),
    )


def write_facilities(df: DataFrame, run: str, table: str) -> None:
    """A table of all facilities as one dataset. A numeric facility_id is written as facility_NNN; a table without rows keeps its columns. Each file is in the order of its patients, so that readers of some of them skip row groups."""
    if dict(df.dtypes)["facility_id"] != "string":
        df = df.withColumn("facility_id", F.format_string("facility_%03d", F.col("facility_id").cast("int")))
    who = next((c for c in ("PATIENT", "PATIENTID", "Id") if c in df.columns), None)
    rows = df.drop("ord")
    if who and "ord" not in df.columns and table in CLINICAL:
        rows = rows.sortWithinPartitions("facility_id", who, *(c for c in ("START", "DATE") if c in df.columns))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("facility_id") if df.take(1) else writer).parquet(f"{run}/facilities/{table}.parquet")


def write_truth(truth: DataFrame, run: str) -> None:
    """Sorted by patient and facility; ranges of the order are files."""
    truth.orderBy("original_patient_uuid", "facility_id").write.mode("overwrite").parquet(f"{run}/metadata/ground_truth.parquet")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file with its whole text, unless there is one: whether it did. Of several that try at once, one does.

    The text is written beside it first. A local disk links that file to the name, other file systems rename it; both refuse a name that is taken.
    On a store whose rename replaces what is there, this guards against earlier files only.
    """
    jvm = spark.sparkContext._jvm
    where, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where):
        return False
    write_text(spark, own.toString(), text)
    if fs.getScheme() != "file":
        done = fs.rename(own, where)
        if not done:
            fs.delete(own, False)
        return done
    try:
        os.link(*(jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).getPath() for p in (own, where)))
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(own, False)


def write_metrics(row: DataFrame | dict, path: str, spark: SparkSession | None = None) -> dict:
    """One row, or a dictionary, as a JSON object."""
    values = row if isinstance(row, dict) else row.first().asDict(recursive=True)
    write_text(spark or row.sparkSession, path, json.dumps(values, indent=2, default=str) + "\n")
    return values


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_error_log(injected: DataFrame, path: str) -> None:
    who = [F.col("Id").alias("patient_uuid"), *(["facility_id"] if "facility_id" in injected.columns else [])]
    log = injected.select(*who, F.explode("error_log").alias("e")).select(*(F.col("patient_uuid") if i == 0 else c for i, c in enumerate(who)), "e.field", "e.error_type", "e.original", "e.errored", F.current_timestamp().alias("timestamp"))
    log.write.mode("overwrite").json(path)
