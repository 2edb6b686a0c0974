"""Text summaries of clinical histories: one aggregate per section, joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.text import blank_to_null, parse_date

# Metrics in their order, and the texts around summaries.
METRICS = ("Body Height", "Body Weight", "Body Mass Index", "Systolic Blood Pressure", "Diastolic Blood Pressure", "Hemoglobin A1c/Hemoglobin.total in Blood", "Glucose", "Total Cholesterol")
NO_RECORDS = "No clinical records available."
PROMPT = (
    "You are a medical record matching expert. Compare these two patient medical records and determine if they belong to the same patient based only on their clinical history.\n\nRecord A:\n",
    "\n\nRecord B:\n",
    "\n\nAre these the same patient? Answer only 'True' or 'False'.",
)


def _date(df: DataFrame, c: str) -> Column:
    return parse_date(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("date")


def _missing(df: DataFrame, c: str) -> Column:
    return blank_to_null(F.col(c)).isNull() if dict(df.dtypes)[c] == "string" else F.col(c).isNull()


def ordered(order: list, value: Column, sep: str) -> Column:
    """Values joined in the order of the given columns."""
    rows = F.array_sort(F.collect_list(F.struct(*(x if isinstance(x, Column) else F.col(x) for x in order), value.alias("_v"))))
    return F.array_join(F.transform(rows, lambda x: x["_v"]), sep)


def conditions(df: DataFrame, key: str) -> DataFrame:
    """key, text of (START, STOP, DESCRIPTION, ord)."""
    rows = df.select(key, "ord", F.year(_date(df, "START")).alias("y"), F.concat("DESCRIPTION", F.when(_missing(df, "STOP"), " *").otherwise("")).alias("d"))
    years = rows.groupBy(key, "y").agg(ordered(["ord"], F.col("d"), "; ").alias("line"))
    body = years.groupBy(key).agg(ordered(["y"], F.when(F.col("y").isNotNull(), F.concat(F.lit("  "), F.col("y").cast("string"), F.lit(": "), "line")), "\n").alias("body"))
    return body.select(key, F.concat_ws("\n", F.lit("CONDITIONS:"), blank_to_null(F.col("body"))).alias("text"))


def medications(df: DataFrame, key: str) -> DataFrame:
    d = df.select(key, "ord", "DESCRIPTION", F.year(_date(df, "START")).alias("a"), F.year(_date(df, "STOP")).alias("b"), _missing(df, "STOP").alias("open"))
    g = d.groupBy(key, "DESCRIPTION").agg(F.min("ord").alias("ord"), F.min("a").alias("a"), F.max("b").alias("b"), F.max("open").alias("open"))
    year = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    span = F.when(F.col("open"), F.when(F.col("a").isNull(), "ongoing").otherwise(F.concat(F.col("a").cast("string"), F.lit("–ongoing")))).when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat(year("a"), F.lit("–"), year("b"))).otherwise("unknown")
    line = F.concat(F.lit("- "), "DESCRIPTION", F.lit(" ("), span, F.lit(")"))
    return g.groupBy(key).agg(F.concat(F.lit("MEDICATIONS:\n"), ordered(["ord"], line, "\n")).alias("text"))


def allergies(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.concat(F.lit("ALLERGIES: "), F.array_join(F.array_sort(F.collect_set("DESCRIPTION")), "; ")).alias("text"))


def latest(df: DataFrame, key: str, metric: str, n: int = 2) -> DataFrame:
    """The last n rows by key and metric: by date, missing dates last of all, then by ord."""
    w = Window.partitionBy(key, metric).orderBy(F.col("d").desc_nulls_first(), F.col("ord").desc())
    return df.withColumn("d", _date(df, "DATE")).withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def observations(df: DataFrame, key: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    named = df.withColumn("m", F.explode(F.array(*(F.when(F.col("DESCRIPTION").rlike(f"(?i){m}"), F.lit(i)) for i, m in enumerate(metrics))))).where("m is not null")
    last = latest(named, key, "m").where(~_missing(df, "VALUE"))
    unit = F.coalesce(F.concat(F.lit(" "), blank_to_null(F.col("UNITS"))), F.lit(""))
    item = F.concat(F.col("VALUE").cast("string"), unit, F.lit(" ("), F.coalesce(F.substring(F.col("DATE").cast("string"), 1, 10), F.lit("")), F.lit(")"))
    lines = last.groupBy(key, "m").agg(ordered([(-F.col("back")).alias("o")], item, ", ").alias("items"))
    name = F.element_at(F.array(*map(F.lit, metrics)), F.col("m") + 1)
    body = lines.groupBy(key).agg(ordered(["m"], F.concat(F.lit("- "), name, F.lit(": "), "items"), "\n").alias("body"))
    return df.select(key).distinct().join(body, key, "left").select(key, F.concat_ws("\n", F.lit("OBSERVATIONS:"), "body").alias("text"))


def procedures(df: DataFrame, key: str) -> DataFrame:
    g = df.select(key, "ord", "DESCRIPTION", F.year(_date(df, "START")).alias("y")).groupBy(key, "DESCRIPTION").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("y")).alias("ys"))
    line = F.concat(F.lit("- "), "DESCRIPTION", F.lit(" ("), F.array_join(F.col("ys").cast("array<string>"), ", "), F.lit(")"))
    return g.groupBy(key).agg(F.concat(F.lit("PROCEDURES:\n"), ordered(["ord"], line, "\n")).alias("text"))


SECTIONS = {"conditions": conditions, "medications": medications, "allergies": allergies, "observations": observations, "procedures": procedures}


def summaries(keys: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """key, summary: the sections there are, a blank line between them."""
    out, names = keys.select(key), []
    for name, build in SECTIONS.items():
        if name in tables:
            out = out.join(build(tables[name], key).withColumnRenamed("text", f"t_{name}"), key, "left")
            names.append(f"t_{name}")
    joined = F.concat_ws("\n\n", *names) if names else F.lit("")
    return out.select(key, F.when(joined == "", NO_RECORDS).otherwise(joined).alias("summary"))


def prompt(a: Column, b: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), a, F.lit(PROMPT[1]), b, F.lit(PROMPT[2]))
