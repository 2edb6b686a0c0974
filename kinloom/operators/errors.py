"""Errors in demographics, as expressions over hash draws.

An error is a function (value, draw, row) -> Column: draw(k) is the k-th uniform
of this row and step. Errors compound: each step chooses an error type by
weight, a class and a field, and later steps see earlier changes. The log holds
what really changed. All steps are one narrow pass: projections on top of each
other, nothing written between them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.functions.draws import pick, uniform

Draw = Callable[[int], Column]
# Street types and their short forms, neighbours on a keyboard, characters of a typo, streets that people move to.
SHORT = {
    "STREET": ["ST", "ST.", "STR"], "AVENUE": ["AVE", "AVE.", "AV"], "ROAD": ["RD", "RD."], "DRIVE": ["DR", "DR."], "LANE": ["LN", "LN."], "COURT": ["CT", "CT."],
    "PLACE": ["PL", "PL."], "BOULEVARD": ["BLVD", "BLVD.", "BLV"], "PARKWAY": ["PKWY", "PKWY.", "PKY"], "CIRCLE": ["CIR", "CIR."], "TERRACE": ["TER", "TER.", "TERR"], "APARTMENT": ["APT", "APT.", "#", "UNIT"],
}
NEIGHBOURS = {
    "Q": "WA", "W": "QES", "E": "WRD", "R": "ETF", "T": "RYG", "Y": "TUH", "U": "YIJ", "I": "UOK", "O": "IPL", "P": "OL",
    "A": "QSZ", "S": "WADZX", "D": "ESFXC", "F": "RDGCV", "G": "TFHVB", "H": "YGJBN", "J": "UHKNM", "K": "IJLM", "L": "OKP",
    "Z": "ASX", "X": "SDZC", "C": "DFXV", "V": "FGCB", "B": "GHVN", "N": "HJBM", "M": "JKN",
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STREETS = (
    "OAK", "MAPLE", "CEDAR", "ELM", "PINE", "WALNUT", "BIRCH", "WILLOW", "CHERRY", "SPRUCE",
    "HIGHLAND", "WASHINGTON", "LINCOLN", "PARK", "LAKE", "RIVER", "HILL", "MEADOW", "FOREST", "SPRING",
)
KINDS = ("STREET", "AVENUE", "DRIVE", "ROAD", "LANE", "COURT", "PLACE", "BOULEVARD", "WAY", "CIRCLE")


def _char(c: Column, at: Column) -> Column:
    return F.substr(c, at, F.lit(1))


def _put(c: Column, at: Column, new: Column, width: int = 1) -> Column:
    return F.concat(F.substr(c, F.lit(1), at - 1), new, F.substr(c, at + width))


def _place(c: Column, u: Column, first: int = 1, last: int = 0) -> Column:
    """A position from first to the length less last, from 1."""
    return (F.floor(u * F.greatest(F.length(c) - last - first + 1, F.lit(1))) + first).cast("int")


def _random_char(u: Column, but: Column) -> Column:
    """A character of the alphabet other than but."""
    others = F.replace(F.lit(ALPHABET), but, F.lit(""))
    return F.substr(others, (F.floor(u * F.length(others)) + 1).cast("int"), F.lit(1))


def _beside(ch: Column, u: Column) -> Column:
    """A key beside that of a letter, in its case; other characters as they are."""
    keys = F.element_at(F.create_map(*(F.lit(x) for kv in NEIGHBOURS.items() for x in kv)), F.upper(ch))
    new = F.substr(keys, (F.floor(u * F.length(keys)) + 1).cast("int"), F.lit(1))
    return F.coalesce(F.when(ch == F.upper(ch), new).otherwise(F.lower(new)), ch)


def _typo(ch: Column, kind: Column, which: Column) -> Column:
    return F.when(kind < 0.5, _beside(ch, which)).otherwise(_random_char(which, ch))


def name_typo(c, draw, row):
    at = _place(c, draw(0), 2)
    return F.when(F.length(c) >= 2, _put(c, at, _typo(_char(c, at), draw(1), draw(2)))).otherwise(c)


def many_typos(c, draw, row):
    """Two or three different places after the first character: those whose draws are least."""
    n = F.least(F.when(draw(0) < 0.5, 2).otherwise(3), F.length(c) - 1)
    salt = F.floor(draw(1) * (1 << 30)).cast("string")
    at = F.sequence(F.lit(2), F.greatest(F.length(c), F.lit(2)))
    places = F.slice(F.transform(F.array_sort(F.transform(at, lambda i: F.struct(F.md5(F.concat(salt, F.lit("|"), i.cast("string"))).alias("h"), i.alias("i")))), lambda x: x["i"]), F.lit(1), F.greatest(n, F.lit(1)))
    u = lambda i, k: F.conv(F.substring(F.md5(F.concat(salt, F.lit(f"|{k}|"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    changed = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.when(F.array_contains(places, i), _typo(_char(c, i), u(i, 0), u(i, 1))).otherwise(_char(c, i))), "")
    return F.when(F.length(c) >= 4, changed).otherwise(c)


def abbreviation(c, draw, row):
    a, out = F.upper(c), None
    for full, short in SHORT.items():
        cases = [(F.contains(a, F.lit(full)), F.replace(a, F.lit(full), pick(draw(0), short)))]
        for s in short:
            other = [x for x in short if x != s]
            cases.append((F.contains(a, F.lit(s)), F.replace(a, F.lit(s), F.when(draw(1) < 0.5, F.lit(full)).otherwise(pick(draw(0), other)))))
        for test, new in cases:
            out = F.when(test, new) if out is None else out.when(test, new)
    return out.otherwise(c)


def apartment(c, draw, row):
    a, out = F.upper(c), None
    for pattern, formats in ((r"APT\.?\s*(\d+)", ("APARTMENT ", "UNIT ", "#", "NO. ")), (r"APARTMENT\s*(\d+)", ("APT ", "APT. ", "UNIT ", "#", "NO. ")), (r"UNIT\s*(\d+)", ("APT ", "APARTMENT ", "#", "NO. ")), (r"#(\d+)", ("APT ", "UNIT ", "APARTMENT ", "NO. "))):
        new = F.regexp_replace(a, F.lit(pattern), F.concat(pick(draw(0), list(formats)), F.lit("$1")))
        out = F.when(a.rlike(pattern), new) if out is None else out.when(a.rlike(pattern), new)
    return out.otherwise(c)


def moved(c, draw, row):
    return F.concat_ws(" ", (1 + F.floor(draw(0) * 9998)).cast("string"), pick(draw(1), list(STREETS)), pick(draw(2), list(KINDS)))


def date_off(c, draw, row):
    return F.date_format(F.date_add(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"), pick(draw(0), [1, -1, 30, -30, 365, -365])), "yyyy-MM-dd")


def date_swap(c, draw, row):
    y, m, d = (F.substring(c, *k) for k in ((1, 4), (6, 2), (9, 2)))
    year = F.concat(F.substr(y, F.lit(1), F.lit(2)), F.substr(y, F.lit(4), F.lit(1)), F.substr(y, F.lit(3), F.lit(1)))
    other = F.concat_ws("-", year, m, d)
    ok = (year >= "1900") & (year <= "2025") & F.try_to_timestamp(other, F.lit("yyyy-MM-dd")).isNotNull()
    return F.when((d <= "12") & (d != m), F.concat_ws("-", y, d, m)).when(ok, other).otherwise(c)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _dashed(d: Column, like: Column) -> Column:
    return F.when(F.contains(like, F.lit("-")), F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))).otherwise(d)


def ssn_swap(c, draw, row):
    d = _digits(c)
    at = _place(d, draw(0), 1, 1)
    return F.when(F.length(d) == 9, _dashed(_put(d, at, F.concat(_char(d, at + 1), _char(d, at)), 2), c)).otherwise(c)


def ssn_digit(c, draw, row):
    d = _digits(c)
    at = _place(d, draw(0))
    new = F.pmod(_char(d, at).cast("int") + 1 + F.floor(draw(1) * 9).cast("int"), F.lit(10)).cast("string")
    return F.when(F.length(d) == 9, _dashed(_put(d, at, new), c)).otherwise(c)


def ssn_format(c, draw, row):
    d = _digits(c)
    return F.when(F.length(d) != 9, c).when(F.contains(c, F.lit("-")), d).otherwise(_dashed(d, F.lit("-")))


def document_digit(c, draw, row):
    at = _place(c, draw(0))
    ch = _char(c, at)
    digit = F.pmod(F.try_to_number(ch, F.lit("9")).cast("int") + 1 + F.floor(draw(1) * 9).cast("int"), F.lit(10)).cast("string")
    letter = F.char(65 + F.pmod(F.ascii(F.upper(ch)) - 65 + 1 + F.floor(draw(1) * 25).cast("int"), F.lit(26)))
    return F.when(F.length(c) < 1, c).otherwise(_put(c, at, F.when(ch.rlike(r"\d"), digit).when(ch.rlike("[A-Za-z]"), letter).otherwise(ch)))


def capitals(c, draw, row):
    mixed = F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(i % 2 == 0, F.upper(x)).otherwise(F.lower(x))), "")
    return F.when(draw(0) < 0.25, F.upper(c)).when(draw(0) < 0.5, F.lower(c)).when(draw(0) < 0.75, text.title_case(c)).otherwise(mixed)


def more_space(c, draw, row):
    return F.regexp_replace(F.trim(c), F.lit(r"\s+"), pick(draw(0), ["  ", "   ", "    "]))


def no_space(c, draw, row):
    return F.regexp_replace(c, r"\s+", "")


def outer_space(c, draw, row):
    pad = pick(draw(0), [" ", "  ", "   "])
    return F.when(draw(1) < 1 / 3, F.concat(pad, c)).when(draw(1) < 2 / 3, F.concat(c, pad)).otherwise(F.concat(pad, c, pad))


def special(c, draw, row):
    return F.when(draw(0) < 0.5, F.concat(c, F.lit("."))).otherwise(F.regexp_replace(c, "[.\\-']", ""))


def missing(c, draw, row):
    return F.lit(None).cast("string")


def maiden(c, draw, row):
    return F.coalesce(text.blank_to_null(F.col("MAIDEN")), c) if "MAIDEN" in row else c


def to_nickname(c, draw, row):
    return text.nickname(c)


#: By error type: name, expression and fields of each class.
REGISTRY: dict[str, list[tuple[str, Callable, tuple[str, ...]]]] = {
    "name_variation": [("nickname_substitution", to_nickname, ("FIRST",)), ("name_typo", name_typo, ("FIRST", "LAST", "MAIDEN")), ("maiden_name_usage", maiden, ("LAST",)), ("multi_character_typo", many_typos, ("FIRST", "LAST"))],
    "address_error": [("address_abbreviation", abbreviation, ("ADDRESS",)), ("apartment_format_variation", apartment, ("ADDRESS",)), ("full_address_change", moved, ("ADDRESS",))],
    "date_variation": [("date_off_by_one", date_off, ("BIRTHDATE",)), ("date_digit_transposition", date_swap, ("BIRTHDATE",))],
    "ssn_error": [("ssn_transposition", ssn_swap, ("SSN",)), ("ssn_digit_error", ssn_digit, ("SSN",)), ("ssn_format_variation", ssn_format, ("SSN",))],
    "formatting_error": [("capitalization_error", capitals, ("FIRST", "LAST", "MAIDEN", "ADDRESS", "CITY")), ("extra_whitespace", more_space, ("FIRST", "LAST", "MAIDEN", "ADDRESS")), ("leading_trailing_whitespace", outer_space, ("FIRST", "LAST", "MAIDEN", "ADDRESS", "CITY", "SSN")), ("special_character_variation", special, ("FIRST", "LAST", "MAIDEN"))],
    "missing_data": [("missing_field_value", missing, ("SSN", "BIRTHDATE", "ADDRESS", "CITY", "ZIP"))],
}
#: Classes of no type; ``inject(extra=...)`` adds them to one.
EXTRA = [("drivers_license_error", document_digit, ("DRIVERS",)), ("passport_error", document_digit, ("PASSPORT",)), ("missing_whitespace", no_space, ("ADDRESS",))]
WEIGHTS = {"name_variation": 0.25, "address_error": 0.2, "date_variation": 0.15, "ssn_error": 0.15, "formatting_error": 0.15, "missing_data": 0.1}
_LOG = "array<struct<step:int,field:string,error_type:string,original:string,errored:string>>"


def _options(columns: list[str], weights: dict[str, float], registry: dict) -> list[tuple]:
    """Name, expression, field and share of every class and field that can be drawn, by ranges of a uniform."""
    kept = {k: w for k, w in weights.items() if w > 0}
    out, low = [], 0.0
    for kind, w in kept.items():
        classes = [(name, f, [x for x in fields if x in columns]) for name, f, fields in registry[kind]]
        classes = [c for c in classes if c[2]]
        for name, f, fields in classes:
            for field in fields:
                high = low + w / sum(kept.values()) / len(classes) / len(fields)
                out.append((low, high, name, f, field))
                low = high
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt over tasks by key: a few megabytes of patients are one split of a file, but work for all cores."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def inject(
    df: DataFrame, rate: float = 1.0, least: int = 1, most: int = 3, several: float = 0.7, weights: dict[str, float] = WEIGHTS,
    seed: int = 42, key: str = "Id", extra: dict[str, list[tuple]] | None = None,
) -> DataFrame:
    """df (demographic columns as strings) with errors, and ``error_log``: an array of (step, field, error_type, original, errored). Every draw is a hash of seed, facility, id and step. extra has further classes by error type."""
    who = [F.col(key)] + ([F.col("facility_id")] if "facility_id" in df.columns else [])
    u = lambda step, k: uniform(seed, *who, step, k)
    n = F.when(u(-1, 0) >= rate, 0).when(u(-1, 1) < several, least + F.floor(u(-1, 2) * (most - least + 1))).otherwise(1)
    out = dealt(df, key).withColumn("error_log", F.array().cast(_LOG)).withColumn("n_errors", n.cast("int"))
    registry = {k: [*v, *(extra or {}).get(k, [])] for k, v in (REGISTRY | {k: [] for k in (extra or {}) if k not in REGISTRY}).items()}
    options = _options(df.columns, weights, registry)
    for step in range(most if options else 0):
        chosen = out.withColumn("_u", F.when(F.spark_partition_id() >= 0, F.when(F.col("n_errors") > step, u(step, 0) * options[-1][1]).otherwise(-1.0)))
        which = reduce(lambda c, o: c.when((F.col("_u") >= o[1][0]) & (F.col("_u") < o[1][1]), o[0]), enumerate(options), F.when(F.col("_u") < 0, None))
        chosen = chosen.withColumn("_which", which.cast("int"))
        draw = lambda k, step=step: u(step, k + 1)
        new = F.lit(None).cast("string")
        old = F.lit(None).cast("string")
        for i, (_, _, _, f, field) in enumerate(options):
            value = F.when(text.blank_to_null(F.col(field)).isNull(), F.col(field)).otherwise(f(F.col(field), draw, df.columns))
            new = F.when(F.col("_which") == i, value).otherwise(new)
        fields = list(dict.fromkeys(o[4] for o in options))
        at = {f: [i for i, o in enumerate(options) if o[4] == f] for f in fields}
        for f in fields:
            old = F.when(F.col("_which").isin(at[f]), F.col(f)).otherwise(old)
        chosen = chosen.withColumn("_new", new).withColumn("_old", old)
        label = lambda k: F.element_at(F.array(*(F.lit(o[k]) for o in options)), F.col("_which") + 1)
        entry = F.struct(F.lit(step).alias("step"), label(4).alias("field"), label(2).alias("error_type"), F.col("_old").alias("original"), F.col("_new").alias("errored"))
        changed = F.col("_which").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))
        columns = {f: F.when(F.col("_which").isin(at[f]), F.col("_new")).otherwise(F.col(f)) for f in fields}
        columns["error_log"] = F.when(changed, F.array_append("error_log", entry)).otherwise(F.col("error_log"))
        # which task reads a row is no matter, but as it is not known beforehand, the optimizer does not copy a step's expressions into every use of them in the next
        kept = lambda c: F.when(F.spark_partition_id() >= 0, c)
        out = chosen.select(*(kept(columns[c]).alias(c) if c in columns else F.col(c) for c in out.columns))
    return out.drop("n_errors")


def error_statistics(injected: DataFrame) -> DataFrame:
    """error_type, field, n."""
    return injected.select(F.explode("error_log").alias("e")).groupBy("e.error_type", "e.field").agg(F.count(F.lit(1)).alias("n"))


def all_statistics(injected: DataFrame) -> DataFrame:
    """statistic, key, n: errors by type, by field, by facility, and all (key null)."""
    columns = ["error_type", "field", *(["facility_id"] if "facility_id" in injected.columns else [])]
    log = injected.select(F.explode("error_log").alias("e"), *columns[2:]).select("e.error_type", "e.field", *(F.col(c).cast("string") for c in columns[2:]))
    keys = F.array(*(F.struct(F.lit(f"errors_by_{c.removeprefix('error_').removesuffix('_id')}").alias("statistic"), F.col(c).alias("key")) for c in columns), F.struct(F.lit("total_errors").alias("statistic"), F.lit(None).cast("string").alias("key")))
    return log.select(F.explode(keys).alias("x")).groupBy("x.statistic", "x.key").agg(F.count(F.lit(1)).alias("n"))


def truth_of(injected: DataFrame, encounters: DataFrame) -> DataFrame:
    """original_patient_uuid, facility_id, num_encounters, errors_applied (in order, or none) and demographics, of injected patients; encounters has patient_id and facility_id."""
    counts = encounters.groupBy("facility_id", F.col("patient_id").alias("Id")).agg(F.count(F.lit(1)).alias("n"))
    applied = F.array_join(F.transform("error_log", lambda e: e["error_type"]), ",")
    names = {"FIRST": "first_name", "LAST": "last_name", "MAIDEN": "maiden_name", "SSN": "ssn", "BIRTHDATE": "birthdate", "GENDER": "gender", "ADDRESS": "address", "CITY": "city", "ZIP": "zip"}
    rows = injected.join(counts, ["facility_id", "Id"], "left")
    own = [F.col(k).alias(v) for k, v in names.items() if k in injected.columns]
    return rows.select(F.col("Id").alias("original_patient_uuid"), "facility_id", F.coalesce("n", F.lit(0)).alias("num_encounters"), F.when(applied == "", "none").otherwise(applied).alias("errors_applied"), *own)


def truth_statistics(truth: DataFrame, errors: int | None = None) -> DataFrame:
    """One row: patient-facility pairs, patients, patients with errors, their share of patients, and patients by number of facilities (a map)."""
    per = truth.groupBy("original_patient_uuid").agg(F.count(F.lit(1)).alias("k"), F.max((F.col("errors_applied") != "none").cast("int")).alias("wrong"))
    spread = per.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("wrong"))
    out = spread.agg(
        F.coalesce(F.sum(F.col("k") * F.col("n")), F.lit(0)).alias("total_patient_facility_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("unique_patients"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("patients_with_errors"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("facility_count_distribution"),
    )
    out = out.withColumn("error_rate", F.when(F.col("unique_patients") > 0, F.col("patients_with_errors") / F.col("unique_patients")).otherwise(0.0))
    return out if errors is None else out.withColumn("total_error_transformations", F.lit(errors))
