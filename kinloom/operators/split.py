"""Tables dealt to facilities with references intact, and checks of that."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.draws import uniform, weighted
from kinloom.operators.golden import placed
from kinloom.operators.graph import materialize

# Shares of patients by number of facilities, and of encounters at the first; kinds of tables; columns that a confusable group shares.
FACILITY_COUNTS = {1: 0.40, 2: 0.30, 3: 0.15, 4: 0.10, 5: 0.05}
PRIMARY_SHARE = 0.60
REFERENCE = ("organizations", "providers", "payers")
ENCOUNTER_LINKED = (
    "conditions", "medications", "observations", "procedures", "immunizations", "allergies", "careplans", "imaging_studies", "devices", "supplies",
)
GROUP_TYPES = {"twin": 0.4, "parent_child": 0.3, "sibling": 0.3}
COPIED = {
    "twin": ("LAST", "BIRTHDATE", "ADDRESS", "CITY", "ZIP", "GENDER", "STATE", "LAT", "LON"),
    "parent_child": ("FIRST", "LAST", "ADDRESS", "CITY", "ZIP", "STATE", "LAT", "LON"),
    "sibling": ("LAST", "ADDRESS", "CITY", "ZIP", "STATE", "LAT", "LON"),
}


def assign_facilities(patients: DataFrame, facilities: int, weights: dict[int, float] = FACILITY_COUNTS, seed: int = 42) -> DataFrame:
    """patient_id, slot, facility_id (1 to facilities): each patient's facilities, slot 0 the primary."""
    who = F.col("patient_id")
    n = F.least(weighted(uniform(seed, who, 0), weights), F.lit(facilities))
    order = F.array_sort(F.array(*(F.struct(uniform(seed, who, k).alias("u"), F.lit(k).alias("f")) for k in range(1, facilities + 1))))
    dealt = patients.select("patient_id", F.posexplode(F.slice(order, F.lit(1), n)).alias("slot", "x"))
    return dealt.select("patient_id", "slot", F.col("x.f").alias("facility_id"))


def encounter_slots(encounters: DataFrame, n_slots: DataFrame, share: float = PRIMARY_SHARE) -> DataFrame:
    """encounter_id, patient_id, slot: by start and id, the first int(n * share) to slot 0, the rest in turn to the others."""
    w = Window.partitionBy("patient_id")
    e = encounters.join(n_slots, "patient_id")
    e = e.withColumn("rn", F.row_number().over(w.orderBy("start", "encounter_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    k = F.floor(F.col("n") * F.lit(share))
    later = 1 + F.pmod(F.col("rn") - k, F.greatest(F.col("m") - 1, F.lit(1)))
    slot = F.when(F.col("m") == 1, 0).when(F.col("rn") < k, 0).otherwise(later)
    return e.select("encounter_id", "patient_id", slot.cast("int").alias("slot"))


def encounter_facilities(encounters: DataFrame, assignment: DataFrame, share: float = PRIMARY_SHARE) -> DataFrame:
    """encounter_id, patient_id, facility_id of encounters (encounter_id, patient_id, start) of assigned patients."""
    n = assignment.groupBy("patient_id").agg(F.count(F.lit(1)).alias("m"))
    return encounter_slots(encounters, n, share).join(assignment, ["patient_id", "slot"]).select("encounter_id", "patient_id", "facility_id")


def route(table: DataFrame, key: str, encounter_facility: DataFrame) -> DataFrame:
    """Rows of a table that hang on an encounter, with its facility; others are dropped."""
    return table.join(encounter_facility.select(F.col("encounter_id").alias(key), "facility_id"), key)


def replicate(reference: DataFrame, facilities: DataFrame) -> DataFrame:
    """A reference table once for each facility (a list of facilities, broadcast)."""
    return reference.crossJoin(F.broadcast(facilities))


def care_periods(encounters: DataFrame) -> DataFrame:
    return encounters.groupBy("facility_id", "patient_id").agg(F.min("start").alias("first"), F.max("start").alias("last"))


def overlapping(transitions: DataFrame, periods: DataFrame) -> DataFrame:
    """Transitions (patient_id, start_date, end_date or null) at every facility whose care period they overlap. An equi-join by patient with the range as a residual."""
    t = transitions.join(periods, "patient_id")
    return t.where((F.col("start_date") <= F.col("last")) & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("first"))))


def patient_column(columns: list[str], table: str) -> str:
    """The column of a table that names the patient."""
    return _column(columns, table, "patients", ("PATIENT", "PATIENTID"))


def encounter_column(columns: list[str], table: str) -> str:
    """The column of a table that names the encounter."""
    return _column(columns, table, "encounters", ("ENCOUNTER", "APPOINTMENTID"))


def _column(columns: list[str], table: str, own: str, names: tuple[str, ...]) -> str:
    found = "Id" if table == own else next((n for n in names if n in columns), None)
    if found is None:
        raise ValueError(f"{table} has none of the columns {', '.join(names)}")
    return found


def split_table(name: str, table: DataFrame, assignment: DataFrame, encounter_facility: DataFrame, routed: dict[str, DataFrame]) -> DataFrame:
    """A table with facility_id, by its kind. routed holds what is split already: claims for claims_transactions, encounters for payer_transitions; without them these are empty, as is a table of unknown kind."""
    if name in REFERENCE:
        return replicate(table, assignment.select("facility_id").distinct())
    if name == "patients":
        return table.join(assignment.select(F.col("patient_id").alias("Id"), "facility_id").distinct(), "Id").select(*table.columns, "facility_id")
    if name == "encounters":
        return route(table, "Id", encounter_facility).select(*table.columns, "facility_id")
    if name in ENCOUNTER_LINKED or name == "claims":
        return route(table, encounter_column(table.columns, name), encounter_facility).select(*table.columns, "facility_id")
    nothing = table.where("false").withColumn("facility_id", F.lit(None).cast(assignment.schema["facility_id"].dataType))
    if name == "claims_transactions":
        if "claims" not in routed:
            return nothing
        claims = routed["claims"].select(F.col("Id").alias("CLAIMID"), "facility_id").distinct()
        return table.join(claims, "CLAIMID").select(*table.columns, "facility_id")
    if name == "payer_transitions":
        if "encounters" not in routed:
            return nothing
        periods = care_periods(routed["encounters"].select("facility_id", F.col("PATIENT").alias("patient_id"), F.col("START").alias("start")))
        at = assignment.select("patient_id", "facility_id").distinct()
        renamed = table.withColumns({"patient_id": F.col("PATIENT"), "start_date": F.col("START_DATE"), "end_date": F.col("END_DATE")})
        return overlapping(renamed, periods.join(at, ["patient_id", "facility_id"], "left_semi")).select(*table.columns, "facility_id")
    warnings.warn(f"unknown table {name} is left out", stacklevel=2)
    return nothing


def split_tables(tables: dict[str, DataFrame], assignment: DataFrame, encounter_facility: DataFrame) -> dict[str, DataFrame]:
    """Every table with facility_id. A patient is at every facility that they are assigned to, with or without encounters there."""
    out: dict[str, DataFrame] = {}
    for name in sorted(tables, key=lambda n: (n not in ("claims", "encounters"), n)):  # those that others follow come first
        out[name] = split_table(name, tables[name], assignment, encounter_facility, out)
    return {name: out[name] for name in tables}


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str) -> DataFrame:
    """check_name, violations: distinct keys without a parent."""
    gone = child.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return gone.agg(F.countDistinct("k").alias("violations")).select(F.lit(check).alias("check_name"), "violations")


def facility_statistics(assignment: DataFrame) -> DataFrame:
    """facilities, patients: how many patients have so many facilities."""
    n = assignment.groupBy("patient_id").agg(F.countDistinct("facility_id").alias("facilities"))
    return n.groupBy("facilities").agg(F.count(F.lit(1)).alias("patients"))


def all_statistics(assignment: DataFrame, encounter_facility: DataFrame) -> DataFrame:
    """statistic, key, n: patients by number of facilities, encounters and patients by facility, and both totals (key null)."""
    named = lambda df, name, key, n: df.select(F.lit(name).alias("statistic"), F.col(key).cast("long").alias("key"), F.col(n).alias("n"))
    count = F.count(F.lit(1)).alias("n")
    total = lambda df, name, c: df.agg(F.countDistinct(c).alias("n")).select(F.lit(name).alias("statistic"), F.lit(None).cast("long").alias("key"), "n")
    parts = [
        named(facility_statistics(assignment), "facility_count_distribution", "facilities", "patients"),
        named(encounter_facility.groupBy("facility_id").agg(count), "encounter_count_per_facility", "facility_id", "n"),
        named(assignment.groupBy("facility_id").agg(F.countDistinct("patient_id").alias("n")), "patient_count_per_facility", "facility_id", "n"),
        total(assignment, "total_patients", "patient_id"),
        total(encounter_facility, "total_encounters", "encounter_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def within_tolerance(shares: DataFrame, expected: Column, actual: Column, points: float = 0.10) -> DataFrame:
    return shares.withColumn("ok", F.abs(expected - actual) <= points)


def pair_count(patients: int, total: int = 0, percent: float | None = None) -> int:
    """Confusable pairs to make: a percentage of the patients if given, else the total."""
    return total if percent is None else round(percent / 100 * patients)


def hashed(seed: int, *keys: Column) -> Column:
    """An order by hash, as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


#: Free patients of a facility that one task puts two by two, about.
PAIR_ROWS = 50_000


def _proposals(free: DataFrame, seed: int, k: int) -> DataFrame:
    """source < target, u: the free patients of each facility two by two, in an order by hash that each round draws anew. A large facility is cut by ranges of the hash, which are ordered each for itself and offset by those before, so pairs do not depend on the cuts; the last of an odd number proposes nothing."""
    source, target = "source_patient_id", "target_patient_id"
    cuts = free.groupBy("facility_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIR_ROWS)).alias("cuts"))
    dealt = free.join(cuts, "facility_id").withColumn("h", hashed(seed, F.lit(k), F.col("patient_id")))
    dealt = dealt.withColumn("cut", F.expr("CAST(conv(substring(h, 1, 8), 16, 10) AS BIGINT) * cuts DIV 4294967296"))
    sizes = dealt.groupBy("facility_id", "cut").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("facility_id", "cut", (F.sum("n").over(Window.partitionBy("facility_id").orderBy("cut")) - F.col("n")).alias("before"))  # a row a cut
    place = F.row_number().over(Window.partitionBy("facility_id", "cut").orderBy("h", "patient_id")) - 1
    placed_rows = dealt.withColumn("i", place).join(F.broadcast(before), ["facility_id", "cut"])
    two = placed_rows.withColumn("g", F.floor((F.col("i") + F.col("before")) / 2)).groupBy("facility_id", "g").agg(F.min("patient_id").alias(source), F.max("patient_id").alias(target))
    return two.where(F.col(source) < F.col(target)).select(source, target).distinct().withColumn("u", hashed(seed, F.col(source), F.col(target)))


def maximal_matching(assignment: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """source_patient_id, target_patient_id, u, round: pairs of patients of one facility, none in two pairs. Rounds stop at n pairs, and else when no facility has two free patients left: the matching is maximal then.

    A facility's pairs are never listed; each round proposes as many as half its free patients. Of the proposals that meet at a patient, those of
    least hash for both their ends stay; the least of all always does, and a fixed share does on average, so rounds grow with the logarithm of the patients.
    Null patients and facilities are left out.
    """
    source, target = "source_patient_id", "target_patient_id"
    free = materialize(assignment.select("facility_id", "patient_id").dropna().distinct())
    found, have, k = None, 0, 0
    while True:
        pairs = materialize(_proposals(free, seed, k))
        ends = pairs.select(F.col(source).alias("p"), "u").unionByName(pairs.select(F.col(target).alias("p"), "u")).groupBy("p").agg(F.min("u").alias("least"))
        kept = pairs
        for side in (source, target):
            kept = kept.join(ends.select(F.col("p").alias(side), F.col("least").alias(f"l_{side}")), side)
        kept = materialize(kept.where((F.col("u") == F.col(f"l_{source}")) & (F.col("u") == F.col(f"l_{target}"))).select(source, target, "u", F.lit(k).alias("round")))
        more = kept.count()
        found, have, k = kept if found is None else found.unionByName(kept), have + more, k + 1
        if not more or (n is not None and have >= n):
            return found
        used = kept.select(F.explode(F.array(source, target)).alias("patient_id"))
        free = materialize(free.join(used, "patient_id", "left_anti"))


def confusable_pairs(assignment: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pairs of maximal_matching, those of earlier rounds, then of lesser hash; fewer, with a warning, if that has fewer. source_patient_id, target_patient_id, group_type."""
    source, target = "source_patient_id", "target_patient_id"
    found = maximal_matching(assignment, n, seed)
    have = found.count()
    if have < n:
        warnings.warn(f"{have} of {n} pairs: no facility has two more free patients", stacklevel=2)
    elif have > n:
        found = placed(found, "round", "u").where(F.col("place") <= n)
    kind = weighted(uniform(seed + 1, F.col(source), F.col(target)), GROUP_TYPES)
    return found.select(source, target, kind.alias("group_type"))


def overwrite_confusable(patients: DataFrame, pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Targets take the group's columns from their source, nulls too; birth dates move by the group's rule (February 29 clamps). The order of the columns stays."""
    present = [f for f in {f: 0 for kind in COPIED.values() for f in kind} if f in patients.columns]
    source = patients.select(F.col("Id").alias("source_patient_id"), *(F.col(f).alias(f"s_{f}") for f in {*present, *({"BIRTHDATE"} & {*patients.columns})}))
    joined = patients.join(pairs.join(source, "source_patient_id").withColumnRenamed("target_patient_id", "Id"), "Id", "left")
    out = {f: F.when(F.col("group_type").isin([k for k, c in COPIED.items() if f in c]), F.col(f"s_{f}")).otherwise(F.col(f)) for f in present}
    if "BIRTHDATE" in patients.columns:
        kind = patients.schema["BIRTHDATE"].dataType
        u = uniform(seed + 2, F.col("Id"))
        apart = F.when(u < 0.5, -1 - F.floor(u * 10)).otherwise(1 + F.floor((u - 0.5) * 10))
        years = F.when(F.col("group_type") == "parent_child", 25 + F.floor(u * 6)).when(F.col("group_type") == "sibling", apart)
        moved = F.add_months(F.col("s_BIRTHDATE").cast("date"), (12 * years).cast("int")).cast(kind)
        out["BIRTHDATE"] = F.when(F.col("group_type") == "twin", F.col("s_BIRTHDATE")).when(years.isNotNull(), moved).otherwise(F.col("BIRTHDATE"))
    return joined.select(*(out.get(c, F.col(c)).alias(c) for c in patients.columns))


def copied_fields(pairs: DataFrame) -> DataFrame:
    """pairs with fields_copied, the columns that the group's rule writes."""
    table = F.create_map(*(F.lit(x) for k, c in COPIED.items() for x in (k, ",".join([*c, *([] if "BIRTHDATE" in c else ["BIRTHDATE"])]))))
    return pairs.withColumn("fields_copied", F.element_at(table, F.col("group_type")))
