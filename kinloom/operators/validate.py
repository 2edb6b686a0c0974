"""Checks of facility tables, distributions and prediction files. Messages come to the driver: there is one a facility and check at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.split import ENCOUNTER_LINKED

CRITICAL = ("patients", "encounters")
#: Child, its key, parent and the parent's key; parents come with their facility.
REFERENCES = (
    ("encounters", "PATIENT", "patients", "Id"),
    ("payer_transitions", "PATIENT", "patients", "Id"),
    *((t, "ENCOUNTER", "encounters", "Id") for t in ENCOUNTER_LINKED),
    ("claims", "APPOINTMENTID", "encounters", "Id"),
    ("claims_transactions", "CLAIMID", "claims", "Id"),
)


def reference_violations(tables: dict[str, DataFrame]) -> DataFrame | None:
    """facility_id, child, key, violations: a facility's distinct keys without a parent there; only where there are some. None if nothing can be checked."""
    out = None
    for child, key, parent, parent_key in REFERENCES:
        if child in tables and parent in tables and key in tables[child].columns:
            own = tables[child].select("facility_id", F.col(key).alias("k"))
            gone = own.join(tables[parent].select("facility_id", F.col(parent_key).alias("k")), ["facility_id", "k"], "left_anti").distinct()
            found = gone.groupBy("facility_id").agg(F.count(F.lit(1)).alias("violations")).select("facility_id", F.lit(child).alias("child"), F.lit(key).alias("key"), "violations")
            out = found if out is None else out.unionByName(found)
    return out


def validate_tables(tables: dict[str, DataFrame], facilities: list | None = None) -> list[str]:
    """What is wrong with the tables (each with facility_id) of every facility; empty if nothing is."""
    said = [f"Missing critical table: {t}" for t in CRITICAL if t not in tables]
    if "claims_transactions" in tables and "claims" not in tables and tables["claims_transactions"].take(1):
        said.append("claims_transactions present but claims missing")
    there = {t: {r[0] for r in tables[t].select("facility_id").distinct().collect()} for t in CRITICAL if t in tables}
    every = set(facilities) if facilities is not None else set().union(*there.values()) if there else set()
    said += [f"{f}: critical table is empty: {t}" for t, some in there.items() for f in sorted(every - some)]
    if not every and facilities is None:
        said += [f"critical table is empty: {t}" for t in there]
    found = reference_violations(tables)
    rows = found.orderBy("facility_id", "child").collect() if found is not None else []
    return said + [f"{r['facility_id']}: {r['child']} has {r['violations']} invalid {r['key']} references" for r in rows]


def validate_distribution(statistics: DataFrame, patients: int, encounters: int, weights: dict[int, float], points: float = 0.10) -> list[str]:
    """What differs from the configuration in statistics (of split.all_statistics)."""
    kept = statistics.where(F.col("statistic").isin("total_patients", "total_encounters", "facility_count_distribution"))
    rows = {(r["statistic"], r["key"]): r["n"] for r in kept.collect()}
    said = []
    for name, want in (("patients", patients), ("encounters", encounters)):
        if (n := rows.get((f"total_{name}", None), 0)) != want:
            said.append(f"{name}: expected {want}, got {n}")
    total = rows.get(("total_patients", None), 0)
    for k, share in weights.items():
        got = rows.get(("facility_count_distribution", k), 0) / total if total else 0.0
        if not share - points <= got <= share + points:
            said.append(f"{k} facilities: expected {share:.2%} of patients, got {got:.2%}")
    return said


def validate_predictions(predictions: DataFrame, expected_rows: int | None = None) -> list[str]:
    """What is missing in a table of predictions."""
    said = [f"column {c} is missing" for c in ("record_id_1", "record_id_2", "prediction", "confidence") if c not in predictions.columns]
    if expected_rows is not None and (n := predictions.count()) != expected_rows:
        said.append(f"expected {expected_rows} rows, got {n}")
    return said
