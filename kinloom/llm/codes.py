"""Vectors as codes of four bytes: integer codebooks refined in rounds, all arithmetic exact."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import map_arrow, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances are held at once.
ROWS = 2048
#: Labels whose sums are broadcast; more of them are joined by a shuffle, in so many salted parts.
BROADCAST_LABELS, SALTS = 100_000, 64


def bound(width: int) -> int:
    """The largest component of vectors of so many components whose squared distances, summed over all parts, surely fit in 64 bits."""
    return math.isqrt((1 << 60) // max(1, width))


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v: vectors of finite components as whole numbers, all of one width, which four divides."""
    x = F.col(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.cast("array<double>").alias("x")).where(F.col("x").isNotNull() & F.forall("x", finite))
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // PARTS)) * PARTS
    top = float(bound(width))
    cut = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * SCALE, F.lit(-top)), F.lit(top))), F.lit(-int(top))), F.lit(int(top))).cast("long")
    whole = F.transform("x", cut)
    return kept.select("vec_id", "label", F.when(F.size("x") == width, whole).otherwise(F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))).alias("v"))


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of int64 vectors (n, width) and codebooks (parts, entries, width / parts): each part's nearest entry, the first of equal ones, and its squared distance. |x|^2 - 2 x.c + |c|^2, in int64."""
    n, (parts, _, width) = len(vectors), books.shape
    codes, errors = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for k in range(parts):
        x, book = np.ascontiguousarray(vectors[:, k * width : (k + 1) * width]), books[k]
        apart = x @ (-2 * np.ascontiguousarray(book.T))
        apart += (book * book).sum(1)
        codes[:, k] = apart.argmin(1)
        errors[:, k] = np.take_along_axis(apart, codes[:, k : k + 1], 1)[:, 0] + (x * x).sum(1)
    return codes, errors


def _vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            yield batch.slice(i, ROWS)


def _sums(whole: DataFrame, books) -> DataFrame:
    """part, entry, at, total: sums of the parts that are nearest to each entry by component, and under at = -1 their number. A task sends one row for each of these that it has used."""

    def run(batches):
        book = books.value
        parts, entries, width = book.shape
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in _pieces(batches):
            v = _vectors_of(batch)
            codes, _ = nearest(v, book)
            for k in range(parts):
                order = np.argsort(codes[:, k], kind="stable")
                used, start = np.unique(codes[order, k], return_index=True)
                total[k, used] += np.add.reduceat(v[order, k * width : (k + 1) * width], start, axis=0)
                count[k] += np.bincount(codes[:, k], minlength=entries)
        part, entry = np.nonzero(count)
        sums = np.concatenate([count[part, entry][:, None], total[part, entry]], axis=1)
        at = np.tile(np.arange(-1, width), len(part))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, width + 1).astype(np.int32)), pa.array(np.repeat(entry, width + 1).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums.ravel())], ["part", "entry", "at", "total"])

    found = map_arrow(whole.select("v"), run, "part int, entry int, at int, total long")
    return found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))


def train(whole: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width / parts) of whole_vectors(). They are entries x width numbers, whatever the table's size; these alone meet on the driver."""
    spark: SparkSession = whole.sparkSession
    first = np.array([r.v for r in whole.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()], np.int64)
    if not len(first):
        return np.zeros((PARTS, 0, 0), np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        merged = _sums(whole, sent).toArrow()
        part, entry, at, total = (merged.column(c).to_numpy() for c in ("part", "entry", "at", "total"))
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        n = at < 0
        counts[part[n], entry[n]] = total[n]
        sums[part[~n], entry[~n], at[~n]] = total[~n]
        used = counts > 0
        books = books.copy()
        books[used] = sums[used] // counts[used][:, None]  # floors, below zero too
        sent.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimals, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error."""
    sent = whole.sparkSession.sparkContext.broadcast(books)
    kinds = whole.schema

    def run(batches):
        for batch in _pieces(batches):
            codes, errors = nearest(_vectors_of(batch), sent.value)
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    plain = lambda name: f"`{name}` {kinds[name].dataType.simpleString()}"
    return map_arrow(whole, run, f"{plain('vec_id')}, {plain('label')}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with v, the whole-number vectors that their codes stand for."""
    spark = codes.sparkSession
    rows = [(int(k), f"{j:02x}", book.tolist()) for k, part in enumerate(books) for j, book in enumerate(part)]
    table = spark.createDataFrame(rows, "part int, byte string, piece array<long>")
    out = codes
    for k in range(len(books)):  # at most 256 rows each
        piece = table.where(F.col("part") == k).select(F.col("byte").alias(f"_b{k}"), F.col("piece").alias(f"_p{k}"))
        out = out.join(F.broadcast(piece), F.substring("code", 2 * k + 1, 2) == F.col(f"_b{k}"))
    return out.select(*codes.columns, F.concat(*(F.col(f"_p{k}") for k in range(len(books)))).alias("v"))


def _label_error(coded: DataFrame) -> Column | DataFrame:
    """coded with label_error. Each task adds up its own labels before the shuffle; sums come back by broadcast, or salted where labels are many, as one label may hold most rows."""
    sums = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    same = coded["label"].eqNullSafe(sums["label"])
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).select(coded["*"], sums["label_error"])
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt["label"].eqNullSafe(salted["label"]) & (dealt["own"] == salted["salt"])).select(*(dealt[c] for c in coded.columns), salted["label_error"])


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without null or non-finite components.

    Null vectors, and such components, drop the row. A vector shorter than the longest counts as followed by zeros, as do all up to a
    multiple of four components; one without components is all zeros. Components beyond bound() (131072.0 at 64 components) count as it,
    so that no distance leaves 64 bits. With fewer than 256 vectors a codebook has as many entries. Rows of equal vec_id begin codebooks in
    the order of their vectors, null ids last; repeated rows stay, and count as often as they stand. Null labels are one label;
    label_error is null if it leaves 64 bits. Extra columns are ignored. An empty table, or one with no row kept, gives an empty result.

    Whole-number vectors are stored once; each round reads them in one narrow pass that sends sums by entry, so what is shuffled is
    entries x width numbers a task at most. A lost executor costs its tasks of the round.
    """
    whole = stored(whole_vectors(vectors, id_col, vector_col, label_col))
    books = train(whole, entries, rounds)
    if not books.size:
        return whole.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    out = _label_error(stored(encode(whole, books)))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Each round as its own step: all distances of a part as sums of squares, the least by (distance, entry), whole means."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"pieces AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) r(p))",
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM pieces), book0 AS MATERIALIZED (SELECT p, e, x AS c FROM ranked WHERE e < {entries})",
    ]
    near = lambda k: f"""near{k} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT a.vec_id, a.label, a.p, a.x, b.e, list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pieces a JOIN book{k} b ON a.p = b.p) GROUP BY vec_id, label, p)"""  # noqa: E731
    for k in range(rounds):
        steps += [
            near(k),
            f"""flat{k} AS (SELECT p, best.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k}), mean{k} AS (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM flat{k} GROUP BY ALL),
new{k} AS (SELECT p, e, list((CASE WHEN s >= 0 OR s % n = 0 THEN s // n ELSE s // n - 1 END)::BIGINT ORDER BY i) AS c FROM mean{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN new{k} n ON n.p = b.p AND n.e = b.e)""",
        ]
    steps += [
        near(rounds),
        "coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM " + f"near{rounds} GROUP BY vec_id)",
        f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, books"
