"""Benchmark decontamination with suffix arrays over the training text.

Each shard of documents (``SHARD_BYTES`` of text) becomes a sequence of word
numbers with a separator after every document. Only words of the benchmark get a
number, so a suffix that begins with any other word, which no benchmark suffix
can match, is left out: the array is sparse but loses no match. Every suffix of
every benchmark item is then binary-searched in the shard's array, all at once,
one word deeper at each step. At the window's depth that gives all places where a
window occurs; windows that follow each other in an item and in a document are
one verbatim match, whose full length and places are reported.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text. A
larger benchmark takes several blocks, one pass over the documents each, and the
marks so far are written between them; so no task ever holds more than one block's
tables, and nothing is dropped.

Null and empty texts have no words and are never contaminated. Items without
words have no window. Rows with the same item_id count as one item; a null
item_id counts as the empty string. Repeated rows and ids, null ids among them,
are documents of their own; texts of any length are searched whole. Columns
besides doc_id and text, whatever their names, are ignored by the report and kept
by the filter. An empty table gives an empty result; an empty benchmark hits
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import map_arrow, stored

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_HIT_IN = 20
BLOCK_BYTES, SHARD_BYTES = 32 << 20, 16 << 20

#: Lower-cases A-Z and blanks every byte that is not a digit, a letter or part of a character beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Benchmark:
    """One block of items: vocab numbers words from 1; words holds all items, each followed by a 0."""

    vocab: dict[bytes, int]
    words: np.ndarray
    left: np.ndarray  # words to the end of the item, from each place
    item: np.ndarray  # of each place: index into ids
    window: np.ndarray  # of each item: words in its windows
    first: np.ndarray  # of each item: its place in words
    ids: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, str | None]], window: int = WINDOW) -> Benchmark:
        vocab: dict[bytes, int] = {}
        words, left, item, sizes, first, ids = [], [], [], [], [], []
        for item_id, text in rows:
            own = words_of(text)
            if not own:
                continue
            first.append(len(words))
            words += [vocab.setdefault(w, len(vocab) + 1) for w in own]
            words.append(0)
            left += range(len(own), -1, -1)
            item += [len(ids)] * (len(own) + 1)
            sizes.append(min(window, len(own)))
            ids.append(item_id)
        return cls(vocab, *(np.array(x, np.int64) for x in (words, left, item, sizes, first)), ids)


class SuffixArray:
    """The suffixes of tokens that begin with a number above 0, in order; 0 ends a suffix and is less than all words. Runs of fewer than ``least`` known words, which can hold no match of that length, are left out."""

    def __init__(self, tokens: np.ndarray, least: int = 1):
        # runs of at least ``least`` known words, each with one 0 after it, so that a suffix never sees past its run
        edge = np.flatnonzero(np.diff(np.concatenate(([False], tokens > 0, [False])).astype(np.int8)))
        begin, stop = edge[::2], edge[1::2]
        long = stop - begin >= least
        begin, size = begin[long], (stop - begin)[long] + 1
        self.place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        text = tokens[self.place]
        self.text = np.append(text, 0)
        n = len(text)
        end = np.flatnonzero(text == 0)
        order = np.argsort(text, kind="stable")
        rank = np.empty(n, np.int64)
        if n:
            rank[order] = np.cumsum(np.append(0, np.diff(text[order]) != 0))
        longest = int(np.diff(np.append(-1, end)).max()) if len(end) else 0
        run_end = end[np.searchsorted(end, np.arange(n))] if len(end) and end[-1] == n - 1 else np.full(n, n - 1)
        k = 1
        while k < longest:  # prefix doubling
            ahead = np.arange(n) + k
            second = np.where(ahead <= run_end, rank[np.minimum(ahead, n - 1)] + 1, 0)
            order = np.lexsort((second, rank))
            a, b = rank[order], second[order]
            new = np.cumsum(np.append(0, (np.diff(a) != 0) | (np.diff(b) != 0)))
            rank[order] = new
            if new[-1] == n - 1:
                break
            k *= 2
        self.order = order[text[order] > 0]

    def search(self, words: np.ndarray, starts: np.ndarray, depth: np.ndarray, wanted: np.ndarray):
        """Binary search of the suffixes of words from starts, of depth words at most. Returns the longest match of each, and lo and hi of the suffixes that share its first ``wanted`` words."""
        m = len(starts)
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.order), np.int64)
        best = np.zeros(m, np.int64)
        at_lo, at_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        live = np.arange(m) if len(self.order) else np.arange(0)
        d = 0
        while len(live):
            live = live[depth[live] > d]
            word = words[starts[live] + d]
            a = self._bound(lo[live], hi[live], word, d, False)
            b = self._bound(a, hi[live], word, d, True)
            found = b > a
            live, lo_, hi_ = live[found], a[found], b[found]
            lo[live], hi[live] = lo_, hi_
            d += 1
            best[live] = d
            full = wanted[live] == d
            at_lo[live[full]], at_hi[live[full]] = lo_[full], hi_[full]
        return best, at_lo, at_hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, d: int, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            seen = self.text[self.order[mid] + d]
            left = (seen <= word[open_]) if after else (seen < word[open_])
            lo[open_[left]] = mid[left] + 1
            hi[open_[~left]] = mid[~left]
        return lo


@dataclass
class Matches:
    """Maximal verbatim matches: document, first word there, words, item and first word in the item's block."""

    doc: np.ndarray
    at: np.ndarray
    words: np.ndarray
    item: np.ndarray
    start: np.ndarray


def search_shard(texts: list[bytes], bench: Benchmark) -> tuple[np.ndarray, Matches]:
    """texts: folded, as bytes. Returns the words of each text, and all maximal matches of a window's length or more."""
    get = bench.vocab.get
    numbers, sizes = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split()
        sizes[i] = len(own)
        numbers.append(np.fromiter(map(get, own, repeat(0)), np.int32, len(own)))
        numbers.append(np.zeros(1, np.int32))
    tokens = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    first = np.cumsum(sizes + 1) - sizes - 1
    starts = np.flatnonzero(bench.left > 0)
    wanted = bench.window[bench.item[starts]]
    array = SuffixArray(tokens, int(bench.window.min()) if len(bench.window) else 1)
    _, lo, hi = array.search(bench.words, starts, np.minimum(bench.left[starts], wanted), wanted)
    hit = np.flatnonzero(hi > lo)
    count = (hi - lo)[hit]
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = array.place[array.order[np.repeat(lo[hit], count) + inside]].astype(np.int64)
    which = np.repeat(hit, count)
    # windows on one diagonal, next to each other in both, are one match: no window reaches past a document's or an item's end
    start = starts[which]
    order = np.lexsort((place, place - start))
    place, start, which = place[order], start[order], which[order]
    new = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(start) != 1))) if len(place) else np.zeros(0, np.int64)
    run = np.diff(np.append(new, len(place)))
    doc = np.searchsorted(first, place[new], side="right") - 1
    return sizes, Matches(doc, place[new] - first[doc], wanted[which[new]] + run - 1, bench.item[start[new]], start[new])


def _spans(doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the windows: document, first word, words."""
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + size)[order]
    if not len(doc):
        return doc, at, at
    wide = np.int64(int(end.max()) + 1)  # one axis for all documents
    a, b = doc * wide + at, np.maximum.accumulate(doc * wide + end)
    new = np.append(True, a[1:] > b[:-1])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(a)) - 1
    return doc[i], at[i], b[j] - a[i]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, str | None]]]:
    """The items in blocks of about block_bytes, fetched one block at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def _shards(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold so many bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _searching(bench, window: int, judge, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in _shards(batches, text, SHARD_BYTES):
            rows = rows or Benchmark.of(bench.value, window)
            if len(batch.column(text)):
                yield judge(batch, rows)

    return run


def _fold(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in batch.column(name).to_pylist()]


_LONGEST = [("words", pa.int64()), ("item_id", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64())]
_MARKS = pa.struct([("at", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("n_words", pa.int64()), ("longest", pa.struct(_LONGEST))])
_MARKS_SQL = "struct<at: array<long>, words: array<long>, items: array<string>, n_words: long, longest: struct<words: long, item_id: string, item_at: long, doc_at: long>>"


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns, the first renamed c0 and so on, and ``marks``: where windows occur (unions of word ranges), item ids, words and the longest verbatim match with its places (of equal ones the first item's, then the first place's; null if there is none)."""
    spark = docs.sparkSession
    names = docs.columns
    cells = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index('text')}"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)

    def judge(batch: pa.RecordBatch, bench: Benchmark) -> pa.RecordBatch:
        sizes, m = search_shard(_fold(batch, text), bench)
        n = len(sizes)
        old = batch.column("marks").to_pylist() if "marks" in batch.schema.names else [None] * n
        items: list[set[str]] = [set(x["items"]) if x else set() for x in old]
        for d, i in set(zip(m.doc.tolist(), m.item.tolist())):
            items[d].add(bench.ids[i])
        longest = [x["longest"] if x else None for x in old]
        order = np.lexsort((m.at, m.start, -m.words, m.doc))
        for k in order[np.append(True, np.diff(m.doc[order]) != 0)] if len(order) else []:
            d, item = int(m.doc[k]), int(m.item[k])
            new = {"words": int(m.words[k]), "item_id": bench.ids[item], "item_at": int(m.start[k] - bench.first[item]), "doc_at": int(m.at[k])}
            if longest[d] is None or (-new["words"], new["item_id"]) < (-longest[d]["words"], longest[d]["item_id"]):
                longest[d] = new
        doc, at, size = m.doc, m.at, m.words
        more = [(d, a, w) for d, x in enumerate(old) if x for a, w in zip(x["at"], x["words"])]
        if more:
            doc, at, size = (np.append(x, np.array(y, np.int64)) for x, y in zip((doc, at, size), zip(*more)))
        doc, at, size = _spans(doc, at, size)
        cut = np.searchsorted(doc, np.arange(n + 1))
        marks = [{"at": at[cut[i] : cut[i + 1]].tolist(), "words": size[cut[i] : cut[i + 1]].tolist(), "items": sorted(items[i]), "n_words": int(sizes[i]), "longest": longest[i]} for i in range(n)]
        kept = [x for x in batch.schema.names if x != "marks"]
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(marks, _MARKS)], [*kept, "marks"])

    for k, rows in enumerate(benchmark_blocks(benchmark, block_bytes)):
        cells = stored(cells) if k else cells
        cells = map_arrow(cells, _searching(spark.sparkContext.broadcast(rows), window, judge, text), f"{schema}, marks {_MARKS_SQL}")
    return cells


def _hits() -> F.Column:
    return F.aggregate("marks.words", F.lit(0).cast("long"), lambda s, x: s + x)


def _contaminated(one_hit_in: int):
    return (_hits() > 0) & (one_hit_in * _hits() >= F.col("marks.n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_hit_in: int = ONE_HIT_IN) -> DataFrame:
    """A row per document: words, hit words, items with windows in it, the verdict, the longest verbatim match with its places, and the hit ranges."""
    found = find_matches(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        F.col("c0").alias("doc_id"),
        F.col("marks.n_words").alias("n_words"),
        _hits().alias("n_hit"),
        F.size("marks.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "marks.items"), 256).alias("items_sha256"),
        _contaminated(one_hit_in).alias("contaminated"),
        F.col("marks.longest").alias("longest"),
        F.arrays_zip(F.col("marks.at").alias("at"), F.col("marks.words").alias("words")).alias("hit_ranges"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_hit_in: int = ONE_HIT_IN) -> DataFrame:
    """docs without the contaminated ones."""
    found = find_matches(docs, benchmark, window).where(~_contaminated(one_hit_in))
    return found.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every maximal verbatim match of at least ``least`` words, or of a whole item of fewer, with its places: item_id, item_at, words, doc_id, doc_at."""
    spark = docs.sparkSession

    def judge(batch: pa.RecordBatch, bench: Benchmark) -> pa.RecordBatch:
        _, m = search_shard(_fold(batch, "text"), bench)
        columns = [pa.array([bench.ids[i] for i in m.item], pa.string()), pa.array(m.start - bench.first[m.item]), pa.array(m.words), batch.column("doc_id").take(pa.array(m.doc)), pa.array(m.at)]
        return pa.RecordBatch.from_arrays(columns, ["item_id", "item_at", "words", "doc_id", "doc_at"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for rows in benchmark_blocks(benchmark, block_bytes):
        part = map_arrow(source, _searching(spark.sparkContext.broadcast(rows), least, judge, "text"), "item_id string, item_at long, words long, doc_id long, doc_at long")
        part = stored(part) if out is not None else part  # one block's tables at a time
        out = part if out is None else out.unionByName(part)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
