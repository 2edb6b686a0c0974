"""Language-model scores by a Katz backoff n-gram model of any order.

Counts cover every training text. A text is its words and one end; before its
first word are start marks. Every gram that occurs is counted and kept, whatever
the size of the input; there is no shortlist of words.

* Unigrams: Good-Turing discounted counts (Katz's form, counts up to ``K``); the
  mass that discounting frees belongs to the unknown word. If it frees none,
  add-one estimates are used instead.
* Longer grams, up to ``ORDER`` words: discounted in the same way. A history's
  backoff weight is the mass its grams leave over the lower order's mass of the
  words that do not follow it. A history whose counts are all too large to be
  discounted gives up one part in c + 1; one that everything follows keeps all.
  A history that never occurred leaves its word to the next shorter one. So each
  conditional distribution sums to one (tested).

Three exchanges, all of packed tables, one row for a chunk of texts and a part:

1. Chunks ask the parts of the word hashes (64 bits) for the counts of their
   words. A part numbers its words by falling count, so that frequent words have
   small numbers.
2. Words that occur ``HOT`` times or more, at most one in ``HOT`` tokens, are hot.
   Chunks ask for the counts of the pairs that a hot word begins; what the model
   needs of a hot word beyond that, a few numbers, is broadcast.
3. Each token goes, as word numbers, to the part of the word before it. All
   histories of a gram end with that word, so its part has the counts, weights
   and lower orders of all its grams. A hot word's tokens are split over parts
   by the word before it (by the next word, where a text begins): the pairs'
   counts came with them. The part sends back a sum for each text; the sums of
   a text are added up.

The third exchange is read twice, first for the counts of counts. Nothing that
grows with the number of words is broadcast or sent to the driver. A history
of two words or more is kept in one part, with one entry for each time a text
holds it.

Chunks are cut by size, in the order of the scan, which must give the same rows
each time, as tables of files do; answers carry a check of what was asked, and a
changed order ends in an error, not in wrong scores.

Null and empty texts are one end. Without training texts nothing is known and
every token has the add-one estimate of an empty table. A null id is held out.
Rows with equal texts get equal scores, to rounding; repeated rows and ids are
rows of their own. Further columns, whatever their names, are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import held_out, map_arrow, stored
from kinloom.llm.tokens import mix, word_hashes

K = 5
#: Words in the longest gram.
ORDER = 3
END_HASH = np.uint64(0x9D2C5680CA876543)
#: Numbers of the start mark, of a word of no training text, and of the first word.
START, UNKNOWN, FIRST = 0, 1, 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text in a chunk and, on average, in a part.
CHUNK_BYTES, PART_BYTES = 8 << 20, 6 << 20
#: Occurrences from which a word is hot.
HOT = 400_000
#: Kinds of rows: what chunks ask and are answered, tables, texts.
ASK, TABLE, WORDS, PAIRS, TEXTS, BASE, SUMS = range(7)

_ROW = "part int, kind int, chunk long, blob binary"
_NAMES = ("part", "kind", "chunk", "blob")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers by byte planes, compressed; sorted ones should come as differences."""
    compress = zstandard.ZstdCompressor(level=1).compress
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        size = a.dtype.itemsize
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, size).T
        body = compress(planes.tobytes()) if len(a) else b""
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    decompress = zstandard.ZstdDecompressor().decompress
    at, out = 2, []
    for _ in range(int.from_bytes(blob[:2], "little")):
        kind = np.dtype(blob[at : at + 4].decode().strip())
        n, size = (int.from_bytes(blob[i : i + 8], "little") for i in (at + 4, at + 12))
        at += 20
        planes = np.frombuffer(decompress(blob[at : at + size]) if n else b"", np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, as blobs may be large."""
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64]), kinds)], list(_NAMES))


def _read(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in _NAMES))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(20)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)


def _cuts(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts the rows of a part together, and where each part begins."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint32))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, by key, and each key's number among them."""
    order = np.argsort(keys)
    ascending = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def _sums(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas, dtype=deltas.dtype)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in a sorted table, and which are in it."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _check(keys: np.ndarray) -> np.ndarray:
    """One number that tells lists of keys apart."""
    return np.array([np.bitwise_xor.reduce(mix(keys + np.uint64(len(keys))), initial=np.uint64(0))], np.uint64)


def _few(counts: np.ndarray) -> np.ndarray:
    """How many keys have each count from 1 to K + 1."""
    return np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2]


# Texts and tokens


def _chunks(batches, most: int) -> Iterator[tuple[int, pa.Table]]:
    """Chunks of a task's rows, cut by the bytes of their texts alone, with their numbers."""
    task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64) + 1)
        begin, before = 0, 0
        while begin < batch.num_rows:
            cut = int(np.searchsorted(upto, most - size + before)) + 1
            held.append(batch.slice(begin, cut - begin))
            if cut > batch.num_rows:
                size += int(upto[-1]) - before
                break
            yield (task << 32) | k, pa.Table.from_batches(held)
            k, held, size, begin, before = k + 1, [], 0, cut, int(upto[cut - 1])
    if held and sum(b.num_rows for b in held):
        yield (task << 32) | k, pa.Table.from_batches(held)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each document's words and its end, as hashes; and the document of each."""
    words, starts, *_ = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), n + 1)
    out = np.full(len(doc), END_HASH, np.uint64)
    is_end = np.zeros(len(doc), bool)
    is_end[np.cumsum(n + 1) - 1] = True
    out[~is_end] = words
    return out, doc


def _before(words: np.ndarray, doc: np.ndarray, back: int) -> np.ndarray:
    """The word so many places before each token; the start mark where there is none."""
    first = _firsts(doc)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    out = np.full(len(words), START, np.uint64)
    out[place >= back] = words[np.flatnonzero(place >= back) - back]
    return out


def _of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and whether they are learned from, of a chunk's tokens."""
    hashes, doc = _tokens(table.column("text").to_pylist())
    return hashes, doc, ~np.asarray(table.column("held_out"))[doc]


def _pairs(hashes: np.ndarray, doc: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that follow a hot word, the hot words' places in the list, and the pairs' keys."""
    place, is_hot = hot.find(_before(hashes, doc, 1))
    at = np.flatnonzero(is_hot)
    return at, place[at], mix(hot.hashes[place[at]] * _FACTOR + hashes[at])


# Statistics


def discounts(few: np.ndarray) -> np.ndarray:
    """Katz's discount of counts 0 (unused) to K, from how many keys have the counts 1 to K + 1; 1 where Good-Turing has none below it."""
    d = np.ones(K + 2)
    n = few.astype(np.float64)
    if n[0] <= 0:
        return d
    a = (K + 1) * n[K] / n[0]
    for r in range(1, K + 1):
        if n[r - 1] > 0 and n[r] > 0 and a < 1:
            x = ((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a)
            d[r] = x if 0 < x < 1 else 1.0
    return d


@dataclass
class Unigrams:
    n: int  # tokens
    v: int  # words
    few: np.ndarray

    def __post_init__(self):
        self.d = discounts(self.few)
        few = self.few[:K] * np.arange(1, K + 1)
        free = 1 - float((few * self.d[1 : K + 1]).sum() + self.n - few.sum()) / self.n if self.n else 0.0
        self.unknown = free if free > 1e-12 else 0.0

    def share(self, c: np.ndarray) -> np.ndarray:
        """Of a word with count c; of the unknown word for 0."""
        c = np.asarray(c, np.int64)
        if self.unknown <= 0:
            return (c + 1) / (self.n + self.v + 1)
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / max(1, self.n), self.unknown)


@dataclass
class Hot:
    """Hot words, by hash; the start mark may be one of them. There is at most one in HOT tokens."""

    hashes: np.ndarray  # sorted
    ids: np.ndarray
    counts: np.ndarray
    least: int
    few: np.ndarray | None = None  # by word: how many words follow it so often
    low: np.ndarray | None = None  # by word: the followers' share of unigrams

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.hashes, hashes)


def weights(kept: np.ndarray, total: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scale and backoff weight of histories: of their grams' discounted counts, all counts, and the lower order's share of the words that follow them. Both are 1 for histories that never occurred."""
    known = total > 0
    total = np.maximum(total, 1).astype(np.float64)
    kept, rest = kept / total, 1 - low
    all_follow = known & (rest < 1e-9)
    s = np.where(all_follow, 1 / np.maximum(kept, 1e-300), np.where(kept > 1 - 1e-12, total / (total + 1) / np.maximum(kept, 1e-300), 1.0))
    return np.where(known, s, 1.0), np.where(known, np.where(all_follow, 0.0, (1 - s * kept) / np.maximum(rest, 1e-9)), 1.0)


# The exchange of words and of hot pairs


def _questions(chunk: int, keys: np.ndarray, train: np.ndarray, parts: int, route: np.ndarray | None = None, *more: np.ndarray) -> list[tuple]:
    """Distinct keys of a chunk with their training counts, to the parts of route (else of the keys)."""
    first, inverse = _distinct(keys)
    counts = np.bincount(inverse, weights=train, minlength=len(first)).astype(np.uint64)
    keys, more = keys[first], [m[first] for m in more]
    order, cut = _cuts(_part_of(keys if route is None else route[first], parts), parts)
    out = []
    for p in np.flatnonzero(np.diff(cut)):
        own = order[cut[p] : cut[p + 1]]
        out.append((int(p), ASK, chunk, pack(_deltas(keys[own]), counts[own], *(m[own] for m in more))))
    return out


def _answers_of(keys: np.ndarray, parts: int, found: dict[int, list[np.ndarray]], route: np.ndarray | None = None) -> list[np.ndarray]:
    """The answers to _questions, by token; found: by part."""
    first, inverse = _distinct(keys)
    single = keys[first]
    order, cut = _cuts(_part_of(single if route is None else route[first], parts), parts)
    some = [found[p] for p in np.flatnonzero(np.diff(cut))] if all(p in found for p in np.flatnonzero(np.diff(cut))) else []
    for p, answer in zip(np.flatnonzero(np.diff(cut)), some):
        if answer[0][0] != _check(single[order[cut[p] : cut[p + 1]]])[0]:
            some = []
            break
    if not some and len(keys):
        raise RuntimeError("the table gave other rows, or in another order, when it was read again; write it to files first")
    out = []
    for column in range(1, len(some[0]) if some else 1):
        own = np.empty(len(single), np.uint64)
        own[order] = np.concatenate([a[column] for a in some])
        out.append(own[inverse])
    return out


def _counted_words(docs: DataFrame, parts: int, chunk_bytes: int) -> DataFrame:
    """Rows of kind WORDS, the numbers and counts of each chunk's words; of kind TABLE, a part's words; with the sums n, v, few."""

    def ask(batches):
        for chunk, table in _chunks(batches, chunk_bytes):
            hashes, doc, train = _of(table)
            starts = _firsts(doc)  # the start mark is a word of no share, with a count
            keys, more = np.append(hashes, np.full(len(starts), START, np.uint64)), np.append(train, train[starts])
            yield from _rows(_questions(chunk, keys, more, parts))

    def count(batches):
        asked = [(part, chunk, unpack(blob)) for part, _, chunk, blob in _read(batches)]
        if not asked:
            return
        part = asked[0][0]
        keys = [_sums(x[0]) for *_, x in asked]
        every = np.concatenate(keys)
        first, inverse = _distinct(every)
        single = every[first]
        counts = np.bincount(inverse, weights=np.concatenate([x[1] for *_, x in asked]), minlength=len(single)).astype(np.int64)
        rank = np.empty(len(single), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(single))
        ids = np.where(counts > 0, FIRST + rank * parts + part, UNKNOWN).astype(np.uint64)
        ids[single == START] = START
        real = (counts > 0) & (single != START)
        found = [(part, TABLE, 0, pack(_deltas(single[counts > 0]), ids[counts > 0], counts[counts > 0].astype(np.uint64)))]
        upto = np.cumsum([len(k) for k in keys])
        found += [(part, WORDS, chunk, pack(_check(k), ids[inverse[end - len(k) : end]], counts[inverse[end - len(k) : end]].astype(np.uint64))) for (_, chunk, _), k, end in zip(asked, keys, upto)]
        for i, batch in enumerate(_rows(found)):
            sums = [int(counts[real].sum()), int(real.sum()), _few(counts[real]).tolist()] if i == 0 else [0, 0, None]
            columns = [pa.array([x if j == 0 else None for j in range(batch.num_rows)], k) for x, k in zip(sums, (pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*_NAMES, "n", "v", "few"])

    asked = map_arrow(docs, ask, _ROW).repartitionById(parts, "part")
    return stored(map_arrow(asked, count, _ROW + ", n long, v long, few array<long>"))


def _unigrams(words: DataFrame) -> Unigrams:
    row = [x or 0 for x in words.agg(F.sum("n"), F.sum("v"), *(F.sum(F.get("few", F.lit(i))) for i in range(K + 1))).first()]
    return Unigrams(row[0], row[1], np.array(row[2:]))


def _hot(words: DataFrame, least: int) -> Hot:
    """Words that occur so often: no more than one in that many tokens."""

    def run(batches):
        for _, _, _, blob in _read(batches):
            h, ids, counts = unpack(blob)
            at = np.flatnonzero(counts >= least)
            yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)) for x in (_sums(h), ids, counts)], ["h", "i", "c"])

    rows = map_arrow(words.where(F.col("kind") == TABLE).select(*_NAMES), run, "h long, i long, c long").collect()
    h, ids, counts = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in range(3))
    order = np.argsort(h)
    return Hot(h[order], ids[order], counts[order].astype(np.int64), least)


def _counted_pairs(docs: DataFrame, words: DataFrame, uni, hot, parts: int, chunk_bytes: int) -> DataFrame:
    """Rows of kind PAIRS, the counts of each chunk's pairs of a hot word and the next; of kind TABLE, sums by hot word. Pairs go to the part of the next word, where its count is."""

    def ask(batches):
        for chunk, table in _chunks(batches, chunk_bytes):
            hashes, doc, train = _of(table)
            at, place, keys = _pairs(hashes, doc, hot.value)
            yield from _rows(_questions(chunk, keys, train[at], parts, hashes[at], place.astype(np.uint32), hashes[at]))

    def count(batches):
        asked, part, known = [], 0, ([np.zeros(0, np.uint64)] * 2)
        for part, kind, chunk, blob in _read(batches):
            if kind == TABLE:
                h, _, c = unpack(blob)
                known = [_sums(h), c]
            else:
                asked.append((chunk, unpack(blob)))
        if not asked:
            return
        keys = [_sums(x[0]) for _, x in asked]
        every = np.concatenate(keys)
        first, inverse = _distinct(every)
        single = every[first]
        counts, place, word = (np.concatenate([x[i] for _, x in asked]) for i in (1, 2, 3))
        counts = np.bincount(inverse, weights=counts, minlength=len(single)).astype(np.int64)
        place, word, n = place[first].astype(np.int64), word[first], len(hot.value.hashes)
        at, there = _find(known[0], word)
        low = uni.value.share(np.where(there, known[1][at], 0) if len(known[0]) else np.zeros(len(word)))
        seen = counts > 0
        few = np.stack([np.bincount(place[seen & (counts == k)], minlength=n) for k in range(1, K + 2)])
        out = [(part, TABLE, 0, pack(few.ravel().astype(np.uint64), np.bincount(place[seen], weights=low[seen], minlength=n)))]
        upto = np.cumsum([len(k) for k in keys])
        out += [(part, PAIRS, chunk, pack(_check(k), counts[inverse[end - len(k) : end]].astype(np.uint64))) for (chunk, _), k, end in zip(asked, keys, upto)]
        yield from _rows(out)

    asked = map_arrow(docs, ask, _ROW).unionByName(words.where(F.col("kind") == TABLE).select(*_NAMES))
    return stored(map_arrow(asked.repartitionById(parts, "part"), count, _ROW))


def _summed(pairs: DataFrame, hot: Hot) -> None:
    """Puts the sums by hot word into hot; they are added up by word on the executors."""

    def run(batches):
        for _, _, _, blob in _read(batches):
            few, low = unpack(blob)
            some = np.flatnonzero(few.reshape(K + 1, -1).any(axis=0) | (low > 0))
            columns = [pa.array(some), *(pa.array(x[some].astype(np.int64)) for x in few.reshape(K + 1, -1)), pa.array(low[some])]
            yield pa.RecordBatch.from_arrays(columns, ["place", *(f"n{k}" for k in range(1, K + 2)), "low"])

    kinds = "place long, " + ", ".join(f"n{k} long" for k in range(1, K + 2)) + ", low double"
    rows = map_arrow(pairs.where(F.col("kind") == TABLE), run, kinds).groupBy("place").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(1, K + 2)), F.sum("low").alias("low")).collect()
    hot.few, hot.low = np.zeros((len(hot.hashes), K + 1), np.int64), np.zeros(len(hot.hashes))
    for r in rows:
        hot.few[r.place], hot.low[r.place] = [r[f"n{k}"] for k in range(1, K + 2)], r.low


# The exchange of tokens


def _sent(chunk: int, table: pa.Table, found: dict[int, dict[int, list[np.ndarray]]], uni: Unigrams, hot: Hot, order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A chunk's tokens to the parts of the words before them, and what is known of its documents already."""
    hashes, doc, train = _of(table)
    ids, counts = _answers_of(np.append(hashes, np.uint64(START)), parts, found.get(WORDS, {}))
    ids, counts = ids[:-1], counts[:-1].astype(np.int64)
    pair = np.zeros(len(ids), np.uint64)
    at, place, keys = _pairs(hashes, doc, hot)
    if len(at):
        pair[at] = _answers_of(keys, parts, found.get(PAIRS, {}), hashes[at])[0]
    rows = table.num_rows
    n = np.bincount(doc, minlength=rows)
    base = np.bincount(doc, weights=np.log10(counts + 1.0), minlength=rows) - n * np.log10(uni.n + uni.v + 1.0)
    sink = pa.BufferOutputStream()
    known = pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": n, "n_known": np.bincount(doc, weights=counts > 0, minlength=rows).astype(np.int64), "base_score": base})
    with pa.ipc.new_stream(sink, known.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(known)
    out = [(chunk % parts, BASE, chunk, sink.getvalue().to_pybytes())]
    back = [_before(ids, doc, k) for k in range(1, order)]
    route = mix(back[0])
    split = np.zeros(len(ids), np.uint64)
    split[at] = hot.counts[place].astype(np.uint64) // np.uint64(hot.least)
    by = np.where(back[0] == START, ids, back[1] if order > 2 else ids)
    route = np.where(split > 0, route + mix(by) % (split + np.uint64(1)), route)
    by_part, cut = _cuts(_part_of(route, parts), parts)
    for p in np.flatnonzero(np.diff(cut)):
        own = by_part[cut[p] : cut[p + 1]]
        first = _firsts(doc[own])
        at_word, number = _distinct(ids[own])
        single, c = ids[own[at_word]], counts[own[at_word]]
        out.append((int(p), ASK, chunk, pack(
            _deltas(doc[own[first]].astype(np.uint32)), np.diff(np.append(first, len(own))).astype(np.uint32), train[own[first]].view(np.uint8), _deltas(single), np.diff(c, prepend=0).astype(np.int64),
            number.astype(np.uint32), pair[own[split[own] > 0]] if len(at) else np.zeros(0, np.uint64), *(b[own] for b in back))))
    yield from _rows(out)


class Part:
    """The tokens of a part: their grams' counts by order, and their probabilities."""

    def __init__(self, blobs: list[bytes], hot: Hot, order: int):
        first, sizes, train, word, c, hot_pair, back = [], [], [], [], [], [], [[] for _ in range(order - 1)]
        self.order = order
        for blob in blobs:
            d, n, t, single, counts, w, pair, *history = unpack(blob)
            single = _sums(single)
            first.append(_sums(d))
            sizes.append(n)
            train.append(np.repeat(t, n))
            word.append(single[w])
            c.append(np.cumsum(counts)[w])
            hot_pair.append(pair)
            for all_, own in zip(back, history):
                all_.append(own)
        self.docs, self.sizes = first, sizes
        train, word, self.c, hot_pair = (np.concatenate(x) for x in (train, word, c, hot_pair))
        back = [np.concatenate(back.pop(0)) for _ in range(order - 1)]
        del c, blob, d, n, t, single, counts, w, pair, history
        ids, places = np.unique(hot.ids, return_index=True)
        hot_at, follows_hot = _find(ids, back[0])
        every = None  # by token: how often its hot pair occurs
        if len(hot_pair):
            every = np.zeros(len(word), np.int64)
            every[follows_hot] = hot_pair
        self.levels = []  # by order from 2: of tokens, the gram; of grams, a token, the history and the count; of histories, the total, or the place of a hot word
        history = np.zeros(len(word), np.uint64)  # of a gram's history, and of a gram, a hash of the numbers and words before
        only_start = np.ones(len(word), bool)
        for own in back:
            only_start &= own == START
            token, history = _distinct(mix(history * _FACTOR + own))
            sample, gram = _distinct(mix(history.astype(np.uint64) * _FACTOR + word))
            count = np.bincount(gram, weights=train, minlength=len(sample)).astype(np.int64)
            is_hot = follows_hot[token] & (only_start[token] if self.levels else True)
            place = np.where(is_hot, places[hot_at[token]] if len(ids) else 0, -1)
            if every is not None:
                count = np.where(is_hot[history[sample]], every[sample], count)
            total = np.bincount(history[sample], weights=count, minlength=len(token)).astype(np.int64)
            self.levels.append((gram.astype(np.uint32), sample.astype(np.uint32), history[sample], count, total, place))
            history = history.astype(np.uint64)

    def few(self) -> np.ndarray:
        """By order from 2, how many grams have each count; without those of hot words, which are known."""
        return np.stack([_few(count[place[history] < 0]) for _, _, history, count, _, place in self.levels])

    def log_probabilities(self, uni: Unigrams, hot: Hot, d: np.ndarray) -> np.ndarray:
        p = uni.share(self.c)
        hot_shares = hot.low  # of the words that follow a hot word, at the order below
        for (gram, sample, history, count, total, place), own in zip(self.levels, d):
            low, seen = p[sample], count > 0
            kept = np.bincount(history, weights=own[np.minimum(count, K + 1)] * count, minlength=len(total))
            under = np.bincount(history[seen], weights=low[seen], minlength=len(total))
            is_hot = place >= 0
            if is_hot.any():
                w = place[is_hot]
                few = hot.few[w][:, :K]
                total, kept, under = total.copy(), kept.copy(), under.copy()
                total[is_hot] = hot.counts[w]
                kept[is_hot] = hot.counts[w] - (few * np.arange(1, K + 1) * (1 - own[1 : K + 1])).sum(axis=1)
                under[is_hot] = hot_shares[w]
            scale, alpha = weights(kept, total, under)
            if is_hot.any():
                hot_shares = np.zeros(len(hot.hashes))
                hot_shares[w] = (scale * kept / np.maximum(total, 1))[is_hot]
            of = np.maximum(total, 1)[history]
            share = np.where(seen, scale[history] * own[np.minimum(count, K + 1)] * count / of, alpha[history] * low)
            p = share[gram]
        return np.log10(np.maximum(p, 1e-300))


def _discounted(stats: list[int], hot: Hot, order: int) -> np.ndarray:
    """The discounts of the orders from 2; the pairs of hot words are added, and as grams of start marks alone, the start mark's to every order."""
    few = np.array(stats, np.int64).reshape(order - 1, K + 1)
    if len(hot.hashes):
        few[0] += hot.few.sum(axis=0)
        few[1:] += hot.few[hot.hashes == START].sum(axis=0)
    return np.stack([discounts(f) for f in few])


def report(docs: DataFrame, held: Column | None = None, order: int = ORDER, hot_from: int = HOT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; learned from those not held out."""
    if order < 2:
        raise ValueError("the model has two words or more")
    held = held_out(F.col("doc_id"), 7, 2) if held is None else F.coalesce(held, F.lit(True))
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    words = _counted_words(docs, parts, chunk_bytes)
    uni, hot = _unigrams(words), _hot(words, hot_from)
    n = uni.n
    u = spark.sparkContext.broadcast(uni)
    answers = words.where(F.col("kind") == WORDS).select(*_NAMES)
    if len(hot.hashes):
        pairs = _counted_pairs(docs, words, u, spark.sparkContext.broadcast(hot), parts, chunk_bytes)
        _summed(pairs, hot)
        answers = answers.unionByName(pairs.where(F.col("kind") == PAIRS))
    h = spark.sparkContext.broadcast(hot)

    def texts(batches):
        for chunk, table in _chunks(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            yield from _rows([(0, TEXTS, chunk, sink.getvalue().to_pybytes())])

    def send(batches):
        """A chunk's answers come first, its texts last."""
        found: dict[int, dict[int, list[np.ndarray]]] = {}
        for part, kind, chunk, blob in _read(batches):
            if kind == TEXTS:
                yield from _sent(chunk, pa.ipc.open_stream(blob).read_all(), found, u.value, h.value, order, parts)
                found = {}
            else:
                found.setdefault(kind, {})[part] = unpack(blob)

    def profile(batches):
        blobs = [blob for _, kind, _, blob in _read(batches) if kind == ASK]
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array([Part(blobs, h.value, order).few().ravel().tolist()], pa.list_(pa.int64()))], ["few"])

    def answer(batches):
        blobs, chunks, few, part = [], [], [0] * (order - 1) * (K + 1), 0
        for batch in batches:
            for (part, kind, chunk, blob), row in zip(_read([batch]), batch.column("few").to_pylist()):
                few = [x or 0 for x in row]
                if kind == BASE:
                    yield from _rows([(part, kind, chunk, blob)])
                else:
                    blobs.append(blob)
                    chunks.append(chunk)
        if not blobs:
            return
        own = Part(blobs, h.value, order)
        blobs.clear()
        p, at = own.log_probabilities(u.value, h.value, _discounted(few, h.value, order)), 0
        for chunk, doc, n in zip(chunks, own.docs, own.sizes):
            upto = at + int(n.sum())
            sums = np.add.reduceat(p[at:upto], np.cumsum(n.astype(np.int64)) - n.astype(np.int64))
            yield from _rows([(part, SUMS, chunk, pack(_deltas(doc), sums.astype(np.float32)))])
            at = upto

    def score(batches):
        """A chunk's documents come first, then sums, by part."""
        known, total = None, np.zeros(0)

        def done():
            columns = {c: known.column(c) for c in known.column_names} | {"train_tokens": pa.array(np.full(known.num_rows, n, np.int64)), "score": pa.array(total)}
            return pa.table({c: columns[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}).to_batches()

        for _, kind, _, blob in _read(batches):
            if kind == BASE:
                if known is not None:
                    yield from done()
                known = pa.ipc.open_stream(blob).read_all()
                total = np.zeros(known.num_rows)
            else:
                doc, sums = unpack(blob)
                total[_sums(doc)] += sums
        if known is not None:
            yield from done()

    whole = map_arrow(docs, texts, _ROW).unionByName(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", F.when(F.col("kind") == TEXTS, 1).otherwise(0))
    asked = map_arrow(whole, send, _ROW).repartitionById(parts, "part")
    few = map_arrow(asked, profile, "few array<long>").agg(F.array(*(F.coalesce(F.sum(F.get("few", F.lit(i))), F.lit(0)) for i in range((order - 1) * (K + 1)))).alias("few"))
    sums = map_arrow(asked.crossJoin(F.broadcast(few)), answer, _ROW)  # the broadcast table has one row
    return map_arrow(sums.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "part"), score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
