"""Near-duplicate documents: MinHash signatures joined by coordinates, links confirmed on full sets.

1. One pass over the texts makes each document's set of word shingles, a 64-bit
   hash of the set, and a signature of ``COORDINATES`` minima. Documents of equal
   sets are one class; only classes go on, so copies are never paired.
2. Every class is posted under each (coordinate, value). Postings that only one
   class has are dropped, and with them all classes that keep fewer than
   ``MATCHES`` postings: they cannot agree with another in so many coordinates.
3. For the classes that stay, sets are made again and the shingles that no other
   of these classes has are counted. Two sets of similarity s share at most what
   neither has alone; that bound removes most of the rest exactly.
4. Prefix: of a class's postings, from rare to frequent, all but the last
   ``MATCHES - 1`` are merged; two classes with ``MATCHES`` collisions meet there.
5. Every class is first held against one pivot, the class with the fewest
   shingles of its own in a list that both are in. Confirmed links make
   components. Skip: lists whose classes are in one component are done. The
   classes of the others are searched block against block for pairs of different
   components with ``MATCHES`` collisions over the whole signature, and those are
   confirmed until the components are joined.

So a group of n near copies costs about n confirmations, not n squared, while a
link that would join two components is always looked for. The signature is the
one approximate step: a pair of similarity 0.8 has fewer than 26 of 48
coordinates in common with a probability of about 1e-5, more similar pairs less.

Nulls and texts without words have an empty set, are linked with nothing and
kept. Rows with the same doc_id and text are one document; a null doc_id is
never a component's id unless all its rows have none. Very long texts are
hashed whole, in pieces. Extra columns are kept by the filter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm.common import map_arrow, stored
from kinloom.llm.tokens import mix, word_hashes
from kinloom.operators.graph import connected_components

COORDINATES, MATCHES = 48, 26
SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 80
#: Rows of ids or labels (16 bytes each) that are broadcast at most.
BROADCAST_ROWS = 2_000_000
#: Most classes, and bytes of their sets, in a block of a search.
BLOCK_NODES, BLOCK_BYTES = 1024, 8 << 20
#: Bytes of text whose words are hashed at once.
PIECE_BYTES = 1 << 20
#: Shingles counted by one task.
SHINGLES_A_TASK = 4_000_000

_rng = np.random.default_rng(11)
_SEED = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_FACTOR = _rng.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle's make one of them all."""
    out, piece, chars = [], [], 0
    for t in texts:  # whole texts, few at a time: a worker's memory then depends on the longest text, not on the batch
        piece.append((t or "").encode("utf-8", "surrogatepass"))
        chars += len(piece[-1])
        if chars > PIECE_BYTES:
            out += _piece_sets(piece, width)
            piece, chars = [], 0
    return out + _piece_sets(piece, width)


def _piece_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    words, starts, *_ = word_hashes(texts)
    n = len(words)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * _PLACE[k]
    full = mix(full)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([int((words[a:b] * _PLACE[: b - a]).sum()) + (b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 4096):
        x = ((shingles[None, i : i + 4096] ^ _SEED[:, None]) * _FACTOR[:, None]) >> np.uint64(32)
        np.minimum(best, x.min(1), out=best)
    return best.astype(np.uint32)


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, node, sig; node and sig are null for an empty set."""

    def run(batches):
        for batch in batches:
            n, node, sig = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), width):
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                sig.append(signature(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n", "node", "sig"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, node long, sig array<int>")


def _small(df: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it has few rows; otherwise its join is a shuffle, which AQE splits where it is skewed."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and set (packed) of the wanted (node, rep) classes, a row each."""

    def run(batches):
        for batch in batches:
            nodes, sets = [], []
            done = set()
            for want, s in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text").to_pylist(), width)):
                if want not in done and _node(s) == want:
                    done.add(want)
                    nodes.append(want)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    found = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(_small(wanted), F.col("rep").eqNullSafe(F.col("r")))
    return map_arrow(found.select("node", "text"), run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def _shared_counts(sets: DataFrame, buckets: int) -> DataFrame:
    """node, c: how many of its shingles some other node has, or more if hashes collide. Packed by bucket of the shingle."""

    def deal(batches):
        for batch in batches:
            nodes = np.array(batch.column("node").to_pylist(), np.int64)
            own = [np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()]
            who = np.repeat(np.arange(len(own)), [len(s) for s in own])
            all_ = np.concatenate(own) if own else np.zeros(0, np.uint64)
            part = ((all_ >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[k] : cut[k + 1]]
                w, count = np.unique(who[at], return_counts=True)
                rows.append((k, nodes[w].tobytes(), count.astype(np.int32).tobytes(), (all_[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["bucket", "nodes", "counts", "hashes"])

    def count(batches):
        keys, nodes = [], []
        for batch in batches:
            for bucket, who, n, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                nodes.append(np.repeat(np.frombuffer(who, np.int64), np.frombuffer(n, np.int32)))
                keys.append(np.frombuffer(hashes, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
        if not keys:
            return
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        shared = np.zeros(len(key), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        who, n = np.unique(node[shared], return_counts=True)
        for i in range(0, len(who), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(who[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["node", "c"])

    dealt = map_arrow(sets.select("node", "set"), deal, "bucket int, nodes binary, counts binary, hashes binary").repartition(buckets, "bucket")
    return map_arrow(dealt, count, "node long, c long").groupBy("node").agg(F.sum("c").alias("c"))


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (a, b) those with enough collisions of signatures and then the similarity on full sets."""
    sigs = classes.select("node", "sig")
    close = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    collisions = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = close.where(collisions >= MATCHES).select("a", "b")
    both = close.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = [_similar(x, y, similarity) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long"))


def _searched(open_: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between different components among classes that meet in a list; enough of them to join what is linked.

    Lists that share classes make a cluster. A cluster is cut into blocks of
    bounded number and bytes, and each pair of blocks is a task of its own: it
    counts collisions of signatures block against block and confirms pairs, those
    of most collisions first, leaving out pairs that it has joined already. What
    is shuffled grows with blocks, not pairs, and only links are written.
    """
    heads = open_.groupBy("key").agg(F.min("node").alias("head"))
    clusters = connected_components(open_.join(heads, "key").select(F.col("node").alias("a"), F.col("head").alias("b")))
    nodes = open_.select("node", "n", "c", F.col("component").alias("label")).distinct()
    nodes = stored(nodes.join(clusters.select("node", F.col("component").alias("cluster")), "node"))
    shape = nodes.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = nodes.join(shape, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("node", "sig"), "node").join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label", "n", "c", "sig", "set")

    def run(table: pa.Table) -> pa.Table:
        node, label, n, c, own = (table.column(k).to_numpy() for k in ("node", "label", "n", "c", "own"))
        sig = np.array(table.column("sig").to_pylist(), np.int32).reshape(len(node), COORDINATES)
        held = table.column("set")
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        x, y = int(table.column("x")[0].as_py()), int(table.column("y")[0].as_py())
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found = []
        for i in left.tolist():
            others = right[right > i] if x == y else right
            others = others[(label[others] != label[i]) & ((100 + similarity) * np.minimum(c[i], c[others]) >= similarity * (n[i] + n[others]))]
            if len(others):
                k = (sig[others] == sig[i]).sum(1)
                found += zip(k[k >= MATCHES].tolist(), [i] * int((k >= MATCHES).sum()), others[k >= MATCHES].tolist())
        found.sort(reverse=True)
        links = []
        for _, i, j in found:
            u, v = find(int(label[i])), find(int(label[j]))
            if u != v and _similar(held[i].as_py(), held[j].as_py(), similarity):
                root[u] = v
                links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([k[0] for k in links], pa.int64()), "b": pa.array([k[1] for k in links], pa.int64())})

    return stored(dealt.groupBy("cluster", "x", "y").applyInArrow(run, "a long, b long"))


def _similar(x: bytes, y: bytes, similarity: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * shared >= similarity * (len(a) + len(b) - shared)


def components(docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY, node: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; with node, a hash of its set too."""
    rows = stored(_signatures(docs, width))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    classes = stored(classes)
    posting = F.explode(F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
    postings = classes.select("node", posting.alias("key"))
    frequent = postings.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    lists = postings.join(frequent, "key").groupBy("node").agg(F.collect_list(F.struct("f", "key")).alias("l")).where(F.size("l") >= MATCHES)
    lists = stored(lists.withColumn("l", F.slice(F.array_sort("l"), F.lit(1), F.size("l") - (MATCHES - 1))))
    near = stored(lists.join(classes.select("node", "rep", "n"), "node"))
    sets = stored(_sets(docs, near.select("node", F.col("rep").alias("r")), width))
    total = near.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHINGLES_A_TASK))
    # c >= s * n must hold for any link
    near = stored(near.join(_shared_counts(sets, buckets), "node").where(100 * F.col("c") >= similarity * F.col("n")).withColumn("own", F.col("n") - F.col("c")))
    prefix = stored(near.select(F.explode("l.key").alias("key"), "node", "n", "c", "own"))
    pivots = prefix.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("o"), "node", "n", "c")).alias("p"))

    def possible(n1, c1, n2, c2):
        # shared <= the smaller c, and shared / (n1 + n2 - shared) must reach the similarity
        return (100 + similarity) * F.least(c1, c2) >= similarity * (n1 + n2)

    starred = prefix.join(pivots, "key").where((F.col("node") != F.col("p.node")) & possible(F.col("n"), F.col("c"), F.col("p.n"), F.col("p.c")))
    starred = starred.groupBy("node", F.col("p.node").alias("pivot")).agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max(F.struct("k", "pivot")).alias("best"))
    links = _confirmed(starred.select(F.col("node").alias("a"), F.col("best.pivot").alias("b")), classes, sets, similarity)
    labels = stored(connected_components(links))
    marked = prefix.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = stored(marked.join(mixed, "key"))
    more = _searched(open_, classes, sets, similarity)
    if more.take(1):
        labels = stored(connected_components(links.unionByName(more)))
    # the smallest doc_id of a component; classes of one row that are linked with none need no label
    named = labels.join(classes.select("node", "rep"), "node")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    copies = classes.where("copies > 1").join(labels, "node", "left_anti").select("node", F.col("rep").alias("component_id"))
    label = stored(named.unionByName(copies))
    out = rows.select("doc_id", "n", "node").join(_small(label), "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["node"] if node else []))


def keep_first(docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """docs without the documents that are linked, directly or through others, with one of a smaller id. Of rows of one id and one set that would all stay, one stays; rows of an empty set all do; a null id goes if a linked document has an id."""
    names = docs.columns
    at = names.index("doc_id")
    cells = docs.toDF(*(f"c{i}" for i in range(len(names))))
    found = stored(components(docs, width, similarity, node=True))
    gone = stored(found.where("not kept").select("doc_id", "node").distinct())
    again = stored(found.where("kept and node is not null").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))

    def run(batches):
        for batch in batches:
            node = [_node(s) if len(s) else None for s in shingle_sets(batch.column(f"c{names.index('text')}").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], [*batch.schema.names, "node"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema) + ", node long"
    own = map_arrow(cells, run, schema).withColumn("own", F.col(f"c{at}").cast("long"))
    side = _small(gone).select("doc_id", F.col("node").alias("gone_node"))
    out = own.join(side, F.col("own").eqNullSafe(F.col("doc_id")) & F.col("node").eqNullSafe(F.col("gone_node")), "left_anti")
    if again.take(1):
        twin = _small(again.select(F.col("doc_id").alias("d"), F.col("node").alias("n"), F.lit(1).alias("twin")))
        out = out.join(twin, F.col("own").eqNullSafe(F.col("d")) & F.col("node").eqNullSafe(F.col("n")), "left").drop("d", "n")
        out = stored(out)
        one = out.where("twin = 1").groupBy("own", "node").agg(F.min_by(F.struct(*cells.columns), F.xxhash64(*(f"c{i}" for i, f in enumerate(docs.schema) if not isinstance(f.dataType, T.MapType)))).alias("row"))
        out = out.where("twin is null").select(*cells.columns).unionByName(one.select("row.*"))
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
