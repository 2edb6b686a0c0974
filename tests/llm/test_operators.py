"""The text operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.llm import decontaminate, html, katz, langid, media, mixing, neardup, quality, toxicity, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(20_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "clash"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "clash"),
    (3, None, None, None, None, None),
    (4, "", "en", "b", 0, ""),
    (5, LONG, "en", "a", len(LONG), "x"),
    (5, LONG, "en", "a", len(LONG), "x"),
    (6, "Ünïcode wörds ß über alles 12345 !!!", "de", None, 9, "y"),
    (None, "one two", "en", "c", 7, "z"),
    (8, "  \t\n ", "fr", "c", 5, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media_round_trip(docs, empty):
    for r in media.media_digest(docs).collect():
        raw = next((t or "").encode() for i, t, *_ in ROWS if i == r.doc_id)
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.media_digest(empty).count() == 0
    box = media.write_container(bytes(64 * 600))
    track = media.read_container(box)
    assert (track["codec"], track["samples"], len(track["key_offsets"]), track["duration"]) == ("raw ", 600, 38, 24.0)
    with pytest.raises(ValueError):
        media.read_container(box[:-100])


def test_media_files_and_features(spark):
    """Against the file's parts put together by hand, and a plain reader."""
    rows = [(1, "a"), (1, "a"), (None, "x" * 1100), (2, "long " * 100_000)]
    got = media.media_digest(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id int, text string, feature string")).collect()
    assert len(got) == 4 and len({tuple(r) for r in got}) == 3
    for r in got:
        raw = next(t.encode() for i, t in rows if i == r.doc_id)
        file = media.write_container(media.padded(raw))
        n = -(-len(raw) // 64)
        at = file.index(b"mdat") + 4
        keys = [(at + 64 * k, 64) for k in range(0, n, 16)]
        ranges = hashlib.sha1(b"".join(x.to_bytes(8, "big") for k in keys for x in k)).hexdigest()[:16]
        assert file[at:] == raw + bytes(-len(raw) % 64)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert r.feature == f"codec=raw;timescale=25;duration={n};samples={n};keyframes={len(keys)};first={keys[0][0]}+64;last={keys[-1][0]}+64;ranges={ranges}"


def _movie(stbl, *more, edit=b""):
    u = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    stsd = media.full_box(b"stsd", u(1), media.box(b"avc1", bytes(78)))
    minf = media.box(b"minf", media.box(b"stbl", stsd, *stbl))
    mdia = media.box(b"mdia", media.full_box(b"mdhd", u(0, 0, 10, 0, 0)), minf)
    trak = media.box(b"trak", media.full_box(b"tkhd", u(0, 0, 7, 0, 0)), edit, mdia)
    return media.box(b"moov", media.full_box(b"mvhd", u(0, 0, 100, 0)), trak, *more)


def test_media_columns(spark):
    u = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    full = media.full_box
    small = (full(b"stts", u(1, 3, 5)), full(b"stsc", u(1, 1, 3, 1)), full(b"stz2", u(4, 3), b"\x12\x30"), full(b"stco", u(1, 8)), full(b"stss", u(1, 2)))
    mdat = media.box(b"mdat", bytes(6))
    none = (full(b"stts", u(0)), full(b"stsc", u(0)), full(b"stsz", u(0, 0)), full(b"stco", u(0)))
    moov = _movie(none, media.box(b"mvex", full(b"trex", u(7, 1, 20, 4, 0x10000))))
    run = full(b"trun", u(2), (8).to_bytes(4, "big"), u(0), flags=5)  # data offset and the first sample's flags
    moof = media.box(b"moof", full(b"mfhd", u(1)), media.box(b"traf", full(b"tfhd", u(7), flags=0x20000), full(b"tfdt", u(0)), run))
    sized = full(b"trun", u(3), u(6, 0, 5, 0x10000, 7, 0), flags=0x600)  # sizes and flags
    again = media.box(b"moof", media.box(b"traf", full(b"tfhd", u(7), (len(moov) + len(moof) + 8).to_bytes(8, "big"), flags=1), sized))
    fragmented = moov + moof + media.box(b"mdat", bytes(40)) + again
    files = {
        "stz2": mdat + _movie(small),
        "edited": mdat + _movie(small, edit=media.box(b"edts", full(b"elst", u(2, 150, 0, 0x10000, 50, 0, 0x10000)))),
        "fragments": fragmented,
        "own": media.write_container(bytes(64 * 40)),
        "damaged": media.write_container(bytes(640))[:-1],
        "text": b"no container at all",
        "empty": b"",
        "none": None,
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in files.items()], "name string, media binary, codec int")
    got = {r.name: r for r in media.media_columns(df, keys=("name",)).collect()}
    ranges = lambda k: [tuple(x) for x in got[k].keyframes]
    assert (got["stz2"].codec, got["stz2"].duration, got["stz2"].samples, ranges("stz2")) == ("avc1", 1.5, 3, [(9, 2)])
    assert got["edited"].duration == 2.0
    base = len(moov) + len(moof) + 8
    assert got["fragments"].samples == 5 and got["fragments"].duration == (2 * 20 + 3 * 20) / 10
    assert ranges("fragments") == [(len(moov) + 8, 4), (base, 6), (base + 11, 7)]
    assert got["own"].samples == 40 and len(got["own"].keyframes) == 3 and got["own"].duration == 1.6
    assert all(got[k].codec is None and got[k].error for k in ("damaged", "text", "empty"))
    assert tuple(got["none"])[1:] == (None,) * 5
    assert media.media_columns(df.limit(0), keys=("name",)).count() == 0


def _contaminated(rows, items, window=13):
    words = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower())
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            x = words(x)
            n = min(window, len(x))
            grams = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add("" if k is None else str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, docs, empty):
    items = [(1, "brown FOX jumps"), (2, ""), (None, "two"), (10, " ".join(f"w{i % 977} x{i % 31}" for i in range(100, 120))), (1, "lazy dog")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 40):  # one block, and several
        found = decontaminate.find_matches(docs.select("doc_id", "text"), bench, block_bytes=size)
        assert found.count() == len(ROWS)
        got = decontaminate.contamination_report(docs, bench).drop("hit_ranges", "longest").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _contaminated([r[:2] for r in ROWS], items)))
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in _contaminated([r[:2] for r in ROWS], items))
    assert decontaminate.contamination_report(empty, bench).count() == 0


def test_longest_matches_against_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"v{int(x)}" for x in rng.integers(0, 3, n))
    items = [(i, word(30)) for i in range(4)] + [(9, "v0 v1"), (11, "")]
    rows = [(i, f"zz {word(40)} {items[i % 4][1]} yy {word(9)}") for i in range(8)] + [(None, "v0 v1 v2"), (3, None)]
    want = []
    for d, t in rows:
        t = (t or "").split()
        for k, x in items:
            x = x.split()
            least = min(6, len(x))
            for i in range(len(t)):
                for j in range(len(x)):
                    if t[i] == x[j] and not (i and j and t[i - 1] == x[j - 1]):
                        n = next((n for n in range(min(len(t) - i, len(x) - j)) if t[i + n] != x[j + n]), min(len(t) - i, len(x) - j))
                        if n >= least:
                            want.append((str(k), j, n, d, i))
    df, bench = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    for size in (1 << 20, 100):
        got = decontaminate.longest_matches(df, bench, least=6, block_bytes=size).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    best = {}
    for k, j, n, d, i in want:
        best.setdefault(d, []).append((-n, k, j, i))
    for size in (1 << 20, 100):
        found = decontaminate.find_matches(df, bench, window=6, block_bytes=size).select("c0", "marks.longest").collect()
        for d, longest in found:
            if longest is None:
                assert d not in best or d == 3
            else:
                assert (-longest.words, longest.item_id) == min(best[d])[:2] and (-longest.words, longest.item_id, longest.item_at, longest.doc_at) in best[d]
    assert decontaminate.longest_matches(df.limit(0), bench).count() == 0
    assert decontaminate.contamination_report(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_reports_whole_matches(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    df, bench = spark.createDataFrame([(1, f"a b {passage} c")], "doc_id long, text string"), spark.createDataFrame([("q", f"x {passage}")], "item_id string, text string")
    (r,) = decontaminate.contamination_report(df, bench).collect()
    assert tuple(r.longest) == (50, "q", 1, 2) and [tuple(x) for x in r.hit_ranges] == [(2, 50)] and r.n_hit == 50


def test_several_blocks_agree(spark, docs):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["brown fox", "lazy dog again", "x3 w65"])], "item_id long, text string")
    one, many = (decontaminate.find_matches(docs.select("doc_id", "text"), bench, block_bytes=b).selectExpr("c0", "marks.at", "marks.words", "marks.items").collect() for b in (1 << 20, 8))
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_mixing_against_sql(spark, docs, empty):
    ours = mixing.mix_report(docs)
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT, score VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    theirs = con.sql(mixing.oracle()).fetchall()
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, theirs))
    assert mixing.mix_report(empty).count() == 0
    assert mixing.mix(docs).columns == [*docs.columns, "taken"]
    clash = docs.withColumn("Taken", F.lit("old")).withColumn("size", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("s", F.lit(3))
    again = mixing.mix(clash)
    assert again.columns == [*docs.columns, "size", "hash", "s", "taken"]
    assert sorted(r.taken for r in again.collect()) == sorted(r.taken for r in ours.collect() if r.taken)


WEB = [(1, "http://b.org/x", "<p>ä</p>"), (2, "http://a.org/", None), (3, "https://www.a.org/y?Q=1", "<p>ä</p>"), (4, None, "WARC/1.1\r\n\r\n\r\n"), (7, "http://a.org/", ""), (3, "http://b.org/x", "<p>ä</p>"), (None, "http://b.org/x", "<p>ä</p>"), (None, "http://c.org/", "alone"), (9, "http://a.org/z\r\nX: y", "long " * 100_000)]


def test_warc(spark):
    df = spark.createDataFrame([(*p, "clash", 1) for p in WEB], "page_id int, url string, html string, digest string, n long")
    got = sorted((repr((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in warc.archive_report(df).collect()))
    want = [(1, 9, "revisit", 3), (3, 9, "response", None), (3, 9, "response", None), (2, 0, "revisit", 7), (7, 0, "response", None), (4, 14, "response", None), (None, 9, "revisit", 3), (None, 5, "response", None), (9, 500_000, "response", None)]
    assert got == sorted(map(repr, want))
    assert warc.archive_report(df.limit(0)).count() == 0
    digests = {r.page_id: r.payload_digest for r in warc.archive_report(df).collect()}
    assert all(digests[i] == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, _, h in WEB if i is not None)


def test_warc_offsets_can_be_sought(spark, tmp_path):
    df = spark.createDataFrame(WEB * 3, "page_id long, url string, html string").repartition(2)
    warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=2000)  # several files
    rows = warc.captures(spark, f"file://{tmp_path}/w").collect()
    assert len(rows) == 27 and len({r.file for r in rows}) > 2
    for r in rows:
        data = open(r.file.removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
        ((head, body, _, _),) = warc.parse_archive(gzip.decompress(data))
        assert head["warc-type"] == r.record_type and (r.record_type == "revisit" or len(body) == r.payload_bytes)


def test_warc_large_records_take_several_members(monkeypatch):
    monkeypatch.setattr(warc, "_MEMBER_BYTES", 60)
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 300\r\n\r\n" + b"x" * 300 + b"\r\n\r\n"
    file = (warc.members(record) + b"\0") * 3
    found = list(warc.parse_members(file))
    assert [len(body) for _, body, _, _ in found] == [300] * 3 and gzip.decompress(file) == record * 3
    assert [at for _, _, at, _ in found] == [0, len(file) // 3, 2 * len(file) // 3]


def test_warc_merge_is_external(spark):
    """Runs of many blocks, merged in order with few of them open; a URL of a third of all captures is split."""
    rng = np.random.default_rng(4)
    rows = [(f"u{int(x) if i % 3 else 5:03d}", f"{int(t):04d}", i if i % 50 else None, "u", 1, "d", "response", None, f"f{i % 7}", i, 1) for i, (x, t) in enumerate(rng.integers(0, 300, (6000, 2)))]
    runs = warc.sorted_runs(spark.createDataFrame(rows, warc.CAPTURE).repartition(4))
    merged = warc.merge_runs(runs, block_rows=50, range_rows=1500)
    got = merged.withColumn("part", F.spark_partition_id()).collect()
    assert [warc._order(tuple(r)) for r in got] == sorted(map(warc._order, rows)) and {tuple(r)[:11] for r in got} == set(rows)
    sizes = collections.Counter(r.part for r in got)
    assert len(sizes) >= 4 and max(sizes.values()) < 3000
    runs = [sorted((str(int(x)), "", i) for x in np.random.default_rng(s).integers(0, 50, 400)) for i, s in enumerate(range(7))]
    blocks = sorted(((i, r[j : j + 10]) for i, r in enumerate(runs) for j in range(0, 400, 10)), key=lambda b: warc._order(b[1][0]))
    merge = warc.Merge(iter(blocks))
    assert list(map(warc._order, merge)) == sorted(warc._order(x) for r in runs for x in r)
    assert merge.most_open <= 7 * 10 * 9  # of 2800


def test_loser_tree():
    runs = [sorted((str(x), "", i) for x in np.random.default_rng(s).integers(0, 50, 40)) for i, s in enumerate(range(7))]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def _brute(rows, width):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((rows[k][0] for k in range(len(rows)) if label[k] == x and rows[k][0] is not None), default=None) for x in label}
    return sorted(repr((r[0], len(s), least[x], r[0] == least[x])) for r, s, x in zip(rows, sets, label))


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = [r[:2] for r in ROWS]
    for k in range(60):  # a group of near copies of which many are linked only through others
        w = list(base)
        for i in rng.integers(0, 120, int(rng.integers(0, 7))):
            w[i] = f"m{k}_{i}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in neardup.components(df, width=4).collect()]
    assert sorted(got) == _brute(rows, 4)
    assert neardup.components(empty).count() == 0
    assert neardup.keep_first(docs).columns == docs.columns


def test_keep_first_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text.replace("w59", "x"), " ".join(f"o{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (2, near, "c"), (2, other, "d"), (None, text, "e"), (None, "alone and without an id", "f"), (3, None, "g"), (3, "", "h"), (4, other, "i"), (5, "short text", "j"), (6, "short text", "k")]
    df = spark.createDataFrame(rows, "doc_id int, text string, node string")
    got = neardup.keep_first(df)
    assert got.columns == df.columns
    kept = sorted((r.node for r in got.collect()))
    assert kept in (["a", "d", "f", "g", "h", "j"], ["b", "d", "f", "g", "h", "j"])
    assert neardup.keep_first(df.limit(0)).count() == 0


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Blocks of a few rows each, so that every path is taken."""
    rng = np.random.default_rng(6)
    page = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(200):
        w = list(page) if k % 3 else [f"c{k % 7}_{i}" for i in range(100)]
        for i in rng.integers(0, 100, int(rng.integers(0, 5))):
            w[i] = f"m{k}_{i}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK_NODES", 8)
    got = [repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()]
    assert sorted(got) == _brute(rows, 4)


def test_shared_counts(spark):
    rng = np.random.default_rng(1)
    sets = {int(k) - 10: np.unique(rng.integers(0, 400, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(30)}
    df = spark.createDataFrame([(k, s.tobytes()) for k, s in sets.items()], "node long, set binary").repartition(3)
    times = collections.Counter(x for s in sets.values() for x in s.tolist())
    want = {k: sum(times[x] > 1 for x in s.tolist()) for k, s in sets.items()}
    assert {r.node: r.c for r in neardup._shared_counts(df, 4).collect()} == {k: n for k, n in want.items() if n}


def test_katz(spark, docs, empty):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b c d", "", None, "a a a b", LONG, "zz a b q"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    counts = collections.Counter(w for i, t in tokens.items() if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in katz.report(df).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0
    assert katz.report(empty).count() == 0


def test_katz_sums_to_one():
    rng = np.random.default_rng(1)
    few = np.array([50, 20, 9, 6, 4, 3])
    d = katz.discounts(few)
    assert ((0 < d[1:6]) & (d[1:6] <= 1)).all()
    for cut in (0, 1, 4):  # histories that occur, all of whose grams are frequent, and of every word
        p = rng.dirichlet(np.ones(30))
        c = rng.integers(0, 9, 30) * (rng.integers(0, 9, 30) > 4) if cut == 0 else rng.integers(7, 12, 30) * (np.arange(30) % cut == 0)
        seen = c > 0
        scale, alpha = katz.weights(*(np.array([x]) for x in ((d[np.minimum(c, 6)] * c).sum(), c.sum(), p[seen].sum())))
        assert np.where(seen, scale * d[np.minimum(c, 6)] * c / c.sum(), alpha * p).sum() == pytest.approx(1)
    assert [float(x[0]) for x in katz.weights(np.zeros(1), np.zeros(1), np.zeros(1))] == [1, 1]


def _katz(train, rows, order):
    """Brute force over tuples of words."""
    texts = [[*(t or "").lower().split(), "</s>"] for t in train]
    grams = lambda w, k: [tuple((["<s>"] * (k - 1) + w)[i : i + k]) for i in range(len(w))]
    counts = {k: collections.Counter(g for w in texts for g in grams(w, k)) for k in range(1, order + 1)}
    d = {k: katz.discounts(np.array([sum(x == i for x in c.values()) for i in range(1, katz.K + 2)])) for k, c in counts.items()}
    cut = lambda k, c: d[k][min(c, katz.K + 1)] * c
    n, v = sum(counts[1].values()), len(counts[1])
    free = 1 - sum(cut(1, c) for c in counts[1].values()) / n
    follow = {k: collections.defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, x in c.items():
            follow[k][g[:-1]][g[-1]] = x

    def p(g):
        k = len(g)
        if k == 1:
            c = counts[1][g]
            return (cut(1, c) / n if c else free) if free > 1e-12 else (c + 1) / (n + v + 1)
        after = follow[k].get(g[:-1])
        if not after:
            return p(g[1:])
        total = sum(after.values())
        kept, rest = sum(cut(k, c) for c in after.values()) / total, 1 - sum(p((*g[1:-1], w)) for w in after)
        s = 1 / kept if rest < 1e-9 else total / (total + 1) / kept if kept > 1 - 1e-12 else 1.0
        if g[-1] in after:
            return s * cut(k, after[g[-1]]) / total
        return 0.0 if rest < 1e-9 else (1 - s * kept) / rest * p(g[1:])

    return [sum(math.log10(max(p(g), 1e-300)) for g in grams([*(t or "").lower().split(), "</s>"], order)) for t in rows]


def _sentences():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 200)}" for x in rng.zipf(1.4, int(rng.integers(1, 25)))) for _ in range(150)]
    return [*texts, "", None, "never seen before", "w1 rare follower", "w1 rare follower w2 w3"]


@pytest.mark.parametrize(("order", "hot", "chunk"), [(2, katz.HOT, katz.CHUNK_BYTES), (2, 20, 300), (3, katz.HOT, 300), (3, 20, 300), (4, 5, 500)])
def test_katz_scores(spark, order, hot, chunk):
    """Against brute force; with hot words, the start mark among them, and many chunks."""
    texts = _sentences()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r for r in katz.report(df, order=order, hot_from=hot, chunk_bytes=chunk).collect()}
    want = _katz([t for i, t in enumerate(texts) if not got[i].held_out], texts, order)
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want, rel=1e-5)


def test_katz_refuses_a_changed_order():
    u, hot = katz.Unigrams(1, 1, np.zeros(6, int)), katz.Hot(*[np.zeros(0, np.uint64)] * 3, 9)
    table = pa.table({"doc_id": [1], "held_out": [False], "text": ["a b"]})
    asked = {p: [katz._check(np.ones(1, np.uint64)), *[np.zeros(2, np.uint64)] * 2] for p in range(4)}
    with pytest.raises(RuntimeError, match="read again"):
        list(katz._sent(0, table, {katz.WORDS: asked}, u, hot, 3, 4))


def test_katz_clashing_names_null_ids_and_repeats(spark):
    rows = [(1, "a b a", 5, "x"), (1, "a b a", 6, "y"), (None, "a b", 7, None), (2, "a b a", 8, "x"), (3, "b", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, part int, held_out string")
    got = sorted(katz.report(df).collect(), key=repr)
    assert len(got) == 5 and sum(r.doc_id is None and r.held_out for r in got) == 1
    same = [r.score for r in got if r.n_tokens == 4]
    assert same == pytest.approx([same[0]] * 3)


LEARN = [(i, t, x, "s", 1, "") for i in range(60) for t, x in (("the dog and the cat of the house", "en"), ("der hund und die katze des hauses", "de"))]


def test_language(spark, docs, empty):
    df = spark.createDataFrame(LEARN, SCHEMA)
    scorer = langid.Scorer(langid.fit(df))
    assert [scorer(t)[0] for t in ("the house of the dogs", "die hunde und der", None, "", "123 !", "the", "½ ² 3", "½ the")] == ["en", "de", "und", "und", "und", "en", "und", "en"]
    assert all(s == 0 for x, s in map(scorer, (None, "", "½ ² 3")) if x == "und")
    assert langid.report(empty).count() == 0
    assert langid.keep_identified(docs, langid.fit(df)).columns == docs.columns
    got = langid.predict(docs, langid.fit(df), F.lit(True)).collect()
    assert sorted(repr((r.doc_id, r.lang_pred, round(r.score, 9))) for r in got) == sorted(repr((i, x, round(s, 9))) for i, (x, s) in ((r[0], scorer(r[1])) for r in ROWS))
    nothing = langid.Scorer(langid.fit(df.limit(0)))
    assert nothing("the house") == ("und", 0.0)


def test_language_learns_every_language_and_word(spark):
    rows = [(i, f"ka{x}mo ri{x}sa {'word' + x}", f"l{i:04d}") for i in range(1200) for x in ["".join(chr(97 + int(d)) for d in f"{i:04d}")]]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(m.langs) == 1200 and len(m.words) == 3600
    zh = [(i, f"这是第{chr(0x4E00 + i)}个中文句子没有空格", "zh") for i in range(50)] + [(100 + i, f"これは{chr(0x3041 + i)}番目の日本語の文です", "ja") for i in range(50)]
    scorer = langid.Scorer(langid.fit(spark.createDataFrame(zh, "doc_id long, text string, lang string")))
    assert [scorer(t)[0] for t in ("没有空格的另一个句子", "別の日本語の文です")] == ["zh", "ja"]


def _backoff_score(counts, text):
    """Brute force of the word-first backoff, from counts by language."""
    langs = sorted(counts)
    grams = {n: {x: collections.Counter(g for w in counts[x] for g in langid.grams_of(w, n)) for x in langs} for n in range(1, 5)}
    total = dict.fromkeys(langs, 0.0)

    def log(table, key):
        keys = set().union(*table.values())
        return {x: math.log((table[x].get(key, 0) + 0.3) / (sum(table[x].values()) + 0.3 * len(keys))) for x in langs}

    for w in langid.words_of(text):
        if any(w in counts[x] for x in langs):
            own = log(counts, w)
        else:
            n = next((n for n in (4, 3, 2, 1) if any(g in grams[n][x] for g in langid.grams_of(w, n) for x in langs)), 0)
            known = [log(grams[n], g) for g in langid.grams_of(w, n) if any(g in grams[n][x] for x in langs)] if n else []
            own = {x: sum(k[x] for k in known) / max(1, n) for x in langs}
            own = {x: v - max(own.values()) for x, v in own.items()}
        total = {x: total[x] + own[x] for x in langs}
    best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_language_against_brute_force(monkeypatch):
    counts = {"de": {b"hund": 3, b"katze": 1, b"haus": 2}, "en": {b"dog": 2, b"house": 2, b"cat": 5}, "fr": {b"chien": 1, b"chat": 4}}
    texts = ["hund cat", "hunde houses chats", "qqq dog", "zzz", "katzen und haus chienne", "chat cat katze " * 50 + "dogs hounds chaton"]
    for most in (langid.REMEMBERED, 8):  # forgets unseen words within a text
        monkeypatch.setattr(langid, "REMEMBERED", most)
        scorer = langid.Scorer(langid.LanguageModel.of(counts))
        for t in texts:
            lang, score = scorer(t)
            want = _backoff_score(counts, t)
            assert lang == want[0] and score == pytest.approx(want[1], rel=1e-4), t
    tied = langid.Scorer(langid.LanguageModel.of({"b": {b"x": 1}, "a": {b"x": 1}}))
    assert tied("x") == ("a", 0.5)


def test_toxicity(spark, docs, empty, monkeypatch):
    clean = [f"the house of the river and day {i} people went to town number{i % 7}" for i in range(80)]
    bad = [f"{c} you {w} there" for c, w in zip(clean, ["moronix", "blasteroid", "snarfelt"] * 20)]
    m = toxicity.train(clean + bad, [0] * len(clean) + [1] * len(bad))
    s = m(["a moronix walked", "a m o r o n i x walked", "a mor.onix walked", "a monix of blasterxoid", "people went to the house", "", LONG])
    assert (s[:4] > 0.5).all() and (s[4:6] < 0.5).all()
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)  # forgets between batches of 256 texts; repeated words must still be found
    many = (clean + bad) * 8
    assert np.array_equal(m(many), np.tile(m(clean + bad), 8))
    assert (toxicity.train(["a"], [1])(["a", ""]) == 0).all()
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for report in (toxicity.report, quality.report):
        got = report(docs, labels).collect()
        assert sorted(repr((r.doc_id, r.held_out)) for r in got) == sorted(repr((r[0], r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 == 0)) for r in ROWS)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if report is toxicity.report else 0.3)) for r in got)
        assert report(empty, labels).count() == 0 and report(docs, labels.limit(0)).count() == len(ROWS)
    scored = toxicity.score(spark.createDataFrame([(1, "a moronix", "x"), (1, None, "y"), (2, "", "z")], "doc_id int, text string, score string"), m, F.lit(True)).collect()
    assert [r.score for r in scored] == pytest.approx(m(["a moronix", "", ""]).tolist()) and [r.predicted for r in scored] == [1, 0, 0]
    assert toxicity.keep_clean(docs, m).columns == docs.columns
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean[:20] + bad[:20] + ["x" * 200_000])], "doc_id long, text string")
    whole = toxicity.fit(df, spark.createDataFrame([(i, int(20 <= i < 40)) for i in range(41)], "doc_id long, toxic int"))
    assert np.array_equal(whole(bad), toxicity.train(clean[:20] + bad[:20] + ["x" * 200_000], [int(20 <= i < 40) for i in range(41)])(bad))  # long rows are learned from too


def test_toxicity_kernel_against_brute_force():
    """Sums over common subsequences, without hashing."""

    def subsequences(w):
        w, out = f"^{w}$", collections.Counter()
        for k in toxicity.ORDERS:
            for at in itertools.combinations(range(len(w)), k):
                if at[-1] - at[0] < k + toxicity.GAP:
                    out["".join(w[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["moron", "moxron", "morons", "river", "idiot", "id", "a", "silver"]
    own = [subsequences(w) for w in words]
    norm = toxicity._norm(np.array([len(w) for w in words]))
    want = np.array([[sum(v * b[k] for k, v in a.items()) for b in own] for a in own]) / norm / norm[:, None]
    assert toxicity.Landmarks(words).kernel(words) == pytest.approx(want, abs=0.02)


def test_toxicity_finds_inserted_letters():
    rows = duckdb.sql("SELECT text, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE length(text) <= 20000 AND toxic IS NOT NULL ORDER BY doc_id, text").fetchall()
    rows = [r for i, r in enumerate(rows) if i % 5 and r[0]]
    m = toxicity.train([r[0] for r in rows], [r[1] for r in rows])
    insults, rng = ["idiot", "stupid", "moron", "trash", "scum", "clown", "pathetic", "loser", "worthless"], np.random.default_rng(99)
    every = [f"{w[:i]}{x}{w[i:]}" for w in insults for i in range(1, len(w)) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)]
    assert (m(every) > 0.5).mean() > 0.8 and (m(insults) > 0.5).all()


def test_quality_learns(spark):
    """From positives and unlabelled texts alone."""
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(300)]
    good = [" ".join(rng.choice(words, 80)) + "." for _ in range(150)]
    bad = [" ".join(x.upper() + "!!" for x in rng.choice(words, 80)) for _ in range(60)]
    m = quality.train(good[:100], good[50:] + bad[:40])
    assert 0.5 < m.prior < 0.9  # 100 of 140
    assert (m(good[100:]) > 0.5).mean() > 0.9 and (m(bad[40:]) < 0.5).mean() > 0.9
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + ["", None, "x " * 200_000])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(160)], "doc_id long, quality int")
    fitted = quality.fit(docs, labels)
    other = quality.fit(docs, labels.withColumn("quality", F.when(F.col("quality") == 1, 1)))  # labels 0 are used for nothing
    assert np.allclose(fitted(good + bad), other(good + bad)) and (fitted(good) > 0.5).mean() > 0.9 > 0.2 > (fitted(bad) > 0.5).mean()
    assert (quality.train([], ["a"])(["a", ""]) == 0.5).all()


def test_quality_curve_has_least_unbiased_risk():
    rng = np.random.default_rng(2)
    p, u, prior = rng.normal(1, 1, 400), np.concatenate([rng.normal(1, 1, 600), rng.normal(-1, 1, 400)]), 0.6
    risk = lambda a, b: np.logaddexp(0, a * u + b).mean() - prior * (a * p + b).mean() + quality.RIDGE / 2 * ((a - 1) ** 2 + b**2)
    a, b = quality._curve(p, u, prior)
    assert all(risk(a, b) <= risk(a + x, b + y) for x in (-0.05, 0, 0.05) for y in (-0.05, 0, 0.05))


def test_html(spark):
    page = "<html><head><title>t</title></head><body><h1>A &amp; B</h1><p>one<p>two <b>bold</b><br>next<ul><li>x<li>y<ol><li>z</ol></ul><table><tr><td>a<td>bb<tr><td>ccc<td>d</table><p hidden>no</p><div style='display:none'>no</div><script>no()</script>"
    assert html.page_text(page) == "A & B\n\none\n\ntwo bold\nnext\n\n- x\n- y\n  1. z\n\na    bb\nccc  d"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<div>" * 5000 + "deep")], "page_id long, html string")
    assert [r.text for r in html.extract(df).orderBy("page_id").collect()] == [None, "", "deep"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>T</title><meta charset=x>\n<p>Hello<p>you", "Hello\n\nyou"),
        ("<html><head><style>s</style> bare text", "bare text"),
        ("<head><title>T</title></head><p>a<head><p>b", "a\n\nb"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<table><tbody><th>a<th>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><form><tr><td>a<td>b</form><tr><td>c</table>", "a  b\nc"),
        ("<table>loose<tr>text<td>a<div>x</div></table>after", "loosetext\n\na\nx\n\nafter"),
        ("<table><div>before</div><tr><p>more<td>a</td></tr></table>", "before\n\nmore\n\na"),
        ("<table><caption>cap<tr><td>a<table><tr><td>in</table>b<td>c</table>", "cap\na   c\nin\nb"),
        ("<table><tr><td>a<table><td>b</table></table><table><td>c<table></table>", "a\nb\n\nc"),
        ("<table><tr><table><td>a</table>", "a"),
    ],
)
def test_html_implied_tags(page, text):
    assert html.page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>" * 250 + "<table><tr><td>x<td>y<td>z", "x  y  z"),
        ("<table>" + "".join(f"<tr><td>x{i}<table>" for i in range(300)), "\n".join(f"x{i}" for i in range(300))),
        ("<table><tr><td colspan=2>wide heading<td>z<tr><td>a<td>b<td>c<tr><td rowspan=2>r<td>s<tr><td>t<td>u</table>", "wide heading  z\na  b          c\nr  s\n   t          u"),
        ("<table><tr><td colspan=99999>a<tr><td>b<td>c</table>", "a\nb  c"),
        ("<table><tr><td><p>one<p>two<ul><li>x<li>y</ul><td>z</table>", "one  z\ntwo\n- x\n- y"),
        ("<ol start=5><li>a<li value=9>b<li>c</ol>", "5. a\n9. b\n10. c"),
        ("<ul><li><p>para</p><li>x</ul>", "- para\n\n- x"),
        ("<style>.h,#q{display:none} p.v{visibility:hidden} /* .k{display:none} */ @media print{.k{display:none}}</style><p class='x h'>no<p id=q>no<p class=v>no <b style='visibility:visible'>yes</b><p class=k>kept", "yes\n\nkept"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>shown<p hidden style='display:block'>too", "shown\n\ntoo"),
        ("<p style='visibility:hidden'>no<i style='visibility:visible'>yes</i>", "yes"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details><dialog>no</dialog><dialog open>yes</dialog>", "S\nT\nyes\nyes"),
        ("<p aria-hidden=true>seen", "seen"),
        ("<textarea>a\n  b</textarea>", "a\n  b"),
        ("<select><option>a<option selected>b<option>c</select><select multiple><option>d<option>e</select>", "b d e"),
        ("<input value=x><input type=hidden value=no><input type=password value=no><input type=submit value=Go>", "x Go"),
        ("<svg><title>no</title><text>drawn</text></svg><math><mi>x</mi></math>", "drawnx"),
        ("a<br><br>b<pre> c\n  d</pre>", "a\n\nb\n\n c\n  d"),
    ],
)
def test_html_layout(page, text):
    assert html.page_text(page) == text


class _Seen(HTMLParser):
    """The words of a page outside what is hidden, in any order."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.words += (a.get("alt") or "").split() if tag == "img" and not self.hidden else []
        if tag not in html.VOID and (self.hidden or tag in html.UNSEEN or "hidden" in a or re.search("display: ?none|visibility: ?hidden", a.get("style") or "")):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        self.words += [] if self.hidden else data.split()


def test_html_loses_no_visible_word():
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall():
        seen = _Seen()
        seen.feed(page)
        seen.close()
        mine, theirs = collections.Counter("".join(html.page_text(page).split())), collections.Counter("".join(seen.words))
        assert not theirs - mine, page


def test_html_handles_hostile_and_odd_tables(spark):
    assert html.page_text("<div>" * 100_000 + "deep") == "deep"
    assert html.page_text("<table><tr><td>" * 3000 + "deep").strip() == "deep"
    df = spark.createDataFrame([(1, "<p>a", "x", 7), (1, "<p>a", "y", 8), (None, "<p>b", "z", 9), (2, "word " * 300_000, "w", 1)], "page_id int, html string, text string, key long")
    got = html.extract(df).collect()
    assert sorted(repr((r.page_id, len(r.text))) for r in got) == sorted(map(repr, [(1, 1), (1, 1), (None, 1), (2, 1_499_999)]))
    assert html.extract(df.limit(0)).count() == 0
