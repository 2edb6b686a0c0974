"""Large and hostile input: time and memory follow its size."""

import os
import random
import struct
import time
import tracemalloc

import numpy as np
import pytest

from kinloom.llm import html, media, warc


def _timed(f, *args, seconds=20):
    began = time.time()
    out = f(*args)
    assert time.time() - began < seconds
    return out


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<style>{'x ' * 500_000}</style>a", "a"),
        (f"<style>{'/*' * 500_000}</style>a", "a"),
        (f"<style>{'@a{' * 300_000}</style>a", "a"),
        (f"<style>{'a{b{' * 250_000}</style>a", "a"),
        ("<i>" * 8000 + "</b>" * 100_000 + "x", "x"),
        ("<b><table><tr><td>" + "<i>" * 8000 + "</b>" * 100_000 + "x", "x"),
        ("<span>" * 8000 + "<h1></h1>" * 50_000 + "z", "z"),
        ("<table><tr>" + "<tr><i>" * 50_000 + "</table>q", "q"),
    ],
)
def test_pages_of_odd_tags(page, text):
    assert _timed(html.page_text, page) == text


def test_wide_tables():
    """No text is lost, and the rendered table is not much larger than the page; up to LINE cells are aligned as ever."""
    wide = "w" * 1_000_000
    page = "<table>" + "<tr><td>a<td>b" * 5000 + f"<tr><td>{wide}<td>c<td>d</table>"
    out = _timed(html.page_text, page)
    assert len(out) < 1.1 * len(page) and out.split("\n")[:2] == ["a  b", "a  b"] and out.split("\n")[-1] == f"{wide}  c  d"
    some = html.page_text(f"<table><tr><td>a<td>b<td>c<tr><td>{'x' * 300}<td>{'y' * 200}<td>z</table>").split("\n")
    assert some == ["a" + " " * 301 + "b" + "  c", "x" * 300 + "  " + "y" * 200 + "  z"]
    spans = _timed(html.page_text, "<table><tr>" + "<td colspan=1000>x" * 50_000 + "</table>")
    assert spans.count("x") == 50_000
    rows = _timed(html.page_text, "<table><tr>" + "<td rowspan=65000 colspan=1000>x" + "<tr><td>y" * 20_000 + "</table>")
    assert rows.count("y") == 20_000


def test_rules_of_style_sheets():
    css = "a{x} /* b{y} */ @media print{c{z}} @import 'q'; d , e { display: none } f{g{h}} } i{j} @font-face{k:l} m{n}"
    assert [(s.strip(), b.strip()) for s, b in html._rules(css)] == [("a", "x"), ("d , e", "display: none"), ("g", "h"), ("i", "j"), ("m", "n")]
    assert list(html._rules("a{b")) == [] and list(html._rules("/* a{b}")) == [] and list(html._rules("@x{a{b}")) == []


def test_a_full_archive_is_read_in_time():
    record = lambda b: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n"
    one = (warc.members(record(os.urandom(16_000))) + b"\0") * 4000
    assert len(one) > 60 << 20
    found = _timed(lambda: [(at, size) for _, body, at, size in warc.parse_members(one)])
    assert len(found) == 4000 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(n for _, n in found) == len(one)
    with pytest.raises(ValueError):
        list(warc.parse_members(one[: len(one) // 4000 - 50]))


def test_merge_of_many_runs():
    draw = random.Random(3)
    rows = sorted((f"{draw.randrange(5000):05d}", "", i) for i in range(20_000))
    for k in (1, 50, 800):
        runs = [rows[i::k] for i in range(k)]
        blocks = sorted(((i, r[j : j + 10]) for i, r in enumerate(runs) for j in range(0, len(r), 10)), key=lambda b: warc._order(b[1][0]))
        merge = warc.Merge(iter(blocks))
        assert _timed(list, merge, seconds=5) == rows and merge.most_open <= 30 * k
    assert list(warc.Merge(iter([]))) == []


def test_merge_in_passes(spark):
    """Forty runs, five at a time: three passes, one order."""
    rng = np.random.default_rng(4)
    rows = [(f"u{int(x) if i % 3 else 5:03d}", f"{int(t):04d}", i if i % 50 else None, "u", 1, "d", "response", None, f"f{i % 7}", i, 1) for i, (x, t) in enumerate(rng.integers(0, 300, (6000, 2)))]
    runs = warc.sorted_runs(spark.createDataFrame(rows, warc.CAPTURE).repartition(40))
    assert runs.select("run").distinct().count() == 40
    got = warc.merge_runs(runs, block_rows=20, range_rows=1000, fan_in=5).collect()
    assert [warc._order(tuple(r)) for r in got] == sorted(map(warc._order, rows)) and {tuple(r) for r in got} == set(rows)
    assert warc.merge_runs(runs.where("false")).count() == 0


def test_media_files_that_lie():
    """Deep nesting, and every changed byte of a file: an error or a result, in little time and memory."""
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    assert sum(1 for _ in media.walk(deep)) == 3000
    with pytest.raises(ValueError):
        media.read_container(deep)
    n = 100_000  # sizes that run to the file's end, one in the other
    assert sum(1 for _ in _timed(lambda: list(media.walk(struct.pack(">I4s", 0, b"moov") * n)))) == n
    file, draw = bytearray(media.write_container(bytes(64 * 40))), random.Random(6)
    head = file.index(b"mdat")
    tracemalloc.start()

    def run():
        errors = 0
        for at in range(head):
            for value in {0, 255, draw.randrange(256)} - {file[at]}:
                old, file[at] = file[at], value
                try:
                    media.read_container(bytes(file))
                except (ValueError, KeyError, IndexError, OverflowError, struct.error):
                    errors += 1
                file[at] = old
        return errors

    assert _timed(run) > 100
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_media_column_of_bad_files(spark):
    good = media.write_container(bytes(64 * 3))
    bad = [b"", b"x", good[:40], struct.pack(">I4s", 0, b"moov") * 5000, None]
    rows = media.media_columns(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate([good, *bad])], "id int, media binary"), keys=("id",)).collect()
    by = {r.id: r for r in rows}
    assert by[0].samples == 3 and by[0].error is None and all(by[i].error for i in (1, 2, 3, 4)) and by[5].error is None and by[5].samples is None
