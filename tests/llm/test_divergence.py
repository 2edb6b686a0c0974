"""The source audit against a plain count, on small and awkward tables, with and without broadcasts."""

import collections
import re

import duckdb
import pyarrow as pa
import pytest

from kinloom.llm import divergence

WORDS = ["der", "Die", "DAS", "naïve", "𝒳yz", "ÄRGER", "ärger", "e", "-", "x9y", "zz"]
ROWS = [(i, " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 2 + i % 9)), ["en", "de", None][i % 3], f"s{i % 4}" if i % 5 else None, "clash") for i in range(90)]
ROWS += [(90, None, "en", "s0", "x"), (91, "", "en", "only empty", "x"), (92, "once", "xx", "a", "x"), (93, "123 \t", "xx", "b", "x"), (94, "der " * 50_000, "en", "s1", "x")]
ROWS += [ROWS[7]] * 12 + [(None, "e e e", "yy", "alone", "y")] * 11
SCHEMA = "doc_id long, text string, lang string, source string, value string"


def _plain(rows, least=divergence.MIN_DOCS, top=divergence.TOP):
    counts, held, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, _ in rows:
        terms = re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        g = (lang or "", source or "")
        groups.add(g)
        counts[g].update(terms)
        held[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {g: counts[g] for g in groups if g[0] == lang}
        total = collections.Counter()
        for c in own.values():
            total.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {g: share(c) for g, c in own.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = [(sum(f(p[g][t], p[h][t]) for t in kept), h[1]) for h in own if h != g]
            terms = [(f(p[g][t], q[t]), t) for t in kept if own[g][t] and p[g][t] > q[t]]
            for part, listed in (("pair", pairs), ("term", terms)):
                listed.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, v, k) for k, (v, item) in enumerate(listed, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("most", [divergence.BROADCAST_GROUPS, 0])
def test_audit(spark, most, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", most)
    want = _plain(ROWS)
    assert {r[2] for r in want} == {"pair", "term"} and max(r[5] for r in want if r[2] == "term") <= 10
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(ROWS, SCHEMA)).collect())) == want


def test_sql(spark):
    con = duckdb.connect()
    con.register("documents", pa.table({n: pa.array([r[k] for r in ROWS], pa.string()) for k, n in ((1, "text"), (2, "lang"), (3, "source"))}))
    assert sorted(con.sql(divergence.ORACLE).fetchall()) == _plain(ROWS)


def test_small_tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert divergence.audit(docs.where("false")).collect() == []
    two = [(1, "a b", "en", "x", ""), (2, None, "en", "y", ""), (3, "c", "fr", "x", "")]  # no kept term
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(two, SCHEMA)).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(two, SCHEMA), min_docs=1, top=1).collect())) == _plain(two, 1, 1)


def test_large_counts(spark):
    """Shares of counts whose product with the scale leaves 64 bits."""
    from pyspark.sql import functions as F

    n, total, terms = 9_000_000_000_000, 30_000_000_000_000, 5_000_000
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
