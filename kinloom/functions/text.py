"""Column expressions for names, codes and dates, and string similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formal first names and the nickname each is swapped for.
NICKNAME = {
    "WILLIAM": "BILL", "ROBERT": "BOB", "RICHARD": "DICK", "JAMES": "JIM", "JOHN": "JACK", "MICHAEL": "MIKE", "DAVID": "DAVE", "JOSEPH": "JOE",
    "THOMAS": "TOM", "CHARLES": "CHUCK", "CHRISTOPHER": "CHRIS", "DANIEL": "DAN", "MATTHEW": "MATT", "ANTHONY": "TONY", "DONALD": "DON", "KENNETH": "KEN",
    "STEVEN": "STEVE", "EDWARD": "ED", "TIMOTHY": "TIM", "JEFFREY": "JEFF", "NICHOLAS": "NICK", "JONATHAN": "JON", "BENJAMIN": "BEN", "SAMUEL": "SAM",
    "ALEXANDER": "ALEX", "ANDREW": "ANDY", "JOSHUA": "JOSH", "ELIZABETH": "LIZ", "PATRICIA": "PAT", "JENNIFER": "JENNY", "LINDA": "LYNN", "BARBARA": "BARB",
    "SUSAN": "SUE", "JESSICA": "JESS", "MARGARET": "PEGGY", "SARAH": "SALLY", "KIMBERLY": "KIM", "DEBORAH": "DEB", "REBECCA": "BECKY", "STEPHANIE": "STEPH",
    "CATHERINE": "CATHY", "CHRISTINE": "CHRIS", "SAMANTHA": "SAM", "AMANDA": "MANDY", "MELISSA": "MEL", "MICHELLE": "SHELLY", "KATHLEEN": "KATHY", "DOROTHY": "DOT",
}
#: The formal name of a nickname; the first that has it.
CANONICAL = {v: k for k, v in reversed(NICKNAME.items())}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title_case(c: Column) -> Column:
    """The first letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def is_title(c: Column) -> Column:
    return (c == title_case(c)) & c.rlike(r"\p{L}")


def zero_fill(c: Column, width: int) -> Column:
    """Zeros on the left up to width; longer values stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(trim(F.regexp_replace(c, r"\d", "")), r"\s+", " ")


def blank_to_null(c: Column, *sentinels: str) -> Column:
    return F.when(~F.trim(c).isin("", *sentinels), c)


def canonical_first_name(c: Column) -> Column:
    name = F.upper(trim(c))
    return F.coalesce(_lookup(CANONICAL, name), name)


def nickname(c: Column) -> Column:
    """The nickname of a formal name; other values as they are."""
    return F.coalesce(_lookup(NICKNAME, F.trim(F.regexp_replace(F.upper(F.trim(c)), r"\d+", ""))), c)


def sound_key(c: Column) -> Column:
    """Soundex; null, not empty, for missing names, so that they do not block together."""
    return F.soundex(blank_to_null(c))


#: Cells of the character tables that are compared at once.
CELLS = 4_000_000


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values, a row each, and their lengths."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    table = np.zeros((len(values), max(1, int(size.max(initial=0)))), np.uint8)
    table[np.arange(table.shape[1]) < size[:, None]] = np.frombuffer(b"".join(values), np.uint8)
    return table, size


def jaro_winkler_bytes(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Similarities of pairs of bytes, with the prefix bonus above 0.7 only; 0 for two empty strings. All pairs of like length advance together, a character a step."""
    out = np.zeros(len(a))
    if not len(a):
        return out
    longest = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b)), np.int64, len(a))
    order = np.argsort(longest, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (longest[order[j]] <= longest[order[i]] + 4) and (j - i) * (longest[order[j]] + 1) < CELLS:
            j += 1
        rows = order[i:j]
        out[rows] = _jaro_winkler_tables(*_table([a[k] for k in rows]), *_table([b[k] for k in rows]))
        i = j
    return out


def _jaro_winkler_tables(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n = len(a)
    rows, at = np.arange(n), np.arange(b.shape[1])
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free = at < lb[:, None]
    mine = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fits = free & (b == a[:, i : i + 1]) & (np.abs(at - i) <= reach[:, None])
        first = fits.argmax(1)
        hit = fits[rows, first] & (i < la)
        mine[hit, i] = True
        free[rows[hit], first[hit]] = False
    theirs = (at < lb[:, None]) & ~free
    m = mine.sum(1)
    width = int(m.max(initial=0))
    left, right = (np.take_along_axis(x, np.argsort(~taken, axis=1, kind="stable"), 1)[:, :width] for x, taken in ((a, mine), (b, theirs)))
    swaps = ((left != right) & (np.arange(width) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    same = np.zeros((n, 4), bool)
    k = min(4, a.shape[1], b.shape[1])
    same[:, :k] = (a[:, :k] == b[:, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(1)
    equal = (la == lb) & (la > 0)
    k = min(a.shape[1], b.shape[1])
    equal &= ((a[:, :k] == b[:, :k]) | (np.arange(k) >= la[:, None])).all(1)
    return np.where(equal, 1.0, np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro))


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Distinct pairs of a batch are scored once."""
    out = pd.Series(np.nan, index=left.index, dtype="float64")
    known = left.notna() & right.notna()
    pairs = pd.DataFrame({"l": left[known], "r": right[known]})
    if len(pairs):
        single = pairs.drop_duplicates()
        single = single.assign(s=jaro_winkler_bytes([x.encode() for x in single["l"]], [x.encode() for x in single["r"]]))
        out[known] = pairs.merge(single, on=["l", "r"], how="left")["s"].to_numpy()
    return out.astype("Float64").where(known)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)


#: Bytes that are counted together: letters of either case by their frequency in names, digits, and all else.
LETTER_GROUPS = ("aA", "eE", "iI", "oO", "nN", "rR", "lL", "sS", "tT", "dDuU", "mMhH", "cCkKgG", "bBpPvVwWfF", "yYjJzZxXqQ", "0123456789")
#: The largest count of a group that is kept; texts with more have no counts, and say nothing.
FULL = 14


def letter_counts(c: Column) -> Column:
    """How often each group's bytes occur, four bits a group in one long, the last for all other bytes; -1 if a group has more than FULL. Null for null."""
    size = F.octet_length(c)
    counts = [size - F.octet_length(F.translate(c, group, "")) for group in LETTER_GROUPS]
    counts.append(F.octet_length(F.translate(c, "".join(LETTER_GROUPS), "")))
    packed = counts[0].cast("long")
    for i, n in enumerate(counts[1:], 1):
        packed = packed + F.shiftleft(n.cast("long"), 4 * i)
    return F.when(F.greatest(*counts) > FULL, F.lit(-1).cast("long")).otherwise(packed)


def common_letters(letters_a: Column, letters_b: Column) -> Column:
    """At most so many bytes of two texts match, from their letter_counts; null where one of these says nothing."""
    out = None
    for i in range(len(LETTER_GROUPS) + 1):
        x, y = (F.shiftrightunsigned(h, 4 * i).bitwiseAND(F.lit(15).cast("long")) for h in (letters_a, letters_b))
        out = F.least(x, y) if out is None else out + F.least(x, y)
    return F.when((letters_a >= 0) & (letters_b >= 0), out)


def jaro_bound(a: Column, b: Column, common: Column) -> Column:
    """No less than the Jaro similarity, from lengths and common_letters: matching bytes are at most those in common, and none of them is out of order at best."""
    la, lb = F.octet_length(a), F.octet_length(b)
    m = F.coalesce(common, F.least(la, lb))
    return F.when((m == 0) | (la == 0) | (lb == 0), 0.0).otherwise((m / la + m / lb + 1) / 3)


def winkler_bound(a: Column, b: Column, jaro: Column) -> Column:
    """No less than the Jaro-Winkler similarity, from a bound of Jaro's, with which it grows, and the texts' first bytes."""
    prefix = F.when((F.length(a) != F.octet_length(a)) | (F.length(b) != F.octet_length(b)), 4)  # bytes of a letter may agree where letters do not
    for k in (4, 3, 2, 1):
        prefix = prefix.when(F.left(a, F.lit(k)) == F.left(b, F.lit(k)), k)
    return F.when(jaro > 0.7 - 1e-9, jaro + prefix.otherwise(0) * 0.1 * (1 - jaro)).otherwise(jaro)


#: A group's bytes are counted up to so many, a bit each; three groups' worth of letters, digits and blanks fill two longs.
UNARY = 3
_GROUP = np.full(256, -1, np.int64)
for _i, _bytes in enumerate([bytes([65 + i, 97 + i]) for i in range(26)] + [bytes([48 + i]) for i in range(10)] + [b" "]):
    _GROUP[list(_bytes)] = _i
_HINTS = T.StructType([T.StructField(k, T.LongType()) for k in ("low", "high", "size")])


@F.pandas_udf(_HINTS)
def letter_hints(values: pd.Series) -> pd.DataFrame:
    """What similar_reach reads of a text: low, high (letters in unary, so that the bits of two texts in common are the bytes in common) and size (first byte, bytes, bytes that have no bit). Null for null and texts of 65,536 bytes or more."""
    raw = [None if x is None or len(x) > 65_535 or len(x.encode()) > 65_535 else x.encode() for x in values]
    known = np.flatnonzero([x is not None for x in raw])
    out = np.zeros((3, len(raw)), np.int64)
    for i in range(0, len(known), 100):
        where = known[i : i + 100]
        table, size = _table([raw[k] for k in where])
        rows, counts = np.arange(len(where)), np.zeros((len(where), 37), np.int64)
        for j in range(table.shape[1]):
            group = np.where(j < size, _GROUP[table[:, j]], -1)
            counts[rows[group >= 0], group[group >= 0]] += 1
        kept = np.minimum(counts, UNARY)
        for g in range(37):
            out[g // 19, where] |= ((1 << kept[:, g]) - 1) << (UNARY * (g % 19))
        out[2, where] = (table[:, 0].astype(np.int64) << 32) | (size << 16) | (size - kept.sum(1))
    missing = np.array([x is None for x in raw], bool)
    return pd.DataFrame({k: pd.array(x, dtype="Int64") for k, x in zip(("low", "high", "size"), out)}).mask(pd.Series(missing))


def similar_reach(low: tuple[Column, Column], high: tuple[Column, Column], size: tuple[Column, Column], threshold: float) -> Column:
    """Whether the Jaro-Winkler similarity of two texts can be threshold or more, from their letter_hints; true where these are null. Matching bytes are at most those in common, and the first four letters agree at best if the first bytes do."""
    n = [F.shiftright(x, 16).bitwiseAND(F.lit(65_535).cast("long")) for x in size]
    rest = [x.bitwiseAND(F.lit(65_535).cast("long")) for x in size]
    common = F.bit_count(low[0].bitwiseAND(low[1])) + F.bit_count(high[0].bitwiseAND(high[1])) + F.least(*rest)
    # (m / la + m / lb + 1) / 3 >= jaro, the least that the bonus for a prefix can raise to the threshold
    least = [3 * max((threshold - 0.1 * k) / (1 - 0.1 * k), min(threshold, 0.7)) - 1 - 1e-9 for k in (0, 4)]
    need = F.when(F.shiftright(size[0].bitwiseXOR(size[1]), 32) == 0, least[1]).otherwise(least[0])
    return F.coalesce(common * (n[0] + n[1]) >= need * n[0] * n[1], F.lit(True))


def date_digits(c: Column) -> Column:
    """The low four bits of ten characters, packed; null for texts of another length."""
    packed = None
    for i in range(10):
        own = F.shiftleft(F.ascii(F.substring(c, i + 1, 1)).cast("long").bitwiseAND(F.lit(15).cast("long")), 4 * i)
        packed = own if packed is None else packed.bitwiseOR(own)
    return F.when(F.length(c) == 10, packed)


def one_edit_reach(a: Column, b: Column) -> Column:
    """Whether one_edit_date can hold, from date_digits: two characters differ at most."""
    x = a.bitwiseXOR(b)
    for k in (1, 2):  # each four bits' lowest one is set if any of them is
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111).cast("long"))) <= 2


def edit_distances(a: list[bytes], b: list[bytes], most: int | None = None) -> np.ndarray:
    """Damerau-Levenshtein distances (insertions, deletions, substitutions and swaps of neighbours, which later edits may part) of pairs of bytes, but most + 1 for any that exceed most.

    All pairs of like length advance together, a cell of the table a step. With most, only the band of cells within most of the diagonal is
    made: all others are beyond it, and so is every way through them.
    """
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(max(len(x), len(y)), min(len(x), len(y))) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    near = np.ones(len(a), bool)
    if most is not None:
        near = sizes[:, 0] - sizes[:, 1] <= most
        out[~near] = most + 1
    order = np.flatnonzero(near)
    order = order[np.lexsort((sizes[order, 1], sizes[order, 0]))]
    i = 0
    while i < len(order):
        band = 2 * int(sizes[order[i], 0]) + 9 if most is None else 2 * most + 1
        each = (int(sizes[order[i], 0]) + 9) * band + 256
        j = i + 1
        while j < len(order) and sizes[order[j], 0] <= sizes[order[i], 0] + 4 and (j - i) * each < CELLS:
            j += 1
        rows = order[i:j]
        out[rows] = _edit_tables(*_table([a[k] for k in rows]), *_table([b[k] for k in rows]), most)
        i = j
    return out


def _edit_tables(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, most: int | None) -> np.ndarray:
    n, rows = len(a), np.arange(len(a))
    na, nb = int(la.max()), int(lb.max())
    k = max(na, nb) if most is None else most
    far = k + 1
    # cell (i, j), both from 0, is at [i, j - i + k]; rows before the first letter's last place are far
    d = np.full((na + 1, 2 * k + 1, n), far, np.int32)
    for j in range(min(k, nb) + 1):
        d[0, j + k] = j
    last_row = np.zeros((256, n), np.int32)  # where each byte was last in a
    for i in range(1, na + 1):
        if i <= k:
            d[i, k - i] = i
        last_column = np.zeros(n, np.int32)  # where a's byte was last in b
        letter = a[:, i - 1]
        for j in range(max(1, i - k), min(nb, i + k) + 1):
            at = j - i + k
            same = letter == b[:, j - 1]
            best = d[i - 1, at] + ~same  # substitution
            if at > 0:
                best = np.minimum(best, d[i, at - 1] + 1)
            if at < 2 * k:
                best = np.minimum(best, d[i - 1, at + 1] + 1)
            i1, j1 = last_row[b[:, j - 1], rows], last_column
            swap = (i1 > 0) & (j1 > 0) & (np.abs(j1 - i1) <= k)
            if swap.any():
                before = d[np.maximum(i1 - 1, 0), np.clip(j1 - i1 + k, 0, 2 * k), rows]
                best = np.minimum(best, np.where(swap, before + (i - i1 - 1) + 1 + (j - j1 - 1), far))
            d[i, at] = np.minimum(best, far)
            last_column = np.where(same, j, last_column).astype(np.int32)
        last_row[letter, rows] = np.where(i <= la, i, last_row[letter, rows])
    return d[la, np.clip(lb - la + k, 0, 2 * k), rows].astype(np.int64)


def _edits(most: int | None):
    @F.pandas_udf(T.IntegerType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        """Distinct pairs of a batch are compared once."""
        known = left.notna() & right.notna()
        out = pd.Series(pd.NA, index=left.index, dtype="Int32")
        pairs = pd.DataFrame({"l": left[known], "r": right[known]})
        if len(pairs):
            single = pairs.drop_duplicates()
            single = single.assign(s=edit_distances([x.encode() for x in single["l"]], [x.encode() for x in single["r"]], most))
            out[known] = pairs.merge(single, on=["l", "r"], how="left")["s"].to_numpy()
        return out

    return run


def damerau_levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """The distance in bytes, or with most, most + 1 for any larger one. Equal texts, and lengths too far apart, are decided before the Python worker. Null for null."""
    la, lb = F.octet_length(a), F.octet_length(b)
    if most is None:
        return F.when(a == b, 0).otherwise(_edits(None)(a, b))
    open_ = (a != b) & (F.abs(la - lb) <= most)
    return F.when(a == b, 0).when(F.abs(la - lb) > most, most + 1).otherwise(_edits(most)(F.when(open_, a), F.when(open_, b)))


def one_edit_date(a: Column, b: Column) -> Column:
    """Whether two yyyy-MM-dd strings differ by one digit or one swap of neighbours (Damerau-Levenshtein of at most 1 at equal length)."""
    at = F.sequence(F.lit(1), F.lit(10))
    differ = F.filter(at, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i, j = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    one = lambda s, k: F.substr(s, k, F.lit(1))
    swapped = (F.size(differ) == 2) & (j == i + 1) & (one(a, i) == one(b, j)) & (one(a, j) == one(b, i))
    return (F.length(a) == 10) & (F.length(b) == 10) & ((F.size(differ) <= 1) | swapped)


def parse_date(c: Column) -> Column:
    """A date from ISO text with or without a time; null if it is none."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")
