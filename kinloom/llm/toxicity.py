"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two words sums, over all subsequences of three and four symbols
that both hold within ``GAP`` skipped symbols, the product of their decayed
weights (decay to the power of the span), divided by a norm that depends on the
words' lengths. A skipped symbol costs little, so an insult with letters
inserted stays close to the insult; words carry a mark at either end, so stems
are told from chance syllables inside words. Punctuation inside a word is
dropped and single letters in a row are joined, so spelled-out insults are words
again. Subsequences are told apart by a hash of ``SLOT_BITS`` bits; two that share
a slot count as one, which at 2^20 slots and the some 10^5 that landmarks have
adds about one in ten of a subsequence's weight by chance, and a test holds the
kernel against one without hashing.

The machine is trained in the span of landmark words (Nyström): K_lm, whitened
by the landmarks' own kernel matrix, and a squared-hinge linear machine on that.
Because the decision is a sum over subsequences, it is unfolded into one weight
per subsequence and scored over a whole batch of texts at once.

A sentence is as toxic as its worst word, and a text as its worst sentence, so
what is compared are words. Labels are of documents: training is
multiple-instance. Every toxic document is stood for by the worst sentence's
worst word under the current machine, the others by the words nearest to insults
and random ones, and that is repeated ``ROUNDS`` times. A text's score comes from
its worst word, put through a steep curve around the cut with the fewest errors
on the training texts.

Fitted on a sample of labelled rows, chosen by a hash of the id: at most about
``FIT_TOXIC`` and ``FIT_CLEAN`` documents, whole, of which the driver receives the
distinct words. Scoring takes whole texts of any length. Null and empty texts get
the curve's value for no word at all. If a class is missing, every score is 0.
Equal texts get equal scores; a row labelled twice is used twice, a null id never
(it is held out); further columns, whatever their names, are not read, or kept
as they are by the filter. An empty table is scored to an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import filter_rows, held_out, map_arrow, release, texts_of

FIT_TOXIC = 1200
FIT_CLEAN = 2400
LANDMARKS = 768
#: Letters of a landmark at most.
LANDMARK_CHARS = 64
ROUNDS = 4
DECAY = 0.75
GAP = 2
ORDERS = (3, 4)
_PATTERNS = [(0, *c) for k in ORDERS for c in combinations(range(1, k + GAP), k - 1)]
_SPAN = np.array([p[-1] + 1 for p in _PATTERNS])
_WEIGHT = (DECAY ** _SPAN).astype(np.float32)
SLOT_BITS = 20
_EDGE = 0
#: Characters decided at once, and characters of words that a task remembers.
_PIECE = 1 << 18
REMEMBERED = 3 << 20
#: Words of a text that its score looks at.
WORST = 1
#: How often each insult that is sure from the start is also learned with a letter inserted.
VARIANTS = 24
SPELLED_SHARE = 0.05
#: A word of a toxic training text counts as an insult from the start if one of its pieces is 20 times as frequent in those and its log likelihood ratio exceeds the log of all pieces by this.
SURE = 2.0
#: Clean words nearest to the insults that a round adds at most.
VIOLATORS = 3000
#: Chosen by cross-validation in three folds of rows to learn from, among 0.02 to 0.4: it missed fewest toxic documents. SPELLED_SHARE was chosen on such rows too.
RIDGE = 0.05
_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S)+(?!\S)")
_PUNCTUATION = re.compile(r"[\W_]+")


def _symbols() -> np.ndarray:
    """Symbol by code point below 0x3000: 0 white space, 255 dropped, 1 to 63 letters and digits."""
    table = np.full(0x3000, 255, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isspace():
            table[c] = _EDGE
        elif "a" <= ch <= "z":
            table[c] = c - 96
        elif "0" <= ch <= "9":
            table[c] = 27 + c - 48
        elif ch.isalnum():
            table[c] = 37 + c % 27
    return table


_SYMBOL = _symbols()


def words_of(text: str) -> list[str]:
    """The words between white space, in lower case, and single letters in a row as one word more."""
    text = text.lower()
    return [*text.split(), *("".join(m[0].split()) for m in _SPELLED.finditer(text))]


def bare(word: str) -> str:
    return _PUNCTUATION.sub("", word)


def encode(words: list[str]) -> np.ndarray:
    """Words as symbols, with an edge before and after each; punctuation is dropped."""
    codes = np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _SYMBOL[np.minimum(codes, 0x2FFF)]
    far = codes >= 0x3000
    sym[far] = 37 + codes[far] % 27
    return sym[sym != 255]


def _slots(sym: np.ndarray) -> Iterator[np.ndarray]:
    """For every pattern, one at a time, the slot of the subsequence that begins at each place."""
    padded = np.concatenate([sym, np.zeros(8, sym.dtype)]).astype(np.uint32)
    n = len(sym)
    at = [padded[d : d + n] for d in range(max(p[-1] for p in _PATTERNS) + 1)]
    for p in _PATTERNS:
        key = at[0]
        for d in p[1:]:
            key = (key << np.uint32(6)) | at[d]
        key = (key ^ np.uint32(len(p) * 0x1234567)) * np.uint32(2654435761)
        yield key >> np.uint32(32 - SLOT_BITS)


def _norm(size: np.ndarray) -> np.ndarray:
    """About the root of a word's kernel with itself, if no subsequence repeats: by its letters."""
    total = np.zeros(len(size))
    for s, w in zip(_SPAN, _WEIGHT):
        total += np.maximum(size + 3 - s, 0) * float(w) ** 2
    return np.sqrt(np.maximum(total, 1e-9))


def decide(words: list[str], beta: np.ndarray) -> np.ndarray:
    """The decision, without bias, of each word; of one without letters, -2."""
    sym = encode(words)
    edges = np.flatnonzero(sym == _EDGE)
    first, size = edges[:-1], np.diff(edges) - 1
    room = np.repeat(edges[1:] + 1, size + 1) - np.arange(len(sym) - 1)  # symbols left in the word, its last edge included
    value = np.zeros(len(sym) - 1, np.float32)
    for slot, span, w in zip(_slots(sym), _SPAN, _WEIGHT):
        value += np.where(room >= span, beta[slot[:-1]], np.float32(0)) * w
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return np.where(size > 0, (total[edges[1:]] - total[first]) / _norm(size), -2.0)


@dataclass
class Machine:
    beta: np.ndarray | None
    bias: float
    slope: np.ndarray
    level: float
    known: dict[str, float] = field(default_factory=dict)
    chars: int = 0  # of known

    def _learn(self, words: set[str]) -> None:
        """Decides new words, in pieces of bounded size; long ones are not remembered for long."""
        piece, chars = [], 0
        self.chars += sum(map(len, words))
        for w in words:
            piece.append(w)
            chars += len(w) + 1
            if chars > _PIECE:
                self.known.update(zip(piece, decide(piece, self.beta).tolist()))
                piece, chars = [], 0
        if piece:
            self.known.update(zip(piece, decide(piece, self.beta).tolist()))

    def worst(self, texts: list[str]) -> np.ndarray:
        """The decisions of each text's WORST worst words, the worst first; -2 where there is no such word."""
        out = np.full((len(texts), WORST), -2.0)
        for i in range(0, len(texts), 64):
            some = [set(words_of(t)) for t in texts[i : i + 64]]
            if self.chars > REMEMBERED:  # before looking what is new, so that no word of these texts is lost
                self.known.clear()
                self.chars = 0
            self._learn(set().union(*some).difference(self.known))
            get = self.known.__getitem__
            for j, words in enumerate(some):
                top = nlargest(WORST, map(get, words)) if WORST > 1 else [max(map(get, words), default=-2.0)]
                out[i + j, : len(top)] = top
        return np.maximum(out + self.bias, -2.0)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.beta is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.worst(texts) @ self.slope + self.level, -30, 30)))


def _features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, slot and weight of the subsequences of each word (bare), normalised; a pattern at a time."""
    sym = encode(words)
    edges = np.flatnonzero(sym == _EDGE)
    size = np.diff(edges) - 1
    word = np.repeat(np.arange(len(size)), size + 1)
    room = np.repeat(edges[1:] + 1, size + 1) - np.arange(len(sym) - 1)
    norm = _norm(size)
    for slot, span, w in zip(_slots(sym), _SPAN, _WEIGHT):
        ok = np.flatnonzero(room >= span)
        yield word[ok], slot[ok].astype(np.int64), w / norm[word[ok]]


def _groups(words: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of so many characters, of one word at least."""
    begin = size = 0
    for i, w in enumerate(words):
        if i > begin and size + len(w) > chars:
            yield begin, i
            begin, size = i, 0
        size += len(w) + 2
    if begin < len(words):
        yield begin, len(words)


class Landmarks:
    """The landmarks' subsequences: by slot, which landmarks have it, and how much."""

    def __init__(self, words: list[str]):
        rows, cols, vals = (np.concatenate(x) for x in zip(*_features(words)))
        order = np.argsort(cols, kind="stable")
        self.slots, first = np.unique(cols[order], return_index=True)
        self.first = np.append(first, len(order))
        self.word, self.value, self.n = rows[order], vals[order], len(words)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Of words and landmarks."""
        out = np.zeros((len(words), self.n), np.float32)
        for i, j in _groups(words, 4000):
            own = out[i:j].reshape(-1)
            for rows, cols, vals in _features(words[i:j]):
                at = np.minimum(np.searchsorted(self.slots, cols), len(self.slots) - 1)
                hit = np.flatnonzero(self.slots[at] == cols)
                for some in np.array_split(hit, len(hit) // 20_000 + 1):
                    n = np.diff(self.first)[at[some]]
                    place = np.repeat(self.first[at[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    flat = np.repeat(rows[some], n) * self.n + self.word[place]
                    own += np.bincount(flat, weights=np.repeat(vals[some], n) * self.value[place], minlength=len(own)).astype(np.float32)
        return out

    def unfolded(self, alpha: np.ndarray) -> np.ndarray:
        """The weight of every slot, where the landmarks' are alpha."""
        beta = np.zeros(1 << SLOT_BITS, np.float32)
        beta[self.slots] = np.add.reduceat(self.value * alpha[self.word], self.first[:-1])
        return beta


def _solve(z: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, step: int = 512) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine of some rows of z, by Newton steps over the active ones, in blocks of rows that bound the memory."""
    w = np.zeros(z.shape[1] + 1)
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(30):
        left, right = np.diag(reg), np.zeros(len(w))
        for i in range(0, len(rows), step):
            some = z[rows[i : i + step]]
            x = np.hstack([some, np.ones((len(some), 1), z.dtype)]).astype(np.float64)
            own = y[i : i + step]
            on = own * (x @ w) < 1
            xa = x[on] * weight[i : i + step][on, None]
            left += xa.T @ x[on]
            right += xa.T @ own[on]
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def _inserted(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word of four letters or more with a letter inserted, VARIANTS times."""
    out = []
    for w in words:
        for _ in range(VARIANTS if len(w) >= 4 else 0):
            at = int(rng.integers(1, len(w)))
            out.append(w[:at] + chr(97 + int(rng.integers(26))) + w[at:])
    return out


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every five symbols in a row of each word with its edges, and where each word's begin."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    n = np.maximum(size - 4, 1)
    first = np.append(0, np.cumsum(n))
    at = np.repeat(np.cumsum(size) - size, n) + np.arange(first[-1]) - np.repeat(first[:-1], n)
    end = np.repeat(np.cumsum(size), n)
    key = np.zeros(len(at), np.uint64)
    for k in range(5):
        key = (key ^ np.where(at + k < end, codes[np.minimum(at + k, len(codes) - 1)] + np.uint64(1), np.uint64(0))) * _FACTOR
        key ^= key >> np.uint64(29)
    return key, first


def _telling(docs: list[np.ndarray], toxic: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A first guess at each word, how telling its most telling five symbols are, and whether it is surely an insult."""
    key, first = _pieces(words)
    _, piece = np.unique(key, return_inverse=True)
    del key
    counts = np.zeros((2, int(piece.max()) + 1), np.int64)  # of clean and toxic documents, by piece
    for own, k in zip(docs, toxic):
        n = np.diff(first)[own]
        place = np.repeat(first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        counts[int(k), np.unique(piece[place])] += 1
    n_good, n_bad = counts
    good, bad = np.bincount(toxic, minlength=2)
    telling = np.where(n_bad > 1, np.log((n_bad + 0.3) / bad) - np.log((n_good + 0.3) / good), -1.0)
    n, k, base = np.maximum(n_bad + n_good, 1), n_bad, bad / (bad + good)
    share = k / n
    likely = k * np.log(np.maximum(share, 1e-12) / base) + np.where(n > k, (n - k) * np.log(np.maximum(1 - share, 1e-12) / (1 - base)), 0.0)
    sure = (n_bad > 1) & (telling > 3) & (share > base) & (likely > np.log((n_bad > 0).sum()) + SURE)
    return np.maximum.reduceat(telling[piece], first[:-1]), np.logical_or.reduceat(sure[piece], first[:-1])


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine:
    return train_words([sorted(set(words_of(t))) for t in texts], toxic, landmarks, rounds)


def train_words(docs: list[list[str]], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine:
    """The machine, from documents' distinct words."""
    nothing = Machine(None, 0.0, np.zeros(WORST), 0.0)
    toxic = np.array(toxic, np.int64)
    clean_of: dict[str, str] = {}
    for own in docs:
        for w in own:
            if w not in clean_of:
                clean_of[w] = bare(w)
    words = sorted(set(clean_of.values()) - {""})
    number = {w: i for i, w in enumerate(words)}
    units = [np.unique(np.array([number[x] for x in map(clean_of.__getitem__, own) if x], np.int64)) for own in docs]
    del clean_of, number
    full = [i for i, u in enumerate(units) if len(u)]
    bad, good = ([units[i] for i in full if toxic[i] == k] for k in (1, 0))
    if not bad or not good:
        return nothing
    rng = np.random.default_rng(7)
    guess, is_sure = _telling([units[i] for i in full], toxic[full], words)
    top = lambda value, u: int(u[len(u) - 1 - np.argmax(value[u][::-1])])  # noqa: E731  the last of equal ones
    witness, hard = [top(guess, u) for u in bad], [top(guess, u) for u in good]
    sure = [int(i) for u in bad for i in u[is_sure[u]]]  # all insults of a text, not only the worst
    marks, seen = Counter([*witness, *sure]), Counter(np.concatenate(good).tolist())
    order = lambda c: sorted(c, key=lambda i: (-c[i], i))
    common, all_good = order(seen)[: landmarks // 8], np.array(sorted(seen))
    pick = lambda n: rng.choice(all_good, min(len(all_good), n), replace=False).tolist()
    chosen = dict.fromkeys([*order(marks)[: landmarks // 2], *common, *order(Counter(hard))[: landmarks // 8], *pick(landmarks // 4)])
    chosen = [i for i in chosen if len(words[i]) <= LANDMARK_CHARS][:landmarks] or list(chosen)[:1]
    near = Landmarks([words[i] for i in chosen])
    s, v = np.linalg.eigh(near.kernel([words[i] for i in chosen]).astype(np.float64))
    whiten = (v / np.sqrt(np.maximum(s, 1e-3 * s.max()))).astype(np.float32)
    negative = dict.fromkeys(words[i] for i in [*hard, *pick(4000), *common])
    spelled = _inserted([words[i] for i in order(Counter(sure))], rng)
    sure = [words[i] for i in sure]
    row: dict[str, int] = {}  # of a word in z
    z = np.zeros((0, near.n), np.float32)
    for turn in range(rounds):
        used = [*(words[i] for i in witness), *sure, *spelled, *negative]
        new = sorted(set(used) - row.keys())
        row |= {w: len(row) + i for i, w in enumerate(new)}
        z = np.concatenate([z, *(near.kernel(new[i : i + 500]) @ whiten for i in range(0, len(new), 500))])
        target = np.append(np.ones(len(used) - len(negative)), -np.ones(len(negative)))
        weight = np.where(target > 0, max(1.0, len(negative) / (target > 0).sum() / 4), 1.0)
        w, bias = _solve(z, np.array([row[x] for x in used]), target, weight, RIDGE)
        beta = near.unfolded(whiten @ w)
        value = np.concatenate([decide(words[i:j], beta) for i, j in _groups(words, 100_000)])
        if turn + 1 < rounds:
            witness = [top(value, u) for u in bad]
            close = all_good[value[all_good] + bias > -0.5]
            close = close[np.argsort(-value[close], kind="stable")]
            negative.update(dict.fromkeys(words[i] for i in close[:VIOLATORS]))
    worst = np.array([max(-2.0, value[u].max() + bias) if len(u) else max(-2.0, -2.0 + bias) for u in units])
    # words with a letter inserted count as toxic texts too, all of them as much as SPELLED_SHARE of the toxic documents
    extra = decide(spelled, beta) + bias if spelled else np.zeros(0)
    weight = np.append(np.ones(len(worst)), np.full(len(extra), SPELLED_SHARE * len(bad) / max(1, len(extra))))
    cut, slope = _cut(np.append(worst, extra), np.append(toxic, np.ones(len(extra), np.int64)), weight)
    return Machine(beta, bias, np.eye(WORST)[0] * slope, -slope * cut)


def _cut(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The middle of the widest range of cuts with the least weight of errors, and the slope of the curve around it."""
    order = np.argsort(score)
    s, t, w = score[order], y[order], weight[order]
    wrong = np.round(np.append(0, np.cumsum(t * w)) + np.append(np.cumsum(((1 - t) * w)[::-1])[::-1], 0), 6)  # below cut i all are clean
    low, high = np.append(s[0] - 1, s), np.append(s, s[-1] + 1)
    width = np.where(wrong == wrong.min(), high - low, -1)
    at = int(np.argmax(width))
    return float((low[at] + high[at]) / 2), 12.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """doc_id, text, label of about most[label] documents each, chosen by a hash of the id; docs and labels hold only rows to learn from."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(list(most))).select("doc_id", F.col(label).cast("int").alias("label"))
    there = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30))
    chosen = rows.where("false")
    for value, n in there.items():
        chosen = chosen.unionByName(rows.where((F.col("label") == value) & (part < int(min(1.0, most[value] / n) * (1 << 30)))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # most's rows


def fit(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> Machine:
    """docs and labels: the rows that may be learned from."""

    def run(batches):
        for batch in batches:
            words = [sorted(set(words_of(t))) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column("doc_id"), batch.column("label")], ["words", "doc_id", "label"])

    sample = labelled_sample(docs, labels, "toxic", {1: toxic, 0: clean}).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    rows = map_arrow(sample, run, "words array<string>, doc_id long, label int").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    order = sorted(range(rows.num_rows), key=lambda i: (rows["doc_id"][i].as_py(), rows["label"][i].as_py(), rows["words"][i].as_py()))  # rows of equal ids too
    held: dict[str, str] = {}  # one object a word
    docs_ = [[held.setdefault(w, w) for w in rows["words"][i].as_py()] for i in order]
    toxic_ = [rows["label"][i].as_py() for i in order]
    del rows, held
    machine = train_words(docs_, toxic_)
    del docs_
    release()
    return machine


def fresh(machine):
    """The machine without the words it remembers: a broadcast one outlives the task, and so would they."""
    return replace(machine, known={}, chars=0) if isinstance(machine, Machine) else machine


def score(docs: DataFrame, machine, held: Column, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        judge = fresh(shared.value)
        for batch in batches:
            s = np.asarray(judge(texts_of(batch)), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """docs without the toxic ones."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def judge():
        machine = fresh(shared.value)
        return lambda texts: machine(texts) < threshold

    return filter_rows(docs, judge)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from rows whose id's checksum is no multiple of 5, scores all documents."""
    held = held_out(F.col("doc_id"), 5, 0)
    return score(docs, fit(docs.where(~held), labels.where(~held)), held)
