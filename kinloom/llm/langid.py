"""Language identification by words first, then by character n-grams.

A known word adds its log frequency in each language. An unseen word falls back
to its n-grams, the longest order of which any is known, from ``LONGEST`` down to
single characters; a word without any known n-gram adds nothing. The language
with the largest sum wins, and the score is its share of the posterior.

The model is fitted on a sample of labelled documents: by a hash of the id, at a
rate that makes about ``FIT_DOCS`` documents of each language, so a language
with a third of all rows weighs no more than the rest. All languages, and all
words and n-grams of the sampled whole texts, are learned. N-grams are counted
once for each distinct word that has them, as unseen words resemble rare ones; so
scripts without spaces, where a run of text is one word, are learned as well.

A text that is null or has no letter is ``und`` with score 0, as is everything
if nothing was learned. Ties go to the language that sorts first. Null ids are
held out; rows with equal ids or texts are rows of their own and equal texts get
equal results; texts of any length are scored whole; further columns, whatever
their names, are not read, or kept as they are by the filter. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import filter_rows, held_out, map_arrow, release, texts_of

FIT_DOCS = 500
LONGEST = 4
#: Bytes of unseen words and of their scores that a task remembers; beyond that it starts anew.
REMEMBERED = 8 << 20
#: Rows of languages that are broadcast at most.
BROADCAST_LANGS = 100_000
UNDETERMINED = "und"

_LETTERLIKE = re.compile(r"[^\W\d_]")
#: Blanks all ASCII that is no letter; bytes of other characters stay.
_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Numerals such as one half or a raised two are no letters."""
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()


def grams_of(word: bytes, n: int) -> list[str]:
    padded = f" {word.decode('utf-8', 'replace')} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(padded[1:-1])


@dataclass
class LanguageModel:
    langs: list[str]
    words: dict[bytes, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    prior: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, dict[bytes, int]]) -> LanguageModel:
        """counts: of each language's words."""
        langs = sorted(counts)

        def scored(tables: list[dict]) -> tuple[dict, np.ndarray]:
            keys = {k: i for i, k in enumerate(sorted(set().union(*tables)))}
            c = np.zeros((len(keys), len(langs)), np.float32)
            for j, t in enumerate(tables):
                c[[keys[k] for k in t], j] = list(t.values())
            c += 0.3
            c /= c.sum(0)
            return keys, np.log(c)

        words, word_scores = scored([counts[x] for x in langs])
        grams: dict[str, int] = {}
        scores = [np.zeros((0, len(langs)), np.float32)]
        for n in range(1, LONGEST + 1):
            own, s = scored([Counter(g for w in counts[x] for g in grams_of(w, n)) for x in langs])
            before = sum(map(len, scores))
            grams.update((g, i + before) for g, i in own.items())
            scores.append(s)
        return cls(langs, words, word_scores, grams, np.concatenate(scores), np.zeros(len(langs)))


class Scorer:
    """Scores texts; remembers the words it has seen."""

    def __init__(self, model: LanguageModel):
        self.m = model
        k = len(model.langs)
        self.unseen: dict[bytes, int] = {}
        self.rows = np.zeros((1024, k), np.float32)
        self.most_rows, self.bytes = max(1024, REMEMBERED // (4 * max(1, k))), 0

    def _row(self, word: bytes) -> np.ndarray:
        get, k = self.m.grams.get, len(self.m.langs)
        for n in range(LONGEST, 0, -1):
            known = [i for i in map(get, grams_of(word, n)) if i is not None]
            if known:  # its n-grams overlap: n of them say about as much as one
                s = self.m.gram_scores[known].sum(0) / max(1, n)
                return s - s.max()
        return np.zeros(k, np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.m.langs or not text or not has_letter(text):
            return UNDETERMINED, 0.0
        words = words_of(text)
        counts = Counter(words)
        names = list(counts)
        at = np.fromiter(map(self.m.words.get, names, repeat(-1)), np.int64, len(names))
        times = np.fromiter(counts.values(), np.float64, len(names))
        seen = at >= 0
        total = self.m.prior + times[seen] @ self.m.word_scores[at[seen]]
        if not seen.all():
            rest = np.flatnonzero(~seen)
            own = np.empty(len(rest), np.int64)
            for j, i in enumerate(rest.tolist()):
                w = names[i]
                r = self.unseen.get(w)
                if r is None:
                    if self.bytes > REMEMBERED or len(self.unseen) >= self.most_rows:  # the words so far are summed up, then forgotten
                        total = total + times[rest[:j][own[:j] >= 0]] @ self.rows[own[:j][own[:j] >= 0]]
                        own[:j] = -1
                        self.unseen, self.bytes = {}, 0
                    r = self.unseen[w] = len(self.unseen)
                    self.bytes += len(w)
                    if r >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[r] = self._row(w)
                own[j] = r
            total = total + times[rest[own >= 0]] @ self.rows[own[own >= 0]]
        best = int(np.argmax(total))  # the first of equal ones
        return self.m.langs[best], float(1 / np.exp(total - total[best]).sum())


def _sampled(docs: DataFrame, per_lang: int) -> DataFrame:
    """About per_lang documents of each language, by a hash of the id."""
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("l"), "n")
    if counts.count() <= BROADCAST_LANGS:
        counts = F.broadcast(counts)
    part = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    return docs.join(counts, F.col("lang") == F.col("l")).where(part * F.col("n") < F.lit(per_lang * (1 << 30)))


def fit(docs: DataFrame, per_lang: int = FIT_DOCS) -> LanguageModel:
    """docs: doc_id, text, lang of the rows that may be learned from."""

    def count(batches):
        for batch in batches:
            tables: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                tables.setdefault(lang, Counter()).update(words_of(text))
            rows = [(x, w, n) for x, t in tables.items() for w, n in t.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.binary(), pa.int64()))], ["lang", "word", "n"])

    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = map_arrow(_sampled(rows, per_lang).select("lang", "text"), count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # the words of the sample
    counts: dict[str, dict[bytes, int]] = {}
    for batch in table.to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts.setdefault(lang, {})[word] = n
    del table
    model = LanguageModel.of(counts)
    del counts
    release()
    return model


def predict(docs: DataFrame, model: LanguageModel, held: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            out = [scorer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.5) -> DataFrame:
    """docs without those whose language is undetermined or less certain than least_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        scorer = Scorer(shared.value)
        return lambda texts: [x != UNDETERMINED and s >= least_score for x, s in map(scorer, texts)]

    return filter_rows(docs, judge)


def report(docs: DataFrame) -> DataFrame:
    """Learns from documents whose id's checksum leaves 0 or 2 by 3, predicts all."""
    held = held_out(F.col("doc_id"), 3, 1)
    return predict(docs, fit(docs.where(~held)), held)
