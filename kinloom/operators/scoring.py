"""Scores of text pairs by a model that a caller plugs in, and what follows from them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.dataset import decode_label, preview
from kinloom.operators.evaluate import class_report, classification, correct, error_summary
from kinloom.operators.graph import materialize
from kinloom.sources import tables as io

#: Two logits a text; made once a task by a factory, which is where a model is loaded.
Scorer = Callable[[list[str]], np.ndarray]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def word_overlap() -> Scorer:
    """A stand-in without a model: the share of words that the two records of a prompt have in common, as logits."""

    def judge(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            a, _, b = t.partition("\n\nRecord B:\n")
            a, b = set(a.split()), set(b.split())
            out[i, 1] = 8 * (len(a & b) / max(1, len(a | b)) - 0.5)
        return out

    return judge


def score_texts(df: DataFrame, make_scorer: Callable[[], Scorer], text: str = "text", batch: int = 64) -> DataFrame:
    """df without its text, with prediction (the likelier class) and confidence (its probability, four places). Texts go to the scorer in batches; a null text is empty."""
    schema = df.withColumns({"prediction": F.lit(0), "confidence": F.lit(0.0)}).drop(text).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            texts = ["" if t is None else t for t in frame[text]]
            p = [softmax(np.asarray(scorer(texts[i : i + batch]), np.float64)) for i in range(0, len(texts), batch)]
            p = np.concatenate(p) if p else np.zeros((0, 2))
            yield frame.drop(columns=[text]).assign(prediction=p.argmax(1).astype(np.int32), confidence=np.round(p.max(1, initial=0), 4))

    return df.mapInPandas(run, schema)


def evaluate_chat(chat: DataFrame, make_scorer: Callable[[], Scorer], batch: int = 64) -> dict[str, DataFrame]:
    """Chat rows (messages) scored and compared with their labels: rows (text preview, label, prediction, confidence, correct), metrics, report by class, errors."""
    rows = chat.select(F.col("messages")[0]["content"].alias("text"), preview(F.col("messages")[0]["content"]).alias("preview"), decode_label(F.col("messages")).alias("label"))
    scored = correct(score_texts(rows, make_scorer, batch=batch).withColumnRenamed("preview", "text"), "label", "prediction")
    return {"rows": scored, "metrics": classification(scored, "label", "prediction"), "classes": class_report(scored, "label", "prediction"), "errors": error_summary(scored, "label", "prediction", "confidence")}


def throughput(examples: int, seconds: float, batch: int) -> dict:
    return {"examples": examples, "elapsed_seconds": round(seconds, 2), "throughput": round(examples / seconds, 2) if seconds else 0.0, "batch_size": batch}


#: Texts of one committed batch of a scoring job, about.
JOB_BATCH = 50_000


def score_job(texts: DataFrame, out: str, make_scorer: Callable[[], Scorer], keys: tuple[str, ...] = ("record_id_1", "record_id_2"), text: str = "text", batch: int = 64, rows: int = JOB_BATCH, most: int | None = None) -> DataFrame:
    """Scores texts as a job that may be stopped and started again: keys, prediction, confidence of all of them, from out.

    Texts are dealt by a hash of their keys to batches, and each batch is scored by all executors and written to its own folder; Spark's
    commit is what says that it is done. A run begins with the keys of all committed batches and scores only texts that are not among them, so a lost run
    repeats no more than the batch it was in, and texts that have come since are scored too. A text whose keys stand repeatedly is scored once.
    most batches are scored at most, if given, so that a job may be done in parts.
    """
    spark = texts.sparkSession
    keys = list(keys)
    done = _scored(spark, out, texts, keys)
    left = texts.dropDuplicates(keys)
    if done is not None:
        left = left.join(done.select(*keys), keys, "left_anti")
    left = materialize(left.select(*keys, text))
    batches = -(-left.count() // rows)
    first = 1 + max([int(re.search(r"batch_(\d+)$", p)[1]) for p in io._paths(spark, f"{out}/batch_*")] or [0])
    at = F.pmod(F.xxhash64(*keys), F.lit(max(1, batches)))
    for k in range(batches if most is None else min(batches, most)):
        score_texts(left.where(at == k), make_scorer, text, batch).write.parquet(f"{out}/batch_{first + k:06d}")
    found = _scored(spark, out, texts, keys)
    return left.select(*keys, F.lit(0).alias("prediction"), F.lit(0.0).alias("confidence")).where("false") if found is None else found


def _scored(spark: SparkSession, out: str, texts: DataFrame, keys: list[str]) -> DataFrame | None:
    """What committed batches hold. A folder without Spark's mark of success is of a run that was lost."""
    marks = [p.removesuffix("/_SUCCESS") for p in io._paths(spark, f"{out}/batch_*/_SUCCESS")]
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "prediction int", "confidence double"])
    return spark.read.schema(schema).parquet(*marks) if marks else None


def _versions(spark: SparkSession, registry: str) -> list[dict]:
    """A registry's versions in order, each with its metrics and the champion that stood when it was added."""
    paths = [p for p in io._paths(spark, f"{registry}/version_*.json") if re.search(r"version_\d+\.json$", p)]
    return [json.loads(io.read_text(spark, p)) for p in paths]


def champion(spark: SparkSession, registry: str) -> dict | None:
    """The model that the registry's last version names, None in an empty registry."""
    known = _versions(spark, registry)
    return known[known[-1]["champion"] - 1] if known else None


def promote(challenger: dict, registry: str, metric: str = "eval_f1") -> dict:
    """Adds a model's metrics (eval_*) to a registry folder and makes it the champion if there is none or it is as good: the decision.

    Each version is a file of its own, version_000001.json and so on, that names the champion from then on. A version is made only if its file is not there; a run
    that comes second to a number reads what the first has decided and judges anew. So runs at the same time add all their versions and leave one champion.
    """
    spark = SparkSession.active()
    while True:
        known = _versions(spark, registry)
        version, old = len(known) + 1, known[-1]["champion"] if known else None
        best = None if old is None else float(known[old - 1]["metrics"][metric])
        promoted = best is None or float(challenger[metric]) >= best
        entry = {"version": version, "metrics": {k: v for k, v in challenger.items() if k.startswith("eval_")}, "champion": version if promoted else old}
        if io.create_text(spark, f"{registry}/version_{version:06d}.json", json.dumps(entry, indent=2) + "\n"):
            return {"promoted": promoted, "challenger": float(challenger[metric]), "champion": best, "model_version": version, "champion_version": old}
