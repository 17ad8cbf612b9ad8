"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the lower-cased text with all but letters as spaces, as square roots of shares
(length 1). Both steps are linear support vector machines (squared hinge, L2), learned on the driver from a bounded
sample of labelled rows: SAMPLE_ROWS rows over all languages, in equal parts as far as they go, at least one row a language
however many there are. Prediction reads every whole text on the executors.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be
learned; rows with equal ids are predicted one by one; a null id counts as the empty string in the held-out rule, which
makes it held out; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import stored
from textloom.llm.tok import forget

FEATURES = 2048
SAMPLE_ROWS = 4800
SAMPLE_EACH = 1200
UNKNOWN = "und"
#: Draws are whole numbers below this.
SPACE = 1 << 40
LETTER = re.compile(r"[^\W\d_]")
#: Families by ISO 639-1 code (fixed values); a language of none of them is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi mr ne sa bn gu pa ur or as",
    "finnic": "fi et",
    "baltic": "lt lv",
    "turkic": "tr az kk uz tk ky",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_KEEP = np.full(256, 32, np.uint32)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], f"other-{lang}")


def features(text: str) -> np.ndarray:
    b = _KEEP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    keys = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[b[1:-1] != 32]
    counts = np.bincount((keys * np.uint32(2654435761)) >> np.uint32(21), minlength=FEATURES)
    return np.sqrt(counts / max(1, len(keys))).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 250) -> np.ndarray:
    """Weights and bias (for the last column of x, which is 1) that minimise |w|^2 / 2 + c * mean squared hinge; y is -1 or 1, both sides weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = z = np.zeros(x.shape[1], x.dtype)
    step, t = 1 / (1 + 2 * c * 2.0), 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * c * (x.T @ (share * y * gap)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


@dataclass
class Model:
    """One SVM for each family against the rest, and one for each pair of languages of a family."""

    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    of_family: np.ndarray | None = None
    of_pair: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNKNOWN, 0.0
        x = np.append(x, np.float32(1))
        score = 1.0
        k = 0
        if len(self.families) > 1:
            margins = self.of_family @ x
            k = int(margins.argmax())
            score = _sure(margins[k] - np.delete(margins, k).max())
        langs = self.langs[self.families[k]]
        if len(langs) == 1:
            return langs[0], score
        votes, sums = np.zeros(len(langs)), np.zeros(len(langs))
        for (i, j), m in zip(combinations(range(len(langs)), 2), self.of_pair[self.families[k]] @ x, strict=True):
            votes[i if m > 0 else j] += 1
            sums[i] += np.tanh(m)
            sums[j] -= np.tanh(m)
        best = int(np.lexsort((sums, votes))[-1])
        return langs[best], score * _sure(2 * sums[best] / (len(langs) - 1))


def _sure(gap: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(gap, -20, 20))))


def fit(x: np.ndarray, y: list[str]) -> Model:
    """The model of feature vectors with a last column of 1 and their languages."""
    by = np.array(y)
    langs = sorted(set(y))
    if not langs:
        return Model()
    families = sorted({family_of(v) for v in langs})
    within = {f: [v for v in langs if family_of(v) == f] for f in families}
    fam = np.array([family_of(v) for v in y])
    of_family = np.stack([fit_svm(x, np.where(fam == f, 1, -1).astype(x.dtype)) for f in families]) if len(families) > 1 else None
    of_pair = {}
    for f, ls in within.items():
        if len(ls) > 1:
            of_pair[f] = np.stack([fit_svm(x[m := (by == a) | (by == b)], np.where(by[m] == a, 1, -1).astype(x.dtype)) for a, b in combinations(ls, 2)])
    return Model(families, within, of_family, of_pair)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, each: int = SAMPLE_EACH) -> DataFrame:
    """About ``each`` labelled rows a language, about ``rows`` in all, drawn by a hash of id and text: no sort, no shuffle of texts.

    Of every language the row with the least draw is taken in any case, so none is left out.
    """
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(SPACE))
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang", draw.alias("draw"))
    counts = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first")), "languages")
    each = min(each, max(1, rows // max(1, counts.count())))
    bounds = counts.select("lang", F.greatest("first", F.floor(F.lit(SPACE) * F.least(F.lit(1.0), each / F.col("n")))).alias("bound"))
    return labelled.join(F.broadcast(bounds), "lang").filter("draw <= bound").select("text", "lang")


def train(docs: DataFrame, **bounds: int) -> Model:
    """Fit on the bounded sample; features are made on the executors, the driver gets one vector a row."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang.as_py(), features(text.as_py()).tobytes()) for text, lang in zip(b.column(0), b.column(1), strict=True) if LETTER.search(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in found], pa.string()), pa.array([v[1] for v in found], pa.binary())], names=["lang", "x"])

    rows = training_sample(docs, **bounds).mapInArrow(vectors, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["x"]))
    # One matrix, filled row by row: the driver holds the sample twice at most.
    x, langs = np.ones((len(rows), FEATURES + 1), np.float32), [r["lang"] for r in rows]
    for k, r in enumerate(rows):
        x[k, :-1] = np.frombuffer(r["x"], np.float32)
    del rows
    return fit(x, langs)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The predicted language and its score of every whole text, beside the columns of keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = shared.value
        for b in batches:
            found = [m.predict(features(t)) if (t := v.as_py()) and LETTER.search(t) else (UNKNOWN, 0.0) for v in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([v[0] for v in found], pa.string()), pa.array([v[1] for v in found], pa.float64())], names=names)

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{results[0]}` string, `{results[1]}` double"])
    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learned without the held-out ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language could be told; a missing label takes the predicted language."""
    found = predict(docs, train(docs), tuple(docs.columns), ("predicted__", "score__")).filter(F.col("predicted__") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "predicted__")).select(*docs.columns)
