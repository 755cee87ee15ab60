"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features are rates over the whole text: densities of a learned lexicon (words and word beginnings that toxic rows
use far more often than others), how often a lexicon word stands near a second-person pronoun, capitals, punctuation,
repetition, and spellings that hide a word (digits and signs among letters). The lexicon, the trees and the
calibration are fitted on a bounded sample of labelled rows (FIT_ROWS, by a hash of the id); the calibration uses rows
that the trees have not seen. Scoring reads every text whole.

Results in odd cases: null text counts as empty and is scored like any other; rows repeated with one id score alike;
a null label is not learned; without both labels in the sample every row gets the share of toxic rows (0 without any);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sosrank.llm.common import crc32_mod, give_back, ship, written

#: Labelled rows that lexicon, trees and calibration are fitted on, at most (in expectation).
FIT_ROWS = 30_000
#: Lexicon entries, the beginnings of words that are tried, and what an entry must reach.
LEXICON_SIZE, STEM_CHARS, MIN_SUPPORT, MIN_LIFT = 2_000, (3, 4, 5, 6, 7, 8), 0.006, 5.0
#: Words between a lexicon word and a second-person pronoun that count as near.
NEAR = 5
TREES, DEPTH, STEP = 24, 4, 0.25
#: Share of the uncalibrated score in the result, so that texts on one calibration step keep their order.
TIE_SHARE = 0.01
#: Words whose lexicon weight is remembered within a partition.
CACHE_WORDS = 100_000

SECOND_PERSON = frozenset(
    "you your yours yourself tu te toi ton vous votre vos du dich dir dein deine ihr euch euer ti tus usted ustedes"
    " vosotros vuestro".split())
FEATURES = ("hits", "hit_rate", "weight_rate", "max_weight", "strong_rate", "hits_near_you", "near_rate", "you_rate",
            "obfuscated_rate", "obfuscated_hits", "capital_rate", "shouted_rate", "bang_rate", "question_rate",
            "sign_rate", "repeat_rate", "log_words")

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[@$!*#0-9]+[^\W\d_]+")
_INSIDE = re.compile(r"[@$!*#0-9][^\W\d_]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_PLAIN = str.maketrans("013457@$!", "oieastasi", "*#")
_SIGNS = re.compile(r"[^\w\s]")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")


def tokens_of(word: str) -> list[str]:
    """The word and its beginnings (marked by a trailing star)."""
    return [word, *[f"{word[:k]}*" for k in STEM_CHARS if len(word) > k]]


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.cache = lexicon, {}

    def weight(self, word: str) -> float:
        w = self.cache.get(word)
        if w is None:
            w = max((self.lexicon.get(t, 0.0) for t in tokens_of(word)), default=0.0)
            if len(self.cache) < CACHE_WORDS:
                self.cache[word] = w
        return w

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = _WORD.findall(low)
        n, chars = max(len(words), 1), max(len(text), 1)
        weight = self.weight
        weights = list(map(weight, words))
        at = [i for i, w in enumerate(weights) if w]
        you = {i for i, w in enumerate(words) if w in SECOND_PERSON}
        near = sum(any(i + j in you for j in range(-NEAR, NEAR + 1)) for i in at) if you else 0
        mixed = _MIXED.findall(low) if _INSIDE.search(low) else []
        hidden = sum(bool(weight(m.translate(_PLAIN))) for m in mixed)
        capitals = sum(map(len, _CAPITALS.findall(text)))
        return [math.log1p(len(at)), len(at) / n, sum(weights) / n, max(weights, default=0.0),
                sum(w > 5 for w in weights) / n, math.log1p(near), near / n, len(you) / n, len(mixed) / n,
                float(hidden), capitals / chars, len(_SHOUTED.findall(text)) / n, text.count("!") / chars,
                text.count("?") / chars, len(_SIGNS.findall(text)) / chars, 1 - len(set(words)) / n, math.log1p(n)]


def features(rows: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """The other columns of ``rows`` and ``features`` (array of doubles); only texts go to the Python workers."""
    others = [c for c in rows.columns if c != text_col]
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = Featurizer(shared.value)
        for some in texts:
            yield pa.array([make(t.as_py()) for t in some], pa.list_(pa.float64()))
        del make, some
        give_back()

    # one call a row, wherever the result is used
    made = F.arrow_udf(run, ArrayType(DoubleType())).asNondeterministic()
    return rows.select(*others, made(F.col(text_col)).alias("features"))


def _token_counts(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(token, n): in how many texts each token occurs; only ``wanted`` tokens if given."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0):
                found = {t for w in set(_WORD.findall((text.as_py() or "").lower())) for t in tokens_of(w)}
                counts.update(found if keep is None else found & keep)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()),
                                              pa.array(counts.values(), pa.int64())], ["token", "n"])

    return texts.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Token -> log of its lift in toxic texts. First toxic texts alone give the candidates, which other texts test."""
    toxic, clean = sample.filter("toxic = 1"), sample.filter("toxic = 0")
    support = max(4, math.ceil(MIN_SUPPORT * n_toxic))
    candidates = (_token_counts(toxic, None).filter(F.col("n") >= support)
                  .orderBy(F.col("n").desc(), "token").limit(20 * size).collect())
    if not candidates:
        return {}
    seen = {r.token: r.n for r in _token_counts(clean, {r.token for r in candidates}).collect()}
    lifts = {}
    for r in candidates:
        lift = (r.n / n_toxic) / ((seen.get(r.token, 0) + 1) / (n_clean + 1))
        if lift >= MIN_LIFT:
            lifts[r.token] = (r.n * math.log(lift), math.log(lift))
    best = sorted(lifts, key=lambda t: (-lifts[t][0], t))[:size]
    return {t: lifts[t][1] for t in best}


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """The other columns of ``rows`` and ``score``."""
        others = [c for c in rows.columns if c != text_col]
        if self.trees is None:
            return rows.select(*others, F.lit(self.prior).alias("score"))
        return self.score_features(features(rows, self.lexicon, text_col)).select(*others, "score")

    def raw(self, featured: DataFrame) -> DataFrame:
        out = self.trees.transform(featured.withColumn("features", array_to_vector("features")))
        return out.withColumn("raw", vector_to_array("probability")[1])

    def score_features(self, featured: DataFrame) -> DataFrame:
        out = self.calibration.transform(self.raw(featured))
        return out.withColumn("score", F.col("calibrated") * (1 - TIE_SHARE) + F.col("raw") * TIE_SHARE)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, holdout: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows; ids for which ``holdout`` (a condition on ``doc_id``) holds are never learned from."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    if holdout is not None:
        known = known.filter(~holdout)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = known.count()
    million = 1_000_000
    share = min(million, million * fit_rows // max(rows, 1))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(million)) < share)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # about fit_rows ids that have a label, with all rows of each
    sample = written(texts.join(F.broadcast(chosen), "doc_id"), "toxic-sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    prior = n_toxic / max(n_toxic + n_clean, 1)
    if not (n_toxic and n_clean):
        return Model({}, None, None, prior)
    lexicon = learn_lexicon(sample, n_toxic, n_clean)
    featured = written(features(sample, lexicon), "toxic-features")
    part = crc32_mod("doc_id", 20)
    learn = featured.filter(part % 4 != 3).withColumn("features", array_to_vector("features"))
    hold = featured.filter(part % 4 == 3)
    if learn.select("toxic").distinct().count() < 2 or hold.limit(1).count() == 0:
        return Model({}, None, None, prior)
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP,
                          maxBins=64, minInstancesPerNode=8, seed=11, cacheNodeIds=False).fit(learn)
    model = Model(lexicon, trees, None, prior)
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="calibrated")
    model.calibration = isotonic.fit(model.raw(hold).select("raw", F.col("toxic").cast("double").alias("toxic")))
    return model


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; ids with crc32 mod 5 = 0 are held out."""
    held = crc32_mod("doc_id", 5) == 0
    model = fit(docs, labels, holdout=held)
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return model.score(rows).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
