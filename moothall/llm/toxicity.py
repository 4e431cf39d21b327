"""Operator 2, toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import CACHE, crc_mod, map_arrow, release, small_batches, table, texts

#: Seed words of abuse by kind, and second-person words, in English, German, French and Spanish.
SEED = {
    "insult": "idiot idiots stupid moron loser scum trash worthless pathetic disgusting dumb imbecile fool jerk clown ugly freak idiota idiote dumm dummkopf blöd trottel versager abschaum estúpido imbécil basura inútil asqueroso payaso connard débile nul ordure minable".split(),
    "profanity": "fuck fucking shit bitch bastard asshole damn crap scheiße arschloch mierda puta cabrón merde putain salope".split(),
    "threat": "kill die hurt murder destroy beat töten sterben schlagen matar morir tuer mourir crever".split(),
}
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
NEAR = 5
NAMES = ("insult", "profanity", "threat", "learned", "learned_weight", "learned_kinds", "hit_share", "second_person", "near_second_person", "capitals", "capital_words", "punctuation", "exclaims", "symbols", "digits", "obfuscated", "obfuscated_hits", "length")
FEATURES = "__toxicity_features"
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_MIXED = re.compile(rb"[a-z][@$!|*0-9._\-]{1,3}[a-z]")
_PLAIN = bytes.maketrans(b"@$!|013457", b"asiioieast")
#: Classes of bytes that the rates count: capitals, punctuation, '!' and '?', symbols, digits.
_CLASS = np.zeros((256, 5), np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (65 <= _b < 91, _c in ".,;:!?'\"()-", _c in "!?", _c in "#$%&*@^~|+=<>_", 48 <= _b < 58)


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


#: Lengths of word beginnings that may be learned as lexicon entries, written with a star.
STEMS = range(4, 9)


class _Known(dict):
    """Word to (kind of seed word or -1, learned weight, second person), or None for the most; starts again when it's full."""

    def __init__(self, learned: dict[str, float]) -> None:
        super().__init__()
        self.learned = learned
        self.seed = {w: k for k, ws in enumerate(SEED.values()) for w in ws}

    def __missing__(self, word: bytes):
        if len(self) >= 2 * CACHE:
            self.clear()
        w = word.decode("utf-8", "replace")
        weight = max([self.learned.get(w, 0.0), *(self.learned.get(f"{w[:k]}*", 0.0) for k in STEMS if len(w) > k)])
        kind, second = self.seed.get(w, -1), w in SECOND_PERSON
        out = self[word] = (kind, weight, second) if kind >= 0 or weight or second else None
        return out


def near_share(hits: list[int], second: list[int]) -> float:
    """Share of the hits with a second-person word within NEAR words; both lists of positions are sorted."""
    if not hits or not second:
        return 0.0
    x = np.array(hits)
    return float(np.mean(np.searchsorted(second, x + NEAR, "right") > np.searchsorted(second, x - NEAR, "left")))


class Features:
    """Dense features of a text, given the learned lexicon of words and word beginnings with their weights."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.known = _Known(learned)

    def of(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        low = (text or "").lower().encode("utf-8", "surrogatepass")
        w = _WORD.findall(low)
        n = max(1, len(w))
        known = self.known
        at = [(i, k) for i, x in enumerate(w) if (k := known[x])]
        second = [i for i, k in at if k[2]]
        hits = [i for i, k in at if k[0] >= 0 or k[1]]
        kinds = Counter(k[0] for _, k in at)
        weights = [k[1] for _, k in at if k[1]]
        near = near_share(hits, second)
        mixed = mixed_hits = end = hit = 0
        for m in _MIXED.finditer(low):
            mixed += 1
            if m.start() >= end:  # else in the token of the match before
                end = low.find(b" ", m.end())
                end = end if end >= 0 else len(low)
                token = low[low.rfind(b" ", 0, m.start()) + 1 : end].strip(b".,;:!?\"'()#%&\n\t")
                hit = any((k := known[x]) and (k[0] >= 0 or k[1] > 0) for x in (token.translate(_PLAIN), re.sub(rb"[*._\-]", b"", token)))
            mixed_hits += hit
        size = max(1, len(raw))
        rates = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / size
        shouted = sum(map(bytes.isupper, _WORD.findall(raw))) if rates[0] else 0
        return [
            *(kinds[k] / n for k in range(3)), len(weights) / n, sum(weights) / n, float(len({w[i] for i, k in at if k[1]})), math.log1p(len(hits)), len(second) / n, near,
            float(rates[0]), shouted / n, *map(float, rates[1:]), mixed / n, mixed_hits / n, math.log1p(len(w)),
        ]


@dataclass
class ToxicityModel:
    """What scores texts: the learned lexicon, the trees and the calibration; or only a rate, where labels have one class or none."""

    lexicon: Broadcast
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def with_features(docs: DataFrame, lexicon: Broadcast, text_col: str = "text") -> DataFrame:
    """docs with a column of dense features; each text is read whole, alone."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(FEATURES, ArrayType(DoubleType()))])

    def run(batches):
        features = Features(lexicon.value)
        for b in batches:
            f = pa.array([features.of(t) for t in texts(b.column(at))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, f], names=[*b.schema.names, FEATURES])
        release()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _fold(folds: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int")


def learn_lexica(sample: DataFrame, folds: int, size: int = 500) -> list[dict[str, float]]:
    """The words and word beginnings most telling of label 1, with their log odds: by all rows (id, text, label), then by the rows outside each fold. All are sums of one count."""
    names = [f"c{k}" for k in range(2 * folds)]

    def count(batches):
        seen: dict[str, list[int]] = {}

        def hand_on() -> dict:
            return {"w": list(seen), **{c: [x[k] for x in seen.values()] for k, c in enumerate(names)}}

        for b in batches:
            for t, y, f in zip(texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = {w.decode("utf-8", "replace") for w in words(t)}
                for w in own | {f"{w[:k]}*" for w in own for k in STEMS if len(w) > k}:
                    if (c := seen.get(w)) is None:
                        c = seen[w] = [0] * len(names)
                    c[2 * f + (y == 1)] += 1
                if len(seen) > CACHE:
                    yield hand_on()
                    seen.clear()
        yield hand_on()

    rows = {(r["f"], r["label"] == 1): r["n"] for r in sample.groupBy(_fold(folds).alias("f"), "label").agg(F.count("*").alias("n")).collect()}
    counted = map_arrow(sample.select("text", "label", _fold(folds).alias("f")), count, "w string, " + ", ".join(f"{c} int" for c in names)).groupBy("w").agg(*(F.sum(c).alias(c) for c in names))
    common = counted.where(" + ".join(names[1::2]) + " >= 3").persist()
    out = []
    for without in (None, *range(folds)):
        n0, n1 = (sum(n for (f, y), n in rows.items() if y == label and f != without) for label in (False, True))
        b, a = (sum((F.col(names[2 * f + k]) for f in range(folds) if f != without), F.lit(0)) for k in (0, 1))
        odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        top = common.where(a >= 3).select("w", odds.alias("o"), z.alias("z")).where("z > 4 and o > 1.5").orderBy(F.desc("z"), "w").limit(size).collect() if n0 and n1 else []
        out.append({r["w"]: min(r["o"], 6.0) for r in top})
    common.unpersist()
    return out


#: Tasks over the labelled rows, which are bounded.
TASKS = 8
#: Parts of the labelled rows; each is scored by trees that the others grew.
FOLDS = 2


def _grow(sample: DataFrame, lexicon: dict[str, float]) -> tuple[GBTClassificationModel | None, float]:
    """Trees of the rows (id, text, label), and the share of label 1; without rows of both labels there are no trees."""
    n, n1 = sample.agg(F.count("*"), F.sum("label")).first()
    rate = (n1 or 0) / n if n else 0.0
    if not 0 < rate < 1:
        return None, rate
    data = with_features(sample, sample.sparkSession.sparkContext.broadcast(lexicon)).select("id", F.col("label").cast("double").alias("label"), array_to_vector(FEATURES).alias("v"))
    parts = max(1, min(TASKS, n // 1000))  # each of some hundred passes over the rows writes a file a part
    data = data.repartition(parts, "id").coalesce(parts).persist()
    trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, seed=11).fit(data)
    data.unpersist()
    return trees, rate


def out_of_fold(sample: DataFrame, lexica: list[dict[str, float]]) -> DataFrame:
    """(label, p) of the rows (id, text, label): each row's probability by the lexicon and trees of the folds that it isn't in, or their share of label 1 where they have no trees. lexica: one a fold."""
    fold, out = _fold(len(lexica)), None
    for k, lexicon in enumerate(lexica):
        trees, rate = _grow(sample.where(fold != k), lexicon)
        own = sample.where(fold == k)
        if trees is None:
            part = own.select(F.col("label").cast("double").alias("label"), F.lit(float(rate)).alias("p"))
        else:
            shared = sample.sparkSession.sparkContext.broadcast(lexicon)
            part = trees.transform(with_features(own, shared).withColumn("v", array_to_vector(FEATURES))).select(F.col("label").cast("double").alias("label"), vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def labelled(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of the documents of at most `rows` labelled ids, the first in the order of a hash."""
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most `rows` labelled ids; all of them give the lexicon and grow the trees.

    The calibration is an isotonic fit over scores out of fold, so that every
    row counts for it too, and at every size alike. The caller picks which
    labels may be seen. Rows with a null label or id are left out; of an id's
    several labels the largest counts, of an id's several documents each
    trains. Where only one label is seen, or none, its share is the score.
    """
    sample = labelled(docs, labels, rows, id_col, text_col, label_col).persist()
    try:
        lexicon, *lexica = learn_lexica(sample, FOLDS)
        trees, rate = _grow(sample, lexicon)
        calibration = None
        if trees is not None:
            calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(out_of_fold(sample, lexica))
        return ToxicityModel(docs.sparkSession.sparkContext.broadcast(lexicon), trees, calibration, rate)
    finally:
        sample.unpersist()


def with_scores(featured: DataFrame, model: ToxicityModel, score_col: str = "score") -> DataFrame:
    """Replace the features, and a column named as the score, by a calibrated score from 0 to 1."""
    keep = [c for c in featured.columns if c not in (FEATURES, score_col)]
    if model.trees is None:
        return featured.select(*keep, F.lit(float(model.rate)).alias(score_col))
    own = {c: f"__toxicity_{c}" for c in ("v", "raw", "p", "label", "s", "score")}
    trees = model.trees.copy().setFeaturesCol(own["v"]).setRawPredictionCol(own["raw"]).setProbabilityCol(own["p"]).setPredictionCol(own["label"])
    out = trees.transform(featured.withColumn(own["v"], array_to_vector(FEATURES))).withColumn(own["s"], vector_to_array(own["p"])[1])
    out = model.calibration.copy().setFeaturesCol(own["s"]).setPredictionCol(own["score"]).transform(out)
    return out.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(own["score"]))).alias(score_col))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score for each row, in place of a column of that name; null and empty texts are scored as texts without words. Nothing is moved between tasks."""
    return with_scores(with_features(docs, model.lexicon, text_col), model, score_col)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
