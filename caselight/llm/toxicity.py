"""Operator 9: toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.shared import documents_of, settled, small_side

#: Labelled rows that training reads, about: beyond it a share of them is taken by a hash of doc_id.
TRAIN_ROWS = 30_000
#: Stems of the learned lexicon, at most, and the toxic documents each must occur in.
STEMS, STEM_DOCUMENTS = 400, 5
TREES, DEPTH = 30, 4
THRESHOLD = 0.3

# Insults, and second-person words, by language.
INSULTS = frozenset("""
asshole bastard bitch clown crap cretin damn degenerate disgusting dumb dumbass fool freak fuck fucking garbage
hate idiot idiotic imbecile jerk kill loser lunatic moron moronic pathetic pig retard retarded scum scumbag shit
shut stupid sucker trash ugly vermin vile whore worthless
arschloch blödmann depp dreck dumm dummkopf fotze hurensohn idioten missgeburt schlampe schwachkopf versager
abruti bâtard connard connasse crétin débile imbécile merde ordure pourriture salaud salope stupide
basura cabrón estúpido gilipollas idiota imbécil inútil mierda perdedor puta puto pendejo tonto
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself yourselves u ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos
tú ti usted ustedes vosotros tuyo
""".split())
# Characters that stand in for letters.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
                           "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})

FEATURES = ("log_words", "insults_per_100", "insults", "stems_per_100", "stems", "stem_weight_per_100",
            "top_stem_weight", "second_person_per_100", "second_person_near", "capital_share", "caps_words_share",
            "exclaims_per_100", "punctuation_share", "obfuscated_share", "unmasked_insults", "stretched_share",
            "digit_share")

_INSULT, _YOU, _CAPS, _MASKED, _STRETCHED, _UNMASKED = (1 << i for i in range(6))
_WEIGHT = 6  # bits from here on: the learned weight in sixteenths
_EDGE = re.compile(r"^\W+|\W+$")
_MIXED = re.compile(r"[^\W\d_][\d@$!|+*#%.\-_]+[^\W\d_]")
_LONG = re.compile(r"(\w)\1\1")
_LETTER = re.compile(r"[^\W\d_]")


def stems(word: str) -> set[str]:
    """A lower-cased word and its beginnings of 5 to 8 letters."""
    return {word} | {word[:k] for k in range(5, min(len(word), 9))}


def plain(word: str) -> str:
    return _EDGE.sub("", word).lower()


class WordFlags(dict):
    """What a word adds to the features, packed in an integer; remembered for a bounded number of words."""

    def __init__(self, weights: dict[str, float], most: int = 500_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> int:
        bare = plain(word)
        flags = 0
        if bare in INSULTS:
            flags |= _INSULT
        if bare in SECOND_PERSON:
            flags |= _YOU
        if len(bare) > 1 and word.upper() == word and word.lower() != word:
            flags |= _CAPS
        if _MIXED.search(word):
            flags |= _MASKED
        if _LONG.search(bare):
            flags |= _STRETCHED
        if not flags & _INSULT:
            unmasked = re.sub(r"[^\w]|_|\d", "", word.lower().translate(STAND_INS))
            squeezed = re.sub(r"(\w)\1+", r"\1", unmasked)
            if unmasked != bare and unmasked in INSULTS or squeezed != bare and squeezed in INSULTS:
                flags |= _UNMASKED
        weight = max((self.weights.get(s, 0.0) for s in stems(bare)), default=0.0) if bare else 0.0
        flags |= min(int(weight * 16), 255) << _WEIGHT
        if len(self) >= self.most:
            self.clear()
        self[word] = flags
        return flags


def features(text: str | None, known: WordFlags) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``; all 0 without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    flags = np.fromiter(map(known.__getitem__, words), np.int64, n)
    weight = (flags >> _WEIGHT) / 16.0
    has = lambda bit: (flags & bit) > 0
    bad = np.flatnonzero(has(_INSULT) | has(_UNMASKED) | (weight > 0))
    you = np.flatnonzero(has(_YOU))
    near = 0.0
    if len(bad) and len(you):
        at = np.searchsorted(you, bad)
        after, before = you[np.minimum(at, len(you) - 1)], you[np.maximum(at - 1, 0)]
        near = float(1 / (1 + np.minimum(abs(after - bad), abs(bad - before)).min()))
    size = len(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    letters = int(kinds[65:91].sum() + kinds[97:123].sum() + kinds[192:].sum())  # each character beyond ASCII counts as one
    capitals, digits = int(kinds[65:91].sum()), int(kinds[48:58].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    rate = 100.0 / n
    return [
        math.log1p(n), has(_INSULT).sum() * rate, float(has(_INSULT).sum()), (weight > 0).sum() * rate,
        float((weight > 0).sum()), weight.sum() * rate, float(weight.max()), len(you) * rate, near,
        capitals / max(letters, 1), has(_CAPS).sum() / n, int(kinds[33]) * rate, marks / size, has(_MASKED).sum() / n,
        float(has(_UNMASKED).sum()), has(_STRETCHED).sum() / n, digits / size,
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_stems(labelled: DataFrame) -> dict[str, float]:
    """Stems that toxic documents hold more often, with their log odds; at most ``STEMS`` are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = (Counter(), Counter())
            for text, label in zip(*(batch.column(c).to_pylist() for c in ("text", "label"))):
                found: set[str] = set()
                for word in set(map(plain, (text or "").split())):
                    if word:
                        found |= stems(word)
                sums[int(label)].update(found)
            all_stems = list(sums[0] | sums[1])
            yield pa.RecordBatch.from_pydict({
                "stem": all_stems, "bad": [sums[1][s] for s in all_stems], "fine": [sums[0][s] for s in all_stems]})

    totals = labelled.agg(F.sum("label"), F.count(F.lit(1))).first()
    bad, rows = float(totals[0] or 0), float(totals[1])
    if not bad or bad == rows:
        return {}
    odds = F.log(((F.col("bad") + 0.5) / bad) / ((F.col("fine") + 0.5) / (rows - bad)))
    counts = labelled.select("text", "label").mapInArrow(count, "stem string, bad long, fine long").groupBy("stem").agg(
        F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    best = counts.where(F.col("bad") >= STEM_DOCUMENTS).withColumn("odds", F.round(odds, 6)).where("odds > 1.2").orderBy(
        (F.col("odds") * F.col("bad")).desc(), "stem").limit(STEMS)
    return {row["stem"]: row["odds"] for row in best.collect()}


def with_features(df: DataFrame, weights: dict[str, float], columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with the features of ``text`` as an array of doubles."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFlags(weights)
        for batch in batches:
            made = {c: batch.column(c) for c in columns}
            made["dense"] = [features(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(made)

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "dense array<double>"])
    return df.select(*columns, "text").mapInArrow(describe, schema)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labelled rows that are not held out fall in three parts by a hash of doc_id: the lexicon is learned
    on one, the trees on the second, so that they see the lexicon as unseen texts do, the calibration on
    the third. Where a part lacks one of the labels its step is left out (constant scores, or none
    calibrated).
    """
    known = settled(spark, labels.where("doc_id is not null and toxic is not null").where(
        ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label")), "toxic-labels")
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    at = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = small_side(known.where(at < share))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(20))
    rows = settled(spark, docs.join(known, "doc_id").select(
        "doc_id", "text", F.col("label").cast("double").alias("label"), part.alias("part")), "toxic-rows")

    weights = learned_stems(rows.where("part < 8"))
    vector = array_to_vector(F.col("dense")).alias("features")
    lesson = settled(spark, with_features(rows.where("part >= 8"), weights, ["doc_id", "label", "part"]), "toxic-lesson")
    lesson = lesson.repartition(8, "doc_id").sortWithinPartitions("doc_id").select("label", "part", vector)
    trees_rows, check_rows = lesson.where("part < 16"), lesson.where("part >= 16")
    both = lambda df: df.select("label").distinct().count() == 2
    every = with_features(docs, weights, ["doc_id"]).select("doc_id", vector)
    if both(trees_rows):
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.15, minInstancesPerNode=3, seed=7).fit(trees_rows)
        raw = lambda df: trees.transform(df).withColumn(
            "raw", vector_to_array("probability")[1])
        every, check_rows = raw(every), raw(check_rows)
        score = F.col("raw")
        if both(check_rows):
            fit = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="even").fit(
                check_rows.select("raw", "label"))
            every = fit.transform(every.select("doc_id", "raw"))
            # steps keep the order of the raw scores within them
            score = F.lit(0.9) * F.col("even") + F.lit(0.1) * F.col("raw")
    else:
        rate = rows.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        score = F.lit(float(rate))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return every.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated toxicity score of every document.

    Null and empty texts get the score of a text without words; null doc_ids are neither held out nor
    learned from; a doc_id labelled twice counts as toxic if one label says so; repeated rows each get a
    score; an empty table gives no rows; other columns are ignored.
    """
    docs = documents_of(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return scored(spark, docs, labels)
