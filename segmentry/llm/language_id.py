"""Language ID by hierarchical discrimination: family first, then language.

Texts are vectors of hashed character bigrams and trigrams. One linear support vector
machine for each pair of families votes for the family, and within it one for each
pair of its languages votes for the language. The machines are fitted by Spark ML on a
bounded sample of labelled texts: at most ``per_language`` distinct texts of each
language, chosen by the hash of the text. Prediction reads the text alone.

Defined cases: a text that is null, empty or has no letter is ``und`` with score 0;
rows without a language teach nothing; a language that no family lists is a family of
its own; with a single language in training, every text with a letter is that
language with score 1; with none, every text is ``und``; equal texts get equal
answers; an empty table gives an empty result; columns other than the id, text and
language are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import materialize, quoted
from .tokens import output

UNDETERMINED = "und"
#: Languages by family, as ISO 639-1 codes.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
DIMENSIONS = 2048
PER_LANGUAGE = 500


def vectors(texts: list[str], dimensions: int) -> np.ndarray:
    """Unit vectors of damped counts of hashed character bigrams and trigrams."""
    out = np.zeros((len(texts), dimensions), np.float32)
    shift = np.uint32(33 - dimensions.bit_length())
    for row, text in zip(out, texts, strict=True):
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
        pairs = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        threes = pairs[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
        for grams in (pairs, threes):
            grams ^= grams >> np.uint32(15)
            grams *= np.uint32(0x2C1B3C6D)
            row += np.bincount(grams >> shift, minlength=dimensions)
        np.sqrt(row, out=row)
        row /= np.linalg.norm(row)
    return out


@dataclass
class Model:
    """Machines as (dimensions, pairs) weights; ``families`` maps names to languages."""

    dimensions: int
    families: dict[str, list[str]]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    intercepts: np.ndarray | None = None

    def _vote(self, names: list[str], margins: dict) -> tuple[str, float]:
        """Winner by votes, then by summed margins; and its weakest duel as a probability."""
        votes = dict.fromkeys(names, 0)
        total = dict.fromkeys(names, 0.0)
        for a, b in itertools.combinations(names, 2):
            m = margins[a, b]  # above 0 for b
            votes[b if m > 0 else a] += 1
            total[a] -= m
            total[b] += m
        best = max(names, key=lambda n: (votes[n], total[n], n))
        duels = [m if pair[1] == best else -m for pair, m in margins.items() if best in pair and set(pair) <= set(names)]
        return best, float(1 / (1 + np.exp(-4 * min(duels)))) if duels else 1.0

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        names = sorted(self.families)
        if not names:
            return [(UNDETERMINED, 0.0)] * len(texts)
        found = []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            if self.pairs:
                margins = vectors(part, self.dimensions) @ self.weights + self.intercepts
            else:
                margins = np.zeros((len(part), 0))
            for row in margins:
                by_pair = dict(zip(self.pairs, map(float, row), strict=True))
                family, sure = self._vote(names, by_pair)
                language, surer = self._vote(self.families[family], by_pair)
                found.append((language, sure * surer))
        return found


def _family(language: str, families: dict) -> str:
    return next((f"family:{f}" for f, members in families.items() if language in members), f"family:{language}")


def _rows_to_vectors(
    batches: Iterator[pa.RecordBatch], dimensions: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = vectors(part.column(1).to_pylist(), dimensions).astype(np.float64)
            offsets = pa.array(np.arange(0, x.size + 1, dimensions), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["language", "vector"])


def training_sample(
    labelled: DataFrame, text_col: str, language_col: str, per_language: int
) -> DataFrame:
    """At most ``per_language`` distinct texts of each language: those of least hash.

    Texts are first thinned by their hash to about twice as many as are wanted, so the
    ranking sees a bounded number of rows of each language.
    """
    rows = labelled.select(
        quoted(language_col).alias("language"),
        quoted(text_col).alias("text"),
        F.xxhash64(quoted(text_col)).alias("hash"),
    ).where("language IS NOT NULL AND text rlike '\\\\p{L}'")
    counts = rows.groupBy("language").agg(F.approx_count_distinct("hash").alias("n"))
    rate = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n"))
    rank = Window.partitionBy("language").orderBy("hash", "text")
    return (
        rows.join(F.broadcast(counts), "language")
        .where(F.pmod("hash", F.lit(1 << 40)) < rate * float(1 << 40))
        .dropDuplicates(["language", "hash"])
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= per_language)
        .select("language", "text")
    )


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    language_col: str = "lang",
    families: dict[str, tuple[str, ...]] = FAMILIES,
    per_language: int = PER_LANGUAGE,
    dimensions: int = DIMENSIONS,
    iterations: int = 15,
) -> Model:
    """Machines for all pairs of families, and of the languages in each family.

    ``per_language`` bounds the sample of each language. The number of languages is a
    property of the labels and taken to be small.
    """
    schema = StructType(
        [StructField("language", StringType()), StructField("vector", ArrayType(DoubleType()))]
    )
    sample = training_sample(labelled, text_col, language_col, per_language)
    data = materialize(
        sample.mapInArrow(lambda b: _rows_to_vectors(b, dimensions), schema).coalesce(2), "languages"
    ).select("language", array_to_vector("vector").alias("features"))
    languages = sorted(r[0] for r in data.select("language").distinct().collect())
    model = Model(dimensions, {})
    for language in languages:
        model.families.setdefault(_family(language, families), []).append(language)
    labels = {name: members for name, members in model.families.items()}
    labels |= {language: [language] for language in languages}
    groups = [sorted(model.families), *model.families.values()]
    machines = []
    for a, b in (pair for group in groups for pair in itertools.combinations(group, 2)):
        machine = LinearSVC(maxIter=iterations, regParam=1e-4, standardization=False)
        both = data.where(F.col("language").isin(labels[a] + labels[b])).withColumn(
            "label", F.col("language").isin(labels[b]).cast("double")
        )
        machines.append(machine.fit(both))
        model.pairs.append((a, b))
    if machines:
        model.weights = np.stack([m.coefficients.toArray() for m in machines], 1).astype(np.float32)
        model.intercepts = np.array([m.intercept for m in machines], np.float32)
    return model


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        texts = batch.column(1).to_pylist()
        known = [i for i, t in enumerate(texts) if t is not None]
        language, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for i, (name, p) in zip(known, model.predict([texts[i] for i in known]), strict=True):
            language[i], score[i] = name, p
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(language, pa.string()), pa.array(score, pa.float64())],
            ["id", "lang_pred", "score"],
        )


def _lettered(text: Column) -> Column:
    return F.when(text.rlike(r"\p{L}"), text)


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, lang_pred, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = output(docs, id_col, "id", ("lang_pred", StringType()), ("score", DoubleType()))
    return docs.select(quoted(id_col), _lettered(quoted(text_col))).mapInArrow(
        lambda b: _predict(b, shared), schema
    )


def _accepted(batches: Iterator[pa.RecordBatch], shared, text_at: int, least: float):
    model = shared.value
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        lettered = batch.column(batch.num_columns - 1).to_pylist()
        known = [i for i, has in enumerate(lettered) if has]
        found = model.predict([texts[i] for i in known])
        keep = [i for i, (name, p) in zip(known, found, strict=True) if name != UNDETERMINED and p >= least]
        out = batch.take(pa.array(keep, pa.int64()))
        yield out.select(range(batch.num_columns - 1))


def keep_identified(
    docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.25
) -> DataFrame:
    """``docs`` without the rows that are undetermined or below ``least_score``.

    Two equal duels, one of families and one of languages, give a score of 0.25.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    # A schema is told by its text, which not every name survives: plain ones around the call.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    marked = plain.select("*", F.coalesce(F.col(f"c{at}").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(lambda b: _accepted(b, shared, at, least_score), plain.schema).toDF(*docs.columns)
