"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies cover every training document. Weights come from follow-the-regularised-leader (proximal) with
elastic-net penalties on a bounded sample of labelled rows; a temperature fitted on rows kept out of that training
calibrates the probabilities.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm import common

BUCKETS = 1 << 15
#: Distinct labelled texts that the weights are fitted on, for each language at most this many, and their bytes at most.
SAMPLE_PER_LANGUAGE = 1500
SAMPLE_BYTES = 64_000_000
#: Percent of a sample that is drawn by hash, so that it is full after the surplus has been dropped.
DRAWN = 125
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.6, 1.0, 2e-4, 1e-6
#: One in so many sampled rows fits the temperature and not the weights.
CALIBRATION_SHARE = 5

#: Characters that are counted at once.
PART = 1 << 20
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - 15)
#: ASCII other than letters counts as a space.
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint64)


def has_letter(text: str | None) -> bool:
    """A letter is a character of the Unicode categories L; numbers such as 1/2 or roman numeral signs are none."""
    return bool(text) and any(map(str.isalpha, text))


def features(text: str, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's one- to three-character grams, and 1 + ln(count) of each; long texts are counted in parts."""
    counts = np.zeros(BUCKETS, np.int64)
    text = f" {text.lower()} "
    for low in range(0, len(text), part):
        # a part begins with the two characters before it, as its first grams do
        begin = max(0, low - 2)
        code = np.frombuffer(text[begin : low + part].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        plain = code < 128
        code[plain] = _PLAIN[code[plain]]
        grams = np.zeros(len(code), np.uint64)
        for n in range(3):
            grams = (grams[: max(0, len(code) - n)] << np.uint64(21)) ^ code[n:]
            own = grams[max(0, low - begin - n) :]
            counts += np.bincount(((own + np.uint64(n + 1)) * _MULTIPLIERS[n] >> _SHIFT).view(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = features(text)
    x = tf * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max())
    return p / p.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (classes, BUCKETS) by FTRL-proximal with per-coordinate rates."""
    z, n = np.zeros((classes, BUCKETS)), np.zeros((classes, BUCKETS))

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            p = _softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[:, at] = zs + g - sigma * w
            n[:, at] = ns + g * g
    return weights(z, n).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) < loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        at, x = weighted(text, self.idf)
        p = _softmax(self.weights[:, at] @ x / self.temperature)
        best = int(p.argmax())
        return self.languages[best], min(1.0, float(p[best]))


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Over all training rows: in how many documents each bucket occurs, and rows by language."""

    def count(batches):
        df, languages = np.zeros(BUCKETS, np.int64), {}
        for batch in common.slices(batches):
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    df[features(text)[0]] += 1
                    languages[language] = languages.get(language, 0) + 1
        at = np.flatnonzero(df)
        names = sorted(languages)
        yield pa.RecordBatch.from_arrays([
            pa.array([*at.tolist(), *[None] * len(names)], pa.int32()), pa.array([*[None] * len(at), *names], pa.string()), pa.array([*df[at].tolist(), *[languages[x] for x in names]], pa.int64()),
        ], names=["bucket", "lang", "n"])

    sums = rows.select("text", "lang").mapInArrow(count, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    df, languages = np.zeros(BUCKETS, np.int64), {}
    for bucket, language, n in sums.collect():  # BUCKETS rows and one for each language
        if bucket is None:
            languages[language] = n
        else:
            df[bucket] = n
    return df, languages


def affordable(rows: list[tuple], most_bytes: int) -> list[tuple]:
    """Of (value, key, size), in order, those that fit in the bytes that are left; larger ones are passed over. A value of which none fits keeps its smallest."""
    out, left = [], most_bytes
    for value, key, size in rows:
        if size <= left:
            out.append((value, key))
            left -= size
    least: dict = {}
    for value, key, size in rows:
        least[value] = min(least.get(value, (size, key)), (size, key))
    return out + [(value, least[value][1]) for value in least.keys() - {v for v, _ in out}]


def bounded_sample(rows: DataFrame, by: str, per_value: int, most_bytes: int) -> DataFrame:
    """Of rows (text, h, ...), those with the smallest h of each value of `by`: at most per_value, and of all at most most_bytes bytes of text.

    The first of each value come first, so that bytes run out for all values alike. A text that is larger than what is
    left is passed over; a value of which no text fits keeps its shortest, so that no value is lost.
    """
    order = Window.partitionBy(by).orderBy("h")
    drawn = common.stored(rows.withColumn("size", F.octet_length("text")), "drawn-texts")
    sized = drawn.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_value).select(by, "h", "size", "nth")
    # at most per_value numbers for each value
    kept = affordable([(r[0], r.h, r.size) for r in sorted(sized.collect(), key=lambda r: (r.nth, r.h))], most_bytes)
    chosen = drawn.sparkSession.createDataFrame(kept, f"{by} {drawn.schema[by].dataType.simpleString()}, h long")
    return drawn.join(F.broadcast(chosen), [by, "h"], "left_semi").drop("size")


def train(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on rows (text, lang): frequencies on all of them, weights on a sample of distinct texts, at most per_language of each language."""
    spark = rows.sparkSession
    df, counts = _document_frequencies(rows)
    names = sorted(counts)
    total = sum(counts.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    if not names:
        return Model([], np.zeros((0, BUCKETS), np.float32), idf, 1.0)
    keyed = rows.select("text", "lang", F.xxhash64("text").alias("h"))
    distinct = {r.lang: r.n for r in keyed.groupBy("lang", "h").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    scale = 1 << 30
    limits = spark.createDataFrame([(x, min(scale, DRAWN * per_language * scale // (100 * distinct[x])), i) for i, x in enumerate(names)], "lang string, most long, y int")
    drawn = keyed.join(F.broadcast(limits), "lang").filter(F.pmod(F.col("h"), F.lit(scale)) < F.col("most"))
    # copies meet before they are moved: of each text and language one stays, about DRAWN percent of per_language for each language
    drawn = drawn.groupBy("y", "h").agg(F.min("text").alias("text"))
    sample = bounded_sample(drawn, "y", per_language, most_bytes)

    def fit(batches):
        held = sorted((h, y, t) for b in batches for t, y, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if has_letter(t))
        data = [(*weighted(t, idf), y) for _, y, t in held]
        check = [i for i, (h, _, _) in enumerate(held) if (h >> 32) % CALIBRATION_SHARE == 0]
        kept = set(check)
        w = ftrl([d for i, d in enumerate(data) if i not in kept], len(names))
        logits = np.array([w[:, data[i][0]] @ data[i][1] for i in check]).reshape(len(check), len(names))
        t = temperature(logits, np.array([data[i][2] for i in check], int))
        yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()], "facts": [json.dumps({"temperature": t})]})

    (found,) = sample.select("text", "y", "h").repartition(1).mapInArrow(fit, "weights binary, facts string").collect()
    weights = np.frombuffer(found.weights, np.float32).reshape(len(names), BUCKETS)
    return Model(names, weights, idf, json.loads(found.facts)["temperature"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row; `und` and 0 where text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each language

    def run(batches):
        for batch in common.slices(batches):
            got = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, may_learn: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learn from the rows where may_learn holds, lang is not null and text has a letter; predict every row.

    Without such rows every prediction is `und`, and so are null texts and those without a letter. Equally likely
    languages go to the first by name. Repeated rows and null ids are predicted as any other row (equal texts teach
    the weights once); very long texts are counted in parts, and teach the weights only where the sample's bytes allow them or
    their language has no shorter one; columns other than doc_id, text and lang are ignored.
    """
    model = train(docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"), per_language)
    return predict(docs, model)


def held_out() -> Column:
    return F.coalesce(common.crc_of_id() % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as identify states."""
    found = identify(common.table(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, may_learn: Column, least: float = 0.4, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Only the rows whose text has a language at a probability of at least `least`; all columns as they were."""
    model = train(docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each language
    place = docs.columns.index("text")

    def run(batches):
        for batch in common.slices(batches):
            got = [shared.value.predict(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([name != "und" and p >= least for name, p in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
