"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, gated attention (tanh and sigmoid branches multiplied)
gives it a weight, and the weighted sum of the encodings is scored. Only document labels train the network, by
gradient descent on a bounded sample; every passage of every document is encoded when scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm import common, langid

#: Labelled documents that the network is fitted on, of each label at most this many, and their bytes at most.
SAMPLE_PER_LABEL = 3000
SAMPLE_BYTES = 64_000_000
#: Bytes of a passage; the last of a document is what is left.
PASSAGE = 512
#: Bytes of texts that are encoded at once.
PART = 1 << 18
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 25, 64, 0.01


def _kinds() -> np.ndarray:
    """Fourteen kinds of bytes: letters by case, digits, white space, some marks of their own, other ASCII, and bytes beyond ASCII."""
    out = np.full(256, 12, np.uint8)
    for kind, members in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"*#%$&@^~", b"|<>{}[]()=/\\_", b"'\"`-", b":;"]):
        out[list(members)] = kind
    out[128:] = 13
    return out


KINDS = _kinds()
N_KINDS = 14
WHITE = common.byte_class([(0, 32)])
WIDTH = N_KINDS * N_KINDS + 32 + 3


def passages(texts: pa.Array, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text (at least one). Texts are encoded `part` bytes at a time."""
    data, offsets = common.text_buffer(texts)
    per = np.maximum(1, -(-np.diff(offsets) // PASSAGE))
    edges = [np.append(np.arange(a, max(b, a + 1), PASSAGE), b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    starts = np.concatenate([np.zeros(0, np.int64), *(e[:-1] for e in edges)])
    stops = np.concatenate([np.zeros(0, np.int64), *(e[1:] for e in edges)])
    out = np.zeros((len(starts), WIDTH), np.float32)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(stops, starts[low] + part, side="right")))
        a = starts[low]
        out[low:high] = _encoded(data[a : stops[high - 1]], np.append(starts[low:high], stops[high - 1]) - a)
        low = high
    return out, per


def _encoded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of passages that are laid end to end."""
    n, pairs = len(offsets) - 1, N_KINDS * N_KINDS
    of = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, WIDTH), np.float32)
    lengths = np.diff(offsets).astype(np.float32)
    safe = np.maximum(lengths, 1)[:, None]
    if len(data):
        kind = KINDS[data].astype(np.int64)
        same = of[1:] == of[:-1]
        out[:, :pairs] = np.bincount((of[:-1] * pairs + kind[:-1] * N_KINDS + kind[1:])[same], minlength=n * pairs).reshape(n, pairs) / safe
        out[:, pairs : pairs + 32] = np.bincount(of * 32 + (common.LOWER[data] & 31), minlength=n * 32).reshape(n, 32) / safe
        # hashes of each word, for the share of words that the passage repeats
        starts, ends, _ = common.word_bounds(data, offsets, WHITE)
        words = np.unique(np.stack([of[starts].astype(np.uint64), common.span_hash(common.prefix_hash(data), starts, ends)]), axis=1)
        total = np.bincount(of[starts], minlength=n)
        out[:, pairs + 32] = np.bincount(words[0].astype(np.int64), minlength=n) / np.maximum(total, 1)
        out[:, pairs + 33] = np.log1p(lengths / np.maximum(total, 1))
    out[:, pairs + 34] = np.log1p(lengths)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Encoder, gated attention and score; parameters in a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        new = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float64)
        return cls({"We": new(WIDTH, HIDDEN), "be": np.zeros(HIDDEN), "V": new(HIDDEN, GATE), "U": new(HIDDEN, GATE), "w": new(GATE, 1)[:, 0], "c": new(HIDDEN, 1)[:, 0], "b": np.zeros(1)})

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> tuple[np.ndarray, tuple]:
        """Scores of n bags; bag: of each passage, ascending, none empty."""
        p = self.p
        h = np.tanh(x @ p["We"] + p["be"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        edge = np.searchsorted(bag, np.arange(n))
        a = np.exp(e - np.maximum.reduceat(e, edge)[bag])
        a /= np.add.reduceat(a, edge)[bag]
        z = np.add.reduceat(a[:, None] * h, edge, axis=0)
        return _sigmoid(z @ p["c"] + p["b"]), (x, bag, edge, h, t, s, a, z)

    def gradient(self, score: np.ndarray, y: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, (x, bag, edge, h, t, s, a, z) = self.p, kept
        d = (score - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, edge)[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"We": x.T @ dh, "be": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Adam on bags in a fixed shuffled order; features are standardised first."""
    flat = np.concatenate(bags)
    mean, spread = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    net = Network.start()
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    rng, step = np.random.default_rng(1), 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            at = order[low : low + BATCH]
            x = (np.concatenate([bags[i] for i in at]) - mean) / spread
            score, kept = net.forward(x, np.repeat(np.arange(len(at)), [len(bags[i]) for i in at]), len(at))
            step += 1
            for k, g in net.gradient(score, y[at], kept).items():
                g = g + decay * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net.p | {"mean": mean, "spread": spread}


def train(docs: DataFrame, known: DataFrame, per_label: int = SAMPLE_PER_LABEL, most_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray] | None:
    """Fit on documents (doc_id, text) with labels (doc_id, y in 0 and 1), at most per_label of each. None without both labels.

    The sample is drawn from the labels, so that only its rows' texts are moved. A doc_id counts once: with its larger
    label and, of several texts, with the smallest.
    """
    known = known.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if set(counts) != {0, 1}:
        return None
    scale = 1 << 30
    share = {y: min(scale, langid.DRAWN * per_label * scale // (100 * n)) for y, n in counts.items()}
    most = F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < most)
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    # distinct doc_ids, at most per_label of each label: small enough to be broadcast, whatever the corpus
    chosen = F.broadcast(drawn.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_label).drop("nth"))
    texts = docs.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = langid.bounded_sample(texts.select("text", "y", F.xxhash64("doc_id").alias("h")), "y", per_label, most_bytes).select("text", "y", "h")
    weight = {y: counts[y] / sum(counts.values()) for y in (0, 1)}

    def run(batches):
        held = sorted((h, y, t or "") for b in batches for t, y, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        bags: list[np.ndarray] = []
        for low in range(0, len(held), 64):
            x, per = passages(pa.array([t for _, _, t in held[low : low + 64]], pa.string()))
            bags += np.split(x, np.cumsum(per)[:-1])
        y = np.array([v for _, v, _ in held], float)
        if set(y) != {0.0, 1.0}:
            return
        p = fit(bags, y)
        # the sample holds more of the rarer label than the rows do: move the log odds back
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        p["b"] = p["b"] + np.log(weight[1] / weight[0]) - np.log(rate / (1 - rate))
        yield pa.RecordBatch.from_pydict({"name": list(p), "values": [np.asarray(a, np.float64).tobytes() for a in p.values()], "shape": [list(np.shape(a)) for a in p.values()]})

    # the sample's size is a parameter's multiple, whatever the corpus
    found = sample.repartition(1).mapInArrow(run, "name string, values binary, shape array<long>").collect()
    return {r.name: np.frombuffer(r["values"], np.float64).reshape(r["shape"]) for r in found} or None


def predict(docs: DataFrame, params: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id and score (probability of label 1) of every row; 0.5 where nothing could be learned."""

    def run(batches):
        net = Network({k: v.astype(np.float32) for k, v in params.items()}) if params else None
        for batch in common.slices(batches, 64):
            x, per = passages(batch.column(1))
            score = np.full(batch.num_rows, 0.5)
            if net:
                score, _ = net.forward((x - net.p["mean"]) / net.p["spread"], np.repeat(np.arange(len(per)), per), len(per))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(score, float))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """Learn quality from the labels where may_learn (a condition on doc_id) holds, and score every whole text.

    Null and empty texts are one empty passage; very long texts are encoded in parts, and teach only where the sample's
    bytes allow them or their label has no shorter one. Labels other than 0 and 1 teach
    nothing; a document that is labelled more than once counts once, with the larger label. Without both labels every
    score is 0.5. Repeated rows and null ids are scored as any other row; other columns are ignored.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & may_learn).select("doc_id", F.col("quality").alias("y"))
    params = train(docs.select("doc_id", "text"), known, per_label)
    return predict(docs, params)


def held_out() -> Column:
    return F.coalesce(common.crc_of_id() % 5 == 0, F.lit(False))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document. Nulls, long texts, ties (0.3 itself is predicted 1), repeated rows, empty tables and extra columns: as score states."""
    found = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
