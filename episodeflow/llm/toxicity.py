"""Toxicity by class-conditional Kneser-Ney character models.

Method
------
A word is scored by two Kneser-Ney models of its characters, one of toxic and one
of ordinary text. The probability of a character after its ``ORDER - 1``
predecessors in the word has its counts from the class's own labelled rows; the
mass that absolute discounting takes from them is spread by one shared model of
the lower orders, whose continuation counts (of how many different characters
precede) come from the words of all documents. Each class backs off by itself:
one that has never met a context takes the shared probability, so what only
toxic text says is evidence, and a rare expression that no labelled row holds is
judged by the part of it that one does.

A document's features are the classes' log-likelihood ratio for each character
of the whole text, the mean ratio of its ``TOP`` most toxic words, and the
logarithm of its number of words: few words make a long text toxic, which the
whole text's ratio alone hardly shows. A logistic function turns them into a
score. It is calibrated on a fourth of the labelled rows by models that hold no
counts of these; the models that then score have the counts of all.

Labels are learnt from a bounded sample of labelled rows: ``SAMPLE`` of each
class, those of the smallest hash of their id, weighted back to their class's
share. Counting is a distributed aggregate over all documents with exact keys, of
whole code points. The two classes differ in sequences and contexts of labelled
rows only; everywhere else both have the same probability, so the ratios of
these, computed from the counts of the whole corpus, are all that scoring needs.
That table grows with the labelled sample and never with the corpus.

Defined cases: null and empty texts have no words and all features zero; of
repeated labels of one id the larger counts, null ids and labels don't; labels
of one class only, or none, give every document the score of that class's share;
repeated rows and null ids are scored each; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, materialise, read_table, slices, stage_input, stage_output
from .decontaminate import words_of

SAMPLE = 10_000
#: A code point has 21 bits.
ORDER, BITS, DISCOUNT, TOP = 5, 21, 0.75, 3
KNOWN_WORDS = 200_000
LABELS = ("n0", "n1", "m0", "m1")
HELD_OUT, CALIBRATION = 0, 4  # of the remainder of crc32(id) by 5


def word_keys(words: list[bytes]):
    """The packed character sequences of the words' characters, and their number in each word.

    A sequence of five code points is exact in two integers: the first three in
    one (``high``), the last two in the other (``low``).
    """
    import numpy as np

    lowered = [w.decode("utf-8", "replace").lower() for w in words]
    text = "".join(["^" * (ORDER - 1) + w + "$" for w in lowered])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    ends = np.cumsum(sizes + ORDER - 1)
    at = np.repeat(ends - sizes - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    high = codes[at - 4] << 2 * BITS | codes[at - 3] << BITS | codes[at - 2]
    return high, codes[at - 1] << BITS | codes[at], sizes


def label_sample(labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, fold) of the sampled labels, and the rows of each class."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).cast("int")
    rows = labels.where("doc_id is not null and toxic in (0, 1)").withColumn("fold", fold).where(F.col("fold") != HELD_OUT)
    rows = rows.groupBy("doc_id", "fold").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    parts = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def _distinct(high, low, counts):
    """The distinct keys, ascending, with their counts summed."""
    import numpy as np

    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.zeros(0, np.int64)
    return high[first], low[first], np.add.reduceat(counts[order], first, axis=0) if len(first) else counts[:0]


def _count_keys(docs: DataFrame) -> DataFrame:
    """(high, low, n0, n1, m0, m1): the sequences of all documents, with their counts in labelled rows.

    The column label is 0 or 1, in rows for calibration 2 or 3.
    """

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        seen: set[bytes] = set()
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.int64))
        held = none

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), *[pa.array(np.ascontiguousarray(held[2][:, k])) for k in range(4)]], names=["high", "low", *LABELS])

        for batch in slices(batches):
            met: set[bytes] = set()
            counted = [Counter() for _ in LABELS]
            for text, label in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = words_of(text)
                met.update(words)
                if label is not None:
                    counted[label].update(words)
            words = list((met - seen).union(*counted))
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                high, low, sizes = word_keys(part)
                counts = np.repeat(np.array([[c[w] for c in counted] for w in part]), sizes, axis=0)
                held = _distinct(np.r_[held[0], high], np.r_[held[1], low], np.vstack([held[2], counts]))
            seen = seen | met if len(seen) + len(met) < KNOWN_WORDS else met
            if len(held[0]) > 400_000:
                yield out()
                held = none
        if len(held[0]):
            yield out()

    return docs.mapInArrow(run, "high bigint, low bigint, " + ", ".join(f"{c} bigint" for c in LABELS)).groupBy("high", "low").agg(*[F.sum(c).alias(c) for c in LABELS])


def labelled_sequences(keys: DataFrame) -> DataFrame:
    """The sequences of labelled rows with their shared lower-order probability (below).

    ``keys`` has every distinct sequence of the corpus. The continuation counts of
    each order, and their sums by context, are aggregates over all of them; only
    those that a labelled sequence needs are joined to it.
    """
    one = (1 << BITS) - 1
    two = (1 << 2 * BITS) - 1
    masks = {4: (two, two), 3: (one, two), 2: (0, two), 1: (0, one)}  # of high and low, by order
    part = lambda order: [F.col(c).bitwiseAND(F.lit(m)).alias(c) for c, m in zip(("high", "low"), masks[order], strict=True)]
    grams = {ORDER: keys}
    for order in range(ORDER - 1, 0, -1):
        grams[order] = materialise(grams[order + 1].select(*part(order)).groupBy("high", "low").agg(F.count("*").alias("n")), f"order{order}")
    rows = keys.where(" + ".join(LABELS) + " > 0")
    total = grams[1].agg(F.coalesce(F.sum("n"), F.lit(1)).alias("every"), F.count("*").alias("kinds")).first()
    below = F.lit(1.0) / F.lit(max(1, total["kinds"]))
    for order in range(1, ORDER):
        own = [F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(("high", "low"), masks[order], strict=True)]
        counts = grams[order].select(F.col("high").alias("gh"), F.col("low").alias("gl"), F.col("n").alias("n_"))
        rows = rows.join(counts, (own[0] == F.col("gh")) & (own[1] == F.col("gl"))).drop("gh", "gl")
        if order == 1:
            every, kinds = F.lit(total["every"]), F.lit(total["kinds"])
        else:
            contexts = grams[order].groupBy(F.col("high").alias("ch"), F.shiftright("low", BITS).alias("cl")).agg(F.sum("n").alias("every_"), F.count("*").alias("kinds_"))
            rows = rows.join(contexts, (own[0] == F.col("ch")) & (F.shiftright(own[1], BITS) == F.col("cl"))).drop("ch", "cl")
            every, kinds = F.col("every_"), F.col("kinds_")
        rows = rows.withColumn("below_", (F.greatest(F.col("n_") - DISCOUNT, F.lit(0.0)) + F.lit(DISCOUNT) * kinds * below) / every).drop("n_", "every_", "kinds_", "below")
        rows = rows.withColumnRenamed("below_", "below")
        below = F.col("below")
    return rows


class Table:
    """Values by pairs of integers, exact: found by a hash of the pair and compared whole."""

    def __init__(self, high, low, values):
        import numpy as np

        for salt in range(64):  # a salt under which no two pairs share a hash
            hashed = self.hashed(high, low, salt)
            order = np.argsort(hashed)
            hashed = hashed[order]
            if not (hashed[1:] == hashed[:-1]).any():
                break
        else:
            raise ValueError("the pairs aren't distinct")
        self.salt, self.hash, self.high, self.low, self.values = salt, hashed, high[order], low[order], values[order]

    @staticmethod
    def hashed(high, low, salt: int):
        import numpy as np

        h = (high.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) ^ low.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    def find(self, high, low):
        """The values, and which of the pairs are there at all."""
        import numpy as np

        if not len(self.hash):
            return np.zeros(len(high)), np.zeros(len(high), bool)
        at = np.minimum(np.searchsorted(self.hash, self.hashed(high, low, self.salt)), len(self.hash) - 1)
        return self.values[at], (self.high[at] == high) & (self.low[at] == low)


class Models:
    """What both classes' models say of each character that they tell apart.

    A sequence that labelled rows hold has its own log ratio. A character that
    neither class has met after a context differs by the classes' backoff weights
    alone, so contexts have a log ratio too; where neither has met the context,
    both have the shared probability and the ratio is zero.
    """

    def __init__(self, high, low, below, ordinary, toxic):
        """Arrays: the labelled sequences, their shared probability, and the counts of each class."""
        import numpy as np

        some = ordinary + toxic > 0
        high, low, below = high[some], low[some], below[some]
        counts = np.stack([ordinary[some], toxic[some]]).astype(np.float64)
        order = np.lexsort((low, high))  # contexts are neighbours
        high, low, below, counts = high[order], low[order], below[order], counts[:, order]
        context = low >> BITS
        first = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (context[1:] != context[:-1])]) if len(high) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(high)])
        every = np.add.reduceat(counts, first, axis=1) if len(first) else counts
        kinds = np.add.reduceat((counts > 0).astype(np.float64), first, axis=1) if len(first) else counts
        weight = np.where(every > 0, DISCOUNT * kinds / np.maximum(every, 1), 1.0)  # of the shared probability
        own = np.repeat(every, sizes, axis=1)
        p = np.where(own > 0, np.maximum(counts - DISCOUNT, 0) / np.maximum(own, 1), 0) + np.repeat(weight, sizes, axis=1) * below
        self.sequences = Table(high, low, np.log(p[1]) - np.log(p[0]))
        self.contexts = Table(high[first], context[first], np.log(weight[1]) - np.log(weight[0]))

    def ratios(self, high, low):
        """log p(toxic) - log p(ordinary) of the last characters of the sequences."""
        import numpy as np

        ratio, known = self.sequences.find(high, low)
        backed, met = self.contexts.find(high, low >> BITS)
        return np.where(known, ratio, np.where(met, backed, 0.0))


class Scorer:
    """Features of texts under given models."""

    def __init__(self, models: Models):
        self.models = models
        self.reset()

    def reset(self) -> None:
        import numpy as np

        #: The place of each known word in the arrays of its ratio and size.
        self.known: dict[bytes, int] = {}
        self.ratio, self.size = np.zeros(0), np.zeros(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        import numpy as np

        if len(self.known) > KNOWN_WORDS:
            self.reset()
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            high, low, sizes = word_keys(part)
            sums = np.add.reduceat(self.models.ratios(high, low), np.r_[0, np.cumsum(sizes)[:-1]])
            self.known.update(zip(part, range(len(self.ratio), len(self.ratio) + len(part)), strict=True))
            self.ratio, self.size = np.r_[self.ratio, sums], np.r_[self.size, sizes]

    def features(self, texts: list[bytes | None]):
        import numpy as np

        out = np.zeros((len(texts), 3))
        at = 0
        while at < len(texts):  # in groups of bounded size
            group, size = [], 0
            while at + len(group) < len(texts) and size < 2_000_000:
                group.append(words_of(texts[at + len(group)]))
                size += len(texts[at + len(group) - 1] or b"")
            met: set[bytes] = set()
            for words in group:
                met.update(words)
            self.learn(met)
            place = self.known.__getitem__
            for i, words in enumerate(group):
                if words:
                    ids = np.fromiter(map(place, words), np.int64, len(words))
                    ratio = self.ratio[ids]
                    top = min(TOP, len(ratio))
                    out[at + i] = ratio.sum() / self.size[ids].sum(), np.partition(ratio, len(ratio) - top)[-top:].mean(), np.log1p(len(ratio))
            at += len(group)
        return out


def calibrate(x, y, weight):
    """Intercept, weights, means and deviations of a logistic fit; None without both classes."""
    import numpy as np

    if not (y == 0).any() or not (y == 1).any():
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    ridge = np.diag([0.0] + [0.05] * x.shape[1])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * w[:, None]).T @ z + ridge + 1e-9 * np.eye(len(b)), z.T @ (weight * (y - p)) - ridge @ b)
        b += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return b, mean, spread


def score(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Add the toxicity score (0 to 1) of each row's whole text as ``score``.

    ``docs`` needs doc_id to find labelled rows; scores depend on texts alone.
    """
    import numpy as np

    picked, totals = label_sample(labels, sample)
    picked = materialise(picked, "labels")
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    # twice ``sample`` rows at most
    tagged = docs.select("doc_id", F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "doc_id", "left")
    counting = tagged.select("text", (F.col("toxic") + F.when(F.col("fold") == CALIBRATION, 2).otherwise(0)).alias("label"))
    keys = materialise(_count_keys(counting), "sequences")
    table = labelled_sequences(keys).toArrow()  # of the sample's texts: bounded by it
    high, low, below, *counts = (table.column(c).to_numpy() for c in ("high", "low", "below", *LABELS))
    part, whole = Models(high, low, below, counts[0], counts[1]), Models(high, low, below, counts[0] + counts[2], counts[1] + counts[3])
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(part)

    def features():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.features(texts).tolist()]

    chosen = tagged.where(F.col("fold") == CALIBRATION).select("text", "toxic")
    rows = add_columns(chosen, ["text"], [("x", "array<double>")], features, drop=("text",)).toArrow()
    x, y = np.array(rows.column("x").to_pylist()).reshape(-1, 3), rows.column("toxic").to_numpy()
    weight = np.array([totals.get(k, 0) / max(1, min(totals.get(k, 0), sample)) for k in (0, 1)])
    fitted = calibrate(x, y, weight[y] if len(y) else y)

    shared.unpersist()
    final = sc.broadcast(whole)

    def scores():
        scorer = Scorer(final.value)

        def apply(texts):
            x = scorer.features(texts)
            if fitted is None:
                return [np.full(len(x), share)]
            b, mean, spread = fitted
            return [1 / (1 + np.exp(-np.clip(b[0] + ((x - mean) / spread) @ b[1:], -500, 500)))]

        return apply

    return add_columns(docs, [text], [("score", "double")], scores)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == HELD_OUT
    scored = score(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    scored = score(stage_input(docs), read_table(spark, sf_dir, "labels"))
    return stage_output(scored.where("score < 0.5"), docs)
