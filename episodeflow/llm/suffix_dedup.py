"""Repeated byte strings by a logarithmic family of sparse suffix indexes.

Method
------
Every byte of a string of ``length`` bytes that starts in two places is to go.
Suffixes are sampled at anchors: the anchor of a string of ``length`` bytes is
the first of its positions whose ``GRAM`` bytes have the least fingerprint. It
depends on the string's bytes alone, so equal strings have it at the same place
and no match is lost. Neighbouring strings mostly share their anchor: an anchor
stands for the run of string starts whose strings have it.

The index is a family of levels. A batch of documents becomes a sparse suffix array
of its own: the ``GRAM`` bytes at its anchors in byte order, each once with its
count, dealt to buckets by hash, so that a bucket is an array in order. Arrays are
bucketed, sorted tables: two of them are scanned side by side, without a shuffle,
which finds the suffixes that they share. Two levels of one size are merged by such
a scan into one of twice the size, as often as there are two, so a suffix is
rewritten a logarithmic number of times; the levels that are left are scanned
together. Bytes are compared whole here. Suffixes that occur once go no further.

What a partner shares is then settled by ever smaller groups of string starts. For
a group, the bytes common to all its strings (core) and the bytes of all of them
together (span) are compared by fingerprints: two places with one span have all
strings in common, a core without a partner has none, and groups of other places
are cut into smaller ones. The groups are the run of starts of an anchor, then
``STARTS`` of them, then single ones; only the borders of matches come to the last.
Each comparison is an aggregate by key with partial sums, and what it finds goes
back to the places by joins whose keys are dealt to ``SALTS`` tasks each, so a
passage that a third of all documents share is no single task's work.

Two places are taken as equal only if two independent fingerprints agree, of 64
bits each, or one of 96 bits for single strings. Bytes never leave their row but for
the grams, and the surroundings of anchors that have partners with other
surroundings.

Defined cases: a null text is empty; texts shorter than ``length`` are kept
whole; a repeated row is a copy like any other, so both lose all strings of
``length``; null ids are treated each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, delete_path, discard, freed_shuffles, materialise, read_table, scratch_path, slices, with_row_id

GRAM = 32
STARTS = 10
SALTS = 8
#: Sampled suffixes of a batch, and the least number of batches.
BATCH_SUFFIXES, LEAST_BATCHES = 1_000_000_000, 5
GROUP_BYTES = 1_000_000


class Fingerprints:
    """Fingerprints of any ranges of one byte array, by prefix sums of a polynomial mod 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _powers: dict = {}

    @classmethod
    def powers(cls, n: int):
        import numpy as np

        if len(cls._powers.get("up", ())) < n + 1:
            size = max(n + 1, 65_536)
            up = np.full(size, cls.BASE, np.uint64)
            down = np.full(size, pow(cls.BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                cls._powers = {"up": np.cumprod(up, dtype=np.uint64), "down": np.cumprod(down, dtype=np.uint64), "byte": np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64)}
        return cls._powers["up"], cls._powers["down"], cls._powers["byte"]

    def __init__(self, data):
        import numpy as np

        up, self.down, byte = self.powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte[data] * up[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def of(self, start, end, salt=0):
        """Mixed fingerprints of the ranges start to end (arrays), as unsigned integers."""
        import numpy as np

        h = (self.sums[end] - self.sums[start]) * self.down[start] + np.uint64(0xD6E8FEB86659FD93) * (np.asarray(end - start).astype(np.uint64) + np.uint64(1)) + np.asarray(salt, np.uint64) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def string_anchors(prints: Fingerprints, low: int, high: int, length: int):
    """Of the strings within bytes low to high: their anchors, ascending, and for
    each the first and last start of its strings."""
    import numpy as np

    width = length - GRAM + 1
    if high - low < length:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(low, high - GRAM + 1)
    least = prints.of(at, at + GRAM)
    done = 1
    while done < width:  # the first least of ever longer runs
        step = min(done, width - done)
        left = least[:-step] <= least[step:]
        at, least = np.where(left, at[:-step], at[step:]), np.where(left, least[:-step], least[step:])
        done += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first + low, np.r_[first[1:], len(at)] - 1 + low


def text_anchors(text: bytes, length: int):
    """(anchor, first, last, fingerprint of its strings) of a text.

    Long texts are worked off in pieces, each with the strings that start in it;
    a run of starts may be cut there, which settles it as two runs.
    """
    import numpy as np

    n = len(text)
    out = []
    for low in range(0, max(1, n - length + 1), GROUP_BYTES):
        data = np.frombuffer(text, np.uint8, min(n, low + GROUP_BYTES + length - 1) - low, low)
        prints = Fingerprints(data)
        at, first, last = string_anchors(prints, 0, len(data), length)
        out.append((at + low, first + low, last + low, prints.of(first, last + length, (at - first) * 512 + (last - first))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _batch(columns, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def sampled_suffixes(texts: DataFrame, length: int) -> DataFrame:
    """(row, pos, first, last, span, gram) of all anchors of the texts (row, text)."""
    names = ["row", "pos", "first", "last", "span", "gram"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def batch_of(held):
            *numbers, grams = held
            sizes = np.arange(len(grams) // GRAM + 1, dtype=np.int32) * GRAM
            gram = pa.Array.from_buffers(pa.binary(), len(sizes) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(bytes(grams))])
            return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c)) for c in numbers], gram], names=names)

        for batch in slices(batches):
            held, size = [[], [], [], [], [], bytearray()], 0
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if text is None or len(text) < length:
                    continue
                at, first, last, span = text_anchors(text, length)
                for column, v in zip(held, (np.full(len(at), row), at.astype("i4"), first.astype("i4"), last.astype("i4"), span.view(np.int64)), strict=False):
                    column.append(v)
                data = np.frombuffer(text, np.uint8)
                for i in range(0, len(at), 100_000):
                    held[5] += data[at[i : i + 100_000, None] + np.arange(GRAM)].tobytes()
                size += len(at)
                if size > 200_000:
                    yield batch_of(held)
                    held, size = [[], [], [], [], [], bytearray()], 0
            if size:
                yield batch_of(held)

    return texts.mapInArrow(run, "row bigint, pos int, first int, last int, span bigint, gram binary")


class IndexFamily:
    """Levels of an index of sampled suffixes; see the module's text.

    A level of rank r holds the suffixes of 2**r batches: a table (gram, n) of
    distinct grams in buckets, in order.
    """

    def __init__(self, spark):
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}
        self.paths: dict[str, str] = {}

    def _written(self, level: DataFrame, label: str) -> str:
        """The name of a bucketed, sorted table in the shared folder."""
        path = scratch_path(self.spark, label)
        name = path.rsplit("/", 1)[1].replace("-", "_")
        with freed_shuffles(self.spark):
            level.select("gram", "n").write.bucketBy(self.buckets, "gram").sortBy("gram").option("compression", "zstd").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete_path(self.spark, self.paths.pop(name))

    def _scanned(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two arrays side by side: all suffixes of either, in order, with their counts added."""
        both = a.withColumnRenamed("n", "n_a").hint("merge").join(b.withColumnRenamed("n", "n_b"), "gram", "full_outer")
        return both.select("gram", (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"))

    def add(self, suffixes: DataFrame) -> None:
        """Add a batch (gram); levels of one rank are merged."""
        rank = 0
        new = self._written(suffixes.groupBy("gram").agg(F.count("*").alias("n")), "level0")
        while rank in self.levels:
            old = self.levels.pop(rank)
            rank += 1
            merged = self._written(self._scanned(self.spark.table(old), self.spark.table(new)), f"level{rank}")
            self._drop(old)
            self._drop(new)
            new = merged
        self.levels[rank] = new

    def repeated(self) -> DataFrame:
        """(gram): the suffixes that stand in two places or more, over all levels."""
        level = None
        for rank in sorted(self.levels):  # the small ones first
            other = self.spark.table(self.levels[rank])
            level = other if level is None else self._scanned(level, other)
        return level.where("n > 1").select("gram")

    def drop(self) -> None:
        for name in self.levels.values():
            self._drop(name)
        self.levels = {}


def _salted(many: DataFrame, few: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """The rows of ``many`` that have a key of ``few``; a key's rows are dealt to ``SALTS`` tasks by ``spread``."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    every = few.select(*keys, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
    return many.withColumn("_salt", salt).join(every, [*keys, "_salt"], "left_semi").drop("_salt")


def settle(places: DataFrame, *place: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split places (core, span and the place's own columns): those whose span
    another place has too, and those to be looked at in smaller groups.

    Of the latter are all places that share their core with another span; of
    places with one span the first stands for all. The first are written, the
    second read the third, a written table.
    """
    spans = materialise(places.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first")), "spans")
    cores = spans.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
    full = materialise(_salted(places, spans.where("n > 1"), ["core", "span"], list(place)).select("row", "first", "last"), "full")
    open_ = _salted(spans, cores, ["core"], ["span"]).select("first.*")
    return full, open_, spans


def repeated_ranges(texts: DataFrame, length: int = 200, batches: int | None = None) -> DataFrame:
    """(row, start, end) of ranges whose union is what repeated strings of ``length`` cover.

    ``texts`` has row (a unique number) and text, and is read several times. Unless
    stated, the number of batches follows that of sampled suffixes.
    """
    suffixes = materialise(sampled_suffixes(texts, length), "suffixes")
    batches = batches or max(LEAST_BATCHES, -(-suffixes.count() // BATCH_SUFFIXES))
    # a batch is a range of rows, which lie together in the written table
    borders = sorted({int(x) for x in texts.approxQuantile("row", [i / batches for i in range(1, batches)], 0.01)})
    family = IndexFamily(texts.sparkSession)
    for low, high in zip([None, *borders], [*borders, None], strict=True):
        batch = suffixes if low is None else suffixes.where(F.col("row") >= low)
        family.add((batch if high is None else batch.where(F.col("row") < high)).select("gram"))
    repeated = family.repeated().select(F.xxhash64("gram").alias("core")).distinct()
    places = suffixes.withColumn("core", F.xxhash64("gram")).drop("gram")
    shared = materialise(_salted(places, repeated, ["core"], ["row", "pos"]), "shared")
    discard(suffixes)
    family.drop()

    full, open_, spans = settle(shared, "row", "pos", "first", "last")
    discard(shared)
    near = open_.groupBy("row").agg(F.collect_list(F.struct("pos", "first", "last")).alias("at"))
    around = texts.join(near.hint("shuffle_hash"), "row").select("row", "text", "at")

    def surroundings(batches_):
        """The bytes of the strings of each anchor."""
        import pyarrow as pa

        names, kinds = ["row", "pos", "first", "bytes"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches_:
            out = [[] for _ in names]
            for row, text, at in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("at").to_pylist(), strict=True):
                for a in at:
                    for column, v in zip(out, (row, a["pos"], a["first"], text[a["first"] : a["last"] + length]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    ranges = materialise(around.mapInArrow(surroundings, "row bigint, pos int, first int, bytes binary"), "ranges")
    discard(spans)
    def hashed(digest, data, start, end, salt):
        """Digests of ranges of bytes, each seeded with its salt."""
        return [digest(data[a:b], c) for a, b, c in zip(start.tolist(), end.tolist(), salt.tolist(), strict=True)]

    reach = length - GRAM  # the most bytes from a string's start to its anchor

    def laid_out(batch):
        """The rows' numbers, starts by distance from the farthest possible one, and fingerprints of all bytes."""
        import numpy as np

        data = batch.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        row, pos, first = (batch.column(c).to_numpy().astype(np.int64) for c in ("row", "pos", "first"))
        low = first - (pos - reach)
        joined = b"".join(data)
        return row, pos, low, low + sizes - length, begin - low, Fingerprints(np.frombuffer(joined, np.uint8)), joined

    def groups(batches_):
        """The groups of string starts of each anchor, with core and span."""
        import numpy as np
        import xxhash

        for batch in batches_:
            if not batch.num_rows:
                continue
            row, pos, low, high, base, prints, joined = laid_out(batch)
            count = high // STARTS - low // STARTS + 1
            i = np.repeat(np.arange(len(row)), count)
            part = np.arange(len(i)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) + low[i] // STARTS
            s0, s1 = np.maximum(part * STARTS, low[i]), np.minimum(part * STARTS + STARTS - 1, high[i])
            inner = np.minimum(part * STARTS + STARTS - 1, reach)
            core = prints.of(base[i] + inner, base[i] + part * STARTS + length, part + 1)
            span = hashed(xxhash.xxh3_64_intdigest, joined, base[i] + s0, base[i] + s1 + length, s0 * 256 + s1)
            at = pos[i] - reach
            yield _batch((row[i], pos[i].astype("i4"), (at + s0).astype("i4"), (at + s1).astype("i4"), core.view(np.int64), np.array(span, np.uint64).view(np.int64)), ["row", "pos", "first", "last", "core", "span"])

    parts = materialise(ranges.mapInArrow(groups, "row bigint, pos int, first int, last int, core bigint, span bigint"), "parts")
    full_parts, open_parts, spans = settle(parts, "row", "pos", "first", "last")
    discard(parts)
    wanted = open_parts.groupBy("row", "pos").agg(F.collect_list(F.struct(F.col("first").alias("a"), F.col("last").alias("b"))).alias("wanted"))

    def strings(batches_):
        """The single strings of groups."""
        import numpy as np
        import xxhash

        for batch in batches_:
            if not batch.num_rows:
                continue
            row, pos, low, high, base, _, joined = laid_out(batch)
            wanted = batch.column("wanted")
            i = np.repeat(np.arange(len(row)), wanted.value_lengths().to_numpy())
            a, b = (wanted.flatten().field(k).to_numpy().astype(np.int64) - (pos[i] - reach) for k in (0, 1))
            # a run that was cut between pieces of a text has two rows of one anchor, each with its own starts
            own = (a >= low[i]) & (b <= high[i])
            i, a, b = i[own], a[own], b[own]
            count = b - a + 1
            j = np.repeat(i, count)
            s = np.arange(len(j)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) + np.repeat(a, count)
            for k in range(0, len(j), 200_000):
                part, start = j[k : k + 200_000], s[k : k + 200_000]
                digest = np.frombuffer(b"".join(hashed(xxhash.xxh3_128_digest, joined, base[part] + start, base[part] + start + length, start)), "<i4").reshape(-1, 4)
                yield _batch((row[part], (pos[part] - reach + start).astype("i4"), np.ascontiguousarray(digest[:, :2]).view("<i8").ravel(), digest[:, 2]), ["row", "first", "core", "more"])

    single = materialise(ranges.join(wanted, ["row", "pos"]).mapInArrow(strings, "row bigint, first int, core bigint, more int"), "strings")
    discard(ranges, spans)
    twice = single.groupBy("core", "more").agg(F.count("*").alias("n")).where("n > 1").select("core", "more")
    found = _salted(single, twice, ["core", "more"], ["row", "first"]).select("row", "first", F.col("first").alias("last"))
    runs = found.unionByName(full).unionByName(full_parts)
    return runs.select("row", F.col("first").alias("start"), (F.col("last") + length).alias("end"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, batches: int | None = None, keep_text: bool = True) -> DataFrame:
    """Each row with the bytes of repeated strings removed.

    Adds n_bytes, n_removed, n_spans, kept_sha256 and kept (binary: a cut may fall
    within a character) to the columns of ``docs``. Without ``keep_text``, the
    text and kept are left out.
    """
    rows = with_row_id(docs, "_row")
    texts = rows.select(F.col("_row").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranges = repeated_ranges(texts, length, batches)
    by_row = ranges.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("_ranges")).withColumnRenamed("row", "_row")
    joined = rows.join(by_row.hint("shuffle_hash"), "_row", "left").drop("_row")
    outputs = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")] + [("kept", "binary")] * keep_text

    def make():
        import hashlib

        def one(t, ranges):
            t = t or b""
            merged = []
            for r in sorted((r["start"], r["end"]) for r in ranges or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            kept, done = [], 0
            for a, b in merged:
                kept.append(t[done:a])
                done = b
            kept = b"".join([*kept, t[done:]])
            return (len(t), len(t) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept)[: len(outputs)]

        return lambda texts, ranges: list(zip(*map(one, texts, ranges), strict=True))

    joined = joined.withColumn("_bytes", F.col(text).cast("string"))
    return add_columns(joined if keep_text else joined.drop(text), ["_bytes", "_ranges"], outputs, make, drop=("_ranges", "_bytes"))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 200 bytes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False)
