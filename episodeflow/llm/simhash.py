"""SimHash near duplicates by a binary trie self-join.

Method
------
Fingerprints of word shingles are linked when they differ in at most ``budget``
bits. Equal fingerprints are one node from the start. A fingerprint is cut into
four blocks of 16 bits; two that differ in two bits agree in at least two whole
blocks, so each of the six choices of two blocks deals the distinct fingerprints
out by those 32 bits, and each pair to be linked meets at least once. The
fingerprints that meet form a binary trie over all 64 bits, its agreed bits
first. The trie is joined with itself from the root: pairs of nodes descend
together, the bits in which their paths differ add up, and a pair is dropped as
soon as they exceed the budget. What is left at the leaves are the links.

A pair of nodes is a row of a NumPy table and a whole level is expanded at once;
a table that grows past ``FRONTIER`` rows is worked off in pieces, so memory is
bounded whatever the data. A fingerprint has at most 2,080 others within two
bits, so links grow with the distinct fingerprints alone.

A group of equal agreed bits may be as large as a family of near copies is. It
is sorted and read as a stream. A group beyond ``GROUP`` fingerprints is dealt
out once more in the same way by its other 32 bits, in four blocks of 8; with 48
bits agreed a group has 65,536 distinct fingerprints at most.

For near copies that differ in more bits than that, ``similar_groups`` deals
fingerprints out by random choices of bits, joins the tries with a wider budget
and holds each link found against the shingles of its texts. What this leaves
apart meets once more by the rarest of its shingles, so that no link is lost.
Links of texts that differ too much by the parities of their shingles are dropped
before any set is read, and the sets of the others are sent in bounded waves.

Defined cases: a text without words, null included, has fingerprint zero and is
linked like any other; a text with fewer words than a shingle is one shingle; a
null id is never the smallest (a component of null ids only has a null id);
repeated rows are kept, each with its component; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, discard, materialise, materialise_parts, read_table, slices, small_side, with_row_id
from .components import connected_components

FRONTIER = 400_000
GROUP = 20_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes | None, shingle_words: int):
    """The hashes of a text's shingles in their order."""
    import numpy as np
    import xxhash

    digest, k = xxhash.xxh64_intdigest, shingle_words
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - k + 1].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(packed) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit integer."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(packed), 65_536):  # 64 bytes for each hash at most at a time
        counts += np.unpackbits(packed[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(packed), bitorder="little").view("<i8")[0])


def second_fingerprint(packed) -> int:
    """A further fingerprint, of the same hashes mixed."""
    import numpy as np

    mixed = (packed ^ packed >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return majority(mixed ^ mixed >> np.uint64(29))


def fingerprint_of(shingle_words: int):
    """A function from a text's bytes to its fingerprint as a signed 64-bit integer."""
    return lambda text: majority(shingle_hashes(text, shingle_words))


def with_fingerprint(docs: DataFrame, text: str = "text", shingle_words: int = 3, name: str = "fp", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the fingerprint of each whole text as a long."""

    def make():
        of = fingerprint_of(shingle_words)
        return lambda texts: [[of(t) for t in texts]]

    return add_columns(docs, [text], [(name, "bigint")], make, drop=drop)


def trie_pairs(left, right, same: bool, budget: int, order: list[int]):
    """Yield (i, j) index arrays of the pairs of two sorted tries within ``budget`` bits.

    ``left`` and ``right`` are sorted arrays of distinct keys whose bit ``order[0]``
    is decided first. With ``same`` they are one trie and pairs come once.
    """
    import numpy as np

    if not len(left) or not len(right):
        return
    one = lambda x: np.array([x], np.int64)
    stack = [(0, one(0), one(len(left)), one(0), one(len(right)), one(0), np.array([same]))]
    while stack:
        depth, a0, a1, b0, b1, bits, own = stack.pop()
        if len(a0) > FRONTIER:
            for part in np.array_split(np.arange(len(a0)), -(-len(a0) // (FRONTIER // 2))):
                stack.append((depth, *(x[part] for x in (a0, a1, b0, b1, bits, own))))
            continue
        if depth == len(order):
            keep = ~own
            yield a0[keep], b0[keep]
            continue
        bit = np.uint64(order[depth])
        am, bm = _middle(left, a0, a1, bit), _middle(right, b0, b1, bit)
        parts = []
        for ax0, ax1, bx0, bx1, differ in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            live = (ax0 < ax1) & (bx0 < bx1) & (bits + differ <= budget)
            if differ:
                if ax0 is am:
                    live &= ~own  # of a node with itself, the halves meet once
                parts.append((ax0[live], ax1[live], bx0[live], bx1[live], bits[live] + 1, np.zeros(int(live.sum()), bool)))
            else:
                live &= ~(own & (ax1 - ax0 == 1))  # a lone fingerprint has no partner
                parts.append((ax0[live], ax1[live], bx0[live], bx1[live], bits[live], own[live]))
        merged = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if len(merged[0]):
            stack.append((depth + 1, *merged))


def _middle(keys, lo, hi, bit):
    """For nodes that are ranges of sorted keys, where the keys with the bit set begin."""
    import numpy as np

    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        set_ = np.zeros(len(lo), bool)
        set_[open_] = (keys[mid[open_]] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)


def rotations() -> list[list[int]]:
    """For each choice of two of four blocks, these two and the two others."""
    return [[*pair, *(b for b in range(4) if b not in pair)] for pair in combinations(range(4), 2)]


def _components(a, b):
    """The nodes of links, the links as places of nodes, and which links join something new, in their order."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    n = len(a)
    new = np.zeros(n, bool)
    for x, (i, j) in enumerate(zip(at[:n].tolist(), at[n:].tolist(), strict=True)):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            new[x] = True
    return nodes, parent, new


def _star(a, b):
    """Links of each node to the least of its component: the components are the same."""
    import numpy as np

    nodes, parent, _ = _components(a, b)
    for i in range(len(nodes)):
        parent[i] = parent[parent[i]]
    root = np.array(parent)
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def _nearest_forest(a, b):
    """Those of the links that join something new when the nearest are taken first."""
    import numpy as np

    order = np.argsort(np.bitwise_count(a ^ b), kind="stable")
    a, b = a[order], b[order]
    _, _, new = _components(a, b)
    return a[new], b[new]


def near_links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints in the column fp.

    Their components are those of all links within ``budget`` (2 at most) bits;
    a link that others of the same task already join may be left out.
    """
    if not 0 <= budget <= 2:
        raise ValueError("two of four blocks agree for up to two differing bits only")
    word = lambda x, shift, mask: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask))
    beside = lambda a, bits, b: F.shiftleft(a, bits).bitwiseOR(b)
    blocks = [word(F.col("fp"), 48 - 16 * b, 0xFFFF) for b in range(4)]
    keys = []
    for r, (i, j, m, n) in enumerate(rotations()):
        keys.append(F.struct(beside(beside(blocks[i], 16, blocks[j]), 3, F.lit(r)).alias("g"), beside(blocks[m], 16, blocks[n]).alias("rest")))
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.g", "x.rest", "fp")
    large = dealt.groupBy("g").count().where(F.col("count") > GROUP).select("g")
    blocks = [word(F.col("rest"), 24 - 8 * b, 0xFF) for b in range(4)]
    again = [beside(beside(F.col("g"), 16, beside(blocks[i], 8, blocks[j])), 3, F.lit(r)).bitwiseOR(F.lit(1 << 60)) for r, (i, j, _, _) in enumerate(rotations())]
    finer = dealt.join(large, "g", "left_semi").select(F.explode(F.array(*again)).alias("g"), "fp")
    dealt = dealt.join(large, "g", "left_anti").select("g", "fp").unionByName(finer)
    return _meet(dealt, budget, 16, _star).select("a", "b")


def whole_groups(batches, columns: list[str]):
    """Of batches sorted by the first column: its groups, whole, in arrays of some 100,000 rows."""
    import numpy as np

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        rows += batch.num_rows
        if rows < 100_000:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        end = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
        if end:
            yield [x[:end] for x in whole]
        held, rows = [[x[end:] for x in whole]], len(whole[0]) - end
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _meet(dealt: DataFrame, budget: int, leaf: int, links) -> DataFrame:
    """Links (a, b) within groups of the rows (g, fp), as ``links`` thins them out.

    A group is a trie that is joined with itself; one of ``leaf`` fingerprints or
    fewer is a leaf, compared as it is. Where the rows have a second fingerprint
    fp2, it must be within the budget too.
    """
    columns = [c for c in ("g", "fp", "fp2") if c in dealt.columns]

    def join(batches):
        import numpy as np
        import pyarrow as pa

        bits = list(range(63, -1, -1))

        def found(g, k, *more):
            """Of whole groups in rows sorted by g: their links."""
            order = np.lexsort((k, g))
            k, more = k[order], [m[order] for m in more]
            cut = np.flatnonzero(np.diff(g)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(g)]
            sizes = ends - starts
            pairs = []
            for n in range(2, leaf + 1):  # leaves of one size together
                at = starts[sizes == n]
                for step in range(0, len(at), max(1, 2_000_000 // (n * n))):
                    some = at[step : step + max(1, 2_000_000 // (n * n))]
                    i, j = np.triu_indices(n, 1)
                    i, j = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    near = np.bitwise_count(k[i] ^ k[j]) <= budget
                    pairs.append((i[near], j[near]))
            for s, e in zip(starts[sizes > leaf].tolist(), ends[sizes > leaf].tolist(), strict=True):
                for i, j in trie_pairs(k[s:e], k[s:e], True, budget, bits):
                    pairs.append((i + s, j + s))
            if not pairs:
                return None
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            for m in more:
                near = np.bitwise_count(m[i] ^ m[j]) <= budget
                i, j = i[near], j[near]
            return links(k[i], k[j]) if len(i) else None

        def batch_of(*rows):
            got = found(*rows)
            return [pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in got], names=["a", "b"])] if got else []

        for group in whole_groups(batches, columns):
            yield from batch_of(*[group[0], *[x.view(np.uint64) for x in group[1:]]])

    partitions = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(partitions, "g").sortWithinPartitions("g").select(*columns).mapInArrow(join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, budget: int = 2) -> DataFrame:
    """Each row's id, fingerprint (16 hex digits) and component.

    component_id is the smallest id reachable over links. Only ids and
    fingerprints are shuffled, never texts.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = materialise(with_fingerprint(docs, "text", shingle_words, drop=("text",)), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(near_links(nodes.select("fp"), budget)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sampled_links(fps: DataFrame, budget: int = 16, tables: int = 80, bits: int | None = None, seed: int = 11) -> DataFrame:
    """Likely links (a, b) within up to ``budget`` bits, nearest first.

    Beyond two bits no few blocks must agree, so each of ``tables`` random choices
    of ``bits`` bits deals the fingerprints out, and those that agree there meet.
    Unless stated, bits follow the number of written ``fps``, so that groups stay
    at some 16 fingerprints however many there are. With 14 bits (262,144
    fingerprints), a link of nine bits is met with a probability of 0.9995, one of
    eleven with 0.98, one of fourteen with 0.79. A second fingerprint (fp2) must be as near,
    which leaves hardly any link by chance. Of a group's links, a forest of the
    nearest is returned; each is a pair that did meet.
    """

    bits = bits or max(14, fps.count().bit_length() - 5)

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(seed)
        chosen = [rng.choice(64, bits, replace=False).astype(np.uint64) for _ in range(tables)]
        for batch in batches:
            signed, other = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "fp2"))
            for at in range(0, len(signed), 20_000):
                part = signed[at : at + 20_000].view(np.uint64)
                keys = [np.bitwise_or.reduce([((part >> b) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(c)]).astype(np.int64) | t << bits for t, c in enumerate(chosen)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(part.view(np.int64), tables)), pa.array(np.tile(other[at : at + 20_000], tables))], names=["g", "fp", "fp2"])

    dealt = fps.select("fp", "fp2").mapInArrow(deal, "g bigint, fp bigint, fp2 bigint")
    return _meet(dealt, budget, 64, _nearest_forest).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Texts whose shingles are counted to tell common ones, and how many of these are held.
ORDER_SAMPLE, ORDER_SHINGLES = 5_000, 1_000_000


def _common_shingles(docs: DataFrame, shingle_words: int):
    """Hashes (ascending) and counts of shingles that several of some texts hold.

    They only order shingles: with other texts, as many links are found, by more work.
    """
    import numpy as np

    step = max(1, docs.count() // ORDER_SAMPLE)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            for t in batch.column("text").cast(pa.large_binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, shingle_words)).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("text").mapInArrow(run, "h bigint")
    top = some.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toArrow()
    hashes, counts = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order].astype(np.int32)


def _profiles(docs: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """(row, fp, fp2, n, shingles, bits, mark, prefix) of texts (row, text).

    n is the number of a text's different shingles, ``shingles`` a digest of their
    set, ``bits`` their parities and ``mark`` those of ``MARK`` places. The prefix holds so many of them, rare ones first, that no text can
    be similar that has none of these in its own prefix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, shingle_words))

    def make():
        import math

        import numpy as np
        import xxhash

        common, counts = shared.value

        def apply(texts):
            out = [[] for _ in range(7)]
            for t in texts:
                packed = shingle_hashes(t, shingle_words)
                own = np.unique(packed)
                size = len(own) - math.ceil(similarity * len(own) - 1e-6) + 1 if len(own) else 0
                count = np.zeros(len(own), np.int32)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    count = np.where(common[at] == own, counts[at], 0)
                prefix = own[np.argsort(count, kind="stable")[:size]]
                for column, x in zip(out, (majority(packed), second_fingerprint(packed), len(own), xxhash.xxh3_128_digest(own.tobytes()), parities(own), parities(own, MARK), prefix.tobytes()), strict=True):
                    column.append(x)
            return out

        return apply

    return add_columns(docs, ["text"], [("fp", "bigint"), ("fp2", "bigint"), ("n", "bigint"), ("shingles", "binary"), ("bits", "binary"), ("mark", "binary"), ("prefix", "binary")], make, drop=("text",))


def parities(own, places: int | None = None) -> bytes:
    """Of distinct hashes dealt to as many places or up to twice as many: whether a place has an odd number.

    The places are a power of two, from 64 on, and given by the hash's low bits.
    """
    import numpy as np

    places = places or 1 << max(6, (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """So many hashes at least are in one of two sets alone, by their parities."""
    import numpy as np

    x, y = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
    while len(y) > len(x):  # with half the places, two of them are one
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


#: Bytes of parities or sets that are sent to their links at a time, where one for each shingle of all texts is less.
WAVE_BYTES = 64_000_000


def _held(links: DataFrame, docs: DataFrame, profiles: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """Those of the written links (a, b) of rows whose whole sets of shingles are as similar, written.

    Sets of too different sizes go first, then those whose parities show that they
    differ in too many shingles; only what is left is held against the sets. Each
    link takes a copy of what it is judged by. So links are dealt by hash to waves,
    worked off one by one, and the copies of a wave take a bounded share of the
    bytes of the texts, however many links there are.
    """
    of = lambda table, column, end: table.select(F.col("row").alias(end), F.col(column).alias(f"{column}_{end}"))
    both = lambda part, table, column: part.join(of(table, column, "a"), "a").join(of(table, column, "b"), "b")
    sizes = materialise(profiles.select("row", "n"), "sizes")
    sized = links.join(small_side(sizes).toDF("a", "n_a"), "a").join(small_side(sizes).toDF("b", "n_b"), "b")
    sized = materialise(sized.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(similarity) - 1e-6), "sized")
    at_once = max(WAVE_BYTES, sizes.agg(F.sum("n")).first()[0] or 0)

    def waves(written, bytes_each):
        """``bytes_each`` is what a shingle takes."""
        total = written.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0
        n = max(1, -int(-total * bytes_each // at_once))
        for wave in range(n):
            yield written.where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == wave)

    def by_parities():
        most = (1 - similarity) / (1 + similarity)
        return lambda xs, ys, ns, ms: [[least_difference(x, y) <= most * (n + m) + 1e-6 for x, y, n, m in zip(xs, ys, ns, ms, strict=True)]]

    def likely():
        for part in waves(sized, 0.25):
            paired = both(part, profiles, "bits")
            judged = add_columns(paired, ["bits_a", "bits_b", "n_a", "n_b"], [("likely", "boolean")], by_parities, drop=("bits_a", "bits_b"))
            yield judged.where("likely").select("a", "b", "n_a", "n_b")

    def sets():
        import numpy as np

        return lambda texts: [[np.unique(shingle_hashes(t, shingle_words)).tobytes() for t in texts]]

    def by_sets():
        import numpy as np

        def apply(xs, ys):
            out = []
            for x, y in zip(xs, ys, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append(common / (len(x) + len(y) - common) if len(x) + len(y) else 1.0)
            return [out]

        return apply

    def similar(left):
        for part in waves(left, 8):
            ends = materialise(part.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ends")
            whole = materialise(add_columns(docs.join(small_side(ends), "row").select("row", "text"), ["text"], [("set", "binary")], sets, drop=("text",)), "sets")
            judged = add_columns(both(part.select("a", "b"), whole, "set"), ["set_a", "set_b"], [("similarity", "double")], by_sets, drop=("set_a", "set_b"))
            yield judged.where(F.col("similarity") >= similarity).select("a", "b")
            discard(ends, whole)

    left = materialise_parts(likely(), "likely")
    found = materialise_parts(similar(left), "held")
    discard(sizes, sized, left)
    return found


#: Places of the parities that go with a node to where it meets others; they tell texts of up to some 2,000 shingles apart.
MARK = 1_024

#: Nodes of one shingle beyond which its group is cut into pieces.
PIECE = 2_000


def _in_pieces(dealt: DataFrame) -> DataFrame:
    """Rows (g, row, root, n, at) that meet nodes of other roots, with the pieces they meet in.

    Groups of one root are counted, not moved. A group of more than ``PIECE`` rows
    is cut into blocks, those of its most frequent root apart from the others', and
    any two blocks make a piece, unless both are of that root. In a piece of one
    block ``side`` is -1; in others only rows of different sides need to meet.
    """
    met = dealt.groupBy("g").agg(F.count("*").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    met = materialise(met.where("lo <> hi").select("g", "rows"), "met")
    large = materialise(met.where(F.col("rows") > PIECE).select("g"), "large")
    most = dealt.join(small_side(large), "g").groupBy("g", "root").count().groupBy("g").agg(F.max(F.struct("count", "root")).alias("x"), F.sum("count").alias("all"))
    blocks = lambda rows: F.ceil(rows / F.lit(PIECE)).cast("int")
    most = most.select("g", F.col("x.root").alias("most"), blocks(F.col("x.count")).alias("own"), blocks(F.col("all") - F.col("x.count")).alias("rest"))
    cut = dealt.join(small_side(materialise(most, "blocks")), "g")
    of = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    cut = cut.withColumn("block", F.when(F.col("root") == F.col("most"), of("own")).otherwise(F.col("own") + of("rest")))
    first = F.when(F.col("root") == F.col("most"), F.col("own")).otherwise(F.lit(0))
    cut = cut.withColumn("other", F.explode(F.sequence(first, F.col("own") + F.col("rest") - 1)))
    piece = F.xxhash64("g", F.least("block", "other"), F.greatest("block", "other"))  # pieces of one hash only meet once more
    cut = cut.select(piece.alias("g"), "row", "root", "n", "at", F.signum(F.col("block") - F.col("other")).cast("int").alias("sign"))
    cut = cut.select("g", "row", "root", "n", "at", F.when(F.col("sign") == 0, -1).when(F.col("sign") < 0, 0).otherwise(1).alias("side"))
    whole = dealt.join(small_side(materialise(met.where(F.col("rows") <= PIECE).select("g"), "small")), "g").withColumn("side", F.lit(-1))
    return whole.unionByName(cut)


def _other_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of nodes (row, root, n, prefix, mark) of different roots that may be similar.

    Two similar texts share a shingle of both prefixes, so the nodes that hold one
    meet. A pair is left out where, were that shingle their first in common, too
    few shingles are left behind it; at their first one in common it never is. It is
    also left out where the marks, if nodes have any, differ too much.
    """
    columns = ["g", "row", "root", "n", "at"]
    marked = "mark" in nodes.columns

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                prefixes = part.column("prefix").to_pylist()
                sizes = np.array([len(x) // 8 for x in prefixes])
                row, root, n = (np.repeat(part.column(c).to_numpy(), sizes) for c in ("row", "root", "n"))
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), np.int64)), pa.array(row), pa.array(root), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], names=columns)

    def join(batches):
        import numpy as np
        import pyarrow as pa

        share = similarity / (1 + similarity)
        most = (1 - similarity) / (1 + similarity)

        def places(g, root):
            """Pairs of places of different roots within groups, in pieces of bounded size."""
            cut = np.flatnonzero((np.diff(g) != 0) | (np.diff(root) != 0)) + 1
            runs = np.r_[cut, len(g)]
            after = runs[np.searchsorted(runs, np.arange(len(g)), side="right")]
            end = np.searchsorted(g, g, side="right")
            sizes = end - after
            total = np.cumsum(sizes)
            at = 0
            while at < len(g):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2_000_000, side="right")))
                some = sizes[at:to]
                i = np.repeat(np.arange(at, to), some)
                j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(after[at:to], some)
                yield i, j
                at = to

        def near(marks, n, i, j):
            """Those of the pairs of places whose marks differ in few enough bits."""
            kept = [(i[:0], j[:0])]
            for part in range(0, len(i), 50_000):
                x, y = i[part : part + 50_000], j[part : part + 50_000]
                may = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64) <= most * (n[x] + n[y]) + 1e-6
                kept.append((x[may], y[may]))
            return (np.concatenate(x) for x in zip(*kept, strict=True))

        def found(g, row, root, n, at, side, mark=None):
            order = np.lexsort((root, g))
            g, row, root, n, at, side = (x[order] for x in (g, row, root, n, at, side))
            marks = np.frombuffer(b"".join(mark[order]), np.uint64).reshape(len(g), -1) if marked else None
            for i, j in places(g, root):
                left = np.minimum(n[i] - at[i], n[j] - at[j])
                may = (left >= share * (n[i] + n[j]) - 1e-6) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
                may &= (side[i] < 0) | (side[i] != side[j])
                i, j = i[may], j[may]
                if marked:
                    i, j = near(marks, n, i, j)
                a, b = np.maximum(row[i], row[j]), np.minimum(row[i], row[j])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for group in whole_groups(batches, [*columns, "side", *(["mark"] if marked else [])]):
            yield from found(*group)

    dealt = nodes.select("row", "root", "n", "prefix").mapInArrow(deal, "g bigint, row bigint, root bigint, n int, at int")
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = _in_pieces(dealt)
    if marked:  # only what meets others is given its mark
        pieces = pieces.join(nodes.select("row", "mark"), "row").select(*columns, "side", "mark")
    return pieces.repartition(partitions, "g").sortWithinPartitions("g").mapInArrow(join, "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """(row, group) of texts (row, text): rows of one group are near copies.

    Links join texts of a Jaccard similarity of ``similarity`` or more, of their
    whole sets of shingles; the groups are the components of all such links. Equal
    sets are one node. The likely links come first: those of ``sampled_links`` and
    ``near_links`` and between nodes of one fingerprint. All pairs that these leave
    in different groups are then met by ``_other_links``, which loses none. Each
    link is held against the sets. The group's name is its smallest row number.
    The result is a written table; those on the way are deleted.
    """
    docs = docs.select("row", "text")
    profiles = materialise(_profiles(docs, similarity, shingle_words), "profiles")
    nodes = materialise(profiles.groupBy("shingles").agg(F.min(F.struct("row", "fp", "fp2")).alias("x")).select("shingles", "x.*"), "nodes")
    firsts = materialise(nodes.groupBy("fp").agg(F.min(F.struct("row", "fp2")).alias("x")).select("fp", "x.*"), "firsts")
    of = lambda c: firsts.select(F.col("fp").alias(f"fp_{c}"), F.col("row").alias(c))
    near = sampled_links(firsts).unionByName(near_links(firsts.select("fp"), 2)).toDF("fp_a", "fp_b")
    near = near.join(of("a"), "fp_a").join(of("b"), "fp_b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    equal = nodes.select("fp", F.col("row").alias("a")).join(firsts.select("fp", F.col("row").alias("b")), "fp").where("a <> b").select("a", "b")
    links = materialise(near.unionByName(equal).distinct(), "links")
    held = _held(links, docs, profiles, similarity, shingle_words)
    roots = connected_components(held).withColumnRenamed("node", "row")
    rooted = materialise(nodes.select("row").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "rooted")
    others = materialise(_other_links(profiles.join(small_side(rooted), "row"), similarity), "others")
    more = _held(others, docs, profiles, similarity, shingle_words)
    joined = rooted.select(F.col("row").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = connected_components(joined).withColumnRenamed("node", "row")
    groups = nodes.select("shingles", "row").join(roots, "row", "left").select("shingles", F.coalesce("root", "row").alias("group"))
    found = materialise(profiles.select("row", "shingles").join(groups, "shingles").select("row", "group"), "groups")
    discard(profiles, nodes, firsts, links, held, rooted, others, more)
    return found


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents over shingles of three words."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=3)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies one row stays, the first of the table.

    Shingles have five words here, and copies a similarity of 0.8 or more.
    """
    docs = with_row_id(docs)
    groups = similar_groups(docs.select(F.col("_row").alias("row"), F.col("text").cast("string").alias("text")))
    gone = materialise(groups.where("row <> group").select(F.col("row").alias("_row")), "copies")
    return docs.join(small_side(gone), "_row", "left_anti").drop("_row")
