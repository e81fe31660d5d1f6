"""Benchmark decontamination by a generalised suffix automaton.

Method
------
The words of all benchmark items go into one generalised suffix automaton, whose
states stand for the runs of words that occur in items. A document's words are
streamed through it; at each word the automaton knows the longest run ending
there that occurs in some item. Where that run is as long as a window, the
state of the window's own length is found along the suffix links, and it knows
the items that hold the window.

Only runs of words that can hold a window are streamed: the first step of the
automaton is a table of known words and the second one of known word pairs, and
both are looked up for a whole text at once. This skips no match.

The benchmark is a set of stated size. It is read in blocks of at most
``BLOCK_BYTES`` of text (measured, not assumed); each block is one automaton and
one broadcast, and with several blocks the documents' results are merged by row.

Words: A-Z are lower-cased, then every maximal run of characters other than
ASCII signs, spaces and controls is a word. A window is ``window`` consecutive
words of an item; an item of fewer words, but not none, is one window.

Defined cases: null and empty texts have no words, as documents and as items;
repeated items with one id count once, and two items of one text each count; a
null item id is ignored; repeated document rows each get a result; an empty
benchmark hits nothing; other columns pass through, and one with the name of an
output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, read_table, with_row_id

BLOCK_BYTES = 8_000_000
#: Bytes that are no part of a word become spaces, A-Z become a-z.
FOLD = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class SuffixAutomaton:
    """The generalised suffix automaton of several word sequences.

    State 0 is the empty run. ``edges[s]`` maps a word's number to a state,
    ``size[s]`` is the longest run of the state and ``link[s]`` the state of its
    longest suffix that stands elsewhere too.
    """

    def __init__(self):
        self.edges, self.link, self.size = [{}], [-1], [0]

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _state(self, edges: dict, link: int, size: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The part of state q whose runs are no longer than p's with the symbol."""
        clone = self._state(dict(self.edges[q]), self.link[q], self.size[p] + 1)
        self.link[q] = clone
        while p != -1 and self.edges[p].get(symbol) == q:
            self.edges[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        q = self.edges[last].get(symbol)
        if q is not None:  # an earlier sequence has this run
            return q if self.size[q] == self.size[last] + 1 else self._split(last, symbol, q)
        new = self._state({}, 0, self.size[last] + 1)
        p = last
        while p != -1 and symbol not in self.edges[p]:
            self.edges[p][symbol] = new
            p = self.link[p]
        if p != -1:
            q = self.edges[p][symbol]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, symbol, q)
        return new

    def step(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest run after one more word."""
        edges, link, size = self.edges, self.link, self.size
        while state and symbol not in edges[state]:
            state = link[state]
            length = size[state]
        after = edges[state].get(symbol)
        return (0, 0) if after is None else (after, length + 1)


class ItemIndex:
    """The automaton of a block of items, with the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)] for _, t in items]
        self.automaton = sam = SuffixAutomaton()
        for t in texts:
            sam.add(t)
        self.shortest = min((min(window, len(t)) for t in texts if t), default=0)
        #: Of a state: the windows' lengths in it, each with its items.
        self.windows: dict[int, dict[int, set[int]]] = {}
        for i, t in enumerate(texts):
            m, state, length = min(window, len(t)), 0, 0
            for at, symbol in enumerate(t):
                state, length = sam.step(state, length, symbol)
                if m and at + 1 >= m:
                    self.windows.setdefault(self._suffix(state, m), {}).setdefault(m, set()).add(i)
        #: The nearest state on the way to the root that has windows, itself included.
        self.nearest = [-1] * len(sam.size)
        for s in sorted(range(1, len(sam.size)), key=sam.size.__getitem__):
            self.nearest[s] = s if s in self.windows else self.nearest[sam.link[s]]
        self.pairs, self._pairs = sorted({(a << 32) | b for t in texts for a, b in zip(t, t[1:], strict=False)}), None

    def _suffix(self, state: int, length: int) -> int:
        link, size = self.automaton.link, self.automaton.size
        while size[link[state]] >= length:
            state = link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit spans (start, end) of words, merged and ascending, and the items hit."""
        import numpy as np

        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.shortest:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        known = ids > 0
        if not known.any():
            return spans, found
        # borders where a run can't go on: an unknown word, or an unknown pair
        if self._pairs is None:
            self._pairs = np.array(self.pairs, np.int64)
        pairs = self._pairs
        key = (ids[:-1] << 32) | ids[1:]
        joined = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key if len(pairs) and len(key) else np.zeros(len(key), bool)
        first = np.flatnonzero(known & np.r_[True, ~joined])
        after = np.flatnonzero(known & np.r_[~joined, True]) + 1
        long = after - first >= self.shortest
        step, size, link, windows, nearest = self.automaton.step, self.automaton.size, self.automaton.link, self.windows, self.nearest
        for start, end in zip(first[long].tolist(), after[long].tolist(), strict=True):
            state = length = 0
            for at in range(start, end):
                state, length = step(state, length, int(ids[at]))
                s, longest = nearest[state], 0
                while s > 0:
                    for m, items in windows[s].items():
                        if m <= length:
                            found |= items
                            longest = max(longest, m)
                    s = nearest[link[s]]
                if longest:
                    begin = at + 1 - longest
                    while spans and begin <= spans[-1][1]:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at + 1))
        return spans, found


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
    """Yield lists of (item id as text, text) of at most ``block_bytes`` each.

    Items are fetched a partition at a time and a list is given up once full, so
    the driver holds one block. A longer item is a block of its own.
    """
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("t")).where("i is not null")
    block, held = [], 0
    for row in rows.toLocalIterator():
        if block and held + len(row.t) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.i, bytes(row.t)))
        held += len(row.t)
    if block:
        yield block


def match_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add to each row of ``docs`` what of its text occurs in benchmark items.

    n_words and n_hit (words), spans (array of {start, end} of hit words, end
    exclusive, merged) and items (sorted ids, as strings, of the items with
    windows that occur).
    """
    kind = "array<struct<start:int,end:int>>"
    outputs = [("n_words", "bigint"), ("n_hit", "bigint"), ("spans", kind), ("items", "array<string>")]
    sc = docs.sparkSession.sparkContext

    def over(source: DataFrame, block) -> DataFrame:
        shared = sc.broadcast(ItemIndex(block, window))

        def make():
            index = shared.value

            def apply(texts):
                out = [[], [], [], []]
                for t in texts:
                    words = words_of(t)
                    spans, found = index.match(words)
                    out[0].append(len(words))
                    out[1].append(sum(b - a for a, b in spans))
                    out[2].append([{"start": a, "end": b} for a, b in spans])
                    out[3].append(sorted({index.names[i] for i in found}))
                return out

            return apply

        return add_columns(source, [text], outputs, make)

    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return over(docs, first)
    docs = with_row_id(docs)
    slim = docs.select("_row", text)
    parts = over(slim, first).drop(text)
    merged = parts.unionByName(over(slim, second).drop(text))
    for block in blocks:
        merged = merged.unionByName(over(slim, block).drop(text))
    merged = merged.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumn("spans", F.expr(_MERGE)).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")).drop("s")
    keep = [c for c in docs.columns if c not in [n for n, _ in outputs]]
    return docs.select(keep).join(merged, "_row").drop("_row").select([c for c in keep if c != "_row"] + [n for n, _ in outputs])


_MERGE = """aggregate(s, cast(array() as array<struct<start:int,end:int>>), (a, x) ->
    if(size(a) > 0 and x.start <= element_at(a, -1).end,
       concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
       concat(a, array(x))))"""


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_run: int = 8, max_coverage: float = 0.5, window: int = 8, text: str = "text", min_item: int = 4) -> DataFrame:
    """Cut benchmark passages out of texts; drop texts that are mostly benchmark.

    Hit spans of at least ``max_run`` words are cut, from their first word's
    first character to their last word's last one. Spans shorter than a window
    are of items shorter than a window; these are cut from ``min_item`` words on,
    as fewer are too common to tell a leak. A row of which more than
    ``max_coverage`` of the words is hit goes altogether. Rows without hits keep
    their text as it is.
    """
    others = [c for c in docs.columns if c != text]
    held = docs.select(*([F.struct(*others).alias("_doc")] if others else []), text)
    matched = match_items(held, benchmark, text=text, window=window).where(F.expr(f"n_words = 0 or n_hit <= {float(max_coverage)}D * n_words"))

    def make():
        import re

        word = re.compile(rb"[^ ]+")

        def cut(t, spans):
            spans = [s for s in spans if (size := s["end"] - s["start"]) >= max_run or min_item <= size < window]
            if t is None or not spans:
                return None if t is None else t.decode()
            at = [m.span() for m in word.finditer(t.translate(FOLD))]
            out, done = [], 0
            for s in spans:
                out.append(t[done : at[s["start"]][0]])
                done = at[s["end"] - 1][1]
            return b"".join([*out, t[done:]]).decode()

        return lambda texts, spans: [[cut(t, s) for t, s in zip(texts, spans, strict=True)]]

    cleaned = add_columns(matched, [text, "spans"], [("_cleaned", "string")], make, drop=(text,))
    return cleaned.select([F.col("_cleaned").alias(text) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Which words of each document occur in benchmark windows, and of which items."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_items(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages of items are cut out, and rows that are mostly passages go."""
    return remove_spans(docs, read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
im AS (SELECT item_id, w, least(8, len(w)) AS m FROM iw WHERE len(w) > 0),
ix AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM im),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM ix),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dx AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT r, i, win.m, item FROM (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM dx) d JOIN win ON win.m = d.m AND win.s = d.s),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
