"""Byte-level BPE encoding and decoding over a trie of distinct words.

Method
------
A text is cut into words by the vocabulary's pattern. The words of a batch that
no earlier batch of the task has met are put in a trie (kept implicitly: sorted
words are its nodes in depth-first order, and the common prefix of neighbours is
the path they share). The trie is traversed depth-first. Each node holds one
state: the last token of the encoding of the bytes on its path. That token is
the one token which ends there and may follow the last token of the node where
it starts; two tokens may follow one another if encoding their joined bytes
gives just the two. So the encoding of a shared prefix is found once, and a
word's encoding is read by walking back along the last tokens.

The states of a task are bounded: the tables of known words and of known pairs of
tokens are emptied when they reach ``KNOWN_WORDS`` and ``KNOWN_PAIRS`` entries,
which changes the cost and never the result.

Defined cases: a null text is an empty text and has no tokens; repeated rows are
encoded each; an empty table gives an empty result; other columns pass through,
and one with the name of an output column is replaced.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

from .common import add_columns, read_table

#: The word pattern of this family of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_WORDS, KNOWN_PAIRS = 200_000, 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file.

    Bytes that print stand for themselves, the others take the code points from
    256 on.
    """
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}


def load_vocabulary(path: str) -> dict:
    """Token bytes by id, the two halves of each merge and the special tokens.

    Raises ValueError where the file is of a kind whose results would differ:
    this encoder needs merges in the order of their ids and no normaliser.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("a byte-level BPE vocabulary without normaliser or prefix space is needed")
    byte_of, ids = printable_bytes(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        raise ValueError("special tokens that take neighbouring text are not supported")
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for text, i in ids.items():
        if text not in special:
            tokens[i] = bytes(byte_of[c] for c in text)
    for text, i in special.items():
        tokens[i] = text.encode()
    merges, before = {}, -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        made = ids[left + right]
        if made <= before:
            raise ValueError("merges must be in the order of their ids")
        before = made
        merges[made] = (ids[left], ids[right])
    return {"tokens": tokens, "merges": merges, "special": special}


class TrieEncoder:
    """Encodes words of bytes; see the module's text."""

    def __init__(self, vocabulary: dict):
        self.tokens: list[bytes] = vocabulary["tokens"]
        self.halves: dict[int, tuple[int, int]] = vocabulary["merges"]
        self.joined = {pair: made for made, pair in self.halves.items()}
        plain = set(self.halves) | {i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.ids = {self.tokens[i]: i for i in plain}
        self.longest = max(map(len, self.ids))
        self.follows: dict[tuple[int, int], bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of ``left`` and ``right`` gives just these two.

        The merges inside either token are undone from the latest to the
        earliest; a merge across the border that comes before one of those
        inside would have been made instead.
        """
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) > KNOWN_PAIRS:
                self.follows.clear()
            known = self.follows[left, right] = self._may_follow(left, right)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        joined, halves = self.joined, self.halves
        limit = len(self.tokens) + 1  # merges from this id on come too late to matter
        while True:
            across = joined.get((a, b))
            if across is not None and across < limit:
                return False
            # undo the later of the two tokens' own last merges: what touched the border before it
            if a > b:
                if a not in halves:
                    if b not in halves:
                        return True
                    limit, b = b + 1, halves[b][0]
                else:
                    limit, a = a, halves[a][1]
            elif b in halves:
                limit, b = b + 1, halves[b][0]
            elif a in halves:
                limit, a = a, halves[a][1]
            else:
                return True

    def encode_sorted(self, words: list[bytes]):
        """Yield (word, token ids) for distinct words in ascending order.

        ``last[d]`` is the state of the node at depth ``d`` on the present path.
        Moving to the next word goes up to the depth of the common prefix and
        down from there.
        """
        ids, may_follow, longest = self.ids, self.may_follow, self.longest
        last, path = [-1], b""
        for word in words:
            n = min(len(path), len(word))
            shared = n if path[:n] == word[:n] else next(i for i in range(n) if path[i] != word[i])
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = ids.get(word[start:end])
                    if token is not None and (start == 0 or may_follow(last[start], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError("a byte has no token")
            path = word
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at -= len(self.tokens[last[at]])
            yield word, out[::-1]


class TextCodec:
    """Encodes and decodes whole texts."""

    def __init__(self, vocabulary: dict):
        import regex

        self.words = regex.compile(WORD_PATTERN).findall
        self.trie = TrieEncoder(vocabulary)
        self.tokens = vocabulary["tokens"]
        self.special = {s: i.to_bytes(4, "little") for s, i in vocabulary["special"].items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        import array
        import sys

        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = sorted(w.encode() for w in words if w not in self.known)
        for word, ids in self.trie.encode_sorted(new):
            packed = array.array("I", ids)
            if sys.byteorder == "big":
                packed.byteswap()
            self.known[word.decode()] = packed.tobytes()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            group.append((text or b"").decode("utf-8", "replace"))
            size += len(group[-1])
            if size > 1_000_000:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.cut(t) if any(s in t for s in self.special) else [t] for t in texts]
        cut = [[p if i % 2 else self.words(p) for i, p in enumerate(ps)] for ps in pieces]
        known = self.known
        out = []
        new: set[str] = set()
        for parts in cut:
            for part in parts[::2]:
                new.update(part)
        self.learn(new)
        for parts in cut:
            out.append(b"".join([self.special[p] if i % 2 else b"".join([known[w] for w in p]) for i, p in enumerate(parts)]))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        import numpy as np

        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None, outputs: tuple[str, ...] = ("ids",), keep_text: bool = True) -> DataFrame:
    """Encode whole texts, and decode the ids again.

    ``outputs`` names the columns to add: ``n_tokens`` (long), ``ids`` (array of
    int), ``decoded`` (string), ``ids_sha256`` and ``decoded_sha256`` (lower-case
    hex of the ids as little-endian unsigned 32-bit integers, and of the decoded
    text in UTF-8). ``vocabulary`` is the path of the vocabulary file, read on
    the driver; its few MB go to the executors as one broadcast. Without
    ``keep_text`` the text itself isn't returned.
    """
    types = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary or default_vocabulary()))

    def make():
        import numpy as np

        codec = TextCodec(shared.value)

        def apply(texts):
            packed = codec.encode(texts)
            decoded = [codec.decode(p) for p in packed] if any(o.startswith("decoded") for o in outputs) else None
            made = {
                "n_tokens": lambda: [len(p) // 4 for p in packed],
                "ids": lambda: [np.frombuffer(p, "<i4") for p in packed],
                "decoded": lambda: decoded,
                "ids_sha256": lambda: [hashlib.sha256(p).hexdigest() for p in packed],
                "decoded_sha256": lambda: [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
            }
            return [made[o]() for o in outputs]

        return apply

    return add_columns(docs, [text], [(o, types[o]) for o in outputs], make, drop=() if keep_text else (text,))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


def encode_corpus(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: each document's ids, their number and the digest of the text that they decode to."""
    return encode_documents(docs, outputs=("n_tokens", "ids", "decoded_sha256"), keep_text=False)
