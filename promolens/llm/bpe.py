"""BPE encoding by a deterministic automaton compiled from the merges.

The automaton starts as one state that loops on the base symbols. Merge after
merge, a gadget is built in: where an arc ``a`` leads to a state that has an arc
``b``, the ``a`` arcs are led to a copy of that state without ``b``, and every
state with an ``a`` arc gets an arc for the merged symbol. A word then has
exactly one path, the one that applying the merges in their order would give.

All arcs with one label lead to one state, so the transition table is one state
per symbol and a bit matrix of which state has which arc. The states' rows mostly
agree, so strips of them are stored once (20 MB for a vocabulary of 49,000). Its
size depends on the vocabulary only. It is compiled once on the driver and
broadcast.

Texts are cut into words first; the distinct words of a block are run through
the table together, position by position. Decoding looks up each arc's label.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .textops import blocks, mix

#: Words kept with their ids in each Python worker, at most.
CACHE_WORDS = 150_000
#: Bytes from which on a word is run by itself, and positions of it that are looked up together.
LONG_WORD, LONG_STEP = 256, 1 << 15
#: Bytes of a row of the table that are stored once where rows agree.
STRIP = 64
END = "</w>"
#: Words as the vocabulary's own splitter cuts them, for Latin texts; others go through that splitter.
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_NOT_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\u024f]|[\xb2\xb3\xb9\xbc-\xbeİ]")


@dataclass
class Automaton:
    """Strip ``strips[which[s]]`` has a bit for each symbol that may follow in state ``s``; ``to`` is the state each symbol leads to."""

    strips: np.ndarray
    which: np.ndarray
    to: np.ndarray
    labels: list[str]
    keys: np.ndarray  # trie of the symbols: node * 512 + byte (+ 256 at the end of a word)
    nodes: np.ndarray
    symbol: np.ndarray  # symbol that ends in a trie node, or -1
    specials: dict[str, int]
    config: str  # the tokenizer file's normaliser and splitter
    cache: dict[str, bytes] = field(default_factory=dict)

    def has_arc(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = symbol >> 3
        return (self.strips[self.which[state, at // STRIP], at % STRIP] >> (symbol & 7).astype(np.uint8)) & 1 > 0

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * 512 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)

    def paths(self, words: list[bytes]) -> list[bytes]:
        """The symbols on each word's path, as little-endian 32-bit ids; words are not empty."""
        out: list[bytes] = [b""] * len(words)
        order = np.argsort([len(w) for w in words], kind="stable")
        i = 0
        while i < len(order):
            longest = len(words[order[i]])
            if longest >= LONG_WORD:
                out[order[i]] = self._run_long(words[order[i]])
                i += 1
                continue
            j = i
            while j < len(order) and len(words[order[j]]) <= min(max(16, 2 * longest), LONG_WORD - 1) and (j == i or (j - i) * len(words[order[j]]) < 1 << 21):
                j += 1
            for k, ids in zip(order[i:j], self._run([words[k] for k in order[i:j]]), strict=True):
                out[k] = ids
            i = j
        return out

    def _run(self, words: list[bytes]) -> list[bytes]:
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        text = np.full((n, width), -1, np.int32)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), size)
        text[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        text[np.arange(n), size - 1] += 256
        state = np.full((n, width + 1), -1, np.int32)
        state[:, 0] = 0
        symbol, back = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        for i in range(width):
            rows = np.flatnonzero((state[:, i] >= 0) & (i < size))
            node = np.zeros(len(rows), np.int32)
            k = i
            while len(rows) and k < width:
                node = self.step(node, text[rows, k])
                alive = node >= 0
                rows, node = rows[alive], node[alive]
                found = self.symbol[node]
                ends = np.flatnonzero(found >= 0)
                ends = ends[self.has_arc(state[rows[ends], i], found[ends])]
                at, got = rows[ends], found[ends]
                state[at, k + 1], symbol[at, k + 1], back[at, k + 1] = self.to[got], got, i
                k += 1
                more = size[rows] > k
                rows, node = rows[more], node[more]
        # walk back from each word's end
        at, steps = size.copy(), []
        rows = np.arange(n)
        while len(rows):
            steps.append((rows, symbol[rows, at[rows]]))
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        count = np.zeros(n, int)
        for r, _ in steps:
            count[r] += 1
        off = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(off[-1], "<i4")
        for s, (r, got) in enumerate(steps):
            ids[off[r] + count[r] - 1 - s] = got
        raw = ids.tobytes()
        return [raw[4 * off[k] : 4 * off[k + 1]] for k in range(n)]

    def _run_long(self, word: bytes) -> bytes:
        """One long word: its symbols are looked up at many positions at once, its states followed one by one."""
        n = len(word)
        text = np.frombuffer(word, np.uint8).astype(np.int32)
        text[-1] += 256
        state, symbol, back = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        state[0] = 0
        strips, which, to, wide = memoryview(self.strips.reshape(-1)), memoryview(self.which.reshape(-1)), memoryview(self.to), self.which.shape[1]
        for first in range(0, n, LONG_STEP):
            rows = np.arange(first, min(n, first + LONG_STEP))
            node, k, found = np.zeros(len(rows), np.int32), 0, []
            while len(rows):
                node = self.step(node, text[rows + k])
                rows, node = rows[node >= 0], node[node >= 0]
                k += 1
                ends = self.symbol[node] >= 0
                found.append((rows[ends], rows[ends] + k, self.symbol[node[ends]]))
                rows, node = rows[rows + k < n], node[rows + k < n]
            at, end, got = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            for i, j, s in zip(at[order].tolist(), end[order].tolist(), got[order].tolist(), strict=True):
                if state[i] >= 0:
                    byte = s >> 3
                    if strips[which[state[i] * wide + byte // STRIP] * STRIP + byte % STRIP] >> (s & 7) & 1:
                        state[j], symbol[j], back[j] = to[s], s, i
        ids = []
        while n:
            ids.append(symbol[n])
            n = back[n]
        return np.array(ids[::-1], "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian 32-bit."""
        split = [self.split(t) for t in texts]
        missing = list({w for words in split for w in words} - self.cache.keys())
        if missing:
            if len(self.cache) + len(missing) > CACHE_WORDS:
                self.cache.clear()
                missing = list({w for words in split for w in words})
            plain = [w for w in missing if w not in self.specials]
            self.cache.update(zip(plain, self.paths([w.encode() for w in plain]), strict=True))
            self.cache.update((w, np.array([self.specials[w]], "<i4").tobytes()) for w in missing if w in self.specials)
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def split(self, text: str) -> list[str]:
        """Words of a text; special symbols are words of their own."""
        if "<|" in text and any(s in text for s in self.specials):
            parts = re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.split(part))]
        if _NOT_PLAIN.search(text):
            steps = _splitter(self.config)
            text = steps.normalizer.normalize_str(text)
            return [text[i:j] for _, (i, j) in steps.pre_tokenizer.pre_tokenize_str(text)]
        return _PLAIN_WORD.findall(text.lower())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}


@lru_cache(4)
def _splitter(config: str) -> Tokenizer:
    """The tokenizer file's normaliser and splitter of words, without its vocabulary."""
    return Tokenizer.from_str(config)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(2)
def compile_automaton(path: str) -> Automaton:
    """Builds the automaton of a byte-level BPE tokenizer file whose words end in ``</w>``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["end_of_word_suffix"] != END:
        raise ValueError("a vocabulary with end-of-word symbols is needed")
    vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
    n = max(vocab.values()) + 1
    labels = [""] * n
    for s, k in vocab.items():
        labels[k] = s
    made = {a + b for a, b in merges}
    arcs = np.zeros((4096, (n + 7) // 8), np.uint8)
    to = np.zeros(n, np.int32)
    uses = np.zeros(n + 2, np.int64)  # labels that lead to a state
    for s, k in vocab.items():
        to[k] = int(s.endswith(END) and len(s) > len(END))
        if s not in made:  # state 0: start, and any symbol that ends no merge's left side yet; state 1: end of the word
            arcs[0, k >> 3] |= 1 << (k & 7)
            uses[to[k]] += 1
    uses[0] += 1
    states = 2
    for a, b in merges:
        i, j, k = vocab[a], vocab[b], vocab[a + b]
        old = to[i]
        to[k] = to[j]
        uses[to[k]] += 1
        if not arcs[old, j >> 3] >> (j & 7) & 1:
            continue
        if uses[old] > 1:  # other labels keep the state, this one gets a copy
            if states == len(arcs):
                arcs = np.concatenate([arcs, np.zeros_like(arcs)])
            arcs[states] = arcs[old]
            uses[old] -= 1
            uses[states] = 1
            to[i] = old = states
            states += 1
        arcs[old, j >> 3] &= ~np.uint8(1 << (j & 7))
        arcs[:states, k >> 3] |= (arcs[:states, i >> 3] >> np.uint8(i & 7) & np.uint8(1)) << np.uint8(k & 7)
    letters = _byte_letters()
    trie: dict[int, int] = {}
    ends = [-1]
    for s, k in vocab.items():
        last = s.endswith(END) and len(s) > len(END)
        body = s[: -len(END)] if last else s
        node = 0
        for x, c in enumerate(body):
            key = node * 512 + letters[c] + 256 * (last and x == len(body) - 1)
            if key not in trie:
                trie[key] = len(ends)
                ends.append(-1)
            node = trie[key]
        ends[node] = k
    keys = np.array(sorted(trie), np.int64)
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for s, k in specials.items():
        labels += [""] * (k + 1 - len(labels))
        labels[k] = s
    config = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})
    rows = np.pad(arcs[:states], ((0, 0), (0, -arcs.shape[1] % STRIP))).reshape(-1, STRIP)
    odd = np.random.default_rng(states).integers(0, 1 << 63, STRIP // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _, some, which = np.unique(mix((mix(rows.view(np.uint64)) * odd).sum(axis=1, dtype=np.uint64)), return_index=True, return_inverse=True)
    strips, which = rows[some], which.reshape(states, -1).astype(np.int32)
    if not (strips[which.ravel()] == rows).all():
        raise AssertionError("two strips of the table have one hash")
    return Automaton(strips, which, to, labels, keys, np.array([trie[k] for k in keys.tolist()], np.int32), np.array(ends, np.int32), specials, config)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row of ``docs``.

    A null or empty text has no ids. The strings of special symbols in a text are
    encoded as those symbols. Repeated rows each get a row, a null doc_id stays;
    other columns are ignored; an empty table gives no rows. Very long texts and
    words take time in proportion to their length. ``path`` is a tokenizer file the driver can read.
    """
    table = docs.sparkSession.sparkContext.broadcast(compile_automaton(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, off in blocks(batch.column(1)):
                raw = b.tobytes()
                ids = table.value.encode([raw[off[k] : off[k + 1]].decode("utf-8", "replace") for k in range(j - i)])
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the labels of its arcs, joined by blanks.

    A null list decodes to the empty string.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(compile_automaton(path).labels)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)), names.take(ids.flatten()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pc.binary_join(lists, " ")], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded string")
