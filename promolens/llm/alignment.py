"""Alignment of the tokens of two tokenizers, by byte offsets.

Both tokenizers encode each whole text. Offsets where a token of either ends
there and the next token of either begins with a space are anchors; they are
verified on the tokens' byte ends and cut a document into windows, about a word
each. A window's alignment depends on its two tuples of token ids alone, so it is
worked out once for each pair of tuples that a block of texts has, all of them
together with numpy, and looked up for the windows that repeat the pair.

A link's count is a sum over the corpus, so there are two passes. The first deals
texts in blocks of about ``BLOCK`` bytes and stores one row per block: the block's
distinct windows as the symbols that write their groups, its documents as lists of
window numbers, and its distinct pairs of ids with their numbers of links. The
pairs are summed over all blocks; then the sums of the pairs that a block has go
back to it, by a join on the pair and a grouping by the block. A pair that is in
all blocks is one row for each block, of a join that Spark may split.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _encoder, encode_ids
from .shared import stored
from .textops import blocks, mix, running_hash

#: Bytes of text in a block, about; a longer document is a block of its own.
BLOCK = 1 << 20
#: Words that a worker remembers the pieces of, at most, and the letters from which on a word is not remembered.
MEMO, LONG = 100_000, 64


class Vocabulary:
    """The bytes of each token, their number, and whether the first one is a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.place = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.place[ids] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]


class ByteLevel:
    """Tokenizer A: a byte-level file; it encodes a space and the text."""

    def __init__(self, path: str):
        self.path, encoding = path, _encoder(path)[0]
        special = {encoding.encode_single_token(s) for s in encoding.special_tokens_set}
        self.vocabulary = Vocabulary([b"" if k in special else encoding.decode_single_token_bytes(k) for k in range(encoding.n_vocab)])

    def encode(self, text: str) -> bytes:
        return encode_ids(" " + text, self.path, specials=False)


class Pieces:
    """Tokenizer B: a sentencepiece model that puts a space before the text.

    No piece has a space behind another character, so no merge crosses from a
    word to the spaces before the next: words with their spaces are encoded one
    by one and remembered (a test holds that together with the whole text's ids).
    Models for which that is not so encode whole texts.
    """

    _WORD = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.vocabulary = Vocabulary([
            bytes([int(s[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) or model.is_unknown(k) else s.replace("▁", " ").encode()
            for k, s in enumerate(names)
        ])
        self.by_word = not any("▁" in s.lstrip("▁") for s in names) and b"".join(self._of_words([" a", "  b", " "])) == self._whole(["a  b "])[0]
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Words with the spaces before them; the model puts one before a text, but before nothing."""
        alone = array("I", [self.model.piece_to_id("▁")]).tobytes()
        return [x if len(w) > 1 else alone for w, x in zip(words, self._whole([w[1:] for w in words]), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as numbers of 32 bits."""
        plain = [bool(t) and self.by_word and "▁" not in t for t in texts]  # the model takes that sign for a space
        words = [self._WORD.findall(" " + t) if ok else [] for t, ok in zip(texts, plain, strict=True)]
        new = list(set().union(*words).difference(self.known))
        found = dict(zip(new, self._of_words(new), strict=True))
        known = self.known
        out = [b"".join([known[x] if x in known else found[x] for x in w]) for w in words]
        for k, ok in enumerate(plain):
            if not ok and texts[k]:
                out[k] = self._whole([texts[k]])[0]
        room = MEMO - len(self.known)
        self.known.update(islice(((w, x) for w, x in found.items() if len(w) < LONG), room))
        return out


@lru_cache(2)
def _tokenizers(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


def align(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of two lists of ids, given the bytes until each token's end.

    Returns the links' pairs of ids and byte ends, in the order of the text, and
    the symbols that write the groups (ids of B below zero). A group ends where tokens of both end; one link joins the two
    tokens over each stretch that no token's end cuts.
    """
    of_a, of_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)  # the token of the other side that ends there or later
    a_shared, b_shared = b_ends[of_a] == a_ends, a_ends[of_b] == b_ends
    ends = np.concatenate([a_ends, b_ends[~b_shared]])
    pairs = np.concatenate([a << 32 | b[of_a], a[of_b[~b_shared]] << 32 | b[~b_shared]])
    order = np.argsort(ends, kind="stable")
    # a group's tokens of A stand before its tokens of B
    a_group, b_group = (np.cumsum(x) - x for x in (a_shared, b_shared))
    b_before = np.concatenate([[0], np.flatnonzero(b_shared) + 1])
    a_until = np.flatnonzero(a_shared) + 1
    symbols = np.empty(len(a) + len(b), np.int64)
    symbols[np.arange(len(a)) + b_before[a_group]] = 2 * a + a_shared
    symbols[np.arange(len(b)) + a_until[b_group]] = -(2 * b + b_shared) - 1
    return pairs[order], ends[order], symbols


@lru_cache(2)
def _symbols(n_a: int, n_b: int) -> pa.Array:
    """How each symbol is written: id of A with , or |, id of B with , or ; or nothing."""
    return pa.array([f"{k}{sign}" for k in range(n_a) for sign in ",|"] + [f"{k}{sign}" for sign in (",", ";", "") for k in range(n_b)])


def _distinct(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a window of each distinct pair of id tuples, the number of each window's pair of tuples), by hash, then by the ids themselves."""
    starts = [np.concatenate([[0], e[:-1]]) for e in (a_ends, b_ends)]
    both = [running_hash(mix(x.astype(np.uint64) + np.uint64(1)), s, e) for x, s, e in zip((a, b), starts, (a_ends, b_ends), strict=True)]
    _, first, number = np.unique(mix(both[0] + mix(both[1] + np.uint64(7))), return_index=True, return_inverse=True)
    same = np.ones(len(number), bool)
    for x, s, e in zip((a, b), starts, (a_ends, b_ends), strict=True):
        n, like = e - s, first[number]
        same &= n == n[like]
        n = np.where(same, n, 0)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differs = x[np.repeat(s, n) + inner] != x[np.repeat(s[like], n) + inner]
        same[np.repeat(np.arange(len(n)), n)[differs]] = False
    odd = np.flatnonzero(~same)  # two tuples of one hash: each such window stands for itself
    number[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), number


BLOCK_SCHEMA = (
    "block long, docs array<long>, n_a array<long>, n_b array<long>, n_windows array<long>, windows binary, n_symbols binary, symbols binary, pairs array<long>, pair_links array<long>"
)


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 32 bits as four planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of runs of n from each start, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(starts - ends + n, n) + np.arange(ends[-1] if len(n) else 0)


def _block(texts: list[bytes], a_path: str, b_path: str) -> tuple:
    """One block's row without its number and documents."""
    one, two = _tokenizers(a_path, b_path)
    va, vb = one.vocabulary, two.vocabulary
    strings = [raw.decode("utf-8", "replace") for raw in texts]
    a_ids, b_ids, spans = [], [], []
    for raw, text, pieces in zip(texts, strings, two.encode(strings), strict=True):
        a = b = np.zeros(0, "<u4")
        if text:
            a, b, whole = np.frombuffer(one.encode(text), "<u4"), np.frombuffer(pieces, "<u4"), b" " + raw
            if va.length[a].sum() != len(whole) or vb.length[b].sum() != len(whole) or va.join(a).tobytes() != whole or vb.join(b).tobytes() != whole:
                a = b = np.zeros(0, "<u4")
        a_ids.append(a)
        b_ids.append(b)
        spans.append(len(raw) + 1 if len(a) else 0)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = np.concatenate(a_ids).astype(np.int64), np.concatenate(b_ids).astype(np.int64)
    if not len(a):
        zeros, none = np.zeros(len(texts), np.int64), _packed(np.zeros(0))
        return zeros, zeros, zeros, none, none, none, [], []
    ends_a, ends_b, doc_ends = np.cumsum(va.length[a]), np.cumsum(vb.length[b]), np.cumsum(spans)
    at = np.zeros(ends_a[-1] + 1, np.uint8)
    at[ends_a] += 1
    at[ends_b] += 1
    shared_a, shared_b = np.flatnonzero(at[ends_a] == 2), np.flatnonzero(at[ends_b] == 2)
    at[doc_ends] = 3
    spaced = np.append(va.spaced[a], True)[shared_a + 1] & np.append(vb.spaced[b], True)[shared_b + 1]
    anchor = spaced | (at[ends_a[shared_a]] == 3)
    a_cut, b_cut = shared_a[anchor] + 1, shared_b[anchor] + 1
    n_windows = np.diff(np.searchsorted(ends_a[a_cut - 1], doc_ends, "right"), prepend=0)
    first, number = _distinct(a, b, a_cut, b_cut)
    uses = np.bincount(number, minlength=len(first))
    order = np.argsort(-uses, kind="stable")  # frequent windows get small numbers
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first, uses = first[order], uses[order]
    # each distinct window once, one after the other
    a_n, b_n = np.diff(a_cut, prepend=0)[first], np.diff(b_cut, prepend=0)[first]
    a, b = a[_runs(a_cut[first] - a_n, a_n)], b[_runs(b_cut[first] - b_n, b_n)]
    ends_a, ends_b = np.cumsum(va.length[a]), np.cumsum(vb.length[b])
    found, ends, symbols = align(a, b, ends_a, ends_b)
    n_links = np.diff(np.searchsorted(ends, ends_a[np.cumsum(a_n) - 1], "right"), prepend=0)
    pairs, place = np.unique(found, return_inverse=True)  # in ascending order
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, place, np.repeat(uses, n_links))
    of_b = symbols < 0
    symbols[of_b] = 2 * len(va.tokens) - 1 - symbols[of_b]
    of_b = symbols >= 2 * len(va.tokens)
    code = symbols[of_b] - 2 * len(va.tokens)
    symbols[of_b] = 2 * len(va.tokens) + (code & 1) * len(vb.tokens) + (code >> 1)
    return n_a, n_b, n_windows, _packed(rank[number]), _packed(a_n + b_n), _packed(symbols), pairs, total


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _documents(row: dict, pos: np.ndarray, count: np.ndarray, best: np.ndarray, va: Vocabulary, vb: Vocabulary) -> pa.RecordBatch:
    """The documents of one block, given its pairs' counts; the windows' links follow from their symbols."""
    n_a, n_b = len(va.tokens), len(vb.tokens)
    counts, bests = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
    counts[pos], bests[pos] = count, best
    windows, n_symbols, symbols = (_unpacked(row[c]) for c in ("windows", "n_symbols", "symbols"))
    closes = (symbols >= 2 * n_a + n_b).astype(np.int64)
    of_a = symbols < 2 * n_a
    a, b = symbols[of_a] >> 1, (symbols[~of_a] - 2 * n_a) % n_b
    links, n_links = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(a):
        ends_a = np.cumsum(va.length[a])
        found, ends, _ = align(a, b, ends_a, np.cumsum(vb.length[b]))
        links = np.searchsorted(np.array(row["pairs"], np.int64), found)
        n_links = np.diff(np.searchsorted(ends, ends_a[np.cumsum(of_a)[np.cumsum(n_symbols) - 1] - 1], "right"), prepend=0)

    def per_window(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums, ends = np.concatenate([[0], np.cumsum(x)]), np.cumsum(n)
        return sums[ends] - sums[ends - n]

    until = np.cumsum(row["n_windows"], dtype=np.int64)

    def per_document(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x[windows])])[until], prepend=0)

    values = [per_document(x) for x in (per_window(closes, n_symbols), n_links, per_window(bests[links], n_links), per_window(counts[links], n_links), n_symbols)]
    written = symbols[_runs((np.cumsum(n_symbols) - n_symbols)[windows], n_symbols[windows])]
    ends = np.cumsum(values.pop())
    last = np.unique(ends[ends > 0]) - 1
    written[last] += n_b  # no sign behind a document's last group
    groups = pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), _symbols(n_a, n_b).take(pa.array(written))), "")
    columns = [pa.array(row["docs"], pa.int64()), pa.array(row["n_a"], pa.int64()), pa.array(row["n_b"], pa.int64()), *map(pa.array, values), groups]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How the tokens of A (a byte-level file) and B (a sentencepiece model) overlap in each document.

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of tokens that
    share bytes), n_best (links whose pair of ids has the most links of all pairs
    with its B id, ties included), count_sum (over the links, the links of their
    pair of ids in the corpus) and groups (``a1,a2|b1;a3|b2,b3``).

    A text that is null, empty, or that one of the two cannot give back byte by
    byte has no tokens: zeros and an empty string. Strings of special symbols are
    plain text. Repeated rows count and get a row each, a null doc_id stays, other
    columns are ignored, an empty table gives no rows. A text without spaces is
    one window. A task holds a block, or one longer text, with its tokens: about a
    hundred bytes for each byte of it.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")], TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]
        for batch in batches:
            for i, j, b, off in blocks(batch.column(1), BLOCK):
                raw = b.tobytes()
                row = (number, batch.column(0)[i:j].to_pylist(), *_block([raw[off[k] : off[k + 1]] for k in range(j - i)], a_path, b_path))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    found = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, BLOCK_SCHEMA))
    exploded = found.select(F.col("block").alias("of"), F.posexplode("pairs").alias("pos", "pair"))
    sums = stored(
        found.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.pair_links").alias("count"))
    )
    piece = F.col("pair").bitwiseAND((1 << 32) - 1)
    highest = sums.groupBy(piece.alias("piece")).agg(F.max("count").alias("most"))  # at most one row for each token of B
    judged = sums.withColumn("piece", piece).join(F.broadcast(highest), "piece").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    scores = exploded.join(judged, "pair").select("of", "pos", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = [right.column(c).to_numpy() for c in ("pos", "count", "best")]
        words = [x.vocabulary for x in _tokenizers(a_path, b_path)]
        return pa.Table.from_batches([_documents(row, *numbers, *words) for row in left.to_pylist()])

    whole = found.drop("pair_links")
    return whole.groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(finish, RESULT)
