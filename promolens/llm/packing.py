"""Harmonic packing of token sequences.

Lengths are partitioned into the classes (C/(k+1), C/k] of a capacity C; a bin of
class k < ``SMALL`` holds exactly k pieces, and shorter pieces share bins one
after the other. Documents may be cut: whole capacities first, then what is left
is cut down to the class length C // k where it would waste more than
``SLACK`` of a bin, so that k pieces fill a bin almost or exactly.

Every task packs the documents of its own partition, with its own open bins;
nothing is shuffled. At the end of a task the pieces of unfinished bins are
strung together and cut again, and the last bin is split at powers of two, which
need no padding. Sequence ids carry the partition's number, so a task that runs
again gives the same ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .textops import SEPARATOR, blocks

CAPACITY = 1024
SMALL = 16
SLACK = 1 / 64
#: Bytes of a run of blanks, or of a run without one, from which on the library itself encodes a text:
#: the faster encoder's splitter runs out of stack on runs of about a million.
LONG_RUN = 1 << 14
#: The splitter of byte-level vocabularies, fixed by the tokenizer file.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoder(path: str) -> tuple[tiktoken.Encoding, list[str]]:
    """An encoder with the merges of a byte-level tokenizer file, and its special symbols.

    Its ids are those of the tokenizers library (a test holds them together); it
    takes about a quarter of the time.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("ids must follow the order of the merges")
    ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items()}
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return tiktoken.Encoding("file", pat_str=_WORD, mergeable_ranks=ranks, special_tokens=specials), list(specials)


@lru_cache(4)
def _library(path: str, specials: bool = True) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not specials
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _has_long_run(b: np.ndarray) -> bool:
    """Whether a text has ``LONG_RUN`` bytes without an ASCII blank, or without any other ASCII character."""
    if len(b) < LONG_RUN:
        return False
    blank = SEPARATOR[b]
    return any(int(np.diff(np.flatnonzero(stop), prepend=-1, append=len(b)).max()) > LONG_RUN for stop in (blank, ~blank & (b < 128)))


def encode_ids(text: str, path: str, specials: bool = True) -> bytes:
    """Ids of a text as little-endian 32-bit numbers; special symbols in it are encoded as such, or as plain text without ``specials``."""
    if len(text) * 4 >= LONG_RUN and _has_long_run(np.frombuffer(text.encode(), np.uint8)):
        return np.array(_library(path, specials).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    encoding, symbols = _encoder(path)
    allowed = "all" if specials and any(s in text for s in symbols) else set()
    return encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4", copy=False).tobytes()


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if k >= SMALL or capacity - k * n <= capacity * SLACK:
            out.append(n)
            break
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


class _Packer:
    """Open bins of one task. A piece is (document, start, tokens, tokens of the document)."""

    def __init__(self, first_id: int, capacity: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.small: list[tuple] = []
        self.room = capacity
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, tokens, total in pieces:
            self.rows.append((doc, start, tokens, total, self.next_id, at))
            at += len(tokens) // 4
        self.next_id += 1

    def string(self, piece: tuple) -> None:
        """Adds to the shared bin, cutting where it is full."""
        doc, start, tokens, total = piece
        while tokens:
            take = min(self.room, len(tokens) // 4)
            self.small.append((doc, start, tokens[: 4 * take], total))
            start, tokens, self.room = start + take, tokens[4 * take :], self.room - take
            if not self.room:
                self.close(self.small)
                self.small, self.room = [], self.capacity

    def add(self, doc: int | None, tokens: bytes) -> None:
        total, start = len(tokens) // 4, 0
        for n in cut_lengths(total, self.capacity):
            piece, k = (doc, start, tokens[4 * start : 4 * (start + n)], total), self.capacity // n
            start += n
            if k >= SMALL and self.capacity - k * n > self.capacity * SLACK or k > SMALL:
                self.string(piece)
                continue
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                self.close(self.open.pop(k))

    def finish(self) -> None:
        for k in sorted(self.open):
            for piece in self.open[k]:
                self.string(piece)
        left, size = self.small, self.capacity - self.room
        while size:
            part = 1 << size.bit_length() - 1
            size -= part
            own = []
            while part:
                doc, start, tokens, total = left.pop(0)
                take = min(part, len(tokens) // 4)
                own.append((doc, start, tokens[: 4 * take], total))
                if take < len(tokens) // 4:
                    left.insert(0, (doc, start + take, tokens[4 * take :], total))
                part -= take
            self.close(own)


SCHEMA = "doc_id long, start long, tokens binary, doc_tokens long, sequence_id long, offset long"


def harmonic_pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of all documents with their place in a sequence.

    Returns doc_id, start (tokens of the document before the piece), tokens (ids
    as little-endian 32-bit numbers), doc_tokens (with ``end_id``, which ends
    every document), sequence_id and offset. Sequences have at most ``capacity``
    tokens. A null or empty text is ``end_id`` alone; repeated rows are packed
    one by one, a null doc_id stays; other columns are ignored. An empty table
    gives no rows. Very long words and runs of blanks get the library's ids too. ``path`` is a tokenizer file that the executors can read.
    """
    end = np.array([end_id], "<i4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId() << 33, capacity)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, b, off in blocks(batch.column(1)):
                raw = b.tobytes()
                for k, doc in enumerate(ids[i:j]):
                    packer.add(doc, encode_ids(raw[off[k] : off[k + 1]].decode("utf-8", "replace"), path) + end)
                if packer.rows:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, SCHEMA)
