"""Exact removal of repeated 50-byte strings with distributed suffix sorting.

A byte goes if a ``length``-byte string that covers it also starts in a document
with a smaller id. Strings (windows) are dealt by their minimizer: the smallest
hash among the window's ``GRAM``-byte grams. Equal windows have equal minimizers,
and neighbouring windows mostly share one, so a text becomes a sequence of short
runs of windows.

1. A task looks at its runs in chunks. Of equal runs of a chunk (their bytes are
   compared) only that of the smallest document goes on; the others are settled
   by it. The runs with the most copies are looked at again with the next chunk,
   so a passage of all documents goes on about once for each task. Runs go to their minimizer's place as a few numbers, in columns of as
   few bytes as they need. Minimizers of one document end there.
2. The runs of shared minimizers are cut from the texts and meet again. The
   parts of a minimizer's distinct strings that agree with others around it (no
   other parts can share a window) are suffix-sorted by linear grouping; windows
   that are neighbours in that order and equal form a group, whose smallest
   document is known then.
3. A minimizer with more than ``HOT`` different runs in one chunk, or ``GROUP`` in
   the whole table, would be a large group in one task: its windows are dealt one
   by one, each by itself, and meet with equal windows only. A chunk sends but a
   mark of it to its place; so at its place no minimizer has more than ``HOT``
   different runs of each chunk, and those beyond ``GROUP`` leave as they come.
   Equal windows of a task are settled there but for the smallest document's.
4. Spans of a document meet by its id and are cut out of its text.

What any task holds of one group is therefore bounded by ``GROUP``, or by the
number of chunks where all that meets is equal. No hash decides an equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .shared import stored
from .suffixes import suffix_arrays
from .textops import blocks, mix, slice_hash, window_hash

LENGTH = 50
GRAM = 20
#: Windows in a run, at most (longer runs of one minimizer are cut).
RUN = 64
#: Different runs of one minimizer in a chunk, and in the whole table, that may meet in one place.
HOT = 64
GROUP = 256
#: Runs that a place holds before those of larger minimizers leave it.
PLACE_RUNS = 1 << 21
#: Bytes of text whose runs meet in one place, about.
PLACE_BYTES = 1 << 23
#: Neighbouring places of the minimizer in a window whose common bytes are compared before strings are sorted.
STEP = 4
#: Strings that are hashed together.
PART = 1 << 14
#: Bytes of strings that a task packs together.
PACK_BYTES = 1 << 23
#: Single windows that a task looks at together.
SINGLES = 1 << 16
#: Runs that a task looks at together before rows leave it.
TASK_RUNS = 1 << 18
#: Bytes of text whose windows are hashed together; temporary arrays take some 50 times as much.
HASH_BYTES = 1 << 18
#: Runs, or single windows, with the most copies that a task looks at again with its next chunk.
SEEN = 1 << 14
#: Bits of a byte's place in its text; those above number the rows of an id.
_PLACE_BITS = 40


def _runs(b: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte in the row's text, number of windows and minimizer of each run of a block."""
    n = len(b) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    grams = length - GRAM + 1
    low, width = window_hash(b, GRAM), 1
    while 2 * width <= grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[grams - width : grams - width + n])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = np.arange(n) + length <= off[row + 1]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= ~inside[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(new & inside)
    if not len(start):
        return none, none, none, none
    stop = np.append(start[1:], n)
    ends = off[row[start] + 1] - length + 1  # windows end with their row
    count = np.minimum(stop, ends) - start
    parts = -(-count // RUN)
    if parts.max() > 1:
        again = np.repeat(np.arange(len(start)), parts)
        piece = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = start[again] + RUN * piece, np.minimum(RUN, count[again] - RUN * piece)
    return row[start], start - off[row[start]], count, low[start].view(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers from 0 on, lowest bytes of all of them first, without planes of zeros at the end."""
    x = x.astype("<u8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which slices from ``a`` and from ``b`` on, of ``size`` bytes each, are equal."""
    out = np.ones(len(a), bool)
    step = max(1, (1 << 21) // max(1, int(size.max(initial=1))))
    for k in range(0, len(a), step):
        n = size[k : k + step]
        at = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(at, n)
        same = raw[np.repeat(a[k : k + step], n) + inner] == raw[np.repeat(b[k : k + step], n) + inner]
        out[k : k + step] = np.logical_and.reduceat(same, at)
    return out


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents in order, those that touch as one; in a document later ones end later."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (a[1:] > b[:-1])]))
    return doc[first], a[first], b[np.append(first[1:], len(a)) - 1]


def _most_copied(first: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Those of ``first`` with several copies, the ``SEEN`` with the most where there are more."""
    first, copies = first[copies > 1], copies[copies > 1]
    return first if len(first) <= SEEN else np.sort(first[np.argsort(-copies, kind="stable")[:SEEN]])


#: What a packed row holds: runs for their place, runs of large minimizers, settled spans.
_PLACED, _SPLIT, _SETTLED = 0, 1, 2


def _placed_runs(texts: DataFrame, length: int, places: int) -> DataFrame:
    """Rows of packed runs by place: those of large minimizers and settled spans anywhere, the others where their minimizer belongs."""
    names = ["place", "what", "n", "first_doc", "h", "s", "doc", "pn"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts_held: list[np.ndarray] = []
        seen: list[tuple[np.ndarray, ...]] = []  # runs that have gone on before, and their bytes

        def packed(at: np.ndarray, what: int, h, s, doc, pn) -> pa.RecordBatch:
            order = np.lexsort((h, at))
            at, h, s, doc, pn = (x[order] for x in (at, h, s, doc, pn))
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            rows: list[list] = [[] for _ in names]
            for i, j in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                base = int(doc[i:j].min())
                values = (int(at[i]), what, j - i, base, _planes(np.diff(h[i:j], prepend=0)), _planes(s[i:j]), _planes(doc[i:j] - base), _planes(pn[i:j]))
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

        def leave() -> Iterator[pa.RecordBatch]:
            h, s, doc, pn, start = (np.concatenate(c) for c in zip(*held, strict=True))
            raw, gone = np.concatenate(texts_held), np.zeros(len(h), bool)
            held.clear()
            texts_held.clear()
            for *runs, text in seen:
                runs[-1] = runs[-1] + len(raw)
                h, s, doc, pn, start = (np.concatenate(x) for x in zip((h, s, doc, pn, start), runs, strict=True))
                raw, gone = np.concatenate([raw, text]), np.append(gone, np.ones(len(runs[0]), bool))
            order = np.lexsort((doc, s, h))
            h, s, doc, pn, start, gone = (x[order] for x in (h, s, doc, pn, start, gone))
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = new_h | np.concatenate([[True], s[1:] != s[:-1]])
            first = np.flatnonzero(new)
            rep = np.repeat(first, np.diff(np.append(first, len(h))))
            size = (pn & 255) + (length - 1)
            again = np.flatnonzero((doc != doc[rep]) & (size == size[rep]))
            again = again[_equal(raw, start[again], start[rep[again]], size[again])]
            if len(again):
                a = pn[again] >> 8
                d, a, b = _merged(doc[again], a, a + size[again])
                zero = np.zeros(len(d), np.int64)
                yield packed((mix((d * 1_000_003 + a).view(np.uint64)) % np.uint64(places)).astype(np.int64), _SETTLED, zero, b - a, d, a)
            left = ~gone
            left[again] = False
            most = _most_copied(first, np.diff(np.append(first, len(h))))
            text = _gathered(raw, start[most], size[most])
            seen[:] = [(h[most], s[most], doc[most], pn[most], np.cumsum(size[most]) - size[most], text)]
            cuts = np.flatnonzero(new_h)
            large = np.add.reduceat(new.astype(np.int64), cuts) > HOT
            hot = np.repeat(large, np.diff(np.append(cuts, len(h))))
            mark, keep = cuts[large], left & ~hot  # a mark has no windows: it says that the minimizer is large
            few = s & 0xFFFF  # enough to count different runs
            ah, as_, ad, ap = (np.concatenate([x[keep], y]) for x, y in ((h, h[mark]), (few, few[mark] * 0), (doc, doc[mark]), (pn, pn[mark] * 0)))
            # minimizers are small numbers: only mixed do they spread evenly
            yield packed((mix(ah.view(np.uint64)) % np.uint64(places)).astype(np.int64), _PLACED, ah, as_, ad, ap)
            hot &= left
            if hot.any():
                spread = (mix((doc[hot] * 1_000_003 + pn[hot]).view(np.uint64)) % np.uint64(places)).astype(np.int64)
                yield packed(spread, _SPLIT, h[hot], few[hot] * 0, doc[hot], pn[hot])

        size = read = 0
        for batch in batches:
            ids = batch.column("__key").to_numpy(zero_copy_only=False)
            number = batch.column("__row").to_numpy(zero_copy_only=False) if "__row" in batch.schema.names else ids * 0
            for i, j, b, off in blocks(batch.column("text"), HASH_BYTES):
                row, at, count, h = _runs(b, off, length)
                if len(h):
                    start = off[row] + at
                    digest = slice_hash(b, start, start + count + length - 1)
                    place_ = (number[i:j][row] << (_PLACE_BITS + 8)) + at * 256 + count
                    held.append((h.view(np.uint64) >> np.uint64(16), digest >> np.uint64(1), ids[i:j][row], place_, start + read))
                    held[-1] = tuple(x.astype(np.int64) for x in held[-1])
                    texts_held.append(b)
                    size, read = size + len(h), read + len(b)
                if size >= TASK_RUNS:
                    yield from leave()
                    size = read = 0
        if size:
            yield from leave()
        pa.default_memory_pool().release_unused()

    kinds = "place int, what int, n long, first_doc long, h binary, s binary, doc binary, pn binary"
    return texts.filter("__key is not null").mapInArrow(place, kinds)


def _met_runs(texts: DataFrame, length: int, places: int) -> DataFrame:
    """(kind, h, doc, a, n): kind 0, settled windows; 1, runs of a shared minimizer; 2, runs whose windows are dealt singly.

    A run is n windows from byte a of its document's text on.
    """

    def rows(kind: int, h, doc, a, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(doc), pa.array(a), pa.array(n.astype(np.int32))], ["kind", "h", "doc", "a", "n"])

    def of_runs(kind: int, h, doc, pn) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(h), 1 << 16):
            one = slice(k, k + (1 << 16))
            yield rows(kind, h[one], doc[one], pn[one] >> 8, pn[one] & 255)

    def large(h, s, pn, cuts) -> np.ndarray:
        """Which minimizers, of runs in order of h and s, have a mark or more than ``GROUP`` different runs."""
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
        return (np.minimum.reduceat(pn, cuts) == 0) | (np.add.reduceat(new.astype(np.int64), cuts) > GROUP)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: list[tuple[np.ndarray, ...]] = []
        held, bound = 0, PLACE_RUNS

        def gathered() -> tuple[np.ndarray, ...]:
            h, s, doc, pn = (np.concatenate(c) for c in zip(*here, strict=True))
            here.clear()
            order = np.lexsort((s, h))
            h, s, doc, pn = h[order], s[order], doc[order], pn[order]
            return h, s, doc, pn, np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))

        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                h, s, doc, pn = np.cumsum(_from_planes(r["h"], n)), _from_planes(r["s"], n), _from_planes(r["doc"], n) + r["first_doc"], _from_planes(r["pn"], n)
                if r["what"] == _SETTLED:
                    yield rows(0, h, doc, pn, s - (length - 1))
                elif r["what"] == _SPLIT:
                    yield from of_runs(2, h, doc, pn)
                else:
                    here.append((h, s, doc, pn))
                    held += n
                if held > bound:  # runs of large minimizers leave, a mark of each stays
                    h, s, doc, pn, cuts = gathered()
                    much = large(h, s, pn, cuts)
                    out, first = np.repeat(much, np.diff(np.append(cuts, len(h)))), cuts[much]
                    yield from of_runs(2, *(x[out & (pn > 0)] for x in (h, doc, pn)))
                    here = [(h[~out], s[~out], doc[~out], pn[~out]), (h[first], s[first] * 0, doc[first], pn[first] * 0)]
                    held = len(h) - int(out.sum()) + len(first)
                    bound = max(PLACE_RUNS, 2 * held)
        if not here:
            return
        h, s, doc, pn, cuts = gathered()
        shared = np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts)
        much = large(h, s, pn, cuts)
        found = np.repeat(np.where(much, 2, np.where(shared, 1, 0)), np.diff(np.append(cuts, len(h))))
        for kind in (1, 2):
            yield from of_runs(kind, *(x[(found == kind) & (pn > 0)] for x in (h, doc, pn)))

    placed = _placed_runs(texts, length, places)
    return placed.repartitionById(places, F.col("place")).mapInArrow(meet, "kind int, h long, doc long, a long, n int")


_STRINGS = "place int, what int, n long, first_doc long, h binary, doc binary, a binary, size binary, s binary"


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of ``raw``, one after the other."""
    return raw[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _packed_strings(what: int, place: np.ndarray, h: np.ndarray, doc: np.ndarray, a: np.ndarray, size: np.ndarray, text: np.ndarray | None) -> pa.RecordBatch:
    """A row for each place; ``text`` has the strings one after the other."""
    order = np.lexsort((h, place))
    if text is not None:
        text = _gathered(text, (np.cumsum(size) - size)[order], size[order])
    place, h, doc, a, size = (x[order] for x in (place, h, doc, a, size))
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    ends, codec, at = np.cumsum(size), pa.Codec("zstd", 3), 0
    rows: list[list] = [[] for _ in range(9)]
    for i, j in zip(cuts, np.append(cuts[1:], len(h)), strict=True):
        base, end = int(doc[i:j].min()), int(ends[j - 1])
        packed = codec.compress(np.ascontiguousarray(text[at:end]), asbytes=True) if text is not None else None
        at = end
        values = (int(place[i]), what, j - i, base, _planes(np.diff(h[i:j], prepend=0)), _planes(doc[i:j] - base), _planes(a[i:j]), _planes(size[i:j]), packed)
        for column, v in zip(rows, values, strict=True):
            column.append(v)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in _STRINGS.split(", ")])


def _strings(batches: Iterator[pa.RecordBatch], length: int, places: int) -> Iterator[pa.RecordBatch]:
    """Packed strings by the place of their key, and settled spans anywhere.

    A minimizer's runs are one string each under the minimizer; windows that are
    dealt singly are strings under their own hash, and a task sends but one place
    of each.
    """
    singles: list[tuple[np.ndarray, ...]] = []
    whole: list[tuple[np.ndarray, ...]] = []
    seen: list[tuple[np.ndarray, ...]] = []  # windows that have gone on before

    def place_of(key: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64)) % np.uint64(places)).astype(np.int64)

    def single_windows() -> Iterator[pa.RecordBatch]:
        n = sum(len(x[-1]) for x in singles)
        text, doc, at, key = (np.concatenate(c) for c in zip(*singles, *seen, strict=True))
        singles.clear()
        order = np.lexsort((doc, key))
        text, doc, at, key, gone = text[order], doc[order], at[order], key[order], order >= n
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rep = np.repeat(first, np.diff(np.append(first, len(key))))
        again = (doc != doc[rep]) & (text == text[rep]).all(axis=1)
        if again.any():
            d, a, b = _merged(doc[again], at[again], at[again] + length)
            yield _packed_strings(_SETTLED, place_of(d * 1_000_003 + a), a * 0, d, a, b - a, None)
        most = _most_copied(first, np.diff(np.append(first, len(key))))
        seen[:] = [(text[most], doc[most], at[most], key[most])]
        left = np.flatnonzero(~again & ~gone)
        yield _packed_strings(_PLACED, place_of(key[left]), key[left], doc[left], at[left], np.full(len(left), length), text[left].ravel())

    def runs_so_far() -> Iterator[pa.RecordBatch]:
        key, doc, at, n, text = (np.concatenate(c) for c in zip(*whole, strict=True))
        whole.clear()
        yield _packed_strings(_PLACED, place_of(key), key, doc, at, n, text)

    size = held = 0
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("__runs")))
        if not batch.num_rows:
            continue
        keys, runs = batch.column("__key").to_numpy(zero_copy_only=False), batch.column("__runs")
        offsets = runs.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        flat = runs.flatten()
        pn, minimizer, alone = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pn", "h", "alone"))
        for i, j, b, off in blocks(batch.column("text"), HASH_BYTES):
            own = slice(offsets[i], offsets[j])
            row = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
            if not len(row):
                continue
            doc, place, count, h, one = keys[i:j][row], pn[own] >> 8, pn[own] & 255, minimizer[own], alone[own]
            start = off[row] + (place & ((1 << _PLACE_BITS) - 1))
            if one.any():
                n = count[one]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                p = np.repeat(start[one], n) + inner
                singles.append((np.lib.stride_tricks.sliding_window_view(b, length)[p], np.repeat(doc[one], n), np.repeat(place[one], n) + inner, window_hash(b, length)[p].view(np.int64)))
                size += len(p)
                if size >= SINGLES:
                    yield from single_windows()
                    size = 0
            x = np.flatnonzero(~one)
            if len(x):
                n = count[x] + (length - 1)
                whole.append((h[x], doc[x], place[x], n, _gathered(b, start[x], n)))
                held += len(whole[-1][-1])
                if held >= PACK_BYTES:
                    yield from runs_so_far()
                    held = 0
    if size:
        yield from single_windows()
    if held:
        yield from runs_so_far()


def first_documents(lanes: list[list[bytes]], firsts: list[list[int]], length: int) -> list[list[np.ndarray]]:
    """Per string of each lane, for each of its windows, the smallest document of an equal window in the lane.

    ``firsts`` has the smallest document of each string. Lanes advance together.
    """
    flat = [s for lane in lanes for s in lane]
    first = np.array([d for lane in firsts for d in lane], np.int64)
    size = np.array([len(s) for s in flat])
    text = np.zeros(int((size + 1).sum()), np.uint16)
    string = np.repeat(np.arange(len(flat)), size + 1)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    text[inner < size[string]] = np.frombuffer(b"".join(flat), np.uint8).astype(np.uint16) + 1  # 0 parts the strings
    of_lane = np.repeat(np.arange(len(lanes)), [len(x) for x in lanes])
    order = suffix_arrays(text, np.bincount(of_lane, weights=size + 1).astype(np.int64))
    order = order[inner[order] + length <= size[string[order]]]
    same = of_lane[string[order[1:]]] == of_lane[string[order[:-1]]]
    step = 1 << 14
    for at in range(0, len(same), step):
        near = order[at : at + step + 1]
        x = text[near[:, None] + np.arange(length)]
        same[at : at + step] &= (x[1:] == x[:-1]).all(axis=1)
    cuts = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(first[string[order]], cuts)
    found = np.zeros(len(text), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(cuts, len(order))))
    ends = np.cumsum(size + 1)
    out, k = [], 0
    for lane in lanes:
        out.append([found[ends[x] - size[x] - 1 : ends[x] - length] for x in range(k, k + len(lane))])
        k += len(lane)
    return out


def _may_share(texts: list[bytes], minimizer: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What part of each string to sort with which others: a label of the set, the first byte and the end of the part.

    Windows whose minimizer stands ``STEP`` neighbouring places deep in them share
    the bytes around it; where no other string has those bytes, no other holds
    such a window. Strings of a minimizer that one of them holds more than once
    are one set of whole strings.
    """
    size = np.array([len(x) for x in texts])
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(texts), np.uint8)
    gram = (window_hash(flat, GRAM) >> np.uint64(16)).view(np.int64)
    name = np.repeat(np.arange(len(texts)), size)[: len(gram)]
    at = np.flatnonzero((gram == minimizer[name]) & (np.arange(len(gram)) + GRAM <= (start + size)[name]))
    times = np.bincount(name[at], minlength=len(texts))
    place = np.zeros(len(texts), np.int64)
    place[name[at[::-1]]] = at[::-1]
    _, one, lane = np.unique(minimizer, return_index=True, return_inverse=True)
    odd = (np.bincount(lane, weights=times != 1) > 0)[lane]
    label = np.where(odd, one[lane], np.arange(len(texts)))
    begin, end = np.where(odd, start, start + size), np.where(odd, start + size, start)
    sets = []
    for least in range(0, length - GRAM + 1, STEP):
        most = min(least + STEP - 1, length - GRAM)
        a, z = place - least, place - most + length  # the bytes that all such windows have
        ok = np.flatnonzero((a >= start) & (z <= start + size) & ~odd)
        if len(ok):
            _, back, count = np.unique(mix(slice_hash(flat, a[ok], z[ok]) ^ mix(lane[ok].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
            several = count[back] > 1
            ok, back = ok[several], back[several]
            begin[ok] = np.minimum(begin[ok], np.maximum(start[ok], place[ok] - most))
            end[ok] = np.maximum(end[ok], np.minimum(start[ok] + size[ok], place[ok] - least + length))
            sets.append((ok, back, len(count)))
    while sets:
        before = label.copy()
        for ok, back, n in sets:
            smallest = np.full(n, len(texts))
            np.minimum.at(smallest, back, label[ok])
            label[ok] = smallest[back]
        if (label == before).all():
            break
    return label, begin - start, end - start


def _sorted_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc, a, b) of the windows that a smaller document holds too; a partition has all rows of its keys.

    Equal strings of a key have one name. Where a key has one name, the smallest
    document settles all its windows; the names of other keys are suffix-sorted.
    """
    codec, parts = pa.Codec("zstd"), []
    for batch in batches:
        for r in batch.to_pylist():
            n = r["n"]
            h, doc, at, size = np.cumsum(_from_planes(r["h"], n)), _from_planes(r["doc"], n) + r["first_doc"], _from_planes(r["a"], n), _from_planes(r["size"], n)
            if r["what"] == _SETTLED:
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(at + size)], ["doc", "a", "b"])
            else:
                parts.append((h, doc, at, size, np.frombuffer(codec.decompress(r["s"], int(size.sum()), asbytes=True), np.uint8)))
    if not parts:
        return
    h, doc, at, size, raw = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    start = np.cumsum(size) - size
    digest = np.concatenate([slice_hash(raw[start[k] : start[k] + int(size[k : k + PART].sum())], start[k : k + PART] - start[k], start[k : k + PART] - start[k] + size[k : k + PART]) for k in range(0, len(h), PART)])
    order = np.lexsort((doc, digest, h))
    h, doc, at, size, start, digest = (x[order] for x in (h, doc, at, size, start, digest))
    same = np.flatnonzero((h[1:] == h[:-1]) & (digest[1:] == digest[:-1]) & (size[1:] == size[:-1])) + 1
    same = same[_equal(raw, start[same], start[same - 1], size[same])]
    new = np.ones(len(h), bool)
    new[same] = False
    name = np.cumsum(new) - 1
    named = np.flatnonzero(new)  # rows are in order of document, so a name's first row has its smallest one
    lane = np.flatnonzero(np.concatenate([[True], h[named[1:]] != h[named[:-1]]]))
    names_of = np.diff(np.append(lane, len(named)))
    single = np.repeat(names_of == 1, names_of)[name]
    first = doc[named]
    x = np.flatnonzero(single & (first[name] < doc))
    if len(x):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _merged(doc[x], at[x], at[x] + size[x])], ["doc", "a", "b"])
    many = np.flatnonzero(np.repeat(names_of > 1, names_of))  # names
    if not len(many):
        return
    texts = [raw[start[r] : start[r] + size[r]].tobytes() for r in named[many].tolist()]
    label, begin, end = (x.tolist() for x in _may_share(texts, h[named[many]], length))
    windows = size[named[many]] - length + 1
    base = np.cumsum(windows) - windows
    found = np.repeat(first[many], windows)
    lanes: dict[int, list[int]] = {}
    for n, k in enumerate(label):
        if end[n] > begin[n]:
            lanes.setdefault(k, []).append(n)
    several = sorted((x for x in lanes.values() if len(x) > 1), key=lambda x: sum(end[n] - begin[n] for n in x))
    i = 0
    while i < len(several):
        j, held = i, 0
        while j < len(several) and (j == i or held < 1 << 19):
            held += sum(end[n] - begin[n] for n in several[j])
            j += 1
        got = first_documents([[texts[n][begin[n] : end[n]] for n in x] for x in several[i:j]], [[first[many[n]] for n in x] for x in several[i:j]], length)
        for x, y in zip(several[i:j], got, strict=True):
            for n, f in zip(x, y, strict=True):
                found[base[n] + begin[n] : base[n] + begin[n] + len(f)] = f
        i = j
    rows = np.flatnonzero(~single)
    of_many = np.cumsum(np.repeat(names_of > 1, names_of)) - 1  # by name
    for k in range(0, len(rows), (1 << 20) // RUN):
        r = rows[k : k + (1 << 20) // RUN]
        n = of_many[name[r]]
        count = windows[n]
        place = np.repeat(np.arange(len(n)), count)
        inner = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        again = np.flatnonzero(found[base[n][place] + inner] < doc[r][place])
        if len(again):
            a = at[r][place[again]] + inner[again]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _merged(doc[r][place[again]], a, a + length)], ["doc", "a", "b"])


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str], int]:
    """``docs`` with ``__key``, its id, and where ids repeat ``__row``, which tells rows of one id apart; these names; the bytes of all texts."""
    ids = docs.select(F.col("doc_id").cast("long").alias("__key"), F.octet_length("text").alias("n"))
    per = ids.groupBy("__key").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    most, size = per.agg(F.max(F.when(F.col("__key").isNotNull(), F.col("rows"))), F.sum("n")).first()
    keyed = docs.withColumn("__key", F.col("doc_id").cast("long"))
    if (most or 0) < 2:
        return keyed, ["__key"], size or 0
    if most > 1 << (63 - 8 - _PLACE_BITS):
        raise ValueError(f"a doc_id has {most} rows")
    within = Window.partitionBy("__key").orderBy(F.xxhash64(F.col("text").cast("string")))
    return keyed.withColumn("__row", F.when(F.col("__key").isNull(), F.lit(0)).otherwise(F.row_number().over(within) - 1).cast("long")), ["__key", "__row"], size or 0


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``spans`` (array of start, end in bytes).

    A byte of a text is removed if a ``length``-byte string that covers it also
    starts in a row with a smaller doc_id. Strings are judged on the input and
    never cross rows. A null or empty text keeps nothing; a text shorter than
    ``length`` is kept. Rows with the same doc_id do not count against each other;
    an id may have up to 32,768 rows, more raise a ValueError. A null doc_id is
    neither judged nor a source. Columns of the result's names are replaced, all
    others stay.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "spans")
    rows, keys, size = _numbered(docs.withColumn("text", F.col("text").cast("string")))
    places = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PLACE_BYTES))
    met = stored(_met_runs(rows.select("text", *keys), length, places))

    def by_row(df: DataFrame, what: Column, name: str) -> DataFrame:
        """All ``what`` of a row as one list."""
        df = df.withColumnRenamed("doc", "__key")
        df = df.withColumn("__row", F.shiftright("a", _PLACE_BITS)) if len(keys) > 1 else df
        return df.groupBy(*keys).agg(F.collect_list(what).alias(name))

    runs = by_row(met.filter("kind > 0"), F.struct((F.col("a") * 256 + F.col("n")).alias("pn"), "h", (F.col("kind") == 2).alias("alone")), "__runs")
    # both joins deal out the same rows by the same key, with all columns, so that Spark deals them out once
    strings = rows.join(runs, keys, "left").mapInArrow(lambda batches: _strings(batches, length, places), _STRINGS).repartitionById(places, F.col("place"))
    spans = strings.mapInArrow(lambda batches: _sorted_spans(batches, length), "doc long, a long, b long").unionByName(
        met.filter("kind = 0").select("doc", "a", (F.col("a") + F.col("n") + (length - 1)).alias("b"))
    )
    low = F.lit((1 << _PLACE_BITS) - 1)
    found = by_row(spans, F.struct(F.col("a").bitwiseAND(low).alias("a"), F.col("b").bitwiseAND(low).alias("b")), "__found")
    schema = StructType([
        *rows.select(*docs.columns).schema.fields, StructField("kept", BinaryType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    ])
    names = docs.columns
    text_at = [c.lower() for c in names].index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(names)
            texts, lists = batch.column(text_at).cast(pa.large_binary()), batch.column(n)
            kept, size, removed, spans = [], [], [], []
            for x in range(batch.num_rows):
                raw = texts[x].as_py() or b""
                one = lists[x]
                merged: list[list[int]] = []
                if one.is_valid and len(one.values):
                    a, b = (one.values.field(c).to_numpy() for c in ("a", "b"))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    merged = [[int(p), int(q)] for p, q in zip(a[new], b[np.append(new[1:], len(b)) - 1], strict=True)]
                at, out = 0, []
                for p, q in merged:
                    out.append(raw[at:p])
                    at = q
                out.append(raw[at:])
                kept.append(b"".join(out))
                size.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                spans.append([{"start": p, "end": q} for p, q in merged])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in range(n)], pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*names, "kept", "n_bytes", "n_removed", "spans"],
            )

    return rows.join(found, keys, "left").select(*names, "__found").mapInArrow(cut, schema)
