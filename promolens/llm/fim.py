"""Fill-in-the-middle arrangement of documents over a piece table.

A document is a list of descriptors (buffer, start, end) over two buffers that
never change: its text in UTF-8 and the three sentinels. Cutting splits a
descriptor in two, an arrangement permutes descriptors and puts sentinels
between them, and restoring applies the inverse permutation to the descriptors
found in an output. Hashes read the buffers descriptor by descriptor; a text is
copied once, when the output is written.

Units (``[A-Za-z]+|[^A-Za-z]``) are counted and cuts are found with numpy over
the bytes of many documents at once; every document is handled by itself, so
nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LEADING, blocks

SENTINELS = b"<P><S><M>"
TEXT, MARKS = 0, 1
PREFIX, SUFFIX, MIDDLE = ((MARKS, k, k + 3) for k in (0, 3, 6))
#: Of each hundred documents: those that are arranged, and of these the ones that begin with the suffix.
ARRANGED, SUFFIX_FIRST = 90, 20

_HAS_SENTINEL = re.compile(b"<[PSM]>")

Piece = tuple[int, int, int]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class PieceTable:
    """Descriptors over a text and the sentinels."""

    def __init__(self, text: bytes | memoryview, pieces: Sequence[Piece] | None = None):
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else list(pieces)

    def cut(self, *places: int) -> None:
        """Splits the descriptors at byte places of the document, in ascending order; a place may occur twice."""
        out, at, left = [], 0, list(places)
        for buffer, start, end in self.pieces:
            while left and left[0] <= at + end - start:
                middle = start + left.pop(0) - at
                out.append((buffer, start, middle))
                at += middle - start
                start = middle
            out.append((buffer, start, end))
            at += end - start
        self.pieces = out

    def arrange(self, order: Sequence[int | Piece]) -> None:
        """Numbers stand for present descriptors, descriptors for themselves."""
        self.pieces = [self.pieces[x] if isinstance(x, int) else x for x in order]

    def parts(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield self.buffers[buffer][start:end]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.parts():
            h.update(part)
        return h.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.parts())


#: What follows what, of the descriptors prefix 0, middle 1, suffix 2; and where each of them is in an output cut at its sentinels.
_FORMS = {"psm": ((PREFIX, 0, SUFFIX, 2, MIDDLE, 1), (0, 2, 1)), "spm": ((SUFFIX, 2, PREFIX, 0, MIDDLE, 1), (1, 2, 0)), "plain": ((0,), (0,))}


def restored(output: bytes, form: str) -> PieceTable:
    """The document behind an output: descriptors over the output, in the document's order."""
    table = PieceTable(output)
    if form == "plain":
        return table
    marks = [SENTINELS[start:end] for _, start, end in (x for x in _FORMS[form][0] if not isinstance(x, int))]
    first = output.index(marks[1])
    second = output.index(marks[2], first)
    if not output.startswith(marks[0]):
        raise ValueError(f"no output of form {form}")
    table.cut(3, first, first + 3, second, second + 3)
    table.arrange((1, 3, 5))
    table.arrange(_FORMS[form][1])
    return table


def _draws(doc: int | None) -> tuple[int, ...]:
    digest = hashlib.sha256(b"1:%s" % (b"" if doc is None else str(doc).encode())).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string(), pa.string()]


def _batches(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)], names)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """Each document arranged for filling in its middle.

    Returns doc_id, n (units ``[A-Za-z]+|[^A-Za-z]``), form (plain, psm or spm),
    prefix_chars and middle_chars (code points, null if plain), output, and
    output_sha256 (hashed from the descriptors). The cuts and the form are drawn
    from the sha256 of ``1:`` and the doc_id, so a task that runs again gives the
    same rows. A null or empty text, and one that contains a sentinel, is plain;
    a null doc_id draws as ``1:`` alone. Repeated rows each get a row, other
    columns are ignored, an empty table gives no rows. A text is never cut inside
    a code point and may be as long as a string can be.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, b, off in blocks(batch.column(1)):
                letter = _LETTER[b]
                first = LEADING[b]
                inside = letter.copy()
                inside[1:] &= letter[:-1]
                inside[:1] = False
                inside[off[:-1][off[:-1] < len(b)]] = False
                starts = np.flatnonzero(first & ~inside)
                bounds = np.searchsorted(starts, off)
                points = np.concatenate([[0], np.cumsum(first)])
                raw = memoryview(b.tobytes())
                rows = []
                for k, doc in enumerate(ids[i:j]):
                    low, high, n = int(off[k]), int(off[k + 1]), int(bounds[k + 1] - bounds[k])
                    text = raw[low:high]
                    h1, h2, h3, h4 = _draws(doc)
                    table, form, chars = PieceTable(text), "plain", (None, None)
                    if n and h3 % 100 < ARRANGED and not _HAS_SENTINEL.search(text):
                        form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                        one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                        x, y = (int(starts[bounds[k] + u]) if u < n else high for u in (one, two))
                        table.cut(x - low, y - low)
                        chars = int(points[x] - points[low]), int(points[y] - points[x])
                    table.arrange(_FORMS[form][0])
                    rows.append((doc, n, form, *chars, table.bytes(), table.sha256()))
                columns = [list(c) for c in zip(*rows, strict=True)]
                columns[5] = [x.decode("utf-8", "replace") for x in columns[5]]
                yield _batches(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(arrange, SCHEMA)


def restore_documents(outputs: DataFrame) -> DataFrame:
    """``outputs`` of ``fill_in_middle`` with restored (the exact text) and restored_sha256, both from output and form alone."""
    schema = f"{SCHEMA}, restored string, restored_sha256 string"

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("output")
            forms = batch.column("form").to_pylist()
            for i, j, b, off in blocks(batch.column(at)):
                raw = b.tobytes()
                tables = [restored(raw[off[k] : off[k + 1]], form) for k, form in enumerate(forms[i:j])]
                texts = pa.array([t.bytes().decode("utf-8", "replace") for t in tables], pa.large_string())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, texts, pa.array([t.sha256() for t in tables])], [*part.schema.names, "restored", "restored_sha256"])

    return outputs.select(*[x.split()[0] for x in SCHEMA.split(", ")]).mapInArrow(restore, schema)
