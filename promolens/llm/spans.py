"""Spans of regular-expression matches, as SQL expressions on a text column.

Splitting a text at a pattern gives the gaps between the matches that
``regexp_extract_all`` returns; their lengths, added up, are the offsets (code
points). Sums over an array are formed by doubling: each round adds the value
1, 2, 4, ... places before, so n values take about log2(n) passes and no array
grows entry by entry. Functions return SQL text, so whole plans stay in
the JVM; those that return columns do so too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string>>)"
#: Code points of the pieces that a text is cut into where many parts of it are taken.
PIECE = 256


def free_names(taken: list[str], names: tuple[str, ...]) -> dict[str, str]:
    """A column name for each of ``names`` that is not among ``taken``."""
    lower, own = {c.lower() for c in taken}, {}
    for name in names:
        free = f"__{name}"
        while free in lower:
            free += "_"
        own[name] = free
    return own


def literal(pattern: str) -> str:
    """A raw SQL string literal of a pattern without single quotes."""
    if "'" in pattern:
        raise ValueError("write single quotes as \\x27")
    return f"r'{pattern}'"


def let(value: str, name: str, result: str) -> str:
    """``result`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {result}), 1)"


def running(numbers: str, join: str = "x + y") -> str:
    """For each place of an array of ints, ``join`` (of x and y, in any grouping) over all values up to it."""
    both = join.replace("y", "acc[i - shiftleft(1, k)]")
    return (
        f"aggregate(sequence(0, cast(ceil(log2(greatest(size({numbers}), 1))) as int)), {numbers}, "
        f"(acc, k) -> transform(acc, (x, i) -> if(i >= shiftleft(1, k), {both}, x)))"
    )


def matches(text: str, kind: str, rank: int, pattern: str, group: int = 0, when: str = "true", window: int = 40) -> str:
    """All leftmost non-overlapping matches: start, rank, end, kind, group's value, text just before.

    ``when`` is a cheap condition that every text with a match fulfils. ``before``
    has at most ``window`` characters of the gap before the match.
    """
    p = literal(pattern)
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    item = (
        f"named_struct('start', ends[i] - length(x.`1`), 'rank', {rank}, 'end', ends[i], 'kind', '{kind}', "
        f"'value', x.`2`, 'before', right(x.`0`, {window}))"
    )
    lengths = "transform(z, x -> length(x.`0`) + coalesce(length(x.`1`), 0))"
    spans = let(lengths, "parts", let(running("parts"), "ends", f"transform(slice(z, 1, size(z) - 1), (x, i) -> {item})"))
    return f"case when {when} then {let(zipped, 'z', f'if(size(z) < 2, {EMPTY}, {spans})')} else {EMPTY} end"


def keep(spans: str, condition: str) -> str:
    """The spans ``s`` that fulfil a condition."""
    return f"filter({spans}, s -> {condition})"


def joined(spans: str) -> str:
    """kind:start:end of all spans by start, then rank, joined by commas."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def bind(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is evaluated once; ``let`` for columns."""
    return F.element_at(F.transform(F.array(value), result), 1)


def reaching(numbers: Column) -> Column:
    """For each place of an array of ints, the largest value up to it; ``running`` for columns."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        shift = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= shift, F.greatest(x, acc[i - shift])).otherwise(x))

    return F.aggregate(rounds, numbers, step)


def pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points; ``part`` takes from them."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, from the ``pieces`` of a text; pieces outside are not read."""

    def one(q: Column) -> Column:
        first = F.greatest(start - q * PIECE, F.lit(0))
        return F.substring(cut[q], first + 1, F.least(end - q * PIECE, F.lit(PIECE)) - first)

    touched = F.sequence((start / PIECE).cast("int"), ((end - 1) / PIECE).cast("int"))
    return F.when(end <= start, F.lit("")).otherwise(F.array_join(F.transform(touched, one), ""))
