"""Near-duplicate vectors by random-hyperplane sign hashing and exact cosine.

Equal vectors collapse into classes first. Each table cuts a vector's signs
against random hyperplanes into a bucket; the number of hyperplanes follows the
number of classes, so that buckets stay small at every size, and the number of
tables follows the hyperplanes, so that a pair at the threshold shares no bucket
with probability ``MISS`` at most, at every size. Buckets hold signatures, not
vectors; one larger than ``BLOCK`` is dealt in pairs of blocks that are units of
their own. Pairs whose signatures differ in more signs than six standard
deviations allow are out, the others are verified by exact cosine in double
precision.

Clusters of very near vectors would have all their pairs verified. So a first
round joins vectors to balls: a vector is in a ball if its verified angle with
the ball's centre, the smallest vector of some bucket, is at most half of the
threshold's. Any two members are linked then, whatever their own cosine, and
only pairs that are not of one ball are looked for.

A wide cluster still has a number of such pairs that grows with its square. So a
unit with more than ``DENSE`` pairs for each of its rows writes none of them: its
bucket is dense, and the vectors of dense buckets meet in blocks, where a matrix
product gives the cosines, a pair counts in the first dense bucket that both
share, and one row for each vector leaves, with its links there, and one edge for
each vector of a spanning forest. Pairs of other buckets that share a dense one
are dropped. Degrees are sums over the pairs, the dense buckets and the balls;
components come from the distributed algorithm shared with other operators.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

#: Probability, at most, that a pair at the threshold shares no bucket.
MISS = 1e-7
#: Signs in the signature that filters pairs before their exact cosine.
SIGNS = 256
BLOCK = 512
#: Rows of a unit, at most, that is compared together with others.
SMALL = 64
#: Pairs of a unit for each of its rows above which its bucket is dense.
DENSE = 4
#: Vectors of a dense bucket in a block; a unit has the cosines of two blocks at once.
DENSE_BLOCK = 2048
#: Tables of the first round, at most; a vector that they miss is in no ball.
BALL_TABLES = 16
#: Mean number of classes in a bucket that the number of hyperplanes aims at.
BUCKET = 16
_SEED = 20021


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def table_count(bits: int, cosine: float) -> int:
    """Tables of ``bits`` hyperplanes that a pair at ``cosine`` slips through with probability ``MISS`` at most."""
    common = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if common == 1 else math.ceil(math.log(MISS) / math.log1p(-common))


_SIG = [f"s{k}" for k in range(SIGNS // 64)]


def _buckets(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(tab, bucket, rep, ball, signature in words of 64) for each table; vectors of another length hash apart."""

    def hash_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in frames:
            for size, part in pdf.groupby(pdf["v"].map(len), sort=False):
                if size not in planes:
                    planes[size] = np.random.default_rng((_SEED, size)).standard_normal((size, max(tables * bits, SIGNS)))
                unit = _unit(np.stack(part["v"].to_numpy()).astype(np.float64))
                sig = np.packbits(unit @ planes[size][:, :SIGNS] >= 0, axis=1).view(np.int64)
                columns = {"rep": part["rep"].to_numpy(), "ball": part["ball"].to_numpy(), **{c: sig[:, k] for k, c in enumerate(_SIG)}}
                for t in range(tables):  # one table's signs at a time: there may be hundreds of tables
                    signs = unit @ planes[size][:, t * bits : (t + 1) * bits] >= 0
                    yield pd.DataFrame({"tab": t, "bucket": (signs << np.arange(bits)).sum(axis=1) + (size << bits), **columns})

    return vectors.select("rep", "ball", "v").mapInPandas(hash_, "tab int, bucket long, rep long, ball long, " + ", ".join(f"{c} long" for c in _SIG))


def _most(cosine: float) -> float:
    """In how many signs of their signatures vectors at ``cosine`` differ, but for six standard deviations."""
    differ = math.acos(cosine) / math.pi
    return SIGNS * differ + 6 * math.sqrt(SIGNS * differ * (1 - differ))


def _balls(vectors: DataFrame, bits: int, tables: int, cosine: float) -> DataFrame:
    """(rep, ball): vectors with their ball's centre; centres are in their own balls."""
    within = math.cos(math.acos(cosine) / 2) + 1e-9  # twice this angle is less than the threshold's
    placed = _buckets(vectors, bits, tables)
    first = placed.groupBy("tab", "bucket").agg(F.min(F.struct("rep", *_SIG)).alias("first"))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"first.{c}"))) for c in _SIG), F.lit(0))
    near = placed.join(first, ["tab", "bucket"]).filter((F.col("rep") != F.col("first.rep")) & (differ <= _most(min(within, 1.0))))
    pairs = near.select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct()
    joined = stored(_verified(pairs, vectors, within).groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("ball")))
    # a centre that is itself in a ball is none
    members = joined.join(joined.select(F.col("rep").alias("ball")), "ball", "left_anti").select("rep", "ball")
    return members.unionByName(members.select(F.col("ball").alias("rep"), "ball").distinct())


def _whole_units(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole units; rows arrive in order of ``keys``, and a unit is complete when the next begins."""
    waiting = None
    for pdf in frames:
        pdf = pdf if waiting is None else pd.concat([waiting, pdf], ignore_index=True)
        last = len(pdf) and int((pdf[keys] != pdf[keys].iloc[-1]).any(axis=1).to_numpy()[::-1].argmax())
        if last:
            yield pdf.iloc[:-last]
        waiting = pdf.iloc[-last:] if last else pdf
    if waiting is not None and len(waiting):
        yield waiting


def _cuts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and sizes of the runs of equal rows."""
    cuts = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1])
    return cuts, np.diff(np.append(cuts, len(code)))


def _blocked(rows: DataFrame, of: list[str], block: int) -> DataFrame:
    """Rows of groups of two or more, in pairs of blocks p <= q, each row with its ``own``."""
    sizes = rows.groupBy(*of).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block)).drop("n")
    return (
        rows.join(sizes, of)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("blocks", "other")
    )


def _candidates(placed: DataFrame, most: float) -> DataFrame:
    """(tab, bucket, a, b): class pairs a < b, not of one ball, that differ in ``most`` signs at most.

    A unit with more than ``DENSE`` of them for each row gives one row without a
    and b instead.
    """
    keys = ["tab", "bucket", "p", "q"]
    rows = _blocked(placed, ["tab", "bucket"], BLOCK).select(*keys, "own", "rep", "ball", *_SIG).repartition(*keys).sortWithinPartitions(*keys, "own", "rep")

    def pairs_of(rep: np.ndarray, i: np.ndarray, j: np.ndarray, unit: np.ndarray, code: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        """Pairs of rows i and j of units, which have ``code`` and ``size`` each."""
        dense = np.bincount(unit, minlength=len(size)) > DENSE * size
        few = ~dense[unit]
        i, j, marks = i[few], j[few], np.full(int(dense.sum()), -1)
        at = np.concatenate([code[unit[few]], code[dense]])
        return pd.DataFrame({
            "tab": at[:, 0].astype(np.int32), "bucket": at[:, 1],
            "a": np.concatenate([np.minimum(rep[i], rep[j]), marks]), "b": np.concatenate([np.maximum(rep[i], rep[j]), marks]),
        })

    def units(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs within small units at once, by their distance in the order; others each by itself."""
        code = pdf[keys].to_numpy()
        cuts, size = _cuts(code)
        small = (size <= SMALL) & (code[cuts, 2] == code[cuts, 3])
        rep, ball, own, sig = pdf["rep"].to_numpy(), pdf["ball"].to_numpy(), pdf["own"].to_numpy(), np.ascontiguousarray(pdf[_SIG].to_numpy())
        for at, n in zip(cuts[~small], size[~small], strict=True):
            x = np.unpackbits(sig[at : at + n].view(np.uint8), axis=1).astype(np.float32) * 2 - 1
            cut = int((own[at : at + n] == own[at]).sum())
            if code[at, 2] == code[at, 3]:
                i, j = np.nonzero(np.triu(x @ x.T >= SIGNS - 2 * most, 1))
            else:
                i, j = np.nonzero(x[:cut] @ x[cut:].T >= SIGNS - 2 * most)  # none where one block is empty
                j = j + cut
            apart = ball[at + i] != ball[at + j]
            i, j = at + i[apart], at + j[apart]
            yield pairs_of(rep, i, j, np.zeros(len(i), np.int64), code[at : at + 1, :2], np.array([n]))
        i = np.flatnonzero(np.repeat(small, size))
        left = np.repeat(cuts + size, size) - np.arange(len(pdf))
        first, second = [], []
        for d in range(1, SMALL):
            i = i[left[i] > d]
            if not len(i):
                break
            near = i[(np.bitwise_count((sig[i] ^ sig[i + d]).view(np.uint64)).sum(axis=1) <= most) & (ball[i] != ball[i + d])]
            first.append(near)
            second.append(near + d)
        if first:
            i, j = np.concatenate(first), np.concatenate(second)
            yield pairs_of(rep, i, j, np.searchsorted(cuts, i, "right") - 1, code[cuts, :2], size)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_units(frames, keys):
            yield from units(pdf)

    found = rows.mapInPandas(compare, "tab int, bucket long, a long, b long")
    return found.select("tab", "bucket", F.expr("nullif(a, -1)").alias("a"), F.expr("nullif(b, -1)").alias("b"))


def _forest(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Root and member, for all but the roots, of the components of a matrix of links.

    Columns are numbered after the rows, or are the same vertices. Each vertex is
    visited once.
    """
    n = len(link)
    if same:
        link = link | link.T
    rows_left, columns_left = link.any(axis=1), link.any(axis=0)
    roots, members = [], []
    for root in np.flatnonzero(rows_left):
        if not rows_left[root]:
            continue
        rows_left[root] = False
        at = np.array([root])
        while len(at):
            if same:
                at = np.flatnonzero(link[at].any(axis=0) & rows_left)
                rows_left[at] = False
                new = at
            else:
                columns = np.flatnonzero(link[at].any(axis=0) & columns_left)
                columns_left[columns] = False
                at = np.flatnonzero(link[:, columns].any(axis=1) & rows_left)
                rows_left[at] = False
                new = np.concatenate([columns + n, at])
            roots.append(np.full(len(new), root))
            members.append(new)
    return (np.concatenate(roots), np.concatenate(members)) if roots else (np.zeros(0, np.int64),) * 2


def _dense_links(inside: DataFrame, known: DataFrame, cosine: float) -> DataFrame:
    """(rep, others, root): links of ``rep`` that count in one unit, and a vertex of its component there.

    ``inside`` has (unit, rep) for the members of dense buckets, ``known`` their
    vectors, with the numbers of all their dense buckets as ``codes``.
    """
    keys = ["unit", "p", "q"]
    rows = _blocked(inside, ["unit"], DENSE_BLOCK).join(known, "rep").select(*keys, "own", "rep", "m", "ball", "codes", "v")

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        code, rep, m = int(pdf["unit"].iloc[0]), pdf["rep"].to_numpy(), pdf["m"].to_numpy().astype(np.float64)
        ball, x = pdf["ball"].to_numpy(), _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        same = pdf["p"].iloc[0] == pdf["q"].iloc[0]
        left = np.flatnonzero(pdf["own"].to_numpy() == pdf["p"].iloc[0])
        right = left if same else np.flatnonzero(pdf["own"].to_numpy() == pdf["q"].iloc[0])
        product = x[left] @ x[right].T
        link = product >= cosine
        i, j = np.nonzero(np.abs(product - cosine) < 1e-9)  # as other pairs are judged, to the last bit
        link[i, j] = (x[left[i]] * x[right[j]]).sum(axis=1) >= cosine
        link &= ball[left][:, None] != ball[right]
        # pairs that share a dense bucket of a smaller number count there
        codes = pdf["codes"].to_numpy()
        number, row = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        before = number < code
        order = np.argsort(number[before], kind="stable")
        number, row = number[before][order], row[before][order]
        counts = link.copy()
        is_left = np.zeros(len(codes), bool)
        is_left[left] = True
        slot = np.empty(len(codes), np.int64)
        slot[right], slot[left] = np.arange(len(right)), np.arange(len(left))
        for at in np.split(row, np.flatnonzero(number[1:] != number[:-1]) + 1):
            one, two = (slot[at], slot[at]) if same else (slot[at[is_left[at]]], slot[at[~is_left[at]]])
            if len(one) and len(two) and len(at) > 1:
                counts[np.ix_(one, two)] = False
        if same:
            counts &= ~np.eye(len(left), dtype=bool)
        others = np.zeros(len(codes))
        others[left] += counts @ m[right]
        if not same:
            others[right] += m[left] @ counts
        root, member = _forest(link, same)
        vertex = left if same else np.concatenate([left, right])
        roots = rep.copy()
        roots[vertex[member]] = rep[vertex[root]]
        some = (others > 0) | (roots != rep)
        return pd.DataFrame({"rep": rep[some], "others": others[some].astype(np.int64), "root": roots[some]})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_units(frames, keys):
            for at, n in zip(*_cuts(pdf[keys].to_numpy()), strict=True):
                yield unit(pdf.iloc[at : at + n])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "own", "rep").mapInPandas(compare, "rep long, others long, root long")


def _verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose exact cosine in double precision reaches ``cosine``; not those with a number in both ``codes``, if there are any."""
    codes = ["codes"] if "codes" in vectors.columns else []
    both = pairs
    for c in ("a", "b"):
        both = both.join(vectors.select(F.col("rep").alias(c), F.col("v").alias(f"v{c}"), *[F.col(x).alias(f"{x}_{c}") for x in codes]), c)
    if codes:
        both = both.filter(~F.arrays_overlap("codes_a", "codes_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            for length in np.unique(size):
                at = np.flatnonzero(size == length)
                part = batch.take(pa.array(at))
                x, y = (_unit(part.column(k).flatten().to_numpy().astype(np.float64).reshape(-1, length)) for k in (2, 3))
                ok = pa.array((x * y).sum(axis=1) >= cosine)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    return both.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long")


def embedding_near_duplicates(embeddings: DataFrame, cosine: float = 0.9, tables: int | None = None, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings``.

    Vectors are linked when they are found in a common bucket and their cosine in
    double precision reaches ``cosine``, which is above 0 and at most 1; no other
    pair is linked. There are as many tables as ``MISS`` asks for, or ``tables``.
    With ``exact`` no pair is missed: all vectors are in one bucket, and every pair
    of blocks is compared. A vector that is
    null or zero, or holds a null or a non-finite component, has no link; nor have
    vectors of different lengths. n_links counts the other vectors linked
    directly, equal vectors too. component_id is the smallest vec_id that can be
    reached. Every row is a vector of its own: rows that repeat a vec_id, with an
    equal vector or another one, each have their links and their component, and
    count in n_links of others; a row with a null vec_id gets no component, takes no
    part, and is kept. Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError(f"cosine must be above 0 and at most 1: {cosine}")
    base = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.expr(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    usable = base.filter(good)
    # equal vectors: one class, by a 128-bit digest of the components (-0.0 counts as 0.0)
    keyed = usable.withColumn("v", F.expr("transform(v, x -> x + 0D)")).withColumn("key", F.md5(F.expr("array_join(transform(v, x -> cast(x as string)), ',')")))
    members = stored(keyed)
    classes = members.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    # a class has a number of its own: rows that repeat a vec_id may be in several classes
    numbered = stored(
        members.join(classes, "key").filter("vec_id = least").dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("rep"), "key", "least", "m", "v")
    )
    vectors = numbered.select("rep", "m", "v")
    n = vectors.count()
    bits = 0 if exact else min(40, max(4, round(math.log2(max(n, 1) / BUCKET))))
    tables = 1 if exact else tables or table_count(bits, cosine)
    most = SIGNS if exact else _most(cosine)
    balls = stored(_balls(vectors.withColumn("ball", F.col("rep")), bits, min(tables, BALL_TABLES), cosine))
    balled = vectors.join(balls, "rep", "left").withColumn("ball", F.coalesce("ball", "rep"))  # a vector of no ball is its own
    placed = _buckets(balled, bits, tables)
    found = stored(_candidates(placed, most))
    dense = stored(found.filter("a is null").select("tab", "bucket").distinct().withColumn("unit", F.monotonically_increasing_id()))
    inside = stored(placed.join(dense, ["tab", "bucket"]).select("unit", "rep"))
    known = stored(
        balled.join(inside.groupBy("rep").agg(F.collect_list("unit").alias("codes")), "rep", "left")
        .withColumn("codes", F.coalesce("codes", F.expr("cast(array() as array<bigint>)")))
    )
    sparse = found.filter("a is not null").join(dense, ["tab", "bucket"], "left_anti").select("a", "b").distinct()
    pairs = stored(_verified(sparse, known, cosine))
    blocks = stored(_dense_links(inside, known, cosine))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    sizes = vectors.select("rep", "m").join(balls, "rep")
    of_ball = sizes.join(sizes.groupBy("ball").agg(F.sum("m").alias("total")), "ball").select("rep", (F.col("total") - F.col("m")).alias("m"))
    of_pairs = both.join(vectors.select(F.col("rep").alias("o"), "m"), "o").select("rep", "m")
    degree = (
        of_pairs.unionByName(of_ball).unionByName(blocks.select("rep", F.col("others").alias("m")))
        .groupBy("rep").agg(F.sum("m").alias("others"))
    )
    edges = pairs.unionByName(balls.select(F.col("ball").alias("a"), F.col("rep").alias("b"))).unionByName(blocks.select(F.col("root").alias("a"), F.col("rep").alias("b")))
    label = components(edges, "a", "b")
    placed_in = numbered.select("rep", "key", "least", "m").join(label, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component_id", "rep")).drop("id", "component_id")
    least = placed_in.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = (
        placed_in.join(degree, "rep", "left").join(least, "component")
        .select("key", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    )
    linked = members.select("vec_id", "key").join(by_class, "key").select("vec_id", "n_links", "component_id", F.expr("vec_id = component_id").alias("kept"))
    alone = base.filter(~F.coalesce(good, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)
