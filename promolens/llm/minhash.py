"""MinHash near-duplicates with bottom-k sketches from one hash function.

A document's set is the hashes of its distinct word shingles. Documents with
equal sets collapse into a class, whose smallest id stands for it. The sketch is
the k smallest hashes. Inverted lists of retained values bring documents
together; in each such group the Jaccard similarity is estimated from the
union's sketch, the k smallest values of both, and pairs that pass are verified
on the full sets.

Which values are listed: of the union's sketch of two linked documents at least
``least_common`` values lie in both but for a probability below ``MISS``, so the
two sketches must share a value among the first s - least + 1 in any common
order. The order is rarest first, so a passage of very many documents forms a
list only for documents that consist of little else. Values of one document
alone need no list.

The lists with the same smallest document, the leader, are one group. A group is
dealt in blocks of about ``BLOCK`` documents and ``BLOCK_SHINGLES`` shingles, each
with a copy of the leader. Documents that their block connects with the leader
are in one component whatever else they are linked with, so only the others, the
rest, are compared once more, with the whole group, block by block. A block
returns no more than a spanning forest of its verified links. So no group lies in
one task, pairs are never emitted as rows, and a group of variants of one document
takes time in proportion to its size.

A group whose rest fills more than ``PARTS`` blocks, such as pages that share a
template and are not linked at all, is cut finer first: by full sets, of which two
linked documents must share one of the rarest n - ceil(n * threshold) + 1 values.
Values of the template are not among these, so pages of one template alone meet
no more.
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
from .textops import Words, blocks, mix

K = 48
SHINGLE = 5
#: Probability, at most, that the estimate loses a pair at the threshold.
MISS = 1e-8
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
#: Blocks of a group's rest from which on the group is cut finer.
PARTS = 4
#: Rows of the second comparison that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_NONE = np.uint64(2**64 - 1)
#: Pairs whose unions are sketched together.
PAIRS = 1 << 13


def least_common(num: int, den: int, k: int = K) -> int:
    """How many of a union's k smallest values lie in both sets, at least, but for a probability below ``MISS``."""
    p, below, n = num / den, 0.0, 0
    while n < k and (below := below + math.comb(k, n) * p**n * (1 - p) ** (k - n)) < MISS:
        n += 1
    return max(1, n)


def _sets(b: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each document of a block."""
    w = Words(b, off, lower=True)
    at, h = w.grams(size)
    cuts = np.searchsorted(at, w.bounds)
    out = []
    for d in range(len(off) - 1):
        if w.count[d] >= size:
            out.append(np.unique(h[cuts[d] : cuts[d + 1]]))
        elif w.count[d]:
            x = w.count[d : d + 1].astype(np.uint64)
            for y in w.hash[w.bounds[d] : w.bounds[d + 1]]:
                x = mix(x * np.uint64(31) + y)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the k smallest hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, off in blocks(batch.column(1)):
                sets = _sets(b, off)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                kept = np.minimum(n, k)
                values = np.concatenate([s[:k] for s in sets]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n), pa.array(h1), pa.array(h2), lists], ["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sketch, "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>"
    )


def groups(reps: DataFrame, least: int, k: int = K) -> DataFrame:
    """(leader, doc_id, n_shingles): documents that share a listed value, by the smallest of them."""
    values = reps.filter("n_shingles > 0").select("doc_id", "h1", "n_shingles", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    need = F.ceil(F.col("s") * least / k)
    listed = (
        values.join(shared, "value")
        .groupBy("doc_id", "h1", "n_shingles", "s").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))  # at most k values
        .withColumn("first", F.col("s") - need + 1 - (F.col("s") - F.size("own")))
        .filter("first > 0")
        .select("doc_id", "n_shingles", F.explode(F.expr("slice(own, 1, cast(first as int)).value")).alias("value"))
    )
    lists = stored(listed)
    leaders = lists.groupBy("value").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    return lists.join(leaders, "value").groupBy("leader", "doc_id").agg(F.max("n_shingles").alias("n_shingles"))


def _union_common(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the sketch of each pair's union: how many values lie in both sets, and its size."""
    a, c = np.full((len(left), k), _NONE), np.full((len(right), k), _NONE)
    for table, sets in ((a, left), (c, right)):
        for x, s in enumerate(sets):
            table[x, : min(k, len(s))] = s[:k]
    both, size = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        x = np.sort(np.concatenate([a[i[at : at + PAIRS]], c[j[at : at + PAIRS]]], axis=1), axis=1)
        again = np.zeros(x.shape, bool)
        again[:, 1:] = (x[:, 1:] == x[:, :-1]) & (x[:, 1:] != _NONE)
        rank = np.cumsum(~again & (x != _NONE), axis=1)
        both[at : at + PAIRS] = (again & (rank <= k)).sum(axis=1)
        size[at : at + PAIRS] = np.minimum(rank[:, -1], k)
    return both, size


def _links(left: list[np.ndarray], right: list[np.ndarray], same: bool, num: int, den: int, least: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with den * intersection >= num * union, found over shared values."""
    every = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    if not left or not right or not len(every):
        return np.zeros(0, int), np.zeros(0, int)
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])

    def counts(a: list[np.ndarray], c: list[np.ndarray]) -> np.ndarray:
        """Sizes of all intersections: a product of 0/1 matrices, some values at a time."""
        out = np.zeros((len(a), len(c)), np.float32)
        va, vc = np.concatenate(a), np.concatenate(c)
        ra, rc = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(c)), [len(s) for s in c])
        both = np.intersect1d(va, vc)
        ia, ic = np.searchsorted(both, va), np.searchsorted(both, vc)
        ka, kc = np.isin(va, both), np.isin(vc, both)
        ra, ia, rc, ic = ra[ka], ia[ka], rc[kc], ic[kc]
        step = 4096
        oa, oc = np.argsort(ia, kind="stable"), np.argsort(ic, kind="stable")
        ra, ia, rc, ic = ra[oa], ia[oa], rc[oc], ic[oc]
        for at in range(0, len(both), step):
            xa, xc = slice(*np.searchsorted(ia, [at, at + step])), slice(*np.searchsorted(ic, [at, at + step]))
            width = min(step, len(both) - at)
            p, q = np.zeros((len(a), width), np.float32), np.zeros((len(c), width), np.float32)
            p[ra[xa], ia[xa] - at] = 1
            q[rc[xc], ic[xc] - at] = 1
            out += p @ q.T
        return out

    # values of the union's sketch that lie in both sets are shared values of the two sketches: these bound the estimate from above
    common = counts([s[:k] for s in left], [s[:k] for s in right])
    smaller, larger = np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :])
    likely = (k * common >= least * np.minimum(larger, k)) & (den * smaller >= num * larger)
    if same:
        likely &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(likely)
    both, size = _union_common(left, right, i, j, k)
    i, j = i[k * both >= least * size], j[k * both >= least * size]
    if len(i) * 8 > likely.size:
        inter = counts(left, right)[i, j]
    else:
        inter = np.array([len(np.intersect1d(left[a], right[c], assume_unique=True)) for a, c in zip(i, j, strict=True)], float)
    inter = inter.astype(np.int64)
    ok = den * inter >= num * (n[i] + m[j] - inter) if len(i) else np.zeros(0, bool)
    return i[ok], j[ok]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between 0..n-1, each tree a star at its least member."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, c in zip(i.tolist(), j.tolist(), strict=True):
        a, c = find(a), find(c)
        if a != c:
            root[max(a, c)] = min(a, c)
    return [(r, x) for x in range(n) if (r := find(x)) != x]


def _in_units(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole units of rows in order; one is complete when the next begins."""
    waiting: list[pd.DataFrame] = []
    key = None
    for pdf in frames:
        for k, part in pdf.groupby(keys, sort=False):
            if key is not None and k != key:
                yield pd.concat(waiting)
                waiting = []
            key = k
            waiting.append(part)
    if waiting:
        yield pd.concat(waiting)


def _sets_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [s for _, _, b, off in blocks(pa.array(pdf["text"], pa.string())) for s in _sets(b, off)]


def finer_groups(rest: DataFrame, members: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, doc_id, n_shingles) as ``groups``, by the full sets of all documents in the groups of ``rest``; only with one of the rest in it."""
    inside = members.join(rest.select("leader").distinct(), "leader", "left_semi").select("doc_id").distinct()
    full = stored(sketches(docs.select(F.col("doc_id").cast("long"), "text").join(inside, "doc_id", "left_semi"), 1 << 40))
    finer = stored(groups(full, num, den))
    useful = finer.join(rest.select("doc_id").distinct(), "doc_id", "left_semi").select("leader").distinct()
    return stored(finer.join(useful, "leader", "left_semi"))


def rest_units(rest: DataFrame, sized: DataFrame) -> DataFrame:
    """(leader, own, part, doc_id, first): parts of the rest with each block of their group."""
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    asked = rest.select("leader", every_block.alias("own"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), "doc_id", F.lit(0).alias("first"))
    parts = rest.select("leader", "parts").distinct()
    return asked.unionByName(sized.join(parts, "leader").select("leader", "own", every_part.alias("part"), "doc_id", F.lit(1).alias("first")))


def verified_links(members: DataFrame, docs: DataFrame, num: int, den: int, finer: bool = True) -> DataFrame:
    """(a, b) links that connect what the verified links of all groups connect; groups of much rest are cut ``finer`` once."""
    least = least_common(num, den)
    per = members.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    sized = members.join(per, "leader").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def with_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
        return texts.join(rows, "doc_id").repartition(*keys).sortWithinPartitions(*keys, "first", "doc_id")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links within a block; of a group of several blocks also the documents that are not connected with the leader."""
        for pdf in _in_units(frames, ["leader", "own"]):
            ids, leader = pdf["doc_id"].to_numpy(), pdf["leader"].iloc[0]
            sets = _sets_of(pdf)
            tree = forest(*_links(sets, sets, True, num, den, least), len(ids))
            a, c = (np.array([ids[t[k]] for t in tree], np.int64) for k in (0, 1))
            if len(a):
                yield pd.DataFrame({"a": a, "b": c, "rest": False})
            if pdf["blocks"].iloc[0] > 1:
                root = np.arange(len(ids))
                for r, x in tree:
                    root[x] = r
                rest = ids[~np.isin(root, root[ids == leader])]
                yield pd.DataFrame({"a": np.full(len(rest), leader), "b": rest, "rest": True})

    def compare_rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links between the rest of a group, in blocks, and each of its blocks."""
        for pdf in _in_units(frames, ["leader", "own", "part"]):
            ids, sets = pdf["doc_id"].to_numpy(), _sets_of(pdf)
            cut = int((pdf["first"] == 0).sum())
            i, j = _links(sets[:cut], sets[cut:], False, num, den, least)
            tree = forest(i, j + cut, len(ids))
            yield pd.DataFrame({"a": np.array([ids[r] for r, _ in tree], np.int64), "b": np.array([ids[x] for _, x in tree], np.int64)})

    whole = sized.select("leader", "own", "blocks", "doc_id", F.lit(1).alias("first"))
    leaders = sized.filter("leader = doc_id and blocks > 1").withColumn("block", every_block).filter("block <> own")
    dealt = whole.unionByName(leaders.select("leader", F.col("block").alias("own"), "blocks", "doc_id", F.lit(0).alias("first")))
    rows = with_texts(dealt, ["leader", "own"]).select("leader", "own", "blocks", "doc_id", "text")
    found = stored(rows.mapInPandas(compare, "a long, b long, rest boolean"))
    links = found.filter("not rest").select("a", "b")
    rest = found.filter("rest").select(F.col("a").alias("leader"), F.col("b").alias("doc_id")).join(sized, ["leader", "doc_id"])
    if rest.isEmpty():
        return links
    parts = rest.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    rest = stored(rest.select("leader", "doc_id", "n_shingles", "blocks").join(parts, "leader"))
    if finer:
        large = rest.filter(F.col("parts") > PARTS)
        if not large.isEmpty():
            links = links.unionByName(verified_links(finer_groups(large, members, docs, num, den), docs, num, den, False))
            rest = rest.filter(F.col("parts") <= PARTS)
    keys = ["leader", "own", "part"]
    dealt = stored(rest_units(rest, sized))
    if dealt.count() <= BROADCAST_ROWS:  # five numbers a row: the texts need not be dealt out once more
        dealt = F.broadcast(dealt)
    rows = with_texts(dealt, keys).select(*keys, "first", "doc_id", "text")
    return links.unionByName(rows.mapInPandas(compare_rest, "a long, b long"))


def minhash_near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked when den * intersection >= num * union of their
    five-word shingle sets (A-Z in lower case; a shorter text is one shingle).
    A null or empty text has no shingle and no link. component_id is the smallest
    doc_id that can be reached, the own one included; rows with equal sets are
    linked like any others. Rows that repeat a doc_id are one vertex; each keeps
    its row. A row whose doc_id is null is never linked: component_id is null and
    it is kept. Other columns are ignored.
    """
    every = stored(sketches(docs))
    known = every.filter("doc_id is not null")
    classes = known.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # doc_id can repeat with another text: its rows are one vertex
    member = known.filter("n_shingles > 0").join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "rep")
    reps = known.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    links = verified_links(stored(groups(reps, least_common(num, den))), docs, num, den)
    label = components(links.unionByName(member.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), "a", "b")
    return every.join(label, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
