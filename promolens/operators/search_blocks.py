"""The most similar offers of many queries, by matrix products of parts of both.

Offers and queries are dealt into parts; each pair of parts is one group of a
cogroup, so a task holds two parts, whatever the sizes of the tables. A product,
in single precision, only tells which pairs may be among a query's best; what it
can be off by is known. Those pairs are compared again by the sum that the
expressions in ``functions.vectors`` compute, term by term, so results do not
depend on a product's precision or on the order in which it adds.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, FloatType, IntegralType

#: Offers and queries of a group, about.
OFFERS_PART, QUERIES_PART = 16_384, 8_192
#: Offers and queries of one product; at most so many pairs are compared term by term at once.
OFFERS_STEP, QUERIES_STEP, PAIRS_STEP = 2_048, 512, 1 << 16
#: Offers of a part's first product, at most: all its pairs are tested for the conditions, and it gives the first limits.
FIRST_STEP = 512
#: More than a double-precision product's rounding for vectors of usual length.
_SLACK = 1e-9
#: Partitions of the cogroup, at most.
MAX_PARTITIONS = 4_096


def _usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can have a cosine that is not null; components stay floats or become doubles."""
    kind = df.schema[vector].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)):
        df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.filter(F.col(vector).isNotNull() & good)


def _alike(offers: DataFrame, queries: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    """Two columns in a type in which Python compares them as Spark does: decimals, else doubles."""
    kinds = [offers.schema[a].dataType, queries.schema[b].dataType]
    if any(isinstance(k, DecimalType) for k in kinds) and all(isinstance(k, (DecimalType, IntegralType)) for k in kinds):
        return tuple(F.col(c) if isinstance(k, DecimalType) else F.col(c).cast("decimal(20,0)") for c, k in zip((a, b), kinds, strict=True))
    return F.col(a).cast("double"), F.col(b).cast("double")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.list_flatten(column).combine_chunks(), np.float64).reshape(len(column), -1)


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products over the last axis, terms added in order."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for n in range(x.shape[-1]):
        total += x[..., n] * y[..., n]
    return total


def _paired(x: np.ndarray, y: np.ndarray, j: np.ndarray, i: np.ndarray) -> np.ndarray:
    """``_summed`` of columns j of x and i of y, a row for each term."""
    total = np.zeros(len(j))
    for a, b in zip(x, y, strict=True):
        total += a[j] * b[i]
    return total


def _cosine(dots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Minus infinity where the cosine is null."""
    value = dots / np.where(lengths == 0, np.nan, lengths)
    return np.where(np.isnan(value), -np.inf, value)


def slack(dims: int) -> float:
    """More than a single-precision product of two unit vectors is off by: a rounding for each term, some for the vectors and the limit."""
    return (dims + 16) * 2.0**-24


def round_half_up(value: np.ndarray, digits: int | None) -> np.ndarray:
    """As Spark's ``round``: halves of the shortest decimal go away from zero."""
    if digits is None or not len(value):
        return value
    scaled = value * 10.0**digits
    out = np.rint(scaled) / 10.0**digits + 0.0
    unsure = np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < max(1e-6, 10.0 ** (digits - 15))
    for n in np.flatnonzero(unsure & np.isfinite(value)):
        out[n] = float(Decimal(repr(float(value[n]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of two columns' values in their common order, NaN last; -1 for null."""
    known = [np.asarray(c.is_valid().combine_chunks()) for c in (a, b)]
    rows = [c.drop_null() for c in (a, b)]
    coded = [c.combine_chunks().dictionary_encode() for c in rows]
    plain = [np.array(c.dictionary.to_pylist(), object) if pa.types.is_decimal(c.type.value_type) else np.asarray(c.dictionary) for c in coded]
    place = np.unique(np.concatenate(plain), return_inverse=True)[1]
    out = [np.full(len(k), -1) for k in known]
    out[0][known[0]], out[1][known[1]] = place[: len(plain[0])][np.asarray(coded[0].indices)], place[len(plain[0]) :][np.asarray(coded[1].indices)]
    return out[0], out[1]


def _conditions(offers: pa.Table, queries: pa.Table):
    """``allowed(i, j)``: whether offers j meet the conditions of queries i."""
    tests = []
    if "max_price" in queries.column_names:
        price, most = _codes(offers.column("price"), queries.column("max_price"))
        price, most = np.where(price < 0, 1 << 40, price), np.where(most < 0, 1 << 41, most)
        tests.append(lambda i, j: price[j] <= most[i])
    if "min_discount" in queries.column_names:
        discount, least = _codes(offers.column("discount_percent"), queries.column("min_discount"))
        least = np.where(least < 0, -2, least)
        tests.append(lambda i, j: discount[j] >= least[i])
    for name, column, meets in (("category", "category", _holding), ("stores", "store", _listed)):
        if name in queries.column_names and queries.column(name).null_count < len(queries):
            tests.append(_table(queries.column(name).to_pylist(), offers.column(column), meets))

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.ones(np.broadcast_shapes(i.shape, j.shape), bool)
        for test in tests:
            out &= test(i, j)
        return out

    return allowed


def _holding(text: str, values: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring(values, text).fill_null(False))


def _listed(stores: tuple, values: pa.Array) -> np.ndarray:
    if not stores:
        return np.ones(len(values), bool)
    return np.asarray(pc.is_in(values, pa.array([s for s in stores if s is not None], values.type)))


def _table(asked: list, values: pa.ChunkedArray, meets):
    """A test that looks up pairs of distinct conditions and distinct values; a null condition is met by all."""
    coded = values.combine_chunks().dictionary_encode(null_encoding="encode")
    place = np.asarray(coded.indices)
    asked = [tuple(a) if isinstance(a, list) else a for a in asked]
    number = {a: n for n, a in enumerate(dict.fromkeys(asked))}
    table = np.array([np.ones(len(coded.dictionary), bool) if a is None else meets(a, coded.dictionary) for a in number])
    row = np.array([number[a] for a in asked])
    return lambda i, j: table[row[i], place[j]]


def _flags(flags: np.ndarray, size: int) -> np.ndarray:
    """Places of the few flags that are set among the first ``size``; there is room up to a multiple of 8."""
    end = -(-size // 8) * 8
    flags[size:end] = False
    eights = np.flatnonzero(flags[:end].view(np.uint64))
    at = np.flatnonzero(flags[:end].reshape(-1, 8)[eights])
    return eights[at >> 3] * 8 + (at & 7)


@np.errstate(all="ignore")
def best_of_parts(offers: pa.Table, queries: pa.Table, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, offer, similarity) of each query's k best; offers are in order of id, which decides ties."""
    x, y = _matrix(offers.column("embedding")), _matrix(queries.column("vector"))
    xn, yn = np.sqrt(_summed(x, x)), np.sqrt(_summed(y, y))
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    units = x / xn[:, None], y / yn[:, None]
    single = [u.astype(np.float32) for u in units]
    # lengths whose squares or products could leave the range of doubles
    odd_x, odd_y = (np.flatnonzero((n < 1e-100) | (n > 1e100)) for n in (xn, yn))
    cutoff = np.array(queries.column("cutoff").to_pylist(), float)
    allowed = _conditions(offers, queries)
    step = 10.0**-digits if digits is not None else 0.0
    off = slack(x.shape[1])

    def cosines(i: np.ndarray, j: np.ndarray, units: list, out: np.ndarray | None = None) -> np.ndarray:
        """Those of queries i with offers j, but for the product's rounding."""
        value = np.matmul(units[1][i[0] : i[-1] + 1], units[0][j[0] : j[-1] + 1].T, out=out)
        for n in odd_x[(odd_x >= j[0]) & (odd_x <= j[-1])]:
            value[:, n - j[0]] = _cosine(_summed(y[i], x[n]), yn[i] * xn[n])
        for n in odd_y[(odd_y >= i[0]) & (odd_y <= i[-1])]:
            value[n - i[0]] = _cosine(_summed(x[j], y[n]), xn[j] * yn[n])
        return value

    def less(limit: np.ndarray, off: float) -> np.ndarray:
        """What a product can be for a cosine of ``limit``: above what stands for none; those of odd lengths can be over one, or infinite."""
        limit = np.minimum(limit, 1e30)
        return np.maximum(limit - off * np.maximum(1, np.abs(limit)), -1e30)

    room, flags = np.empty(QUERIES_STEP * OFFERS_STEP, np.float32), np.empty(QUERIES_STEP * OFFERS_STEP + 7, bool)
    first = min(FIRST_STEP, OFFERS_STEP)
    found = []
    for q in range(0, len(y), QUERIES_STEP):
        i = np.arange(q, min(q + QUERIES_STEP, len(y)))
        limit = cutoff[i] - step / 2
        held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for o in (0, *range(first, len(x), OFFERS_STEP)):
            j = np.arange(o, min(o + OFFERS_STEP if o else first, len(x)))
            value = cosines(i, j, single, room[: len(i) * len(j)].reshape(len(i), len(j)))
            if o == 0:
                value[~allowed(i[:, None], j[None, :])] = -np.inf
                if len(j) > k:
                    limit = np.maximum(limit, less(np.partition(value, len(j) - k, axis=1)[:, len(j) - k].astype(float), off) - step)
            np.greater_equal(value, less(limit, off).astype(np.float32)[:, None], out=flags[: value.size].reshape(value.shape))
            r, c = np.divmod(_flags(flags, value.size), len(j))
            if o:
                met = allowed(i[r], j[c])
                r, c = r[met], c[met]
            if len(r) > value.size // 32:
                # many are as good as the last of k to single precision, as copies of one vector are
                met = cosines(i, j, units)[r, c] >= less(limit, _SLACK)[r]
                r, c = r[met], c[met]
            exact = []
            for n in range(0, len(r), PAIRS_STEP):
                at_x, at_y = j[c[n : n + PAIRS_STEP]], i[r[n : n + PAIRS_STEP]]
                exact.append(_cosine(_paired(xt, yt, at_x, at_y), xn[at_x] * yn[at_y]))
            exact = round_half_up(np.concatenate(exact) if exact else np.zeros(0), digits)
            good = (exact >= cutoff[i[r]]) & (exact > -np.inf)
            r, c, v = (np.concatenate(p) for p in zip(held, (r[good], j[c[good]], exact[good]), strict=True))
            order = np.lexsort((c, -v, r))
            r, c, v = r[order], c[order], v[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            held = r, c, v = r[keep], c[keep], v[keep]
            # a later offer must be better than the last of k, as its id is not smaller
            last = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k - 1)
            limit[r[last]] = np.maximum(limit[r[last]], v[last] + step / 2)
        found.append((q + held[0], held[1], held[2]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def nearest_in_parts(queries: DataFrame, offers: DataFrame, k: int, digits: int | None) -> DataFrame:
    """(query_id, id, similarity, rank) of the k best offers of each query; see ``search.nearest``."""
    narrowing = {"max_price": "price", "min_discount": "discount_percent", "category": "category", "stores": "store"}
    narrowing = {q: o for q, o in narrowing.items() if q in queries.columns}
    changed = {"q": {}, "o": {}}
    for q, o in narrowing.items():
        if q in ("max_price", "min_discount"):
            changed["o"][o], changed["q"][q] = _alike(offers, queries, o, q)
    if "category" in narrowing:
        changed["o"]["category"] = changed["q"]["category"] = F.lower("category")
    asked = _usable(queries.select("query_id", "vector", F.col("cutoff").cast("double").alias("cutoff"), *narrowing).withColumns(changed["q"]), "vector").filter("cutoff is not null and not isnan(cutoff)")
    rows = offers.filter(F.col("is_active")).select("id", "embedding", *dict.fromkeys(narrowing.values())).withColumns(changed["o"])
    rows = _usable(rows, "embedding")
    n_asked, n_rows = asked.count(), rows.count()
    q_parts, o_parts = max(1, -(-n_asked // QUERIES_PART)), max(1, -(-n_rows // OFFERS_PART))
    # stated, as the exchange is small beside the products and would be coalesced to a few tasks
    partitions = min(4 * q_parts * o_parts, MAX_PARTITIONS)

    def dealt(df: DataFrame, key: str, vector: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        """Rows in one of ``parts`` parts, once for each part of the other side."""
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        placed = df.withColumns({"dims": F.size(vector), own: F.pmod(F.xxhash64(key, vector), F.lit(parts)).cast("int")}).withColumn(other, every)
        return placed.repartition(partitions, "dims", "o_part", "q_part")

    left = dealt(rows, "id", "embedding", "o_part", o_parts, "q_part", q_parts)
    right = dealt(asked, "query_id", "vector", "q_part", q_parts, "o_part", o_parts)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {offers.schema['id'].dataType.simpleString()}, similarity double"

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "id", "similarity"]
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (b.schema.field("query_id").type, a.schema.field("id").type, pa.float64())], names)
        a = a.take(pc.sort_indices(a, sort_keys=[("id", "ascending")], null_placement="at_start"))
        i, j, value = best_of_parts(a, b, k, digits)
        return pa.Table.from_arrays([b.column("query_id").take(pa.array(i)), a.column("id").take(pa.array(j)), pa.array(value)], names)

    keys = ("dims", "o_part", "q_part")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")
