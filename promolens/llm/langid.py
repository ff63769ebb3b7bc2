"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of a letter n-gram binds
(multiplies) its letters' vectors, each permuted (rotated) by its place; a text's
vector bundles (adds) those of its n-grams. A language's prototype bundles the
texts of its training documents, each scaled to length 1. A text gets the
language whose prototype has the largest cosine with it.

Letter vectors are drawn from the code point alone, so no table has to be built
or sent. Binding is done once for each n-gram that a block of texts contains,
and bundling is one matrix product of counts and n-gram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

DIM = 1024
N = 3
#: Training documents at most, per language; chosen by hash of the id.
MAX_TRAINING = 20_000
#: Languages at most; each takes ``DIM`` numbers on the driver and in every task.
MAX_LANGUAGES = 10_000
#: Code points handled by one matrix product.
BLOCK_CHARS = 1 << 18
#: N-grams whose vectors are held together.
GRAMS = 2048
UNDETERMINED = "und"


@lru_cache(1 << 16)
def _letter(code: int) -> np.ndarray:
    return np.random.default_rng((20090601, code)).integers(0, 2, DIM).astype(np.float32) * 2 - 1


_lower = np.zeros(0x110000, np.uint32)  # filled on first use


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    if not _lower[97]:
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                _lower[c] = ord(s.lower()[0])
    return _lower


def _vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of texts, and which of them have letters.

    Each text has a blank before and after it, so its vector depends on nothing
    else. Its components are whole numbers, added without rounding.
    """
    table, n = _letters(), len(texts)
    out, found = np.zeros((n, DIM)), np.zeros(n, bool)
    i = 0
    while i < n:
        j, size = i, 0
        while j < n and (j == i or j - i < 256 and size + len(texts[j]) <= BLOCK_CHARS):
            size += len(texts[j])
            j += 1
        raw = np.frombuffer("".join(f"\0{t}\0" for t in texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[raw]
        long = np.array([len(t) + 2 for t in texts[i:j]])
        doc = np.repeat(np.arange(j - i), long)
        found[i:j] = np.bincount(doc, weights=letter > 0, minlength=j - i) > 0
        keep = (letter > 0) | np.concatenate([[True], letter[:-1] > 0])  # one blank between words
        keep[np.cumsum(long) - long] = True
        letter, doc = letter[keep].astype(np.int64), doc[keep]
        code = letter[:-2] << 42 | letter[1:-1] << 21 | letter[2:]
        inside = (doc[:-2] == doc[2:]) & (code > 0)
        code, doc = code[inside], doc[:-2][inside]
        grams, at = np.unique(code, return_inverse=True)
        exact = np.float32 if len(code) < 1 << 24 else np.float64  # sums of fewer ones are exact in 32 bits
        for g in range(0, len(grams), GRAMS):
            part = grams[g : g + GRAMS]
            own = (at >= g) & (at < g + GRAMS)
            used, back = np.unique(np.stack([part >> 42, part >> 21 & 0x1FFFFF, part & 0x1FFFFF]), return_inverse=True)
            base, back = np.stack([_letter(int(c)) for c in used]), back.reshape(3, -1)
            bound = np.roll(base, 2, 1)[back[0]] * np.roll(base, 1, 1)[back[1]] * base[back[2]]
            counts = np.bincount(doc[own] * len(part) + (at[own] - g), minlength=(j - i) * len(part)).reshape(j - i, -1)
            out[i:j] += counts.astype(exact) @ bound.astype(exact)
        i = j
    return out, found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_profiles(docs: DataFrame, training: Column, most: int = MAX_TRAINING, most_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Prototype of each language from about ``most`` training documents of each at most.

    ``docs`` needs doc_id, text and lang. Each task adds up its own documents and
    sends one vector per language. Every language of the training documents is
    learned; more than ``most_languages`` of them raise a ValueError, as then
    ``lang`` does not hold languages.
    """
    sized = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = sized.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(per_lang) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    # keep a document by hash so that about ``most`` of each language remain at every size
    share = {r["lang"]: min(1.0, most / r["count"]) for r in per_lang}
    if not share:
        return {}
    chosen = sized.select("lang", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)).alias("draw"))
    if min(share.values()) < 1:
        rate = F.create_map(*[F.lit(x) for kv in share.items() if kv[1] < 1 for x in kv])[F.col("lang")]
        chosen = chosen.filter(F.col("draw") < F.coalesce(rate, F.lit(1.0)) * (1 << 20))
    chosen = chosen.select("lang", "text")

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in frames:
            vectors, found = _vectors(pdf["text"].tolist())
            vectors = _unit(vectors)
            for lang, at in pdf.groupby("lang").indices.items():
                sums[lang] = sums.get(lang, np.zeros(DIM)) + vectors[at[found[at]]].sum(axis=0)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "i": np.arange(DIM), "x": v})

    total = chosen.mapInPandas(bundle, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()  # languages times DIM numbers
    return {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in sorted(rows, key=lambda r: r["lang"])}


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score (cosine, at least 0) from ``text`` alone.

    All columns of ``docs`` stay. A null text, or one without a letter, gets
    ``und`` and 0, as does every text when there are no profiles; ties go to the
    language that sorts first. Repeated rows each get their row. A row's result
    depends on its text and the profiles alone, however the table is dealt. Texts
    are read whole, however long; an empty table gives no rows.
    """
    names = list(profiles)
    protos = _unit(np.stack([profiles[k] for k in names])) if names else np.zeros((0, DIM))
    taken = {c.lower() for c in docs.columns}
    if taken & {"lang_pred", "score"}:
        docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    at = [c.lower() for c in docs.columns].index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):  # small batches leave, so that no task holds all texts twice
                batch = whole.slice(k, 512)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                vectors, found = _vectors(texts)
                # rounded, so that no order of adding up shows in a tie or a score
                cos = np.round(_unit(vectors) @ protos.T, 9) if names else np.zeros((len(texts), 0))
                best = cos.argmax(axis=1) if names else np.zeros(len(texts), int)
                ok = found & bool(names)
                lang = [names[k] if y else UNDETERMINED for k, y in zip(best, ok, strict=True)]
                score = np.where(ok, np.clip(cos.max(axis=1), 0, 1) if names else 0.0, 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that never train: the CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
