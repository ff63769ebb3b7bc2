"""Personal data: patterns propose, checksums confirm, context words weigh.

Everything is one projection of SQL expressions over a row's own text: no
shuffle, no Python. Patterns are possessive or guarded, so that long runs of
characters take linear time; so do many matches, but for sorting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import bind, free_names, joined, keep, matches, part, pieces, reaching

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone")
#: A span that is not of a base kind is reported from this score on.
MIN_SCORE = 0.6
#: kind: score after its validator, gain with a context word before it, context words.
SCORES = {
    "email": (0.9, 0.1, "mail|contact|write|contacto|courriel|kontakt"),
    "ip": (0.6, 0.3, "address|host|server|adresse|dirección"),
    "card": (0.7, 0.3, "card|visa|credit|carte|karte|tarjeta"),
    "phone": (0.7, 0.3, "call|phone|tel|mobile|fax|anruf"),
    "iban": (0.9, 0.1, "iban|account|konto|compte|cuenta"),
    "local_phone": (0.4, 0.3, "call|phone|tel|mobile|fax|anruf"),
}
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_MOD97 = (
    "aggregate(split(concat(substring(replace(s.value, ' ', ''), 5), left(s.value, 4)), ''), 0, "
    "(n, c) -> case when c = '' then n when c between '0' and '9' then (n * 10 + cast(c as int)) % 97 else (n * 100 + ascii(c) - 55) % 97 end) = 1"
)


def _found(text: str) -> dict[str, str]:
    """kind: expression of its confirmed spans."""
    return {
        "email": matches(text, "email", 0, rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", when=f"instr({text}, '@') > 0"),
        "ip": keep(
            matches(text, "ip", 1, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", when=rf"{text} rlike r'[0-9]\.[0-9]'"),
            rf"s.value rlike r'^{_PART}(?:\.{_PART}){{3}}$'",
        ),
        "card": keep(
            matches(text, "card", 2, r"[0-9](?:[\x20-]?[0-9])++", when=rf"{text} rlike r'[0-9](?:[\x20-]?[0-9]){{11}}'"),
            f"length({_DIGITS}) between 12 and 19 and luhn_check({_DIGITS})",
        ),
        "phone": keep(
            matches(text, "phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", when=f"instr({text}, '+') > 0"),
            f"length({_DIGITS}) between 9 and 15",
        ),
        "iban": keep(
            matches(text, "iban", 4, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", when=rf"{text} rlike r'[A-Z]{{2}}[0-9]{{2}}'"),
            f"length(replace(s.value, ' ', '')) between 15 and 34 and {_MOD97}",
        ),
        "local_phone": matches(text, "local_phone", 5, r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", when=rf"{text} rlike r'[0-9]{{3}}[\x20.-][0-9]{{4}}'"),
    }


def _score(kind: str) -> str:
    score, gain, words = SCORES[kind]
    return f"{score}D + if(lower(s.before) rlike r'\\b(?:{words})', {gain}D, 0D)"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: an array of start, rank, end, kind, value, score by start, then rank.

    Offsets are code points, the end is exclusive. Base kinds are always
    reported; iban and local_phone only from ``MIN_SCORE`` on. A null or empty
    text has an empty array. All rows and other columns stay; a column ``pii`` is
    replaced.
    """
    docs = docs.drop("pii")
    whole = f"coalesce(cast(`{text}` as string), '')"
    own = free_names(docs.columns, KINDS)
    found = docs.withColumns({own[k]: F.expr(e) for k, e in _found(whole).items()})
    scored = ", ".join(
        f"transform({own[k]}, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end, 'kind', s.kind, 'value', s.value, 'score', {_score(k)}))" for k in KINDS
    )
    kept = f"filter(concat({scored}), s -> s.rank < {len(BASE)} or s.score >= {MIN_SCORE})"
    return found.withColumn("pii", F.expr(f"sort_array({kept})")).drop(*own.values())


def masked(text: Column, spans: Column) -> Column:
    """``text`` with the characters of the spans of ``find_pii`` replaced by their kind in brackets.

    Overlapping spans are masked as one, under the kind of the first. A null text
    stays null.
    """
    whole = text.cast("string")

    def pieces_of(cut: Column, reach: Column) -> Column:
        """``reach[i]`` is how far the spans up to i reach; one that starts before that continues them."""

        def one(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(reach[i - 1])
            return F.when((i > 0) & (s["start"] < before), F.lit("")).otherwise(F.concat(part(cut, before, s["start"]), F.lit("["), s["kind"], F.lit("]")))

        return F.concat(F.array_join(F.transform(spans, one), ""), part(cut, reach[F.size(reach) - 1], F.length(whole)))

    several = bind(pieces(whole), lambda cut: bind(F.transform(spans, lambda s: s["end"]), lambda ends: bind(reaching(ends), lambda reach: pieces_of(cut, reach))))
    return F.when(F.size(spans) == 0, whole).otherwise(several)


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text, per row."""
    spans = find_pii(docs.select("doc_id", "text"))
    base = f"filter(pii, s -> s.rank < {len(BASE)})"
    return spans.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined(base)), 256).alias("base_sha256"),
        F.expr(joined("pii")).alias("spans"),
    )
