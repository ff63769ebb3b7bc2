"""Secrets: plain patterns, and weak parts linked within a scope.

A key pair leaks as several parts: an identifier, a secret, an endpoint. Alone,
a random-looking token, a login or a web address means little. Strong parts
(assignments, access identifiers, long hex strings) are always reported; a weak
part only when its complement's interval meets the part's interval widened by
``SCOPE`` characters. That interval join runs within a row, as a sweep over the
ends of the intervals. All of it is SQL expressions in one projection: no
shuffle, no Python. Many matches of a text take linear time, but for sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import free_names, joined, keep, let, matches, running

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "login", "endpoint")
#: Code points on either side of a part within which a complement counts.
SCOPE = 200
_IDS = "('access', 'login')"
_SECRETS = "('assign', 'hex', 'key')"


def _found(text: str) -> dict[str, str]:
    word = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]"
    return {
        "assign": keep(
            matches(text, "assign", 0, word + r"\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", group=1, when=f"{text} rlike r'{word}'"),
            "length(s.value) >= 8",
        ),
        "access": matches(text, "access", 1, r"AKIA[A-Z0-9]{12,}+", when=f"instr({text}, 'AKIA') > 0"),
        "hex": matches(text, "hex", 2, r"[0-9a-f]{32,}+", when=f"{text} rlike r'[0-9a-f]{{32}}'"),
        "key": keep(
            matches(text, "key", 3, r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", when=f"{text} rlike r'[A-Za-z0-9/+]{{40}}'"),
            "s.value rlike '[0-9]' and s.value rlike '[a-z]' and s.value rlike '[A-Z]'",
        ),
        "login": matches(
            text, "login", 4, r"(?i:user(?:name)?|login|account|client_id)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9@._-]{3,}+",
            when=rf"{text} rlike r'(?i:user|username|login|account|client_id)[\x22\x27]?\x20*[:=]'",
        ),
        "endpoint": matches(text, "endpoint", 5, r"https?://[A-Za-z0-9.-]++(?::[0-9]+)?", when=f"instr({text}, '://') > 0"),
    }


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of start, rank, end, kind by start, then rank.

    Offsets are code points of the whole match, the end is exclusive. Base kinds
    are always reported. A key is reported with an identifier in scope, a login
    with a secret, an endpoint with both. A null or empty text has an empty
    array. All rows and other columns stay; a column ``secrets`` is replaced.
    """
    docs = docs.drop("secrets")
    whole = f"coalesce(cast(`{text}` as string), '')"
    own = free_names(docs.columns, KINDS)
    found = docs.withColumns({own[k]: F.expr(e) for k, e in _found(whole).items()})
    plain = "s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end, 'kind', s.kind)"
    base, weak = (f"transform(concat({', '.join(own[k] for k in kinds)}), {plain})" for kinds in (BASE, KINDS[len(BASE):]))
    # one sweep: a part enters where it starts, a weak part asks where its scope ends; whatever reaches back into the scope meets it
    enters = "s -> named_struct('at', s.start, 'asks', 0, 'part', s)"
    asks = f"s -> named_struct('at', s.end + {SCOPE}, 'asks', 1, 'part', s)"
    events = f"sort_array(concat(transform({base}, {enters}), transform({weak}, {enters}), transform({weak}, {asks})))"

    def reach(kinds: str) -> str:
        return let(f"transform(events, e -> if(e.asks = 0 and e.part.kind in {kinds}, e.part.end, {-SCOPE - 1}))", "ends", running("ends", "greatest(x, y)"))

    near = "{0}[i] >= e.part.start - " + str(SCOPE)
    linked = (
        f"e.asks = 1 and case e.part.kind when 'key' then {near.format('ids')} when 'login' then {near.format('secrets')} "
        f"else {near.format('ids')} and {near.format('secrets')} end"
    )
    reported = let(events, "events", let(reach(_IDS), "ids", let(reach(_SECRETS), "secrets", f"transform(filter(events, (e, i) -> {linked}), e -> e.part)")))
    some = " or ".join(f"size({own[k]}) > 0" for k in KINDS[len(BASE):])
    return found.withColumn("secrets", F.expr(f"sort_array(if({some}, concat({base}, {reported}), {base}))")).drop(*own.values())


def secrets_report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text, per row."""
    spans = find_secrets(docs.select("doc_id", "text"))
    base = f"filter(secrets, s -> s.rank < {len(BASE)})"
    return spans.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined(base)), 256).alias("base_sha256"),
        F.expr(joined("secrets")).alias("spans"),
    )
