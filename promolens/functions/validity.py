"""Validity windows, weeks and German dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import squash

TZ = "Europe/Berlin"
#: Weekday names, Monday is 0.
WEEKDAYS = {
    "montag": 0, "mo": 0, "dienstag": 1, "di": 1, "mittwoch": 2, "mi": 2, "donnerstag": 3, "do": 3,
    "freitag": 4, "fr": 4, "samstag": 5, "sa": 5, "sonntag": 6, "so": 6,
}
_DATE = r"\d{1,2}\.\d{1,2}\.?(?:\d{2,4})?"
_WORD = rf"heute|morgen|übermorgen|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|mo|di|mi|do|fr|sa|so|{_DATE}"
#: The forms in which a validity is shown, in order of precedence.
_SHOWN = (
    r"(gültig\s+vom\s+.+?\s+bis\s+.+?)(?:$|[|,])",
    r"(vom\s+.+?\s+bis\s+.+?)(?:$|[|,])",
    r"((?:gültig\s+)?\d{1,2}\.\d{1,2}\.?\s*(?:bis|-)\s*\d{1,2}\.\d{1,2}\.?(?:\d{2,4})?)(?:$|[|,])",
    r"((?:ab|bis|nur am)\s+(?:heute|morgen|übermorgen|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|mo|di|mi|do|fr|sa|so|\d{1,2}\.\d{1,2}\.?(?:\d{2,4})?))(?:$|[|,])",
)


def local_date(at: Column, tz: str = TZ) -> Column:
    """Calendar date of a UTC timestamp in a time zone."""
    return F.to_date(F.from_utc_timestamp(at, tz))


def week_range(at: Column, which: str = "current", tz: str = TZ) -> tuple[Column, Column] | None:
    """(Monday, Sunday) of the current or next week; None for all weeks."""
    if which == "all":
        return None
    monday = F.to_date(F.date_trunc("week", F.from_utc_timestamp(at, tz)))
    if which == "next":
        monday = F.date_add(monday, 7)
    return monday, F.date_add(monday, 6)


def week_version(at: Column) -> Column:
    """Label version of an ISO week: v1-YYYY-Www."""
    return F.concat(F.lit("v1-"), F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def parse_timestamp(text: Column) -> Column:
    """ISO timestamp with +0000 or +00:00; without a zone it is UTC."""
    return F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def date_part(text: Column) -> Column:
    """Date of an ISO timestamp as written."""
    return F.substring(text, 1, 10).try_cast("date")


def german_date(text: Column, ref: Column, year: Column | None = None) -> Column:
    """dd.mm. or dd.mm.yy(yy); without a year the given one, else the reference's or the next.

    A date without a year that lies over seven days before the reference belongs
    to the next year. Impossible dates are null.
    """
    full = r"^(\d{1,2})\.(\d{1,2})(?:\.(\d{2,4})?)?$"
    day, month, own = (F.nullif(F.regexp_extract(F.trim(text), full, k), F.lit("")).cast("int") for k in (1, 2, 3))
    own = F.when(own < 100, own + 2000).otherwise(own)

    def made(y: Column) -> Column:
        return F.concat_ws(
            "-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
        ).try_cast("date")

    given = F.coalesce(own, year) if year is not None else own
    here = made(F.year(ref))
    rolled = F.when(here < F.date_sub(ref, 7), made(F.year(ref) + 1)).otherwise(here)
    return F.when(day.isNull(), F.lit(None).cast("date")).when(given.isNotNull(), made(given)).otherwise(rolled)


def relative_date(word: Column, ref: Column) -> Column:
    """heute, morgen, übermorgen, a weekday (the next one, today included) or a date."""
    weekday = F.create_map(*[F.lit(x) for kv in WEEKDAYS.items() for x in kv])[word]
    ahead = F.pmod(weekday - F.weekday(ref), F.lit(7)).cast("int")
    return (
        F.when(word == "heute", ref).when(word == "morgen", F.date_add(ref, 1)).when(word == "übermorgen", F.date_add(ref, 2))
        .when(weekday.isNotNull(), F.date_add(ref, ahead)).otherwise(german_date(word, ref))
    )


def parse_validity(df: DataFrame, text: str, ref: str) -> DataFrame:
    """``df`` with validity_text, valid_from, valid_to and is_upcoming read from a text.

    ``ref`` is the date column that relative words refer to. The first form found
    decides: a date range, vom ... bis, ab, bis, nur am.
    """
    day = F.col(ref)

    def first_of(patterns: dict[str, str]) -> Column:
        """What the first pattern that matches captures: its name, one or two words."""
        low = F.lower("__whole")
        cases = [
            F.when(low.rlike(p), F.struct(F.lit(k).alias("form"), F.regexp_extract(low, p, 1).alias("a"), (F.regexp_extract(low, p, 2) if k in ("range", "from_to") else F.lit("")).alias("b")))
            for k, p in patterns.items()
        ]
        return F.coalesce(*cases)

    word = r"(?<![a-z0-9_äöüß])"
    found = first_of({
        "range": rf"({_DATE})\s*(?:bis|-)\s*({_DATE})", "from_to": rf"vom\s+({_WORD})\s+bis\s+({_WORD})",
        "ab": rf"{word}ab\s+({_WORD})", "bis": rf"{word}bis\s+({_WORD})", "nur am": rf"{word}nur am\s+({_WORD})",
    })
    # one step each, kept apart by the lambda that holds it: text, words, dates, choice
    whole = df.withColumn("__whole", squash(F.coalesce(F.col(text), F.lit(""))))
    shown = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("__whole", "(?iu)" + p, 1)), F.lit("")) for p in _SHOWN])
    form = F.element_at(F.transform(F.array(found), lambda f: f), 1)
    read = whole.withColumns({"validity_text": shown, "__form": form})

    def window(f: Column) -> Column:
        plain = relative_date(f["a"], day)
        start = F.when(f["form"] == "range", german_date(f["a"], day)).otherwise(plain)

        def ends(a: Column) -> Column:
            end = F.when(f["form"] == "range", german_date(f["b"], day, F.year(a))).when(f["form"] == "from_to", relative_date(f["b"], day)).when(f["form"].isin("bis", "nur am"), a)
            return F.struct(F.when(f["form"] != "bis", a).alias("a"), end.alias("b"))

        return F.element_at(F.transform(F.array(start), ends), 1)

    dated = read.withColumn("__window", F.element_at(F.transform(F.array("__form"), window), 1))
    out = dated.withColumns({"valid_from": F.col("__window.a"), "valid_to": F.col("__window.b")}).drop("__whole", "__form", "__window")
    return out.withColumn("is_upcoming", F.coalesce(F.col("valid_from") > day, F.lit(False)))


def validity_display(valid_from: Column, valid_to: Column, is_upcoming: Column, raw: Column) -> Column:
    """A readable window; the raw text where there are no dates."""
    up = F.coalesce(is_upcoming, F.lit(False))
    a, b = valid_from.cast("string"), valid_to.cast("string")
    return (
        F.when(valid_from == valid_to, F.concat_ws(" ", F.when(up, "Gültig ab").otherwise("Gültig am"), a))
        .when(valid_from.isNotNull() & valid_to.isNotNull(), F.concat(F.lit("Gültig "), a, F.lit(" bis "), b))
        .when(valid_from.isNotNull(), F.concat_ws(" ", F.when(up, "Gültig ab").otherwise("Seit"), a))
        .when(valid_to.isNotNull(), F.concat(F.lit("Gültig bis "), b)).otherwise(raw)
    )
