"""Prices, discounts and loyalty conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash

#: Discounts from here on are financing rates or mismatched variants, not markdowns.
IMPLAUSIBLE_DISCOUNT = 90.0
#: Trust bounds of a displayed discount.
TRUST_IMPLAUSIBLE, TRUST_SUSPECT, TRUST_PACK = 95, 85, 70
#: Phrases that reveal a loyalty programme, in order of precedence.
LOYALTY_PHRASES = (
    ("lidl_plus", ("lidl plus", "lidl+", "plus preis", "mit lidl plus")),
    ("payback", ("payback", "mit payback")),
    ("edeka_app", ("edeka app", "mit edeka app")),
    ("rewe_app", ("rewe app", "mit rewe app")),
    ("app_coupon", ("app-coupon", "app coupon", "coupon in der app", "digitaler coupon")),
    ("kundenkarte", ("kundenkarte", "clubkarte", "karte", "treuekarte")),
)
#: Hints in the conditions of a listing.
LOYALTY_HINTS = (
    ("lidl_plus", ("lidl plus", "lidl+")),
    ("rewe_app", ("rewe app",)),
    ("edeka_app", ("edeka app",)),
    ("penny_app", ("penny app",)),
    ("payback", ("payback",)),
    ("app", ("nur mit app", "app-preis", "app preis", "mit app")),
    ("card", ("kundenkarte", "clubkarte", "treuekarte")),
)
#: Titles that name a pack, whose regular price may be another unit's.
PACK_PATTERNS = (
    r"\b\d+\s*er[-\s]*pack(?:ung)?",
    r"\b\d+\s*[x×]\s*[\d.,]+\s*(?:l|ml|cl|g|kg|stk|st\.)",
    r"\bkasten\b",
    r"\btray\b",
    r"\bpalette\b",
    r"\bgebinde\b",
    r"\bharass(?:en)?\b",
    r"\b\d+\s*(?:flaschen?|dosen?|büchsen?|gläser)\b",
    r"\bsixpack\b",
    r"\bmehrweg-?kasten\b",
    r"\b\d+\s*[+]\s*\d+\b",
)
#: Fixed value: the part of a sentence that is shown as a condition.
CONDITION_SENTENCE = r"(?i)([^.!?\n]{0,80}(?:lidl plus|lidl\+|payback|edeka app|rewe app|app-coupon|app coupon|kundenkarte|clubkarte)[^.!?\n]{0,120})"
_NUMBER = r"\d+\.?\d*"
_EUR = r"\d{1,3}(?:\.\d{3})*,\d{2}\s*€"


def _number(text: Column) -> Column:
    return F.regexp_extract(text, _NUMBER, 0).try_cast("double")


def clean_price(text: Column) -> Column:
    """First number of a German price: dots part thousands, a comma the cents."""
    return _number(F.regexp_replace(F.regexp_replace(text, "[.€]", ""), ",", "."))


def clean_discount(text: Column) -> Column:
    """First number of a percentage."""
    return _number(text)


def clean_number(value: Column) -> Column:
    """A number with a decimal comma or point, other signs dropped."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), ",", "."), r"[^0-9.]", "").try_cast("double")


def price_candidates(text: Column) -> Column:
    """Distinct euro amounts of a text, first seen first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_EUR), F.lit(0)), clean_price))


def original_price(text: Column) -> Column:
    """The price after "statt" or "war"."""
    return clean_price(F.nullif(F.regexp_extract(text, r"(?i)(?:statt|war)\s+(\d[\d.,]*)\s*€", 1), F.lit("")))


def compute_discount(main: Column, secondary: Column, is_range: Column) -> Column:
    """Percent off with one decimal; null for missing, rising, ranged or implausible pairs."""
    percent = F.round((secondary - main) / secondary * 100, 1)
    ok = (main > 0) & (secondary > main) & ~F.coalesce(is_range, F.lit(False))
    return F.when(ok & (percent < IMPLAUSIBLE_DISCOUNT), percent)


def card_discount(effective: Column, original: Column) -> Column:
    """Percent off without guards; negative where the price rose."""
    return F.when(original > 0, F.round((1 - effective / original) * 100, 1))


def price_roles(main: Column, secondary: Column, requires_loyalty: Column) -> dict[str, Column]:
    """What a listing's two prices mean; 0 counts as missing."""
    price, second = F.nullif(main, F.lit(0.0)), F.nullif(secondary, F.lit(0.0))
    original = F.when(second > price, second)
    return {
        "price": price,
        "original_price": original,
        "loyalty_price": F.when(requires_loyalty, price),
        "standard_price": F.coalesce(original, price),
    }


def resolve_prices(primary: Column, text: Column, requires_loyalty: Column) -> dict[str, Column]:
    """Standard and loyalty price from a card's text: with a condition, the lowest and the next."""
    found = F.array_sort(price_candidates(text))
    two = requires_loyalty & (F.size(found) >= 2)
    one = requires_loyalty & (F.size(found) < 2)
    standard = F.when(two, F.get(found, F.lit(1))).when(one & primary.isNotNull(), F.lit(None)).otherwise(primary)
    loyalty = F.when(two, F.get(found, F.lit(0))).when(one, primary)
    return {"price": F.coalesce(standard, primary), "standard_price": standard, "loyalty_price": loyalty}


def loyalty_program(text: Column, phrases: tuple = LOYALTY_PHRASES) -> Column:
    """First programme with a phrase in the text, or null."""
    low = squash(F.lower(text))
    found = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in phrases]
    return F.coalesce(*found)


def loyalty_condition(text: Column) -> Column:
    """The part of a sentence around the condition, else the first phrase found; null without one."""
    sentence = squash(F.regexp_extract(text, CONDITION_SENTENCE, 1))
    low = squash(F.lower(text))
    phrase = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for _, ws in LOYALTY_PHRASES for w in ws])
    return F.when(loyalty_program(text).isNotNull(), F.coalesce(F.nullif(sentence, F.lit("")), phrase))


def structured_loyalty(conditions: Column) -> dict[str, Column]:
    """Programme of a listing's conditions: the last card named, else a hint in the texts."""
    rows = F.filter(F.coalesce(conditions, F.array().cast("array<struct<loyaltyProgram:struct<isCard:boolean,name:string>,other:string>>")), lambda c: c.isNotNull())
    cards = F.filter(rows, lambda c: F.coalesce(c["loyaltyProgram"]["isCard"], F.lit(False)))
    names = F.filter(F.transform(cards, lambda c: F.nullif(c["loyaltyProgram"]["name"], F.lit(""))), lambda n: n.isNotNull())
    texts = F.filter(F.transform(rows, lambda c: F.trim(c["other"])), lambda t: t.isNotNull() & (t != ""))
    named = F.when(F.size(names) > 0, F.element_at(names, -1))
    hinted = loyalty_program(F.array_join(texts, " "), LOYALTY_HINTS)
    return {
        "requires_loyalty": (F.size(cards) > 0) | (named.isNull() & hinted.isNotNull()),
        "loyalty_program": F.coalesce(named, hinted),
        "condition_text": F.nullif(F.array_join(texts, " · "), F.lit("")),
    }


def discount_trust(title: Column, discount: Column) -> Column:
    """trusted, suspect or implausible."""
    pack = F.lower(F.coalesce(title, F.lit(""))).rlike("(?iu)" + "|".join(PACK_PATTERNS))
    return (
        F.when(discount.isNull(), "trusted").when(discount > TRUST_IMPLAUSIBLE, "implausible").when(discount > TRUST_SUSPECT, "suspect")
        .when((discount > TRUST_PACK) & pack, "suspect").otherwise("trusted")
    )


def effective_discount(title: Column, discount: Column) -> Column:
    return F.when(discount_trust(title, discount) != "implausible", discount)


def percentile_tone(percentile: Column) -> Column:
    """Band of a price percentile; null stays null."""
    return F.when(percentile <= 15, "great").when(percentile <= 35, "good").when(percentile <= 65, "fair").when(percentile.isNotNull(), "high")
