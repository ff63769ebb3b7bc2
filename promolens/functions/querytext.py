"""Search phrases: price cap, stores, intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and words that the rules below look for.
GENERIC_PHRASES = (
    "was ist gerade im angebot", "was ist aktuell im angebot", "aktuelle angebote", "gerade im angebot", "heute im angebot", "welche angebote gibt es", "zeige aktuelle angebote",
)
STORES = ("lidl", "edeka", "aldi", "rewe", "penny", "netto")
BROCHURE_WORDS = ("prospekt", "katalog", "kataloge", "seite", "flyer")
INTENT_WORDS = {
    "scrape": ("lade", "aktualisiere", "neue angebote", "scan", "scrape"),
    "compare": ("vergleich", "unterschied", "welch", "besser"),
    "alert": ("benachrichtig", "alert", "erinner", "sobald"),
    "delete": ("lösch", "entfern", "deaktiviere"),
    "list": ("zeig", "mein", "list", "übersicht"),
}
CATALOG_WORDS = ("katalog", "kataloge", "catalog", "catalogs", "catalogue")
REVIEW_WORDS = ("review", "reviewv", "prüf", "pruef")
REVIEW_STORES = ("lidl", "aldi", "edeka")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def price_cap(text: Column) -> Column:
    """Number after "unter"; a comma is the decimal point."""
    return F.replace(F.regexp_extract(text, r"(?i)unter\s+([\d,.]+)", 1), F.lit(","), F.lit(".")).try_cast("double")


def intent(text: Column, whole_words: bool = False) -> Column:
    """Intent by ordered word lists; with ``whole_words`` a word must begin where the list's does."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def has(name: str) -> Column:
        words = INTENT_WORDS[name]
        return low.rlike(r"(?<![a-zäöüß])(?:" + "|".join(words) + ")") if whole_words else contains_any(low, words)

    return (
        F.when(low == "", "unknown").when(has("scrape"), "scrape").when(has("compare"), "compare")
        .when(has("alert") & has("delete"), "delete_alert").when(has("alert") & has("list"), "list_alerts").when(has("alert"), "set_alert").otherwise("query")
    )


def tag_queries(messages: DataFrame, text: str = "text", whole_words: bool = False) -> DataFrame:
    """A message log with what the search rules find in each message.

    Adds intent, price_cap, is_generic, is_brochure, stores (array), is_review,
    review_stores, review_mode. A null text counts as empty.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    named = F.filter(F.array(*map(F.lit, STORES)), lambda s: F.contains(low, s))
    review = F.filter(F.array(*map(F.lit, REVIEW_STORES)), lambda s: F.contains(low, s))
    return messages.withColumns({
        "intent": intent(F.col(text), whole_words),
        "price_cap": price_cap(F.col(text)),
        "is_generic": contains_any(low, GENERIC_PHRASES),
        "is_brochure": contains_any(low, BROCHURE_WORDS),
        "stores": named,
        "is_review": F.contains(low, F.lit("/review")) | contains_any(low, CATALOG_WORDS) & contains_any(low, REVIEW_WORDS),
        "review_stores": F.when(F.size(review) > 0, review).otherwise(F.array(*map(F.lit, REVIEW_STORES))),
        "review_mode": F.when(contains_any(low, ("manual", "manuell")), "manual").otherwise("auto"),
    })


def clean_keywords(words: Column, most: int = 5) -> Column:
    """Trimmed lower-case keywords of 2 to 40 characters, the first ones."""
    return F.slice(F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda w: F.length(w).between(2, 40)), 1, most)
