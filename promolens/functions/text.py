"""Titles, URLs and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def squash(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fingerprint_url(url: Column) -> Column:
    """16 hex digits that ignore letter case, outer white space and trailing slashes."""
    return F.substring(F.sha1(F.lower(F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/+$", ""))), 1, 16)


#: Characters of titles in comparisons, digests and messages.
COMPARISON_TITLE, DIGEST_TITLE, MESSAGE_TITLE = 40, 55, 60


def shorten(c: Column, most: int) -> Column:
    """The first ``most`` characters."""
    return F.substring(c, 1, most)


def canonical_url(base: Column, href: Column) -> Column:
    """An absolute link as it is, a relative one against its page."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_extract(base, r"^([a-z]+://[^/]+(?:/[^?#]*)?/)[^/]*$", 1)
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), href))
    )


def source_page(url: Column) -> tuple[Column, Column]:
    """(page number from the query string or null, the URL if it is a viewer page)."""
    page = F.regexp_extract(F.regexp_extract(url, r"\?([^#]*)", 1), r"(?:^|&)page=([^&]*)", 1).try_cast("int")
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return page, F.when(F.contains(F.lower(path), F.lit("contentviewer")), url)


def viewer_url(base: str, brochure_id: Column, page_number: Column) -> Column:
    """Link to a brochure page; stored pages count from 0, the viewer's from 1."""
    page = (F.coalesce(page_number, F.lit(0)) + 1).cast("string")
    return F.concat(F.lit(f"{base}/contentViewer/static/"), brochure_id, F.lit("?feature=brochure_shelf&page="), page)


def display_title(title: Column, brand: Column) -> Column:
    """The title with its brand in front unless it names it already."""
    t = F.coalesce(F.nullif(title, F.lit("")), F.lit("(ohne Titel)"))
    b = F.nullif(brand, F.lit(""))
    return F.when(b.isNotNull() & ~F.contains(F.lower(t), F.lower(b)), F.concat_ws(" ", b, t)).otherwise(t)


def title_from_alt(alt: Column) -> Column:
    """The product part of an image description."""
    head = F.regexp_extract(alt, r"^(.+?)\s+bei\s+.+?\s+im Prospekt", 1)
    return F.nullif(F.trim(F.when(head != "", head).otherwise(alt)), F.lit(""))


def url_slug(url: Column) -> Column:
    """Last path segment of a URL with at least one."""
    clean = F.regexp_replace(url, "/+$", "")
    return F.when(F.size(F.split(clean, "/")) > 3, F.element_at(F.split(clean, "/"), -1))


def rule_text(c: Column) -> Column:
    """Lower case, separators to blanks, umlauts spelled out: the form that keyword rules match."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[-_./]", " ")
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return squash(t)


def offer_link(base: str, url: Column, title: Column) -> Column:
    """The offer's own link, else a search link for its title, else the start page."""
    search = F.concat(F.lit(f"{base}/Angebote/"), F.replace(F.url_encode(F.trim(title)), F.lit("+"), F.lit("%20")))
    return F.when(blank_to_null(url).isNotNull(), url).when(blank_to_null(title).isNotNull(), search).otherwise(F.lit(base))


def image_link(large: Column, normal: Column, thumbnail: Column) -> Column:
    best = F.coalesce(*[F.nullif(c, F.lit("")) for c in (large, normal, thumbnail)])
    return F.when(best.startswith("//"), F.concat(F.lit("https:"), best)).otherwise(best)
