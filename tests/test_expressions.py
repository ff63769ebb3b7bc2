"""Prices, loyalty, validity, titles and categories: fixed cases."""

import random
import re
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from promolens.functions import prices, querytext, taxonomy, text, validity, vectors

REF = date(2026, 5, 16)


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean", date: "date", type(None): "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'array<string>')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("t", "v"), [("1.299,99 €", 1299.99), ("0,99€", 0.99), ("12,50", 12.5), ("ab 19 EUR", 19.0), ("kein Preis", None), (None, None), ("12.50", 1250.0)])
def test_clean_price(spark, t, v):
    assert one(spark, prices.clean_price(F.col("t")), t=t) == v


@pytest.mark.parametrize(("t", "v"), [("-38%", 38.0), ("38 %", 38.0), ("Rabatt 15", 15.0), (None, None)])
def test_clean_discount(spark, t, v):
    assert one(spark, prices.clean_discount(F.col("t")), t=t) == v


@pytest.mark.parametrize(
    ("main", "second", "ranged", "v"),
    [(0.99, 2.79, False, 64.5), (None, 2.0, False, None), (0.0, 2.0, False, None), (2.79, 2.79, False, None), (2.79, 1.99, False, None), (50.0, 100.0, True, None), (50.0, 100.0, False, 50.0), (1.0, 769.0, False, None), (11.0, 100.0, False, 89.0)],
)
def test_compute_discount(spark, main, second, ranged, v):
    df = spark.createDataFrame([(main, second, ranged)], "a double, b double, r boolean")
    assert df.select(prices.compute_discount(F.col("a"), F.col("b"), F.col("r"))).first()[0] == v


def test_price_candidates(spark):
    assert one(spark, prices.price_candidates(F.col("t")), t="9,99 € statt 7,49€ und 9,99 €") == [9.99, 7.49]


@pytest.mark.parametrize(("t", "v"), [("statt 9,99 €", 9.99), ("WAR 12,49 €", 12.49), ("statt 1.299,00 €", 1299.0), ("nur 7,49 €", None)])
def test_original_price(spark, t, v):
    assert one(spark, prices.original_price(F.col("t")), t=t) == v


@pytest.mark.parametrize(("t", "v"), [("Nur mit Lidl  Plus 1,99", "lidl_plus"), ("einfach billig", None), (None, None)])
def test_loyalty(spark, t, v):
    assert one(spark, prices.loyalty_program(F.col("t")), t=t) == v


@pytest.mark.parametrize(("title", "d", "v"), [("Bier 24x500ml", 75.0, "suspect"), ("Bier", 75.0, "trusted"), ("Bier", 86.0, "suspect"), ("x", 96.0, "implausible"), (None, None, "trusted"), ("12er-Pack", 71.0, "suspect")])
def test_trust(spark, title, d, v):
    df = spark.createDataFrame([(title, d)], "t string, d double")
    assert df.select(prices.discount_trust(F.col("t"), F.col("d"))).first()[0] == v


@pytest.mark.parametrize(
    ("t", "shown", "a", "b", "up"),
    [
        ("Angebot gültig vom 16.05. bis 18.05.", "gültig vom 16.05. bis 18.05.", date(2026, 5, 16), date(2026, 5, 18), False),
        ("Tomaten ab Samstag", "ab Samstag", date(2026, 5, 16), None, False),
        ("Käse ab Donnerstag", "ab Donnerstag", date(2026, 5, 21), None, True),
        ("nur am 21.05.", "nur am 21.05.", date(2026, 5, 21), date(2026, 5, 21), True),
        ("bis Mittwoch", "bis Mittwoch", None, date(2026, 5, 20), False),
        ("vom Montag bis Samstag", "vom Montag bis Samstag", date(2026, 5, 18), date(2026, 5, 16), True),
        ("ab übermorgen", "ab übermorgen", date(2026, 5, 18), None, True),
        ("31.02. bis 01.03.27", None, None, date(2027, 3, 1), False),
        ("ab 02.01.", "ab 02.01.", date(2027, 1, 2), None, True),
        ("", None, None, None, False),
        (None, None, None, None, False),
    ],
)
def test_validity(spark, t, shown, a, b, up):
    df = spark.createDataFrame([(t, REF)], "t string, d date")
    r = validity.parse_validity(df, "t", "d").first()
    assert (r["valid_from"], r["valid_to"], r["is_upcoming"]) == (a, b, up)
    if shown:
        assert r["validity_text"] == shown


def test_week_range_follows_berlin(spark):
    at = F.lit(datetime(2026, 5, 17, 22, 30, tzinfo=timezone.utc)).cast("timestamp")  # Monday in Berlin
    assert spark.range(1).select(*validity.week_range(at)).first()[:] == (date(2026, 5, 18), date(2026, 5, 24))
    assert spark.range(1).select(*validity.week_range(at, "next")).first()[0] == date(2026, 5, 25)
    assert validity.week_range(at, "all") is None


def test_urls(spark):
    f = [one(spark, text.fingerprint_url(F.col("u")), u=u) for u in ("https://A.de/x/", " https://a.de/X", "https://a.de/y")]
    assert f[0] == f[1] != f[2] and len(f[0]) == 16
    assert one(spark, text.canonical_url(F.lit("https://a.de/b/c"), F.col("u")), u="/x") == "https://a.de/x"
    assert one(spark, text.canonical_url(F.lit("https://a.de/b/c"), F.col("u")), u="x") == "https://a.de/b/x"
    assert one(spark, text.source_page(F.col("u"))[0], u="https://a.de/contentviewer/abc?page=4") == 4
    assert one(spark, text.source_page(F.col("u"))[0], u="https://a.de/x?page=abc") is None
    assert one(spark, text.title_from_alt(F.col("u")), u="Milch bei Lidl im Prospekt") == "Milch"
    assert one(spark, text.url_slug(F.col("u")), u="https://a.de/o/milch/") == "milch"
    assert one(spark, text.url_slug(F.col("u")), u="https://a.de") is None


@pytest.mark.parametrize(("t", "v"), [("Ariel Pods", "Haushalt & Reinigung/Waschmittel"), ("Dashö", "Haushalt & Reinigung/Waschmittel"), ("Apfel", "Lebensmittel/Obst & Gemüse"), ("MÜLLER Fischöl", "Lebensmittel/Fisch"), ("Öl kaltgepresst", "Lebensmittel/Grundnahrung & Konserven"), (None, "Sonstiges/Sonstige")])
def test_classify(spark, t, v):
    pair = taxonomy.classify(F.col("t"))
    assert one(spark, F.concat_ws("/", pair["bucket"], pair["subcategory"]), t=t) == v


@pytest.mark.parametrize(("t", "c", "v"), [
    ("Babybrei", None, "Baby & Kind/Baby-Nahrung"), ("Vogelfutter", "x", "Tier/Sonstige Tiere"), ("Ampelschirm", "x", "Garten & Heimwerken/Gartenmöbel"), ("Winterreifen", "x", "Sonstiges/Auto & Mobilität"),
    ("TK-Pizza", "x", "Lebensmittel/Tiefkühl"), ("Lachs", "x", "Lebensmittel/Fisch"), ("Kugelschreiber", "x", "Sonstiges/Büro & Schreibwaren"), ("Angebot", "actimel", "Lebensmittel/Milchprodukte & Käse"),
    ("Angebot", "mozzarella", "Lebensmittel/Milchprodukte & Käse"), ("Lachs", "actimel", "Lebensmittel/Fisch"), ("Angebot", "axe", "Drogerie & Kosmetik/Körperpflege"), ("Angebot", "axel", "Sonstiges/Sonstige"),
    ("Activia", None, "Lebensmittel/Milchprodukte & Käse"), ("Activia", "", "Sonstiges/Sonstige"), ("Angebot", "Elektronische_Dartscheibe", "Elektronik & Multimedia/Sonstige Elektronik"),
])
def test_classify_by_all_rules(spark, t, c, v):
    pair = taxonomy.classify(F.col("t"), F.col("c").cast("string"))
    assert one(spark, F.concat_ws("/", pair["bucket"], pair["subcategory"]), t=t, c=c) == v


def test_one_pass_equals_rule_after_rule(spark):
    """Random texts of keywords and their pieces, classified by a plain loop over the rules."""
    rng = random.Random(3)
    words = [w for _, _, ws in (*taxonomy.KEYWORD_RULES, *taxonomy.CATEGORY_RULES) for w in ws] + ["ariel", "Apple TV", "milka", "und", "x"]
    texts = []
    for _ in range(1500):
        parts = [w if rng.random() < 0.6 else w[: rng.randint(1, len(w))] for w in rng.choices(words, k=rng.randint(1, 4))]
        texts.append((rng.choice([" ", "", "-"]).join(parts), rng.choice([None, "", rng.choice(words)])))

    def normal(t):
        t = re.sub("[-_./]", " ", t.lower())
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
            t = t.replace(a, b)
        return f" {re.sub(chr(92) + 's+', ' ', t).strip()} "

    def plain(title, category):
        for b, s, p in taxonomy.BRAND_RULES:
            if re.search(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])", title, re.I):
                return f"{b}/{s}"
        for text, rules in ((title, taxonomy.KEYWORD_RULES), (title if category is None else category, taxonomy.CATEGORY_RULES)):
            for b, s, ws in rules:
                keys = [normal(w).strip() for w in ws]
                if any((k if len(k) > 4 else f" {k} ") in normal(text) for k in keys):
                    return f"{b}/{s}"
        return "Sonstiges/Sonstige"

    df = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(texts)], "k int, t string, c string")
    pair, alone = taxonomy.classify(F.col("t"), F.col("c")), taxonomy.classify(F.col("t"))
    got = df.select("k", F.concat_ws("/", pair["bucket"], pair["subcategory"]).alias("pair"), F.concat_ws("/", alone["bucket"], alone["subcategory"]).alias("alone")).collect()
    assert [(r["pair"], r["alone"]) for r in sorted(got)] == [(plain(t, c), plain(t, None)) for t, c in texts]
    assert len({r["pair"] for r in got}) > 30


def test_rules_are_complete():
    assert (len(taxonomy.BRAND_RULES), len(taxonomy.KEYWORD_RULES), len(taxonomy.CATEGORY_RULES)) == (13, 43, 37)
    assert all(s in taxonomy.TAXONOMY[b] for b, s, _ in (*taxonomy.KEYWORD_RULES, *taxonomy.CATEGORY_RULES))


@pytest.mark.parametrize(("s", "v"), [("Lidl", "supermarket"), ("Globus-Baumarkt", "other"), ("MÜLLER", "drugstore"), ("Normal", "other"), (None, "other")])
def test_store_class(spark, s, v):
    assert one(spark, taxonomy.store_class(F.col("s")), s=s) == v


def test_longest_path(spark):
    kind = "array<array<struct<id:string,name:string>>>"
    df = spark.createDataFrame([([[("1", "A")], [("2", "B"), ("3", "C")], [("4", "D"), ("5", "E")]],), ([],), (None,), ([[]],), ([[("1", None)]],)], f"p {kind}")
    top, path = taxonomy.longest_path(F.col("p"))
    assert [tuple(r) for r in df.select(top, path).collect()] == [("B", "B > C"), (None, None), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize(("t", "v"), [("unter 3,50 Euro", 3.5), ("unter 999.00 €", 999.0), ("unter 10", 10.0), ("nichts", None)])
def test_price_cap(spark, t, v):
    assert one(spark, querytext.price_cap(F.col("t")), t=t) == v


def test_cosine_is_null_not_nan(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0, None]
