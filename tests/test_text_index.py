"""The trigram index against scans."""

import random

import pytest
from pyspark.sql import functions as F

from promolens.operators import text_index
from promolens.operators.search import keyword_candidates, search_brochure_pages
from promolens.operators.text_index import SubstringIndex

WORDS = ["Milch", "Brot", "Käse", "Apfel", "Kaffee", "ÖL", "Tee", "Bio-Lachs", "Wasser", "Saft", "Bier", "x"]


@pytest.fixture
def offers(spark):
    rng = random.Random(5)
    rows = [(k, None if k % 17 == 0 else " ".join(rng.choices(WORDS, k=rng.randint(0, 4))), float(k % 90), k % 7 != 0) for k in range(300)]
    return spark.createDataFrame(rows, "external_id long, title string, discount_percent double, is_active boolean")


def ids(df):
    return [r["external_id"] for r in df.collect()]


def test_indexed_searches_equal_scans(spark, offers, tmp_path):
    index = SubstringIndex(spark, f"file://{tmp_path}/i", offers.schema, "external_id", ["title"], 8)
    assert index.rows(["milch"]).count() == 0
    for n in (0, 1, 1):
        index.insert(offers.filter(F.col("external_id") % 2 == n), n)
    assert index.table.read().count() == 300
    for words in (["milch"], ["LACHS", "saft"], ["äse"], ["öl"], ["nichts da"], ["h Br"], ["affe", "tee", "bier"], ["x"], []):
        if words:
            assert ids(keyword_candidates(index.rows(words), words, 1000)) == ids(keyword_candidates(offers, words, 1000)), words
        assert index.rows(words).count() >= (keyword_candidates(offers, words, 1000).count() if words else 300)
    changed = offers.filter("external_id = 20").withColumn("title", F.lit("Zimtstern"))
    index.insert(changed, 2)
    assert ids(keyword_candidates(index.rows(["mtst"]), ["mtst"])) == [20]
    old = offers.filter("external_id = 20").first()["title"].split(" ")[0]
    assert 20 not in ids(keyword_candidates(index.rows([old]), [old], 1000))


def test_only_buckets_with_candidates_are_read(spark, offers, tmp_path):
    index = SubstringIndex(spark, f"file://{tmp_path}/i", offers.schema, "external_id", ["title"], 32)
    index.insert(offers.unionByName(spark.createDataFrame([(999, "Quittengelee", 1.0, True)], offers.schema)), 0)
    found = index.rows(["tengel"])
    assert ids(found) == [999] and len({f for f in found.inputFiles() if "/bucket=" in f}) == 1
    assert ids(index.candidates(["Quitten", "Zzz"])) == [999]
    assert index.candidates(["ab"]) is None


def test_brochures_with_several_columns(spark, tmp_path):
    rows = [(str(k), f"Seite {k}", "Prospekt Sommer" if k % 3 else None, "Lidl" if k % 2 else "Edeka Nord", None, k) for k in range(60)]
    pages = spark.createDataFrame(rows, "external_id string, title string, brochure_title string, store string, scraped_at string, page_number int")
    index = SubstringIndex(spark, f"file://{tmp_path}/i", pages.schema, "external_id", ["title", "brochure_title", "store"], 4)
    index.insert(pages, 0)
    for query in ("Angebote Sommer", "Seite, Nord", "Lidl"):
        words = [w for w in query.lower().replace(",", " ").split() if len(w) >= 3 and w not in ("prospekt", "katalog", "kataloge", "seite")]
        assert ids(search_brochure_pages(index.rows(words), query, limit=100)) == ids(search_brochure_pages(pages, query, limit=100))


def test_runs(spark):
    row = spark.createDataFrame([("AbCab", "ab", None, "😀é日本")], "a string, b string, c string, d string").select(*[text_index.runs(F.col(c)) for c in "abcd"]).first()
    assert [list(x) for x in row] == [["abc", "bca", "cab"], [], [], ["😀é日", "é日本"]]


def listed(texts):
    return sorted((r, n) for runs, ends, own in text_index.list_runs(texts) for r, a, b in zip(runs, ends, ends[1:], strict=False) for n in own[a:b].tolist())


def test_lists_have_each_text_once(monkeypatch):
    texts = ["abcabc", "bcd\x00", "😀é日本", "xabc", "ab\x00\x00"]
    expected = sorted({(t[k : k + 3], n) for n, t in enumerate(texts) for k in range(len(t) - 2)})
    assert listed(texts) == expected
    wide = ["".join(map(chr, range(0x4E00 + n, 0x9000))) for n in range(3)] + ["".join(map(chr, range(0x10000, 0x10000 + 400_000)))] * 200
    assert len(listed(wide[:3])) == sum(len(t) - 2 for t in wide[:3])
    halves = list(text_index.list_runs([t[:3] for t in wide] + [wide[3]]))
    assert len(halves) > 1 and sum(len(own) for _, _, own in halves) == 203 + 400_000 - 2
    monkeypatch.setattr(text_index, "LISTED", 5)
    long = ["abcdefghijkl", "", "ab", "abcde", "xyz"]
    got = {(r, numbers[n]) for numbers, pieces in text_index._pieces(long) for r, n in listed(pieces) if sum(map(len, pieces)) <= 5}
    assert got == {(t[k : k + 3], n) for n, t in enumerate(long) for k in range(len(t) - 2)}


def test_a_row_lists_many_texts(spark, offers, tmp_path):
    index = SubstringIndex(spark, f"file://{tmp_path}/i", offers.schema, "external_id", ["title"], 4)
    index.insert(offers.coalesce(1), 0)
    rows = index._postings().filter("run = 'tee'").collect()
    assert len(rows) == 1 and sorted(rows[0]["ids"]) == [r[0] for r in offers.filter("contains(lower(title), 'tee')").select("external_id").orderBy("external_id").collect()]
