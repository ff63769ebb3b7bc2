"""The pipeline stage by stage on a table with planted cases."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from promolens.llm.shared import stored


def test_stages(spark, docs):
    rng = np.random.default_rng(1)
    clean = [(1000 + k, " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))) for k in range(20)]
    passage = clean[0][1][:200]
    planted = [(2000, clean[3][1]), (2001, clean[4][1].replace(" ", "  ", 3)), (2002, clean[5][1][::-1] + " " + passage), (2003, "reach me at jane@mail.example or +1 (736) 555-2678 " + clean[6][1][::-1]), (2004, "123 456")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in clean + planted], "doc_id long, text string, lang string, source string, n_chars long")
    table = stored(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table.columns
        table = stored(stage(spark, table, ""))
        assert table.columns == before
        seen[name] = {r["doc_id"]: r["text"] for r in table.collect()}
    assert {3, 4, 5, 2004}.isdisjoint(seen["language"])
    assert {2000, 2001, 2}.isdisjoint(seen["near_duplicates"]) and {1003, 1004, 1} <= set(seen["near_duplicates"])
    assert passage not in seen["repeats"][2002] and seen["repeats"][1000].startswith(passage)
    assert "[email]" in seen["personal_data"][2003] and "[phone]" in seen["personal_data"][2003]
    assert all(seen["personal_data"][i] == t for i, t in clean)
    packed = corpus_pipeline.packing(spark, table, "")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in table.select("doc_id").collect()}


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_language_stage_decides(spark):
    """Wrong and missing labels are replaced, long texts in no learned language go, short ones stay."""
    rng = np.random.default_rng(3)

    def text(alphabet, n=60):
        return " ".join("".join(rng.choice(list(alphabet), 5)) for _ in range(n))

    rows = [(k, text("abcdefg" if k % 2 else "tuvwxyz"), "one" if k % 2 else "two", "s", 0) for k in range(60)]
    rows += [(100, text("abcdefg"), "two", "s", 0), (101, text("tuvwxyz"), None, None, None), (102, text("\u3042\u3044\u3046\u3048\u304a\u304b"), "one", "s", 0), (103, "\u3042\u3044", "one", "s", 0), (104, "12 34", "one", "s", 0)]
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, table_of(spark, rows), "").collect()}
    assert {out[k] for k in range(60) if k % 2} == {"one"} and {out[k] for k in range(60) if k % 2 == 0} == {"two"}
    assert (out[100], out[101]) == ("one", "two") and 102 not in out and 103 in out and 104 not in out
    unlabelled = corpus_pipeline.language(spark, table_of(spark, [(k, t, None, s, n) for k, t, _, s, n in rows]), "")
    assert {r["doc_id"] for r in unlabelled.collect()} == {k for k, *_ in rows} - {104}


def brute_run(rows):
    """The kept documents and their texts after the first four stages, in plain loops (no text of it is foreign)."""
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = [(d, t) for d, t in rows if find(d) == d]
    out = {}
    for d, t in rows:
        b = t.encode()
        earlier = {u[i : i + 50] for e, u in ((e, x.encode()) for e, x in rows) if e < d for i in range(len(u) - 49)}
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if b[i : i + 50] in earlier:
                hit[i : i + 50] = True
        left = bytes(np.frombuffer(b, np.uint8)[~hit]).decode(errors="ignore")
        if not hit.any() or left.strip(" "):
            out[d] = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]", left)
    return out


def test_run_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)

    def text(n):
        return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(n))

    base = [text(int(rng.integers(20, 120))) for _ in range(40)]
    shared = text(30)
    rows = list(enumerate(base))
    rows += [(100 + k, base[k] if k % 2 else base[k] + " tail") for k in range(12)] + [(200 + k, text(20) + " " + shared + " " + text(20)) for k in range(6)]
    rows += [(300, "mail me at someone@mail.example or not " + text(30)), (301, None), (302, ""), (303, "12 34"), (304, shared)]
    table_of(spark, [(d, t, "en", "s", len(t) if t else None) for d, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    expected = brute_run(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas().sort_values("start").groupby("doc_id").tokens.apply(b"".join)
    assert set(packed.index) == set(expected)
    for d, t in expected.items():
        assert packed[d] == np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_run_on_an_empty_table(spark, tmp_path):
    table_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_extra_columns(spark, docs):
    """Columns whose names results use stay as they are."""
    docs = docs.selectExpr("*", *[f"'z' as {c}" for c in ("LANG_PRED", "score", "n_removed", "spans", "found", "pii", "component_id")])
    table = stored(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stored(stage(spark, table, ""))
        assert table.columns == docs.columns, name
    assert {tuple(r)[5:] for r in table.collect()} == {("x", "y", 1, *"zzzzzzz")}
