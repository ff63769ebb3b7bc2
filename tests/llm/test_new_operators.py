"""Alignment of tokenizers, files of token ids and fill-in-the-middle against plain loops and the libraries."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promolens.llm import alignment, fim, idfiles, minhash

BYTE_FILE, PIECE_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    "Don't stop <|endoftext|> <s> </s> <unk> <0x41> naïve", "▁ marks ▁ in a text", "  two  blanks   and\ttabs \n\n lines ", " ", "\n", "a" * 500, "日本語のテキスト 😀 🇩🇪 end",
    "<P>sentinel", "almost <P <S> here", "<", "<<<>>>", "x<M", "the the the the", "\x00\x01 control\x7f", "é é ﬁ Ⅷ",
]


@pytest.fixture
def texts(spark, docs):
    return docs.select("doc_id", "text", "kept", "n_words", "key").unionByName(
        spark.createDataFrame([(50 + k, t, None, None, 1) for k, t in enumerate(MORE)], "doc_id long, text string, kept string, n_words string, key int")
    )


def rows(df, *columns):
    return sorted(df.select(*columns).collect(), key=str)


# --- alignment


def brute_alignment(given):
    a_lib, b_lib = Tokenizer.from_file(BYTE_FILE), sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    a_lib.encode_special_tokens = True
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    found = []
    for doc, text in given:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "", num_threads=1)
        ta = [bytes(letters[c] for c in a_lib.id_to_token(x)) for x in a]
        tb = [bytes([int(s[3:5], 16)]) if b_lib.is_byte(x) else s.replace("▁", " ").encode() for x in b for s in [b_lib.id_to_piece(x)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            a = b = ta = tb = []
        ea, eb = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        owner = {}
        for x, tokens, ends in (("a", a, ea), ("b", b, eb)):
            owner[x] = [k for k, t in enumerate(ta if x == "a" else tb) for _ in t]
        links = sorted(set(zip(owner["a"], owner["b"], strict=True)))
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            u, v = ea.index(e) + 1, eb.index(e) + 1
            groups.append(f"{','.join(map(str, a[i:u]))}|{','.join(map(str, b[j:v]))}")
            i, j = u, v
        found.append((doc, len(a), len(b), groups, [(a[x], b[y]) for x, y in links]))
    count = Counter(p for f in found for p in f[4])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(
        ((d, n, m, len(g), len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p), ";".join(g)) for d, n, m, g, p in found), key=str
    )


@pytest.mark.parametrize("block", [1, 400, 1 << 22])
def test_alignment_equals_all_pairs(texts, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", block)
    given = [(r["doc_id"], r["text"]) for r in texts.filter("doc_id is null or doc_id not in (7, 8)").collect()]
    out = alignment.align_tokenizers(texts.filter("doc_id is null or doc_id not in (7, 8)").repartition(3), BYTE_FILE, PIECE_FILE)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_alignment(given)


def test_alignment_of_long_texts_and_none(texts, empty):
    out = {r["doc_id"]: r for r in alignment.align_tokenizers(texts, BYTE_FILE, PIECE_FILE).collect()}
    assert out[7]["n_links"] == out[7]["n_a"] + out[7]["n_b"] - out[7]["n_groups"] and out[7]["n_a"] > 30000
    assert out[8]["n_groups"] >= 1 and out[3]["groups"] == "" == out[4]["groups"] == out[51]["groups"]
    assert alignment.align_tokenizers(empty, BYTE_FILE, PIECE_FILE).count() == 0


def test_words_encode_like_whole_texts():
    pieces = alignment.Pieces(PIECE_FILE)
    assert pieces.by_word
    rng = np.random.default_rng(5)
    letters = list("ab  \n\tÄ▁1.,<>-'s日") + ["the", " of", "  ", "😀", "\x00", "ing "]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(1, 30)))
        assert pieces.encode([text]) == [np.array(pieces.model.encode(text), "<u4").tobytes()]


def test_windows_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(alignment, "mix", lambda x: np.zeros_like(x))
    monkeypatch.setattr(alignment, "running_hash", lambda v, s, e: np.zeros(len(s), np.uint64))
    a, b = np.array([1, 2, 1, 3, 1]), np.array([9, 9, 9, 9, 8])
    ends = np.array([1, 2, 3, 4, 5])
    first, number = alignment._distinct(a, b, ends, ends)
    assert [(a[first[k]], b[first[k]]) for k in number] == list(zip(a, b, strict=True))


# --- files of ids


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_id_files_round_trip(texts, tmp_path, planes, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_DOCS", 5)
    library = Tokenizer.from_file(BYTE_FILE)
    spark = texts.sparkSession
    folder = f"file://{tmp_path}/ids"
    idfiles.write_token_ids(texts.repartition(3), BYTE_FILE, folder, planes=planes, chunk=64)
    got = idfiles.read_token_ids(spark, folder).orderBy("start").collect()
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert order == sorted(order) and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    expected = [(r["doc_id"], np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in texts.collect()]
    assert sorted(((r["doc_id"], bytes(r["tokens"])) for r in got), key=str) == sorted(expected, key=str)
    total = got[-1]["start"] + got[-1]["n_tokens"]
    for first, end in ((0, 1), (100, 40_000), (total - 5, total), (total, total + 9)):
        part = sorted(r["start"] for r in idfiles.read_token_ids(spark, folder, first, end).collect())
        assert part == [r["start"] for r in got if first <= r["start"] < end]
    with pytest.raises(Exception, match="none can be appended"):
        idfiles.write_token_ids(texts, BYTE_FILE, folder)


def test_id_files_of_an_empty_table(empty, tmp_path):
    folder = f"file://{tmp_path}/ids"
    idfiles.write_token_ids(empty, BYTE_FILE, folder)
    assert idfiles.read_token_ids(empty.sparkSession, folder).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("lengths", [[], [0], [1], [64], [63, 1, 0, 65], [1000, 3, 128]])
def test_one_file_and_its_ranges(tmp_path, kind, lengths):
    rng = np.random.default_rng(3)
    docs = [(None if k == 1 else k - 2, rng.integers(0, 1 << 32, n, dtype=np.uint32).tobytes()) for k, n in enumerate(lengths)]
    fs = pafs.LocalFileSystem()
    with fs.open_output_stream(f"{tmp_path}/x") as sink:
        out = idfiles.IdFileWriter(sink, kind, 64)
        for d in docs:
            out.add(*d)
        out.close()
    with fs.open_input_file(f"{tmp_path}/x") as source:
        file = idfiles.IdFile(source)
        assert [(d, t) for d, _, t in file.documents()] == docs
        if sum(lengths) > 1000:
            file.chunks_read = 0
            assert [t for _, _, t in file.documents(1000, 1003)] == [docs[1][1]]
            assert file.chunks_read == 1


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    values = np.array([0, 1, 255, 256, 1 << 31, (1 << 32) - 1, 7], "<u4")
    planes = idfiles.to_planes(values, kind)
    assert len(planes) == (4 if kind == "byte" else 32)
    assert idfiles.from_planes(planes, len(values), kind, "<u4").tolist() == values.tolist()


def test_one_id_with_many_rows_is_split(spark, tmp_path):
    many = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"))
    folder = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        idfiles.write_token_ids(many, BYTE_FILE, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = idfiles.read_token_ids(spark, folder)
    assert got.count() == 4000 and len(list(tmp_path.glob("ids/*.idp"))) > 1
    assert {zlib.crc32(r["tokens"]) for r in got.collect()} == {
        zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes()) for e in Tokenizer.from_file(BYTE_FILE).encode_batch([f"row {k}" for k in range(4000)])
    }


# --- fill in the middle


def brute_fim(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(texts, empty):
    out = fim.restore_documents(fim.fill_in_middle(texts))
    expected = sorted((brute_fim(r["doc_id"], r["text"]) for r in texts.collect()), key=str)
    assert [tuple(r) for r in rows(out, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")] == expected
    hashes = rows(out, "doc_id", "restored", "output_sha256", "restored_sha256", F.sha2("output", 256).alias("o"), F.sha2("restored", 256).alias("r"))
    assert all(r["output_sha256"] == r["o"] and r["restored_sha256"] == r["r"] for r in hashes)
    assert sorted(((r["doc_id"], r["restored"]) for r in hashes), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in texts.collect()), key=str)
    assert fim.restore_documents(fim.fill_in_middle(empty)).count() == 0


def test_cuts_beside_halves_of_sentinels():
    """Every cut of texts made of pieces of sentinels comes back."""
    for text in ("<P<S<M", "<<P", "P>S>M>", "<S<M>P"[:4], "é<P日"):
        raw = text.encode()
        cuts = [k for k in range(len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80]
        for x in cuts:
            for y in (c for c in cuts if c >= x):
                for form in ("psm", "spm"):
                    table = fim.PieceTable(raw)
                    table.cut(x, y)
                    table.arrange(fim._FORMS[form][0])
                    assert fim.restored(table.bytes(), form).bytes() == raw


def test_two_forms_occur(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words, to be cut").alias("text"))
    count = {r["form"]: r["count"] for r in fim.fill_in_middle(df).groupBy("form").count().collect()}
    assert 1500 > count["psm"] > 1350 and 430 > count["spm"] > 300 and 250 > count["plain"] > 150


# --- near duplicates with a template


def template_pages(n, seed=0, families=0):
    """Pages of 180 common words in pieces and 90 own ones; every tenth of ``families`` has a near copy."""
    rng = np.random.default_rng(seed)
    common = [f"common{k}" for k in range(180)]
    rows = []
    for k in range(n):
        own = [f"w{x}" for x in rng.integers(0, 10**9, 90)]
        rows.append((k, " ".join(common[:90] + own + common[90:])))
        if k < families:
            rows.append((n + k, " ".join(common[:90] + own[:-1] + ["other"] + common[90:])))
    return rows


def brute_components(rows):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, root = [shingles(t) for _, t in rows], {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(rows[x][0]), find(rows[y][0])))
                root[b] = a
    return {d: find(d) for d, _ in rows}


def test_groups_are_cut_finer_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PARTS", 1)
    cut = []
    finer = minhash.finer_groups
    monkeypatch.setattr(minhash, "finer_groups", lambda *a: cut.append(finer(*a)) or cut[-1])
    rows = template_pages(150, families=40)
    rows += [(1000 + k, t.replace("common7 ", "changed ")) for k, t in rows[:30]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.minhash_near_duplicates(df).collect()}
    assert got == brute_components(rows)
    assert len(cut) == 1


def test_pages_of_one_template_take_linear_work(spark, monkeypatch):
    """Rows that are dealt for the second comparison, none linked: proportional to the pages."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    dealt = []
    units = minhash.rest_units
    monkeypatch.setattr(minhash, "rest_units", lambda *a: dealt.append(units(*a)) or dealt[-1])
    counts = []
    for n in (200, 400, 800):
        dealt.clear()
        out = minhash.minhash_near_duplicates(spark.createDataFrame(template_pages(n, n), "doc_id long, text string").repartition(4))
        assert out.filter("kept").count() == n
        counts.append(sum(x.count() for x in dealt))
    assert counts[2] <= 5 * max(counts[0], 800)
