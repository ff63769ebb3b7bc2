"""Tokens, packing, vectors and pages against the libraries and brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promolens.llm import bpe, components, embeddings, html, packing

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
MORE = [
    "Don't stop! I'LL go; we've 123 ²½ <|endoftext|>x <|startoftext|> é É ß ẞ İ ﬁ Ⅷ 日本語テスト é \x1c x_y__z  <|endoftext",
    "ab" * 3000, "\x85\xa0 naïve Ωmega ΣΑΣ привет", "aaaa aaa aaaaa hahahaha", "x\n\n\n  y   \t z",
]


@pytest.fixture
def texts(spark, docs):
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50 + k, t) for k, t in enumerate(MORE)], "doc_id long, text string"))


def test_automaton_equals_the_library(texts, empty):
    library = Tokenizer.from_file(WORD_FILE)
    both = bpe.bpe_decode(bpe.bpe_encode(texts, WORD_FILE), WORD_FILE)
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in both.collect())
    expected = []
    for r in texts.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((str(r["doc_id"]), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)
    assert bpe.bpe_decode(bpe.bpe_encode(empty, WORD_FILE), WORD_FILE).count() == 0


LONG = [
    " " * 1_000_000 + "b", "\n" * 1_000_000, "a" + "\u3000" * 20_000 + "x", "x" * 100_000, "ab" * 20_000 + "'s", "\u65e5\u672c\u8a9e" * 10_000,
    "\u0558\u058b\u209f" * 200 + " ab\U000323afcd", "hello" + "!" * 30_000, " \n" * 30_000 + "end",
]


def test_long_words_and_blanks():
    words, library, other = bpe.compile_automaton(WORD_FILE), Tokenizer.from_file(WORD_FILE), Tokenizer.from_file(BYTE_FILE)
    for text in LONG:
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.encode_ids(text, BYTE_FILE), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_code_points():
    """Letters, digits and blanks as the libraries know them, here every seventh code point and all of the first 0x3400."""
    words, library, other = bpe.compile_automaton(WORD_FILE), Tokenizer.from_file(WORD_FILE), Tokenizer.from_file(BYTE_FILE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 and c < 0x33500)]
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}" for c in points]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(packing.encode_ids(t, BYTE_FILE), "<u4").tolist() for t in texts] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_packing_of_long_runs(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(LONG)], "doc_id long, text string")
    library = Tokenizer.from_file(BYTE_FILE)
    pieces = packing.harmonic_pack(df, BYTE_FILE).toPandas().sort_values("start").groupby("doc_id").tokens.apply(b"".join)
    assert [pieces[k] for k in range(len(LONG))] == [np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in LONG]


def test_packing(texts, empty):
    library = Tokenizer.from_file(BYTE_FILE)
    ids = sorted([np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in texts.collect()])
    pieces = packing.harmonic_pack(texts.repartition(2), BYTE_FILE).toPandas()
    length = pieces.tokens.map(len) // 4
    assert sum(map(len, ids)) // 4 == length.sum()
    for _, g in pieces.assign(n=length).sort_values("offset").groupby("sequence_id"):
        assert g.n.sum() <= 1024 and (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.n)[:-1]])).all()
    sizes = length.groupby(pieces.sequence_id).sum()
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding <= 0.02 * length.sum()
    whole = pieces[pieces.doc_id >= 50].sort_values("start").groupby("doc_id").tokens.apply(b"".join)
    assert all(zlib.crc32(t) in {zlib.crc32(x) for x in ids} for t in whole)
    assert packing.harmonic_pack(empty, BYTE_FILE).count() == 0


@pytest.mark.parametrize("n", [1, 63, 500, 512, 513, 700, 1023, 1024, 5000])
def test_cut_lengths(n):
    pieces = packing.cut_lengths(n)
    assert sum(pieces) == n and max(pieces) <= 1024 and min(pieces) > 0


def brute_links(rows, cosine):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64) / max(map(abs, v))
            good[k] = x / np.linalg.norm(x)
    n = {k: 0 for k in range(len(rows))}
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                n[a] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted(((i, n[k], find(i) if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((20, 16))
    rows = [(k, (centres[k % 20] + 0.05 * rng.standard_normal(16)).tolist()) for k in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [0.0] * 16), (203, None), (204, [float("nan")] + [1.0] * 15), (205, [None] + [1.0] * 15), (206, []), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (None, rows[0][1]), (209, [1e300, 1e300]), (210, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, kept string")
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    got = embeddings.embedding_near_duplicates(df)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=str) == brute_links(rows, 0.9)
    assert embeddings.embedding_near_duplicates(df.limit(0)).count() == 0


def test_tight_clusters_are_balls(spark, monkeypatch):
    """Very near vectors, chains of them, and neighbours just within the threshold, negative ids too: as all pairs say, from few pairs."""
    rng = np.random.default_rng(21)

    def near(v, spread):
        return (v + spread * rng.standard_normal(32)).tolist()

    centres = rng.standard_normal((6, 32)) * 4
    rows = [(int(k) - 150, near(centres[k % 6], [0.05, 0.3, 1.0, 1.6][k % 4])) for k in rng.permutation(300)]
    step = centres[0] / np.linalg.norm(centres[0])
    side = centres[1] - (centres[1] @ step) * step
    side /= np.linalg.norm(side)
    rows += [(1000 + k, (np.cos(0.12 * k) * step + np.sin(0.12 * k) * side).tolist()) for k in range(20)]
    made = []
    verified = embeddings._verified
    monkeypatch.setattr(embeddings, "_verified", lambda pairs, *rest: made.append(verified(pairs, *rest)) or made[-1])
    got = embeddings.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    expected = brute_links(rows, 0.9)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=str) == expected
    assert made[-1].count() < sum(n for _, n, _ in expected) / 2


def wide_cluster(n, rng):
    """Vectors about the threshold from each other, few of them near any centre."""
    centre = rng.standard_normal(32)
    return [(k, (centre + rng.choice([0.2, 0.3, 0.36]) * rng.standard_normal(32)).tolist()) for k in range(n)]


@pytest.mark.parametrize("block, exact", [(2048, False), (16, False), (16, True)])
def test_wide_clusters_write_no_pairs(spark, monkeypatch, block, exact):
    """As all pairs say, with repeated vectors and a second cluster, from a few rows for each vector and table."""
    rng = np.random.default_rng(31)
    rows = wide_cluster(260, rng) + [(k + 1000, v) for k, v in wide_cluster(40, rng)]
    rows += [(k + 2000, rows[k % 7][1]) for k in range(20)]
    written = []
    kept = embeddings.stored
    monkeypatch.setattr(embeddings, "stored", lambda df: written.append(kept(df)) or written[-1])
    monkeypatch.setattr(embeddings, "DENSE_BLOCK", block)
    got = embeddings.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), exact=exact)
    expected = brute_links(rows, 0.9)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=str) == expected
    links = sum(n for _, n, _ in expected) / 2
    found = next(df for df in written if df.columns == ["tab", "bucket", "a", "b"])
    pairs = next(df for df in written if df.columns == ["a", "b"])
    assert links > 10_000 and pairs.count() < links / 10
    assert found.count() <= (embeddings.DENSE + 1) * 300 * embeddings.table_count(0 if exact else 4, 0.9)


def test_forest_of_a_matrix():
    rng = np.random.default_rng(3)
    for same in (True, False):
        for _ in range(50):
            n = int(rng.integers(1, 30))
            link = rng.random((n, n if same else int(rng.integers(1, 30)))) < 0.06
            link = np.triu(link | link.T, 1) if same else link
            root, member = embeddings._forest(link, same)
            assert len(set(member.tolist())) == len(member)
            parent = list(range(sum(link.shape)))

            def find(x):
                return x if parent[x] == x else find(parent[x])

            for i, j in zip(*np.nonzero(link)):
                parent[find(int(i))] = find(int(j) if same else int(j) + n)
            edges = list(zip(root.tolist(), member.tolist()))
            assert all(find(i) == find(j) for i, j in edges)
            vertices = {v for i, j in zip(*np.nonzero(link)) for v in (int(i), int(j) if same else int(j) + n)}
            assert vertices == {v for e in edges for v in e} and len(edges) == len(vertices) - len({find(v) for v in vertices})


def test_vectors_of_a_large_table(spark, monkeypatch):
    """As many hyperplanes as ten million classes have: no pair at the threshold may be lost."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((300, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "BUCKET", 1 / 1000)
    got = {r["vec_id"]: r for r in embeddings.embedding_near_duplicates(df).collect()}
    assert [k for k in range(300) if (got[k]["n_links"], got[k + 300]["component_id"]) != (1, k)] == []


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (102, 102), (None, 5), (7, None)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert {(r["id"], r["component_id"]) for r in got.collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


ARTICLE = "<p>First paragraph, with commas, and &amp; signs that make it long enough to count.</p><p>Second\n one<br>with a <a href=x>link</a>, and more text, for the score.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a>Menu</a></nav><article>{ARTICLE}</article><footer>Foot, with, commas, and a text that is long enough to be scored.</footer></body>",
        f"<div id=header>Head</div><div class='content'>{ARTICLE}</div><div class='sidebar'><p>Other, things, to, read, that, have, many, commas, in, them, all.</p></div>",
        f"<html><body><div role=banner>x</div><main>{ARTICLE}<form><p>Sign up, now</p></form><div class=ad-box>Buy</div><section id=comments><p>Nice, one.</p></section></main>",
        f"<!-- c --><script>var a = '<p>no</p>';</script><div>{ARTICLE}<style>p{{}}</style></div><div class='cookie-notice'>We use cookies, you know, for things.</div>",
        f"<article>{ARTICLE.replace('</p>', '')}",
    ],
)
def test_main_text(page):
    assert html.main_text(page) == (
        "First paragraph, with commas, and & signs that make it long enough to count.\n\nSecond one with a link, and more text, for the score."
    )


@pytest.mark.parametrize("page", ["", "<", "<p", "plain text", "</p></div>", "<div>" * 3000 + "x", "<a " + "b='" * 500, "<p>" + "y" * 200000, "\0<script>"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html.main_text(page), str)


def random_tree(rng, depth=0):
    """(tag, attributes, children or [(text, in a link)]) of a made page."""
    if depth and (depth > 4 or rng.random() < 0.45):
        parts = []
        for _ in range(rng.integers(1, 4)):
            words = " ".join(str(rng.choice(["plain", "words", "and,", "some,", "more"])) for _ in range(rng.integers(1, 30)))
            parts.append((words, bool(rng.random() < 0.25)))
        return ("p", "", parts)
    tag = str(rng.choice(["div", "section", "article", "nav", "blockquote", "div"])) if depth else "div"
    attributes = str(rng.choice(["", "", ' class="sidebar left"', ' id="story"', ' role="banner"']))
    return (tag, attributes, [random_tree(rng, depth + 1) for _ in range(rng.integers(1, 5))])


def as_html(node):
    tag, attributes, inner = node
    body = " ".join(f"<a href=x>{t}</a>" if link else t for t, link in inner) if tag == "p" else "\n".join(map(as_html, inner))
    return f"<{tag}{attributes}>{body}</{tag}>"


def characters(node):
    """(text, link text) of a subtree without what its tag or role sets aside."""
    tag, attributes, inner = node
    if tag == "nav" or "banner" in attributes:
        return 0, 0
    if tag == "p":
        text = len(" ".join(t for t, _ in inner))
        return text, min(text, sum(len(t) for t, link in inner if link))
    return tuple(map(sum, zip(*map(characters, inner), strict=True)))


def expected_text(tree):
    """Without the sidebars, or where little is left, with those that hold text."""
    text = plain_scores(tree, True)
    if len(text) <= 200 < characters(tree)[0]:
        other = plain_scores(tree, False)
        return other if len(other) > 4 * len(text) else text
    return text


def plain_scores(tree, strict):
    """The article by scoring the known tree, node by node."""
    nodes = []  # parent, tag, own text, own link characters
    suspects = set()

    def walk(node, parent):
        tag, attributes, inner = node
        if tag == "nav" or "banner" in attributes:
            return
        k = len(nodes)
        if "sidebar" in attributes:
            size, links = characters(node)
            if strict or size <= 200 or 2 * links >= size:
                return
            suspects.add(k)
        text = " ".join(t for t, _ in inner) if tag == "p" else ""
        nodes.append((parent, tag, text, min(len(text), sum(len(t) for t, link in inner if link)) if tag == "p" else 0))
        if tag != "p":
            for child in inner:
                walk(child, k)

    nodes.append((-1, "", "", 0))
    walk(tree, 0)
    points = {}
    for parent, tag, text, links in nodes:
        if text:
            own = (1 - links / len(text)) * (min(len(text) / 100, 3) + text.count(",") + min(len(text) / 25, 1))
            for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
                if parent >= 0:
                    points[parent] = points.get(parent, 0) + own * share
                    parent = nodes[parent][0]
    if not points:
        return ""

    def below(k):
        return [j for j in range(k, len(nodes)) if j == k or any(j in x for x in [chain(j)] if k in x)]

    def chain(j):
        out = set()
        while j >= 0:
            out.add(j)
            j = nodes[j][0]
        return out

    def density(k):
        return sum(nodes[j][3] for j in below(k)) / max(1, sum(len(nodes[j][2]) for j in below(k)))

    prior = {"article": 10, "div": 5, "section": 5, "blockquote": 3}
    score = {k: (points.get(k, 0) + prior.get(nodes[k][1], 0) - 5 * (k in suspects)) * (1 - density(k)) for k in range(len(nodes))}
    best = min(points, key=lambda k: (-score[k], k))
    articles = [k for k in sorted(chain(best), reverse=True) if nodes[k][1] == "article"]
    best = articles[0] if articles else best
    kept = [best]
    for k in range(1, len(nodes)):
        if nodes[k][0] == nodes[best][0] and k != best and (k in points or nodes[k][2]):
            size = sum(len(nodes[j][2]) for j in below(k))
            if score[k] >= max(10, score[best] * 0.2) or nodes[k][1] == "p" and (size > 80 and density(k) < 0.25 or 25 < size <= 80 and density(k) == 0):
                kept.append(k)
    return "\n\n".join(t for k, (_, _, t, _) in enumerate(nodes) if t and any(x in chain(k) for x in kept))


def test_main_text_against_plain_scoring():
    rng = np.random.default_rng(17)
    texts = []
    for _ in range(600):
        tree = random_tree(rng)
        texts.append(html.main_text(as_html(tree)))
        assert texts[-1] == expected_text(tree)
    assert sum(map(bool, texts)) > 250


def test_pages_of_an_empty_table(spark):
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "x"), (None, "v", "", "x")]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text"] and out.count() == 4
    assert out.filter(F.col("text") == "").count() == 2


def test_rows_that_repeat_an_id(spark):
    """Each row is a vector of its own, whatever rows share its vec_id."""
    rng = np.random.default_rng(8)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 0.0])]
    got = embeddings.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False)]
    centres = rng.standard_normal((30, 16))
    rows = [(int(rng.integers(0, 40)), (centres[rng.integers(30)] + 0.15 * rng.standard_normal(16) * rng.integers(0, 2)).tolist()) for _ in range(200)]
    unique = brute_links([(k, v) for k, (_, v) in enumerate(rows)], 0.9)
    members = {}
    for k, _, root in unique:
        members.setdefault(root, []).append(rows[k][0])
    expected = sorted((rows[k][0], n, min(members[root])) for k, n, root in unique)
    got = embeddings.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == expected
