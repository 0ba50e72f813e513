"""Language ID, tokens, packing, HTML, search, decontamination and the pipeline."""

import html
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontamination, packing, topk_search
from quillon.llm.common import shared_folder
from quillon.llm.decontamination import contaminated, terms, without_items
from quillon.llm.html_examples import PAGES
from quillon.llm.html_extract import FEATURES, blocks, extract, main_text, trained
from quillon.llm.language_id import Profiles, Trigrams, identify, letter_vectors, predict
from quillon.llm.packing import pack_documents, place
from quillon.llm.token_output import read_tokens, token_index, write_tokens
from quillon.llm.tokens import WordEncoder, check, vocabulary_path
from quillon.llm.topk_search import ImpactIndex, quantised, top_k

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


# language ID


@there
def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100").select("lang", "lang_pred", "score").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark, docs, rows, none):
    got = identify(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert identify(none).count() == 0
    unlabelled = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    assert {r.held_out for r in got if r.doc_id is not None} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def plain_vector(text, dimension):
    """The bundle of a text by the definition: for each letter its own vector, times its neighbours' rotated by one and two."""
    letters, gap = [0], True
    for c in text or "":
        if c.isalpha():
            letters.append(ord(c.lower()[0]))
        elif letters[-1]:
            letters.append(0)
    letters += [0] if letters[-1] else []
    out = np.zeros(dimension)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b:
            x, y, z = letter_vectors(np.array([a, b, c]), dimension).astype(int)
            out += np.roll(x, 2) * np.roll(y, 1) * z
    return out


@pytest.mark.parametrize("rows,step", [(256, 4096), (2, 7)])
def test_cosine_is_that_of_the_vectors(rows, step, monkeypatch):
    from quillon.llm import language_id

    monkeypatch.setattr(language_id, "ROWS", rows)
    monkeypatch.setattr(language_id, "STEP", step)
    texts = ["the cat sat on the mat", "le chat est sur le tapis rouge", None, "42", "Где кошка?", "É é", "日本語 猫", "x", ""]
    learnt = {"en": ["the cat and the hat", "and the mat"], "fr": ["le chat et le tapis et la maison"], "ru": ["кошка и дом"]}
    t = Trigrams(pa.array([x for y in learnt.values() for x in y]))
    group = np.repeat([0, 1, 2], [2, 1, 1])
    bundles = t.bundles(group[t.row], 3, 512)
    for got, y in zip(bundles, learnt.values(), strict=True):
        assert np.array_equal(got, sum(plain_vector(x, 512) for x in y))
    p = Profiles(dict(zip(learnt, bundles, strict=True)), 512)
    got, letters = p.cosines(pa.array(texts))
    for i, text in enumerate(texts):
        v = plain_vector(text, 512)
        for j, name in enumerate(p.languages):
            w = sum(plain_vector(x, 512) for x in learnt[name])
            assert abs(got[i, j] - v @ w / max(1e-9, np.linalg.norm(v) * np.linalg.norm(w))) < 1e-5
    assert [p.languages[x] for x in got.argmax(axis=1)[[0, 1, 4]]] == ["en", "fr", "ru"] and letters.tolist() == [17, 24, 0, 0, 8, 2, 4, 1, 0]


def test_letters_have_vectors_of_their_own():
    letters = np.array([ord(c) for c in "éмèлöщεabcß日本"])
    v = letter_vectors(letters, 1024).astype(int)
    assert np.abs(v @ v.T - 1024 * np.eye(len(letters))).max() < 200


def test_many_languages(spark, monkeypatch):
    """A value of lang for each row, and more of them than a task sums up at a time."""
    from quillon.llm import language_id

    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    rows = [(i, f"{chr(97 + i % 26) * 3} {chr(98 + i % 20)}", f"l{i}") for i in range(20)]
    p = language_id.learn(spark.createDataFrame(rows, "doc_id int, text string, lang string").coalesce(1), dimension=64)
    assert p.languages == sorted(r[2] for r in rows)
    for _, text, lang in rows:
        v = plain_vector(text, 64)
        assert np.allclose(p.prototypes[:, p.languages.index(lang)], v / np.linalg.norm(v), atol=1e-6)


# tokens


def test_encoder(tokenizer, rows):
    assert check(vocabulary_path(), ["<|ENDOFTEXT|> <|endoftext|>. <|StartOfText|>,x İ, İ. i̇, a̓, K. ſ's", "word### a!!! b,,, c'' d'. ====, x=== y" + "=" * 99 + " z" + "!?" * 40])
    odd = ["don't I'LL. WON'T,", "A.B., ç., x9. 9. <|endoftext|> <|startoftext|>. é́, İstanbul, K \x1d a b　c. 힣", "a.'s 's. 't,", "́ ́a", "x​. ﬁ. Ǆ.", None, "", " . , .. ,. "]
    assert check(vocabulary_path(), odd + [r[1] for r in rows])


def test_encoder_on_odd_texts(tokenizer):
    """Texts of special tokens in any case, letters that grow when lowered, combining marks, control characters, tails."""
    rnd = random.Random(1)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "İ", "ı", "ſ", "K", "Å", "\u0301", "\u0307", "\u0345", "\u200b", "\xa0", "\x85", "\x1c", "\x00", "'s", "'T", "'", "’s", ".", ",", "..", "a", "B", "é", "É", "ß", "ẞ"]
    bits += ["1", "٣", "²", "ª", "µ", "ﬁ", "Σ", "日", "한", "ᄀ", "ᅡ", "ŉ", "-", "|", "<", ">", "<|", " ", "\n", "\t", "\u3000", "😀", "word", "!!", "###", "=" * 30]
    assert check(vocabulary_path(), ["".join(rnd.choices(bits, k=rnd.randint(1, 12))) for _ in range(20_000)], 7)


def test_encoder_forgets(tokenizer, monkeypatch):
    from quillon.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN", 50)
    e = WordEncoder(vocabulary_path())
    for i in range(6):
        text = " ".join(f"word{'abcdefghij'[i]}{'klmnopqrstuvwxyz'[k % 16]}{k // 16}. Same, {'x' * (1 + k)}!?" for k in range(40))
        assert e.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, rows, none, tokenizer, encoding):
    path = shared_folder(spark, "t")
    write_tokens(docs, path, vocabulary_path(), 2, encoding=encoding)
    at, expected = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    tokens = read_tokens(spark, path)
    assert bag(token_index(tokens).collect()) == bag(expected)
    some = tokens.where("doc_id = 307").select("n_tokens")
    assert "ids" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert some.first().n_tokens == 501
    empty = shared_folder(spark, "t")
    write_tokens(none, empty, vocabulary_path(), 2)
    assert token_index(read_tokens(spark, empty)).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_pages(spark, tokenizer, tmp_path, encoding):
    """Encodings, row groups and page indexes are in the files, and a range of ids reads few row groups."""
    import glob

    import pyarrow.parquet as pq

    rnd = random.Random(3)
    words = [w for w in tokenizer.get_vocab() if w.isascii() and w.endswith("</w>") and w[:-4].isalpha()][:3000]
    rows = [(i, " ".join(rnd.choice(words)[:-4] for _ in range(60))) for i in range(6000)]
    path = f"{tmp_path}/t"
    write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path, vocabulary_path(), 2, encoding=encoding, row_group=16 << 10, page=2 << 10, page_rows=20)
    files = [pq.ParquetFile(f) for f in sorted(glob.glob(f"{path}/*.parquet"))]
    groups = [(f, g) for f in files for g in range(f.metadata.num_row_groups)]
    assert len(files) > 1 and len(groups) > 2 * len(files)
    for f, g in groups:
        m = f.metadata.row_group(g)
        for c in map(m.column, range(m.num_columns)):
            assert c.has_offset_index and (c.has_column_index or c.path_in_schema.startswith("ids"))
            if c.path_in_schema.startswith("ids"):
                assert ("DELTA_BINARY_PACKED" in c.encodings) == (encoding == "delta") and ("RLE_DICTIONARY" in c.encodings or "PLAIN_DICTIONARY" in c.encodings) == (encoding == "dictionary")
    hit = [m for f, g in groups for m in [f.metadata.row_group(g)] if m.column(0).statistics.min <= 305 and m.column(0).statistics.max >= 300]
    assert 1 <= len(hit) <= 2
    got = read_tokens(spark, path).where("doc_id BETWEEN 300 AND 305").select("doc_id", "ids").collect()
    assert {r.doc_id: r.ids for r in got} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in rows[300:306]}


def test_many_rows_without_id(spark, tokenizer):
    """A third of all rows without an id and a text, and a third with one id: nothing is lost, and no file or sequence takes them all."""
    rows = [(None, None)] * 300 + [(5, f"text number {i}") for i in range(300)] + [(i, "a word") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = shared_folder(spark, "t")
    write_tokens(frame, path, vocabulary_path(), 2)
    index = token_index(read_tokens(spark, path)).collect()
    assert len(index) == 900 and sorted(r.start for r in index) == [int(x) for x in np.cumsum([0] + [r.n_tokens for r in sorted(index, key=lambda r: r.start)])[:-1]]
    assert read_tokens(spark, path).where("doc_id = 5").select("part").distinct().count() > 1
    got = pack_documents(frame, vocabulary_path(), capacity=64).collect()
    assert len(got) == 900 and len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 64)


def test_very_long_text(spark, tokenizer):
    """One text of 120,000 words among short ones, through every operation on documents."""
    from quillon.llm.line_dedup import remove_repeated_lines
    from quillon.llm.near_dedup import one_of_similar
    from quillon.llm.simhash_dedup import near_duplicates
    from quillon.llm.substring_dedup import remove_repeats
    from quillon.llm.suffix_dedup import remove_earlier

    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 9))) for _ in range(30_000)]
    parts = [" ".join(rnd.choices(words, k=12)) for _ in range(10_000)]
    long, passage = "\n".join(parts), "\n".join(parts[5000:5004])
    frame = spark.createDataFrame([(1, passage, "aa"), (2, long, "aa"), (3, "short", "bb")], "doc_id bigint, text string, lang string")
    one = {r.doc_id: r for r in remove_repeats(frame).collect()}
    assert (one[2].n_words, one[2].n_removed, one[1].n_removed) == (120_000, 48, 48)
    five = {r.doc_id: r for r in remove_earlier(frame).collect()}
    assert five[2].n_bytes == len(long) and abs(five[2].n_removed - len(passage)) <= 2 and five[1].n_removed == 0
    ten = {r.doc_id: r for r in remove_repeated_lines(frame, exact=1).collect()}
    assert ten[2].n_removed == 4 and ten[2].text == "\n".join(parts[:5000] + parts[5004:])
    assert near_duplicates(frame).select("component_id").distinct().count() == one_of_similar(frame).count() == 3
    assert {r.doc_id: r.lang_pred for r in identify(frame).collect()}[2] in ("aa", "bb")
    pieces = pack_documents(frame, vocabulary_path()).where("doc_id = 2").collect()
    ids = [*tokenizer.encode(long, add_special_tokens=False).ids, 0]
    assert sum(r.length for r in pieces) == len(ids) and {r.piece: r.ids_crc32 for r in pieces}[3] == zlib.crc32(np.array(ids[3 * 2048 : 4 * 2048], "<u4").tobytes())
    item = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    assert {r.doc_id for r in contaminated(frame, item).collect()} == {1, 2} and [r.doc_id for r in without_items(frame, item).collect()] == [3]


# packing


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, docs, rows, none, tokenizer, capacity):
    got = pack_documents(docs, vocabulary_path(), capacity=capacity, keep_ids=True).collect()
    expected, total = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for s in range(0, len(ids), capacity):
            part = ids[s : s + capacity]
            expected.append((r[0], s // capacity, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got) == bag(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) <= 1.1 * total / capacity + 2
    assert len({r.sequence_id for r in got if r.doc_id is None or r.doc_id == 310}) > 1
    assert pack_documents(none, vocabulary_path()).count() == 0


def test_rule():
    """Each length goes where the sum of squares becomes smallest."""
    rnd = random.Random(4)
    lengths, capacity = [rnd.randint(1, 20) for _ in range(400)], 20
    bins, offsets, used = place(np.array(lengths), capacity)
    fill = {}
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        assert o == fill.get(b, 0)

        def cost(state):
            gaps = defaultdict(int)
            for f in state.values():
                gaps[capacity - f] += f < capacity
            return sum(x * x for x in gaps.values())

        choices = {f: cost(fill | {k: f + s}) for k, f in fill.items() if f + s <= capacity} | {0: cost(fill | {-1: s})}
        fill[b] = o + s
        assert cost(fill) == min(choices.values())
    assert used == len(fill)


def test_every_piece_follows_the_rule():
    """Pieces of open bins that are placed once more go by the same rule: what is left is a packing of place() for some order."""
    rnd = np.random.default_rng(5)
    lengths = -np.sort(-rnd.integers(1, 100, 500))
    bins, offsets = packing.settled(lengths, 100)
    fill = np.bincount(bins, lengths)
    once = place(lengths, 100)[2]
    assert fill.max() <= 100 and (fill > 0).sum() <= once
    loose = np.flatnonzero(fill[bins] < 100)
    assert place(lengths[loose], 100)[2] >= len(np.unique(bins[loose]))  # no further round would save a bin
    for b in np.unique(bins):
        order = np.argsort(offsets[bins == b])
        assert np.array_equal(offsets[bins == b][order], np.cumsum(lengths[bins == b][order]) - lengths[bins == b][order])


def test_parts(spark, monkeypatch, docs):
    monkeypatch.setattr(packing, "TOGETHER", 20)
    got = pack_documents(docs, vocabulary_path(), capacity=256).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).collect()
    assert all(r.n == r.e <= 256 for r in got)


# HTML


def test_tree_fits_its_table():
    """Every block of the labelled pages; those in elements for menus, footers and the like go before the tree is asked."""
    tree = trained()
    for page, wanted in PAGES:
        texts, x = blocks(page)
        asked = x[:, FEATURES.index("aside")] == 0
        assert all(k == (t in wanted) for t, k, a in zip(texts, tree.accepts(x), asked, strict=True) if a) and set(wanted) <= {t for t, a in zip(texts, asked, strict=True) if a}


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<", "<"), ("<p", ""), ("<article><p>a &lt; b &amp b &eacute;&#x41;</p>", "a < b & b éA"), ("<article>x<b>y</b>z<br>w\n\n v</article>", "xyz w v"),
        ("<article><p>one<script>var a='</p>';</script> two</p><!-- <p>no</p> --><style>p{}</style><p>three", "one two three"),
        ("<body><nav>menu</nav><article>A<div class='comments'>no</div><aside>no</aside>B<form>no</form></article><footer>no</footer></body>", "A B"),
        ("<article><p>unclosed <a href=\"x>link</a><p>next</article>", "unclosed link next"),
    ],
)
def test_pages(page, text):
    assert main_text(page or "", trained()) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><div><video src=x></div><p>the rest</p></article>", "the rest"), ("<article><p>a<button>no</p><p>b</p><div><object><object>no</object></div>c</article>", "a b c"),
        ("<article>a<svg><title>no</title><svg>no</svg>no<style></svg></style></svg>b<canvas><div>no</div>no</canvas> c</article>", "a b c"),
        ("<article>a<select><option>no<option>no</select> b<template><p>no</p></p><div>no</div></template> c<video>no <b>no</b></i></video> d</article>", "a b c d"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", "so x=2 holds"), ("<article><p>a</p><script>b</p><p>c</p></article>", "a"),
        ("<article><ul><li><audio src=x></li><li>one</li></ul><p>two<button>no<button>no</button> three</p></article>", "one two three"),
    ],
)
def test_silence_ends_with_its_block(page, text):
    assert " ".join(blocks(page)[0]) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>a </ b and the rest</p></article>", "a </ b and the rest"), ("a </ b and the rest", "a </ b and the rest"), ("<article><p>one</p><button>x<p>two</p></article>", "one two"), ("<article><p>one</p><object data=x><p>two</p></article>", "one two"),
        ("<article>a </> b</article>", "a b"), ("<article><p>one</p><select><option>x<p>two</p></article>", "one two"),
    ],
)
def test_nothing_else_is_lost(page, text):
    assert " ".join(blocks(page)[0]) == text


def test_words_and_neighbours_decide_without_an_article():
    """Pages without an element or class that says where the article is."""
    tree = trained()
    asked = {FEATURES[i] for i in tree.used()}
    assert {"words", "link_density", "own_share", "article_share"} <= asked and asked & {"words_before", "words_after"} and asked & {"link_density_before", "link_density_after"}
    long = "The council met on the first day of the month and spoke for many hours about the bridge, which has been closed since the spring of last year."
    more = "Most of those who came wanted it open again before the winter, and some of them had brought drawings of how it could be done for little money."
    links = lambda *x: "<p>" + " ".join(f"<a href='/{k}'>{k}</a>" for k in x) + "</p>"
    assert main_text(f"<body>{links('Home', 'News')}<p>Since 1901</p>{links('All stories')}<h1>The bridge</h1><p>{long}</p><p>It rained.</p><p>{more}</p>{links('Next', 'Back')}<p>Imprint below</p>{links('Imprint')}</body>", tree) == f"The bridge {long} It rained. {more}"
    assert main_text(f"<body><div class='social-history'><p>{long}</p><p>{more}</p></div><div class='social-buttons'>{links('Tell')}</div></body>", tree) == f"{long} {more}"
    assert main_text(f"<body><div class='top-nav'><p>{long}</p></div><p>{more}</p><p>{long} {more}</p><div id='reader-comments'><p>{long}</p></div></body>", tree) == f"{long} {more} {long} {more}"  # prose stays, whatever is named like a tool
    assert main_text(f"<article><div class='social-history'><p>{long}</p></div><div class='comments'><p>{more}</p></div></article>", tree) == long


def words(n, name):
    return " ".join(f"{name}{i}" for i in range(n)) + "."


STORY = [words(30, "one"), words(25, "two"), words(40, "three")]


@pytest.mark.parametrize(
    "page,more",
    [
        ("<body><div class='story'>{}</div><article><p>" + words(15, "comment") + "</p></article></body>", ""), ("<body><div id='main-text'>{}</div><article><p>Teaser</p></article></body>", ""), ("<body><article><p>Teaser</p></article><div id='main-text'>{}</div></body>", ""),
        ("<body><article><p>" + words(20, "first") + "</p><section id='search'>{}</section></article></body>", words(20, "first")), ("<body><article>{}<ul><li><a href='1'>One link</a></li><li><a href='2'>Two</a></li><li><a href='3'>Three links here</a></li></ul></article></body>", ""),
        ("<body><div><p>" + words(20, "cookie") + "</p></div><article>{}</article></body>", ""), ("<body><div><p>" + words(20, "cookie") + "</p></div><div><h1>Head</h1>{}</div></body>", "Head"), ("<body><div id=page><div><p>" + words(20, "cookie") + "</p></div><div><h1>Head</h1>{}</div></div></body>", "Head"),
    ],
)
def test_no_element_or_class_decides_alone(page, more):
    """A story beside the article element, prose in an element that is named like a tool, menus and notices without a class: by words, links and shares of the page, and without class names as well."""
    for tree in (trained(), trained(without=("marks", "tools"))):
        assert main_text(page.format("".join(f"<p>{t}</p>" for t in STORY)), tree) == " ".join([more, *STORY]).strip()


@there
def test_class_names_are_hints():
    """The tree that asks no class names gives the article elements of nearly all of the driver's pages, the one that does of all."""
    import pyarrow.parquet as pq

    with_names, tree, same = trained(), trained(without=("marks", "tools")), 0
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in table:
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        want = " ".join("".join(" " if c.startswith("<") else html.unescape(c) for c in __import__("re").split(r"(<[^>]*>)", inner)).split())
        assert main_text(page, with_names) == want
        same += main_text(page, tree) == want
    assert same > 0.98 * len(table)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article>a</article>", "old", 9), (2, None, None, "old", 9), (1, "u", "<article>a</article>", "old", 9)], "page_id int, url string, html string, text string, n_chars int")
    assert bag(extract(pages).collect()) == bag([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0)])
    assert extract(pages.limit(0)).count() == 0


@there
def test_driver_pages(spark):
    for r in extract(spark.read.parquet(f"{SF}/pages.parquet").withColumn("keep", F.col("html"))).collect():
        inner = r.keep[r.keep.index("<article>") + 9 : r.keep.index("</article>")]
        inner = "".join(" " if c.startswith("<") else html.unescape(c) for c in __import__("re").split(r"(<[^>]*>)", inner))
        assert r.text == " ".join(inner.split()) and r.n_chars == len(r.text)


# search


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 150)
    monkeypatch.setattr(topk_search, "QUERIES", 5)
    rnd = np.random.default_rng(3)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rnd.normal(0, 0.2, (700, 12)), 2))]
    data += [(1000 + i, data[50][1]) for i in range(30)]  # ties
    data += [(2000, None), (2050, [1.0, None] * 6), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, [0.5] * 5), (2250, []), (2300, [0.0] * 12)]
    vectors = quantised(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"))
    got = [tuple(r) for r in top_k(vectors, vectors.where("id % 50 = 0"), 5).collect()]
    fine = {i: [int(np.floor(256 * x)) for x in v] for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in fine:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(fine[q], fine[c], strict=False)), c) for c in fine if c != q)[:5]
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert bag(got) == bag(expected)
    few = vectors.where("id < 3")
    assert bag(top_k(few, few, 5).groupBy("query_id").count().collect()) == [(0, 2), (1, 2), (2, 2)]
    assert top_k(vectors.limit(0), vectors, 5).count() == 0 and top_k(vectors, vectors.limit(0), 5).count() == 0


def test_impact_index_takes_queries_together(monkeypatch):
    """A band's postings reach all queries of a slice by one product, and where a few impacts decide, queries end after the first bands."""
    rnd, products = np.random.default_rng(6), []

    class Counted(np.ndarray):
        def __rmatmul__(self, other):
            products.append(len(other))
            return other @ self.view(np.ndarray)

    even = np.floor(rnd.normal(0, 30, (900, 16)))
    steep = np.floor(rnd.normal(0, 1, (900, 16)) * 3)
    steep[np.arange(900), rnd.integers(0, 16, 900)] = rnd.integers(500, 2000, 900)
    for vectors, early in ((even, False), (steep, True), (np.zeros((900, 16)), False)):
        queries = np.concatenate([vectors[::5], -vectors[:1], np.zeros((1, 16)), vectors[:1] * 1e200])
        index = ImpactIndex(np.arange(900), vectors)
        index.bands = [(postings.view(Counted), rest) for postings, rest in index.bands]
        for cells in (1 << 20, 900 * 50):
            monkeypatch.setattr(topk_search, "CELLS", cells)
            products.clear()
            found = dict(index.possible(queries, 6))
            assert sorted(found) == list(range(len(queries))) and len(products) <= len(index.bands) * -(-len(queries) * 900 // cells)
            assert (sum(products) < 3 * len(queries)) == (early or len(index.bands) < 3)
            for i, at in found.items():
                scores = vectors @ (queries[i] / 1e200 if i == len(queries) - 1 else queries[i])
                assert set(np.flatnonzero(scores >= np.sort(scores)[-6])) <= set(at.tolist())


def test_topk_rows_and_large_scores(spark):
    """Equal ids: a row's own copy takes no part, all others do. Scores beyond 64 bits rank exactly and are told as NULL."""
    rnd = np.random.default_rng(8)
    data = [(int(i), [int(x) for x in v]) for i, v in zip(rnd.choice([0, 50, 100, 3, 4], 60), rnd.integers(-3, 3, (60, 2)), strict=True)]
    big = [(0, [10**17, 1]), (50, [10**17, 2]), (3, [-(10**17), 1]), (4, [3, -5]), (5, [10**17, 1])]
    huge = [(0, [1e300, 3.0]), (50, [-1e300, 2.0]), (3, [1e250, 1.0]), (4, [0.0, 7.0]), (5, [5e299, -1.0])]
    for rows in (data, big, [(i, [4 * 10**9 * x for x in v]) for i, v in data], huge):
        rows = [(i, [float(x) for x in v]) for i, v in rows]
        frame = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
        got = [tuple(r) for r in top_k(frame, frame.where("id % 50 = 0"), 5).collect()]
        expected = []
        for n, (q, v) in enumerate(rows):
            if q % 50 == 0:
                scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), c) for m, (c, w) in enumerate(rows) if m != n)[:5]
                expected += [(q, k + 1, c, -s if -(2**63) <= -s < 2**63 else None) for k, (s, c) in enumerate(scores)]
        assert bag(got) == bag(expected)


# decontamination


def test_decontamination(spark, docs, rows, none, monkeypatch):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, f"{say(20)}?\n{say(5)}.") for i in range(30)] + [(30, say(25)), (31, None), (32, "too short"), (33, ""), (5, "again " + say(20))]
    text = dict(items[:31])
    planted = [
        (1000, say(300) + " " + text[0] + " " + say(100)), (1001, text[1].upper().replace(" ", "!! ")), (1002, say(10) + text[30]), (1003, text[2].split("\n")[0] + " " + say(200)), (1004, say(500)),
        (1005, text[3] + " " + say(2000) + " " + text[4]), (1006, " ".join(sorted(text[6].split()))), (None, text[7]), (1007, " ".join(text[8].split()[:-2] + ["zz", "yy"])),
    ]
    frame = spark.createDataFrame([(i, t, *rows[0][2:]) for i, t in planted], docs.schema).union(docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1000, 0), (1001, 1), (1002, 30), (1005, 3), (1005, 4), (None, 7)}  # 1007 lacks the answer
    assert all(r.score >= 0.8 and r.question_overlap >= 0.5 and r.answer_overlap >= 0.5 for r in found)
    left = without_items(frame, bench)
    assert left.columns == frame.columns and bag(left.collect()) == bag(r for r in frame.collect() if (r.doc_id, r.text) not in {(d, t) for d, t in planted if d in (1000, 1001, 1002, 1005, None)})
    monkeypatch.setattr(decontamination, "INDEX_ITEMS", 7)
    assert bag(without_items(frame, bench).collect()) == bag(left.collect()) and without_items(none, bench).count() == 0
    assert {(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect()} == {(r.doc_id, r.item_id) for r in found}
    assert contaminated(none, bench).count() == 0 and contaminated(frame, bench.limit(0)).count() == 0


def test_items_of_every_length(spark):
    """Items of under eight terms are found where all their terms stand in a row; those of scripts without spaces by their characters."""
    items = [(1, "Who was first?\nNobody knows"), (2, "Paris"), (3, "東京の一番高い建物は何ですか。\n東京スカイツリー"), (4, "水是什么"), (5, "รถไฟฟ้า"), (6, "twice the same twice the same"), (7, "... !"), (8, "Who was")]
    docs = [
        (10, "so: who WAS first? nobody\nknows, he said"), (11, "who was the first? nobody knows"), (12, "in paris."), (13, "parisian"), (14, "前文東京の一番高い建物は何ですか。東京スカイツリー後文"), (15, "他问：水是什么？"), (16, "水 什么是"),
        (17, "นั่งรถไฟฟ้าไป"), (18, "twice the same twice same the same"), (19, "it was twice the same twice the same"), (20, "who"), (21, "was first"), (22, None), (23, ""), (24, "who was first? nobody"),
    ]
    found = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(10, 1), (10, 8), (11, 8), (24, 8), (12, 2), (14, 3), (15, 4), (17, 5), (19, 6)}
    assert {(r.doc_id, r.passage) for r in found.where("item_id in (1, 6)").collect()} == {(10, 1), (19, 2)}
    few = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items[1:2], "item_id bigint, text string"))
    assert [tuple(r) for r in few.collect()] == [(12, 2, 1.0, 1.0, 1.0, 1)]


def plain_pairs(docs, items, threshold=0.8, question=0.5, answer=0.5, least=8):
    """contaminated() by its docstring: every passage of every text against every item."""
    from collections import Counter
    from math import log1p

    items = [(i, t, terms(t)) for i, t in items if t is not None]
    df, mean = Counter(t for _, _, w in items for t in set(w)), sum(len(w) for _, _, w in items) / max(1, len(items))
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    def overlap(part, words):
        n = max(1, min(3, len(part)))
        return len(grams(part, n) & grams(words, n)) / len(grams(part, n)) if part else 1.0

    best = {}
    for d, text in docs:
        said = terms(text or "")
        for i, t, w in items:
            found = []
            if 0 < len(w) < least:
                found = [(1.0, 1.0, 1.0, -p) for p in range(len(said)) if said[p : p + len(w)] == w][:1]
            elif w:
                stride = 64
                while stride < len(w):
                    stride *= 2
                weight = {x: log1p((len(items) - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in Counter(w).items()}
                lines = [x for x in map(terms, t.splitlines()) if x]
                q, a = (sum(lines[:-1], []), lines[-1]) if len(lines) > 1 else (w, [])
                for lo, hi in [(0, stride), *((k * stride, (k + 2) * stride) for k in range(-(-len(said) // stride)))]:
                    words = said[lo:hi]
                    score = sum(v for x, v in weight.items() if x in set(words)) / sum(weight.values())
                    if score >= threshold - 1e-9 and overlap(q, words) >= question and overlap(a, words) >= answer:
                        found.append((round(score, 9), overlap(q, words), overlap(a, words), -lo))
            if found:
                best[d, i] = max([*found, *([best[d, i]] if (d, i) in best else [])])
    return {(d, i, s, q, a, -b) for (d, i), (s, q, a, b) in best.items()}


def test_decontamination_against_every_passage(spark, monkeypatch):
    """The whole operator against brute force; the same for any size of groups and with a very long item beside the others, which have no say in an item's passages."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(90)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(rnd.choice([3, 7, 9, 15, 40, 63, 64, 65, 90, 130])) + rnd.choice(["", "\n" + say(4)])) for i in range(40)] + [(40, "? !"), (41, None), (None, say(12)), (3, say(20))]
    docs = []
    for d in range(40):
        i, text = rnd.choice([x for x in items if x[1]])
        lines = text.split("\n")
        docs.append((d, rnd.choice([say(rnd.randint(0, 150)) + " " + text + " " + say(rnd.randint(0, 200)), lines[0] + " " + say(rnd.choice([10, 70, 2000])) + " " + lines[-1], " ".join(w for w in text.split() if rnd.random() < 0.9), say(300)])))
    docs += [(100, None), (101, ""), (102, items[0][1] + " " + say(3000) + " " + items[1][1]), (5, docs[7][1]), (None, items[5][1])]
    apart = [(200, f"far {say(40)}\nquite {say(6)}")]
    split = apart[0][1].split("\n")
    docs.append((103, split[0] + " " + say(2000) + " " + split[1]))  # question and answer 2000 words apart: no pair
    long = [(300, " ".join(f"z{i % 4000}" for i in range(8000)))]

    def got(bench):
        found = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()
        return {(r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap, r.passage) for r in found}

    bench = items + apart
    want = plain_pairs(docs, bench)
    assert got(bench) == want and len(want) > 20 and not any(p[:2] == (103, 200) for p in want)
    assert got(bench + long) == plain_pairs(docs, bench + long)
    assert {p[:2] for p in got(bench + long)} == {p[:2] for p in want}
    monkeypatch.setattr(decontamination, "INDEX_ITEMS", 5)
    assert got(bench) == want


def test_bounds_lose_nothing():
    """The search over blocks finds every pair that plain BM25 puts above the threshold."""
    from collections import Counter

    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(8, 20)))) for i in range(50)]
    df = Counter(t for _, x in items for t in set(terms(x)))
    full = [decontamination.Item(i, x, terms(x), {t: df[t] for t in terms(x)}) for i, x in items]
    index = decontamination.Group(full, len(items), sum(len(x.words) for x in full) / len(items), 0.6, 8).indexes[0]
    pairs, expected = [], set()
    for p in range(80):
        have = {index.vocabulary[w] for w in set(rnd.choices(words, k=30)) if w in index.vocabulary}
        pairs += [(p, t) for t in sorted(have)]
        for i in range(len(items)):
            if sum(s for t, j, s in zip(index.term, index.item, index.share, strict=True) if j == i and t in have) >= 0.6 - 1e-9:
                expected.add((p, i))
    passage, item, _ = index.search(*np.array(pairs).T)
    assert set(zip(passage.tolist(), item.tolist(), strict=True)) == expected and expected


# pipeline


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "best_fit_packing"]
    folder = str(tmp_path)
    item = "which of the many rivers of this land is the longest one of all\nthe second one from the north"
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    leak = spark.createDataFrame([(900, f"some words before {item} and after", None, "s", 1), (901, "ñandú " * 30, None, "s", 1)], plain.schema)
    plain.union(leak).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, frame, folder)
        if k < 4:
            assert out.columns == frame.columns and out.dtypes == frame.dtypes
        out.write.parquet(f"{folder}/{k}")
        frame = seen[name] = spark.read.parquet(f"{folder}/{k}")
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    assert {300, 301, 302, 303, 308} & ids("language_id") == set() and 304 in ids("language_id")
    assert seen["language_id"].where("doc_id = 901").first().lang == "en"
    assert len({i for i in ids("simhash_dedup") if i is not None and 100 <= i < 115}) <= 2  # the first copy, and what short lines the others have left
    assert 900 in ids("simhash_dedup") and 900 not in ids("decontamination")
    assert ids("decontamination") == ids("simhash_dedup") - {900} and ids("best_fit_packing") == ids("decontamination")
    same = [(None, f"clean text number {i} of those that have no id and tell of other things each time {i * 7}", None, "s", 1) for i in range(3)] + [(77, f"another text {i} under one id with words of its own like w{i} and v{i}", None, "s", 1) for i in range(3)]
    leaks = [(None, f"{item} as everybody knows", None, "s", 1), (77, f"we read that {item}", None, "s", 1)]
    held = spark.createDataFrame(same + leaks, plain.schema)
    assert bag(P.decontamination(spark, held, folder).select("text").collect()) == bag((r[1],) for r in same)
    nothing = plain.limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, nothing, folder)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == list(P.COLUMNS))
    again = P.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert bag(again) == bag(seen["best_fit_packing"].select("doc_id", "piece", "length", "ids_crc32").collect())


def test_predict_replaces_its_columns(spark, docs, none):
    out = predict(docs, Profiles({}, 64))
    assert out.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    assert {(r.lang_pred, r.score) for r in out.select("lang_pred", "score").collect()} == {("und", 0.0)} and out.count() == docs.count()
    assert predict(none, Profiles({"en": np.ones(64)}, 64)).count() == 0
