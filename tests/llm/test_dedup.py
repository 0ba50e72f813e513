"""Substring, suffix, line and SimHash dedup against plain definitions."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chunks, line_dedup, near_dedup, simhash_dedup, suffix_dedup
from quillon.llm.components import components
from quillon.llm.hashing import xxh64
from quillon.llm.line_dedup import remove_repeated_lines, within
from quillon.llm.near_dedup import one_of_similar
from quillon.llm.simhash_dedup import fingerprint_components, near_duplicates, one_of_each
from quillon.llm.substring_dedup import COVER, PERIOD, remove_repeats
from quillon.llm.suffix_dedup import remove_earlier

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("window,fan", [(35, 512), (22, 512), (35, 3)])
def test_substring(docs, rows, window, fan, monkeypatch):
    monkeypatch.setattr(chunks, "FAN", fan)
    seen = Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    expected = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        expected.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = remove_repeats(docs, window=window)
    assert bag(got.select("doc_id", "n_words", "n_removed", "kept").collect()) == bag(expected)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans[:-1], r.spans[1:], strict=True))


@pytest.mark.parametrize("fan", [512, 3])
def test_suffix(docs, rows, fan, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4096)
    monkeypatch.setattr(chunks, "FAN", fan)
    low = -(2**63)
    first: dict = {}
    for r in sorted(rows, key=lambda r: low if r[0] is None else r[0]):
        b = (r[1] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], low if r[0] is None else r[0])
    expected = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (low if r[0] is None else r[0]):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        expected.append((r[0], len(b), sum(gone), len(re.findall(b"\1+", gone)), bytearray(kept)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept) for r in remove_earlier(docs).collect()]
    assert bag(got) == bag(expected)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=14), st.lists(st.tuples(st.integers(0, 20), st.sampled_from("idr"), st.integers(97, 99)), max_size=4))
def test_within(a, changes):
    b = bytearray(a)
    for at, kind, c in changes:
        if kind == "i":
            b.insert(at % (len(b) + 1), c)
        elif b and kind == "d":
            del b[at % len(b)]
        elif b:
            b[at % len(b)] = c
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    for edits in range(4):
        assert within(a, bytes(b), edits) == (row[-1] <= edits)


@pytest.mark.parametrize("cell,fan", [(1024, 512), (3, 3)])
def test_lines(spark, docs, rows, cell, fan, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELL", cell)
    monkeypatch.setattr(chunks, "FAN", fan)
    rnd = random.Random(5)
    family = "the same line with a number in it, and a little more "
    more = [(400 + i, "\n".join(family + str(rnd.randrange(10**rnd.randint(1, 5))) for _ in range(3)), "en", "s", 0, 7, "b", "f", 1, "xx", "?") for i in range(15)]
    every = rows + more
    frame = spark.createDataFrame(every, docs.schema)
    low = -(2**63)
    seen, expected = [], []
    for r in sorted(every, key=lambda r: (low if r[0] is None else r[0], r[1] is not None, r[1] or "")):
        kept = []
        for x in (r[1] or "").split("\n"):
            b = x.strip().encode()
            if len(b) >= 24:
                again = any(within(p, b, 2) for p in seen)
                seen.append(b)
                if again:
                    continue
            kept.append(x)
        n = 0 if r[1] is None else r[1].count("\n") + 1
        expected.append((r[0], n, 0 if r[1] is None else n - len(kept), None if r[1] is None else "\n".join(kept), "b"))
    assert bag(remove_repeated_lines(frame, keep=("bucket",)).collect()) == bag(expected)


def test_short_lines(spark, docs, rows):
    """Every line that is not blank goes if an earlier one equals it; only lines of 24 bytes and more go for edits."""
    every = rows + [(500, "yes\n\n x\nAll rights reserved.\n}\n日", "en", "s", 0, 7, "b", "f", 1, "xx", "?"), (501, "All rights reserved.\nNo.7\n\n}\nyes \nAll rights reserved!\n日\nNo.7", "en", "s", 0, 7, "b", "f", 1, "xx", "?")]
    low = -(2**63)
    seen, expected = set(), []
    for r in sorted(every, key=lambda r: (low if r[0] is None else r[0], r[1] is not None, r[1] or "")):
        kept = []
        for x in (r[1] or "").split("\n"):
            b = x.strip().encode()
            again = b in seen or (len(b) >= 24 and any(len(p) >= 24 and within(p, b, 2) for p in seen))
            if b:
                seen.add(b)
            if not again:
                kept.append(x)
        expected.append((r[0], None if r[1] is None else "\n".join(kept)))
    got = remove_repeated_lines(spark.createDataFrame(every, docs.schema), exact=1)
    assert bag(got.select("doc_id", "text").collect()) == bag(expected)
    assert got.where("doc_id = 501").first().text == "No.7\n\nAll rights reserved!"


def fingerprint(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=2):
    """The smallest id reachable of each (id, fp), and the number of components."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f, least.get(find(i))) for i, (d, f) in enumerate(prints)], len({find(i) for i in range(len(prints))})


def test_simhash(docs, rows):
    expected, n = brute_components([(r[0], fingerprint(r[1])) for r in rows])
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(docs).collect()]
    assert bag(got) == bag(expected)
    stay = one_of_each(docs)
    assert stay.columns == docs.columns
    kept = stay.select("doc_id", "text").collect()
    # two components may have one name, as different texts have the same id
    assert len(kept) == n > len({c for _, _, c in expected}) and {r.doc_id for r in kept} == {c for _, _, c in expected}


def test_near_duplicates_are_of_texts_not_ids(spark):
    """Repeated and null ids: every different text stays, once."""
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(random.Random(i).choices(words, k=60)) for i in range(8)]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (1, texts[0], "a"), (None, texts[2], "c"), (None, texts[3], "d"), (None, texts[2], "c"), (2, texts[4], "e"), (3, texts[4] + " end", "f"), (None, texts[4], "g")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    for stay in (one_of_each(frame), one_of_similar(frame)):
        assert stay.columns == frame.columns
        assert bag(r for r in stay.collect() if r.fp not in "ef") == bag([(1, texts[0], "a"), (1, texts[1], "b"), (None, texts[2], "c"), (None, texts[3], "d")])
    assert [r.fp for r in one_of_similar(frame).where("fp in ('e', 'f', 'g')").collect()] == ["e"]


def test_simhash_families(spark):
    """Large groups of fingerprints a few bits apart: chains and balls."""
    rnd = random.Random(2)
    prints = []
    for centre in (0, rnd.getrandbits(64), 2**64 - 1):
        prints += [centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)]
        for _ in range(40):
            centre ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            prints.append(centre)
    prints += [rnd.getrandbits(64) for _ in range(100)]
    rows = list(enumerate(prints))
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id bigint, fp bigint")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in fingerprint_components(frame).collect()]
    assert bag(got) == bag(brute_components(rows)[0])


@pytest.mark.parametrize("common,cell", [(4, 4096), (10**9, 4)])
def test_near_copies(spark, docs, rows, common, cell, monkeypatch):
    """Every pair with a Jaccard similarity of five-word shingles of 0.8 or more is connected, also within large families and beside a passage that many hold."""
    monkeypatch.setattr(near_dedup, "COMMON", common)
    monkeypatch.setattr(near_dedup, "CELL", cell)
    rnd = random.Random(9)
    say = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    passage, more = say(30), []
    for f in range(12):
        base = say(rnd.choice([20, 60, 150])).split(" ")
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
            more.append(" ".join(w) + (f" {passage}" if f % 3 == 0 else ""))
    more += [f"{say(10)} {passage} {say(10)}" for _ in range(30)]
    every = rows + [(1000 + i, t, *rows[0][2:]) for i, t in enumerate(more)]

    def sets(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    held = [sets(r[1]) for r in every]
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(held):
        for j in range(i):
            if x == held[j] or 5 * len(x & held[j]) >= 4 * len(x | held[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, r in enumerate(every):
        least.setdefault(find(i), []).extend([r[0]] if r[0] is not None else [])
    got = one_of_similar(spark.createDataFrame(every, docs.schema))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(min(x) for x in least.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=5), st.integers(0, 2**64 - 1))
def test_xxh64(parts, seed):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    starts = ends - np.array([len(p) for p in parts], np.int64)
    assert xxh64(data, starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


def test_blocks_are_bounded():
    masks = simhash_dedup.blocks_for(2)
    assert max(64 - m.bit_count() for m in masks) <= 12
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 3)] + [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("kind", [chunks.OTHER, chunks.SMALLER, chunks.FAMILY, chunks.TIMES])
def test_exchange(spark, kind, monkeypatch):
    """Any number of chunks, in steps of a few at a time, get the answers that all keys together give."""
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(chunks, "FAN", 4)
    n, held, sent = 40, [], []
    buckets = chunks.Buckets(n)
    assert len(buckets.widths) == 3 and chunks.Buckets(3).widths == [1]
    for c in range(n):
        keys = rnd.integers(0, 150, 60).astype(np.uint64) << np.uint64(3)
        members = rnd.integers(0, 4, 60).astype(np.uint64) if kind == chunks.FAMILY else None
        docs = rnd.integers(0, 5, 60)
        ids = np.sort(rnd.choice(300, 5, replace=False)).astype(np.int64)
        k = chunks.KeySet(keys, keys ^ np.uint64(77), buckets, docs, members)
        k.count_owners(docs)
        held.append((k, ids))
        sent += [*k.rows(c, kind, ids if kind in (chunks.SMALLER, chunks.FAMILY) else None, c if kind == chunks.SMALLER else None), chunks.passed(c, b"%d" % c)]
    got = chunks.answered(spark.createDataFrame(chunks.key_table(sent), chunks.KEYS), buckets).collect()
    whole = [(int(a), int(m), int(ids[o]), c, int(t)) for c, (k, ids) in enumerate(held) for a, m, o, t in zip(k.keys, k.keys if k.members is None else k.members, k.owner, k.owners, strict=True)]
    for c, (k, ids) in enumerate(held):
        assert [bytes(r.bits) for r in got if r.chunk == c and r.kind == chunks.PASS] == [b"%d" % c]
        mine = [(r.bucket, bytes(r.bits)) for r in got if r.chunk == c and r.kind == kind]
        assert len(mine) <= 4
        own = [x for x in whole if x[3] == c]
        if kind == chunks.TIMES:
            assert k.totals(mine).tolist() == [sum(y[4] for y in whole if y[0] == x[0]) for x in own]
        elif kind == chunks.OTHER:
            assert k.answers(mine).tolist() == [any(y[0] == x[0] and y[3] != c for y in whole) for x in own]
        elif kind == chunks.SMALLER:
            assert k.answers(mine).tolist() == [any(y[0] == x[0] and y[2:4] < x[2:4] for y in whole) for x in own]
        else:
            has = [any(y[:2] == x[:2] and y[2] < x[2] for y in whole) for x in own]
            alone = [any(y[0] == x[0] and y[2] > min(z[2] for z in whole if z[0] == x[0]) and y[2] == min(z[2] for z in whole if z[:2] == y[:2]) for y in whole) for x in own]
            assert k.answers(mine).tolist() == has and k.answers(mine, 1).tolist() == [a and not h for a, h in zip(alone, has, strict=True)]


def test_null_and_equal_ids_are_spread(spark):
    """A third of rows may share an id, or have none and no text: they don't share a chunk."""
    rnd = random.Random(6)
    rows = [(None, None)] * 400 + [(None, "x" * rnd.randint(1, 900)) for _ in range(400)] + [(7, f"{rnd.random()}") for _ in range(400)]
    packed = chunks.chunked(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), "doc_id", "text", 12).groupBy("chunk").count().count()
    sizes = [chunks.rows_of(pa.table({"data": [r.data for r in x]})).num_rows for x in _by_chunk(chunks.chunked(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), "doc_id", "text", 12))]
    assert packed == 12 and sum(sizes) == 1200 and max(sizes) < 200


def _by_chunk(packed):
    out = {}
    for r in packed.collect():
        out.setdefault(r.chunk, []).append(r)
    return out.values()


def test_empty(none):
    assert remove_repeats(none).count() == 0
    assert remove_earlier(none).count() == 0
    assert remove_repeated_lines(none).count() == 0
    assert near_duplicates(none).count() == 0
    assert one_of_each(none).count() == 0
    assert one_of_similar(none).count() == 0


def test_sampled_positions_follow_the_text():
    rnd = np.random.default_rng(0)
    a = rnd.integers(97, 100, 400).astype(np.uint8)
    whole = suffix_dedup.sampled(suffix_dedup.doubled(a, [26])[0], 25)
    part = suffix_dedup.sampled(suffix_dedup.doubled(a[100:300], [26])[0], 25) + 100
    assert set(part) <= set(whole)
    assert np.diff(whole).max() <= 25
