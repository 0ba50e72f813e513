"""Benchmark decontamination: every training passage is a BM25 query against an index of the test items, with block-max bounds."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship, stored, trim
from .hashing import mix
from .simhash_dedup import _slices

#: Items of one index and bytes of their texts: what is broadcast at a time. More items make more indexes, each of which all documents are searched with.
INDEX_ITEMS, INDEX_BYTES = 20_000, 16 << 20
BLOCK = 8
#: Words whose terms a worker keeps.
KNOWN = 100_000
K1, B = 1.2, 0.75
_REST = re.compile(r"[\W_]+")
#: Letters of scripts without spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han): each is a term of its own.
_ALONE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_PIECE = re.compile(f"[{_ALONE}]|[^{_ALONE}]+")
PAIRS = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, passage bigint"


def terms(text: str) -> list[str]:
    """Words between white space, lowered, with nothing but letters and digits; single letters where a script has no spaces."""
    return [w for x in text.lower().split() for w in _pieces(x)]


def _pieces(word: str) -> list[str]:
    """The terms of a lowered word."""
    x = _REST.sub("", word)
    return ([x] if x else []) if x.isascii() else _PIECE.findall(x)


def _grams(words: list, n: int = 3) -> set:
    n = max(1, min(n, len(words)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Item(NamedTuple):
    """A test item: its terms in order, and of each the number of items that have it."""

    id: int | None
    text: str
    words: list[str]
    df: dict[str, int]


class Index:
    """Postings of items of like lengths in blocks of BLOCK neighbours, with BM25 impacts as shares of an item's score against itself.

    threshold: the share that a passage must reach. Of each item, the terms that most items have are passive while their shares sum to less than half the threshold:
    a passage that reaches the threshold holds active terms worth the rest. Passive postings are only read for items that can still reach it.
    stride: half the words of a passage, no less than the words of any item here.
    """

    def __init__(self, items: list[Item], vocabulary: dict[str, int], n_items: int, mean_words: float, threshold: float, stride: int):
        self.threshold, self.stride = threshold, stride
        self.ids = [x.id for x in items]
        parsed = [(x.df, x.words, x.text) for x in items]
        self.vocabulary = vocabulary
        rows = []
        self.need = np.zeros(len(parsed))
        self.parts = []
        for i, (df, w, text) in enumerate(parsed):
            count = Counter(w)
            weight = {t: np.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean_words)) for t, c in count.items()}
            own, passive = sum(weight.values()), 0.0
            for t in sorted(count, key=lambda t: (-df[t], t)):
                share = weight[t] / own
                active = passive + share >= threshold / 2
                passive += 0 if active else share
                rows.append((self.vocabulary[t], i, share, active))
            self.need[i] = threshold - passive - 1e-9
            lines = [x for x in (terms(x) for x in text.splitlines()) if x]
            question, answer = ([x for y in lines[:-1] for x in y], lines[-1]) if len(lines) > 1 else (w, [])
            ids = lambda x: [self.vocabulary[t] for t in x]
            self.parts.append((_grams(ids(question)), _grams(ids(answer)) if answer else set()))
        rows.sort()
        self.term, self.item = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.share, active = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], bool)
        n = len(self.vocabulary) + 1
        self.at = np.searchsorted(self.term, np.arange(n))  # postings of a term, passive ones too
        block = self.item // BLOCK
        self.n_blocks = len(parsed) // BLOCK + 1
        key, first = np.unique((self.term * self.n_blocks + block)[active], return_index=True)
        self.block_term, self.block = key // self.n_blocks, key % self.n_blocks
        self.block_at = np.searchsorted(self.block_term, np.arange(n))
        self.block_max = np.maximum.reduceat(self.share[active], first) if len(first) else np.zeros(0)
        self.block_need = np.array([self.need[b * BLOCK : (b + 1) * BLOCK].min(initial=9) for b in range(self.n_blocks)])
        self.active = active
        # the most that a term is worth to any item here, and the least that an item needs
        self.term_max = np.zeros(n)
        np.maximum.at(self.term_max, self.term[active], self.share[active])
        self.least = float(self.need.min(initial=9))

    def search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs that reach the threshold, from the distinct (passage, term), sorted.

        The test of WAND's pivots, for all passages of a batch at a time and in three depths: only where the largest impacts of a passage's terms, then those of a block, then those of an item's
        active terms reach what is needed, the next postings are read.
        """
        key, total = _sums(passage, self.term_max[term])
        pivot = np.isin(passage, key[total >= self.least])
        passage, term = passage[pivot], term[pivot]
        # blocks: the largest active impacts of a block's items, summed over the passage's terms, must reach what one of its items needs
        p, j = _postings(passage, term, self.block_at)
        key, total = _sums(p * self.n_blocks + self.block[j], self.block_max[j])
        fine = total >= self.block_need[key % self.n_blocks]
        alive = key[fine]
        # items of those blocks, by active terms, then by all terms
        near = np.isin(passage, alive // self.n_blocks)
        p, j = _postings(passage[near], term[near], self.at)
        inside = np.isin(p * self.n_blocks + self.item[j] // BLOCK, alive)
        p, j = p[inside], j[inside]
        n = len(self.ids)
        a = self.active[j]
        key, total = _sums((p * n + self.item[j])[a], self.share[j][a])
        alive = key[total >= self.need[key % n]]
        inside = np.isin(p * n + self.item[j], alive)
        key, total = _sums((p * n + self.item[j])[inside], self.share[j][inside])
        fine = total >= self.threshold - 1e-9
        return key[fine] // n, key[fine] % n, total[fine]


class Rows:
    """Short items by length: their terms in a row, the items of each, and a hash of each to look up."""

    def __init__(self, items: list[Item], vocabulary: dict[str, int]):
        self.starts = np.zeros(len(vocabulary) + 1, bool)
        rows_of: dict[int, dict[tuple, list[int]]] = {}
        for x in items:
            row = tuple(vocabulary[t] for t in x.words)
            self.starts[row[0]] = True
            rows_of.setdefault(len(row), {}).setdefault(row, []).append(x.id)
        self.short = []
        for size, found in sorted(rows_of.items()):
            h = _row_hashes(np.array(list(found), np.int64).ravel(), np.arange(len(found)) * size, size)
            order = np.argsort(h)
            self.short.append((size, h[order], [list(found.items())[k] for k in order.tolist()]))

    def rows(self, doc: np.ndarray, word: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, place) of each short item's first place in each document where all its terms stand in a row; word has -1 for other terms."""
        out = []
        begin = np.flatnonzero(self.starts[word]) if self.short else np.zeros(0, np.int64)  # -1 is the entry after the vocabulary
        for size, hashes, found in self.short:
            s = begin[begin + size <= len(word)]
            s = s[doc[s] == doc[s + size - 1]]
            h = _row_hashes(word, s, size)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            s, at = s[hashes[at] == h], at[hashes[at] == h]
            _, first = np.unique(doc[s] * len(hashes) + at, return_index=True)
            for p, k in zip(s[first].tolist(), at[first].tolist(), strict=True):
                row, ids = found[k]
                if tuple(word[p : p + size].tolist()) == row:
                    out += [(int(doc[p]), i, p) for i in ids]
        return out


class Group:
    """What is broadcast at a time: an index for each class of lengths, the short items, and the vocabulary of all. What is found of an item does not depend on the others here."""

    def __init__(self, items: list[Item], n_items: int, mean_words: float, threshold: float, least_words: int):
        self.key = uuid.uuid4().hex
        self.vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for x in items for t in x.words))}
        self.rows = Rows([x for x in items if 0 < len(x.words) < least_words], self.vocabulary)
        by: dict[int, list[Item]] = {}
        for x in items:
            if len(x.words) >= max(least_words, 1):
                by.setdefault(stride_of(len(x.words)), []).append(x)
        self.indexes = [Index(own, self.vocabulary, n_items, mean_words, threshold, stride) for stride, own in sorted(by.items())]


def stride_of(words: int) -> int:
    """The stride of an item's passages, from its own length: the power of two that is no less, at least 64."""
    return max(64, 1 << (words - 1).bit_length())


def _row_hashes(word: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(start), np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[start + k].astype(np.uint64) + np.uint64(1))
    return h


def _postings(passage: np.ndarray, term: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passage and the posting of each posting of the passages' terms."""
    n = at[term + 1] - at[term]
    return np.repeat(passage, n), np.arange(int(n.sum())) + np.repeat(at[term] - (np.cumsum(n) - n), n)


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(value[order], first) if len(first) else np.zeros(0)


def _held(group: Group, texts: pa.Array, question: float, answer: float) -> list[tuple]:
    """(text, item, score, question overlap, answer overlap, first word of the passage) of all pairs among some texts."""
    known = kept(("terms", group.key), dict)
    split = pc.utf8_split_whitespace(texts.fill_null(""))
    flat = split.flatten().dictionary_encode()
    code, size = [], []
    for w in flat.dictionary.to_pylist():
        c = known.get(w)
        if c is None:
            c = tuple(group.vocabulary.get(x, -1) for x in _pieces(w.lower()))
            if len(known) > KNOWN:
                known.clear()
            known[w] = c
        code += c
        size.append(len(c))
    which, size, code = flat.indices.to_numpy(zero_copy_only=False), np.array(size, np.int64), np.array(code, np.int64)
    n = size[which]  # terms of each word: none, one, or its letters
    word = code[np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    doc = np.repeat(np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False)), n)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = [x for index in group.indexes for x in _passages(index, doc, first, word, question, answer)]
    return out + [(d, i, 1.0, 1.0, 1.0, int(p - first[d])) for d, i, p in group.rows.rows(doc, word)]


def _passages(index: Index, doc: np.ndarray, first: np.ndarray, word: np.ndarray, question: float, answer: float) -> Iterator[tuple]:
    """What the passages of some texts hold of an index's items."""
    stride = index.stride
    step = (np.arange(len(doc)) - first[doc]) // stride
    wide = int(step.max(initial=0)) + 2
    # passages of two strides, one each stride: a word is in the one that begins at its stride and in the one before
    hit = np.flatnonzero(word >= 0)
    where = np.concatenate([(doc * wide + step + 1)[hit], (doc * wide + step)[hit]])
    n = len(index.vocabulary) + 1
    both = np.unique(where * n + np.tile(word[hit], 2))
    passage, item, score = index.search(both // n, both % n)
    for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist(), strict=True):
        d, k = p // wide, p % wide - 1
        lo = first[d] + max(0, k) * stride
        words = word[lo : min(first[d + 1], first[d] + (k + 2) * stride)].tolist()
        q, a = index.parts[i]
        near = _grams(words)
        share = lambda x, near=near, words=words: len(x & (near if len(next(iter(x))) == 3 else _grams(words, len(next(iter(x)))))) / len(x) if x else 1.0
        if share(q) >= question and share(a) >= answer:
            yield d, index.ids[i], s, share(q), share(a), int(max(0, k) * stride)


def _searched(held, question: float, answer: float):
    """Pairs of the documents of batches (doc_id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 1 << 20):
                columns = list(zip(*_held(held.value, b.column(1), question, answer), strict=True)) or [()] * 6
                ids = b.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage"])

    return of


def _groups(items: DataFrame, item_id: str, item_text: str, threshold: float, least_words: int) -> Iterator[Group]:
    """Indexes of the items, a group at a time. Spark counts the items of each term and gives each item the counts of its own; the driver holds the items of one group."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(x) for x in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["id", "text", "words"])

    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("text"))
    rows = stored(rows.mapInArrow(words, "id bigint, text string, words array<string>").withColumn("row", F.monotonically_increasing_id()), "items")
    n, total = rows.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not n or not total:
        return
    each = rows.select("row", F.explode(F.array_distinct("words")).alias("term"))
    counts = each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    stream = rows.join(counts, "row").select("id", "text", "words", "df").orderBy("id", "text").toLocalIterator()
    while group := _group(stream):
        yield Group(group, n, total / n, threshold, least_words)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, question: float = 0.5, answer: float = 0.5, least_words: int = 8) -> DataFrame:
    """Pairs of a document and an item that one of its passages holds: doc_id, item_id, the best passage's score, overlaps and first word.

    A passage is two strides of words, one begins at each stride. The stride is the item's own length up to the next power of two (64 at least), so that the item lies in a passage as a whole and
    no other item has a say in it. Its BM25 score against an item, as a share of the item's score
    against itself, must reach `threshold`; then the word triples of the item's question (all lines but the last, or the only one) and answer (the last line) must be in
    the passage to the shares `question` and `answer`. Items of fewer than least_words terms
    are found where all their terms stand in a row, at any place, with a score and overlaps of 1; null ones and those without terms are not looked for. Null texts match nothing. Documents, or items,
    with equal ids or without one count as one, whose best pair is told; no items give no pairs. A long text is searched in whole.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = spark.createDataFrame([], PAIRS)
    for group in _groups(items, item_id, item_text, threshold, least_words):
        found = found.union(source.mapInArrow(_searched(spark.sparkContext.broadcast(group), question, answer), PAIRS))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", F.negative("passage").alias("back"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap", F.negative("best.back").alias("passage"))


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, question: float = 0.5, answer: float = 0.5, least_words: int = 8) -> DataFrame:
    """The rows of docs whose texts hold none of the items, by the rules of contaminated().

    Each row is judged by its own text, so null or equal ids, repeated rows and columns of any names stay as they are; null and empty texts stay.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for group in _groups(items, item_id, item_text, threshold, least_words):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(group), docs.columns.index(text_col), question, answer), schema)
    return docs


def _clean(held, at: int, question: float, answer: float):
    """The rows whose texts, in the column at a place, hold no item."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 1 << 20, at):
                stay = np.ones(b.num_rows, bool)
                stay[[x[0] for x in _held(held.value, b.column(at), question, answer)]] = False
                yield b.filter(pa.array(stay))
        trim()

    return of


def _group(stream: Iterator) -> list[Item]:
    out, size = [], 0
    for id, text, words, df in islice(stream, INDEX_ITEMS):
        out.append(Item(id, text, words, df))
        size += len(text)
        if size > INDEX_BYTES:
            break
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
