"""Substring dedup by difference-cover anchors: windows of words that occur more than once in the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import parts_for, text_bytes
from .hashing import BYTES, OTHER, WORDS, utf8, words

#: Any two residues modulo 21 differ by the difference of two of these: two equal windows share an anchor at the same offset below 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>"


class _Words:
    """The words of a chunk's documents one after another, with hashes of any run of them."""

    def __init__(self, packed: pa.Table):
        self.ids, text = C.documents(packed)
        self.n_docs = len(self.ids)
        self.words, self.doc = words(text)
        data, o = utf8(self.words)
        self.h = BYTES.spans(data, o[:-1], o[1:])
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.doc)) - self.first[self.doc]  # of each word in its document
        self.left = self.counts[self.doc] - self.place  # words from this one to the end

    def runs(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the n words from each position."""
        return WORDS.spans(self.h, at, at + n), OTHER.spans(self.h, at, at + n)

    def anchors(self, window: int) -> np.ndarray:
        size = window - PERIOD + 1
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        return np.flatnonzero(cover[self.place % PERIOD] & (self.left >= size) & (self.counts[self.doc] >= window))

    def windows(self, shared: np.ndarray, window: int) -> np.ndarray:
        """Starts of the windows that hold one of these anchors at an offset below the period."""
        held = np.zeros(len(self.doc) + PERIOD + 1, np.int32)
        held[shared + 1] = 1
        held = np.cumsum(held)
        starts = np.flatnonzero(self.left >= window)
        return starts[held[starts + PERIOD] > held[starts]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Removes every word that lies in a window of `window` words whose word sequence also starts anywhere else.

    Words are runs of anything but ASCII white space; a window lies in one document; all windows are judged on the input.
    Per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space) and spans (removed word ranges).
    A null text has no words; a null id stays null; rows with equal ids are documents of their own; other columns are ignored.

    A window of 35 holds, at an offset below 21, an anchor of 15 words at a position of the difference cover modulo 21, and
    two equal windows hold it at the same offset whatever their positions are. So only 5 of 21 positions are hashed for the first search;
    the windows around anchors that occur twice are then compared themselves, as runs of all their words.
    """
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    n = parts_for(text_bytes(docs, text_col), C.CHUNK_BYTES, 24)
    packed, buckets = C.chunked(docs, id_col, text_col, n), C.Buckets(n)
    size = window - PERIOD + 1

    def anchors(w: _Words) -> tuple[np.ndarray, C.KeySet]:
        at = w.anchors(window)
        a, b = w.runs(at, size)
        return at, C.KeySet(a, b, buckets)

    def shared_windows(w: _Words, at: np.ndarray, keys: C.KeySet, got: list) -> tuple[np.ndarray, C.KeySet]:
        again = keys.answers(got) | (keys.times > 1)
        starts = w.windows(at[again[keys.group]], window)
        a, b = w.runs(starts, window)
        return starts, C.KeySet(a, b, buckets)

    def first(chunk: int, t: pa.Table) -> list[tuple]:
        return anchors(_Words(t))[1].rows(chunk, C.OTHER)

    def second(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        w = _Words(t)
        at, keys = anchors(w)
        starts, found = shared_windows(w, at, keys, got.get(C.OTHER, []))
        return C.key_table([*found.rows(chunk, C.OTHER), C.passed(chunk, C.pressed(starts.astype(np.uint32)))])

    def last(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        w = _Words(t)
        starts = C.unpressed(got[C.PASS][0][1], np.uint32).astype(np.int64)
        a, b = w.runs(starts, window)
        keys = C.KeySet(a, b, buckets)
        hit = starts[(keys.answers(got.get(C.OTHER, [])) | (keys.times > 1))[keys.group]]
        edge = np.zeros(len(w.doc) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        keep = ~gone
        offsets = np.concatenate([[0], np.cumsum(np.bincount(w.doc[keep], minlength=w.n_docs))])
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), w.words.filter(pa.array(keep))), " ")
        # a run of removed words begins where the word before is kept or belongs to another document
        begin = np.flatnonzero(gone & ~((np.roll(gone, 1)) & (w.place > 0)))
        end = np.flatnonzero(gone & ~((np.roll(gone, -1)) & (w.left > 1))) + 1
        per = np.concatenate([[0], np.cumsum(np.bincount(w.doc[begin], minlength=w.n_docs))])
        base = w.first[w.doc[begin]]
        spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]))
        return pa.table([w.ids.cast(pa.int64()), pa.array(w.counts, pa.int64()), pa.array(np.bincount(w.doc[gone], minlength=w.n_docs), pa.int64()), kept, spans], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    one = C.answered(C.emitted(packed, first), buckets)
    two = C.answered(C.with_answers(packed, one, second, C.KEYS), buckets)
    return C.with_answers(packed, two, last, OUT)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("bigint").alias("n_spans"))


#: The same with every window compared to every other by grouping.
OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w),
s AS (SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS window_text FROM p),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY window_text) AS n FROM s) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM hit, (SELECT unnest(range(35)) AS k) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed, words, coalesce(places, []) AS places FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id),
one AS (SELECT doc_id, n_words, n_removed, words, unnest(range(1, n_words + 1)) AS i, places FROM kept WHERE n_removed > 0),
rest AS (SELECT o.doc_id, string_agg(o.words[o.i], ' ' ORDER BY o.i) AS kept FROM one o LEFT JOIN (SELECT doc_id, unnest(places) AS i FROM gone) g ON o.doc_id = g.doc_id AND o.i = g.i WHERE g.i IS NULL GROUP BY o.doc_id),
spans AS (SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT doc_id, unnest(places) AS i FROM gone)) WHERE b IS NULL OR b < i - 1 GROUP BY doc_id)
SELECT k.doc_id, k.n_words, CAST(k.n_removed AS BIGINT) AS n_removed,
       sha256(CASE WHEN k.n_removed = 0 THEN array_to_string(k.words, ' ') ELSE coalesce(r.kept, '') END) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM kept k LEFT JOIN rest r ON k.doc_id = r.doc_id LEFT JOIN spans s ON k.doc_id = s.doc_id
"""
