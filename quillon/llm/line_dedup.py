"""Line dedup by a segment-partition edit join: lines that an earlier line equals but for a few edits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import parts_for, text_bytes
from .hashing import BYTES, OTHER, U, mix, utf8

#: Lines of a key that one task compares with one another; more are compared block by block.
CELL = 1024
OUT = "doc_id bigint, n_lines bigint, n_removed bigint, text string"
PARTS = "bucket bigint, chunk bigint, data binary, text binary, size array<int>, line array<int>, doc array<bigint>, group array<bigint>, at array<int>, side array<int>"
FOUND = "chunk bigint, bucket bigint, kind int, bits binary"


def segments(length: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the i-th of edits + 1 even segments of lines of these lengths; the last ones are the longer ones."""
    n = edits + 1
    base, extra = length // n, length % n
    longer = np.maximum(0, i - (n - extra))
    return i * base + longer, base + (i >= n - extra)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift): where a line holds, unchanged, a segment of a line that is as much shorter and within the edits.

    The shifts are those that an alignment can have if the segments before and those after the one in question share out the edits.
    """
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                if (d, shift) != (0, 0):
                    out.append((d, i, shift))
    return out


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether two strings are at most `edits` edits apart: what is left without common ends, by bit-parallel columns of a band around the diagonal."""
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    same = x[:n] == y[:n]
    lo = n if same.all() else int(np.argmin(same))
    same = x[len(a) - (n - lo) :][::-1] == y[len(b) - (n - lo) :][::-1]
    hi = n - lo if same.all() else int(np.argmin(same))
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) <= edits
    # bit k of the band at row j stands for column j - edits + k; reach[e]: cells that e edits reach
    width = 2 * edits + 1
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    valid = lambda j: full & ((((1 << (len(a) + 1)) - 1) << edits >> j) if j <= len(a) + edits else 0)  # noqa: E731  columns 0 to len(a)
    reach = []
    for e in range(edits + 1):
        reach.append(sum(1 << (edits + k) for k in range(e + 1)) & valid(0))
    for j, c in enumerate(b, 1):
        match = places.get(c, 0) << (edits + 1) >> j  # bit k: column j - edits + k ends with c
        ok, new = valid(j), []
        for e in range(edits + 1):
            r = reach[e] & match
            if e:
                r |= reach[e - 1] | reach[e - 1] >> 1  # substitution keeps the diagonal, insertion moves left
                r |= new[e - 1] << 1  # deletion
            r &= ok
            new.append(r & full)
        reach = new
        if not reach[-1]:
            return False
    at = len(a) - len(b) + edits
    return at >= 0 and bool(reach[-1] >> at & 1)


class _Lines:
    """The lines of a chunk's documents, white space at their ends aside, in ascending order of (document, line)."""

    def __init__(self, packed: pa.Table, exact: int):
        self.table = C.rows_of(packed)
        self.row_ids, self.text = (self.table.column(i).combine_chunks() for i in (0, 1))
        self.ids = C.ids_of(self.row_ids)
        split = pc.split_pattern(self.text.fill_null(""), "\n")
        self.lines, self.count = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.data, self.o = utf8(pc.utf8_trim_whitespace(self.lines))
        self.size = np.diff(self.o)
        self.full = np.flatnonzero(self.size >= exact)

    def whole(self, buckets: C.Buckets) -> C.KeySet:
        """Lines of the exact pass as keys, owned by the first of them here."""
        s, e = self.o[self.full], self.o[self.full + 1]
        return C.KeySet(BYTES.spans(self.data, s, e), OTHER.spans(self.data, s, e), buckets, self.full)

    def firsts(self, got: list, keys: C.KeySet) -> np.ndarray:
        """The lines of the exact pass that no earlier line equals, here or elsewhere."""
        return np.sort(keys.owner[~keys.answers(got)])

    def parts(self, lines: np.ndarray, edits: int, buckets: C.Buckets) -> tuple[np.ndarray, np.ndarray, C.KeySet]:
        """(line, whether the key is an index entry, keys): each line's own segments, and the substrings where it may hold those of others."""
        size, begin = self.size[lines], self.o[lines]
        at, s, e, tag, own = [], [], [], [], []
        for d, i, shift, mine in [*((0, i, 0, True) for i in range(edits + 1)), *((*p, False) for p in probes(edits))]:
            start, n = segments(size - d, edits, i)
            start = start + shift
            fits = (start >= 0) & (start + n <= size) & (n > 0)
            at.append(lines[fits])
            s.append((begin + start)[fits])
            e.append((begin + start + n)[fits])
            tag.append(((size - d) * (edits + 1) + i)[fits].astype(U))
            own.append(np.full(int(fits.sum()), mine))
        at, s, e, tag, own = map(np.concatenate, (at, s, e, tag, own))
        h = mix(BYTES.spans(self.data, s, e) + tag * U(0x9E3779B97F4A7C15))
        keys = C.KeySet(h, h ^ U(0x5555), buckets)
        keys.count_owners(at)
        return at, own, keys


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, least: int = 24, keep: tuple[str, ...] = (), exact: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, text and the columns to keep, text without the lines that an earlier line is at most `edits` edits away from.

    Lines end at "\\n"; white space at the ends of a line is no part of the comparison; edits are of UTF-8 bytes. Earlier: of a smaller document id (null is the smallest; rows with
    equal ids in an order that their contents fix), or before it in the same document. An earlier line counts even if it goes itself. Lines shorter than `least` bytes go
    only if an earlier line equals them, and stay if they are shorter than `exact` bytes (`least`, if None) or blank; so does what is between other lines. A null text stays null, with no lines; repeated rows lose what they repeat.

    Equal lines are settled by their keys alone. Of what is left, a line's edits + 1 segments are index entries, and a line probes for the segments of lines of its
    length or up to `edits` shorter; of two lines within the edits one holds a segment of the other at one of the places probed. Lines that share no key with another line drop out. The others
    go to the buckets of their shared keys and are compared there. A key that more than CELL lines share is dealt into cells: every two blocks of its lines meet in one.
    """
    exact = least if exact is None else max(1, exact)
    n = parts_for(text_bytes(docs, text_col), C.CHUNK_BYTES, 24)
    packed, buckets = C.chunked(docs, id_col, text_col, n, keep), C.Buckets(n)

    def first(chunk: int, t: pa.Table) -> list[tuple]:
        b = _Lines(t, exact)
        return b.whole(buckets).rows(chunk, C.SMALLER, b.ids[b.doc], chunk)

    def second(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        b = _Lines(t, exact)
        lines = b.firsts(got.get(C.SMALLER, []), b.whole(buckets))
        _, _, keys = b.parts(lines[b.size[lines] >= least], edits, buckets)
        return C.key_table([*keys.rows(chunk, C.TIMES), C.passed(chunk, C.pressed(lines.astype(np.uint32)))])

    def third(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        b = _Lines(t, exact)
        lines = C.unpressed(got[C.PASS][0][1], np.uint32).astype(np.int64)
        line, own, keys = b.parts(lines[b.size[lines] >= least], edits, buckets)
        total = keys.totals(got.get(C.TIMES, []))[keys.group]
        key = keys.keys[keys.group]
        shared = total > 1
        line, own, key, total = line[shared], own[shared], key[shared], total[shared]
        blocks = -(-total // CELL)
        mine = (mix(line.astype(U) + U((chunk + 1) * 0x9E3779B97F4A7C15 % 2**64)) % blocks.astype(U)).astype(np.int64)
        which = np.repeat(np.arange(len(line)), blocks)
        other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low, high = np.minimum(mine[which], other), np.maximum(mine[which], other)
        group = mix(key[which] + low.astype(U) * U(0xD6E8FEB86659FD93) + high.astype(U) * U(0xC2B2AE3D27D4EB4F))
        side = np.where(low == high, 2, mine[which] == low) + 4 * own[which]  # two blocks of a cell are compared across only
        bucket = (group % U(n)).astype(np.int64)
        # a bucket gets each of its lines once, whatever keys it has
        many = len(b.doc) + 1
        used, at = np.unique(bucket * many + line[which], return_inverse=True)
        there = np.unique(bucket)
        base = np.searchsorted(used, np.append(there, n) * many)
        at = at - base[np.searchsorted(there, bucket)]
        order = np.argsort(bucket, kind="stable")
        entries, used = np.searchsorted(bucket[order], np.append(there, n)), used % many
        size = b.size[used]
        ends = np.cumsum(size)
        text = b.data[np.arange(int(size.sum())) + np.repeat(b.o[used] - (ends - size), size)]
        lists = lambda values, cuts, kind: pa.ListArray.from_arrays(pa.array(np.append(cuts, cuts[-1:]), pa.int32()), pa.array(values, kind))  # noqa: E731  the last row has none
        cuts = np.concatenate([[0], ends])[np.append(base, base[-1:])].astype(np.int32)
        columns = [
            pa.array(np.append(there, -1 - chunk)), pa.array(np.full(len(there) + 1, chunk)), pa.array([None] * len(there) + [C.pressed(lines.astype(np.uint32))], pa.binary()),
            pa.BinaryArray.from_buffers(pa.binary(), len(there) + 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(text.tobytes())]),
            lists(size, base, pa.int32()), lists(used, base, pa.int32()), lists(b.ids[b.doc[used]], base, pa.int64()), lists(group[order].view(np.int64), entries, pa.int64()), lists(at[order], entries, pa.int32()), lists(side[order], entries, pa.int32()),
        ]
        return pa.table(columns, names=["bucket", "chunk", "data", "text", "size", "line", "doc", "group", "at", "side"])

    def last(chunk: int, t: pa.Table, got: dict) -> pa.Table:
        b = _Lines(t, exact)
        stay = np.ones(len(b.doc), bool)
        stay[b.full] = False
        stay[C.unpressed(got[C.PASS][0][1], np.uint32)] = True
        for _, x in got.get(C.OTHER, []):
            stay[C.unpressed(x, np.uint32)] = False
        left = np.bincount(b.doc[stay], minlength=len(b.count))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), b.lines.filter(pa.array(stay))), "\n")
        texts = pc.if_else(pa.array(left == b.count), b.text, joined)
        there = b.text.is_valid().to_numpy(zero_copy_only=False)
        return pa.table([b.row_ids.cast(pa.int64()), pa.array(b.count * there, pa.int64()), pa.array((b.count - left) * there, pa.int64()), texts, *b.table.columns[2:]], names=["doc_id", "n_lines", "n_removed", "text", *keep])

    one = C.answered(C.emitted(packed, first), buckets)
    two = C.answered(C.with_answers(packed, one, second, C.KEYS), buckets)
    three = C.with_answers(packed, two, third, PARTS)
    four = three.groupBy("bucket").applyInArrow(lambda t: _compared(t, edits), FOUND)
    kept = [f", `{f.name}` {f.dataType.simpleString()}" for c in keep for f in docs.schema if f.name == c]
    return C.with_answers(packed, four, last, OUT + "".join(kept))


def _compared(table: pa.Table, edits: int) -> pa.Table:
    """Of the lines of a bucket those that an earlier one is within the edits of, for each chunk."""
    table = table.combine_chunks()
    out = [(r["chunk"], r["bucket"], C.PASS, r["data"]) for r in table.select(["chunk", "bucket", "data"]).filter(pc.less(table.column("bucket"), 0)).to_pylist()]
    table = table.filter(pc.greater_equal(table.column("bucket"), 0)).combine_chunks()
    if table.num_rows:

        def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
            column = table.column(name).combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)

        (lines, held), (docs, _), (size, _), (group, entries), (at, _), (side, _) = map(flat, ("line", "doc", "size", "group", "at", "side"))
        chunks, so_far = np.repeat(table.column("chunk").to_numpy(), held), len(lines)
        at, own, side = at + np.repeat(np.cumsum(held) - held, entries), side >= 4, side & 3
        text, begin_of = b"".join(table.column("text").to_pylist()), np.concatenate([[0], np.cumsum(size)]).tolist()
        rank = np.empty(so_far, np.int64)  # equal ids go by chunk, and in a chunk by line
        rank[np.lexsort((lines, chunks, docs))] = np.arange(so_far)
        order = np.lexsort((rank[at], group))
        group, at, side, own = group[order], at[order], side[order], own[order]
        begin = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        length, size = size.astype(np.int64), np.diff(np.append(begin, len(group)))
        run = np.repeat(np.arange(len(begin)), size)
        gone = np.zeros(so_far, bool)

        def settle(x: np.ndarray, y: np.ndarray) -> None:
            """Marks the later of each pair of entries that are within the edits, once for each two lines."""
            fit = (at[x] != at[y]) & (own[x] | own[y]) & ((side[x] == 2) | (side[x] != side[y])) & (np.abs(length[at[x]] - length[at[y]]) <= edits) & ~gone[at[y]]
            pair = np.unique(at[x][fit] * so_far + at[y][fit])
            for p, q in zip((pair // so_far).tolist(), (pair % so_far).tolist(), strict=True):
                if not gone[q] and within(text[begin_of[p] : begin_of[p + 1]], text[begin_of[q] : begin_of[q + 1]], edits):
                    gone[q] = True

        pairs = [np.zeros((2, 0), np.int64)]
        few = np.repeat(size <= 8, size)
        for d in range(1, 8):
            if len(group) > d:
                i = np.flatnonzero(few[:-d] & (run[d:] == run[:-d]))
                pairs.append(np.stack([i, i + d]))
        settle(*np.concatenate(pairs, axis=1))
        for lo, n in zip(begin[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            for i in range(lo, lo + n - 1):  # the earliest first: it settles most of a family
                rest = np.arange(i + 1, lo + n)
                rest = rest[~gone[at[rest]]]
                if not len(rest):
                    break
                settle(np.full(len(rest), i), rest)
        for chunk in np.unique(chunks[gone]).tolist():
            out.append((chunk, int(table.column("bucket")[0].as_py()), C.OTHER, C.pressed(lines[gone & (chunks == chunk)].astype(np.uint32))))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["chunk", "bucket", "kind", "bits"])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), exact=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: White space as Unicode has it.
_BLANK = " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())
#: The same with segments and shifted substrings as rows of a join, and edit distances of bytes.
OP10_SQL = f"""
WITH line AS (SELECT doc_id, n, raw, trim(raw, {_BLANK}) AS s FROM (
  SELECT doc_id, unnest(range(len(lines))) AS n, unnest(lines) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, n) AS copy FROM line),
whole AS (SELECT *, hex(encode(s)) AS h, strlen(s) AS size, row_number() OVER (ORDER BY doc_id, n) AS place FROM ranked WHERE copy = 1 AND strlen(s) >= 24),
cut AS (SELECT *, size // 3 * i + greatest(0, i - (3 - size % 3)) AS start, size // 3 + CASE WHEN i >= 3 - size % 3 THEN 1 ELSE 0 END AS n_bytes FROM (SELECT *, unnest(range(3)) AS i FROM whole)),
entry AS (SELECT place, size, i, substring(h, 2 * start + 1, 2 * n_bytes) AS seg FROM cut),
shorter AS (SELECT *, size - d AS least FROM (SELECT *, unnest(range(3)) AS d FROM whole)),
aim AS (SELECT *, least // 3 * i + greatest(0, i - (3 - least % 3)) + shift AS start, least // 3 + CASE WHEN i >= 3 - least % 3 THEN 1 ELSE 0 END AS n_bytes
  FROM (SELECT *, unnest(range(-2, 3)) AS shift FROM (SELECT *, unnest(range(3)) AS i FROM shorter))),
probe AS (SELECT place, least, i, substring(h, 2 * start + 1, 2 * n_bytes) AS seg FROM aim WHERE start >= 0 AND start + n_bytes <= size),
pair AS (SELECT DISTINCT e.place AS a, p.place AS b FROM entry e JOIN probe p ON e.size = p.least AND e.i = p.i AND e.seg = p.seg WHERE e.place <> p.place),
near AS (SELECT DISTINCT greatest(a, b) AS place FROM pair JOIN whole x ON x.place = a JOIN whole y ON y.place = b WHERE levenshtein(x.s, y.s) <= 2),
gone AS (SELECT doc_id, n FROM whole JOIN near USING (place) UNION ALL SELECT doc_id, n FROM ranked WHERE copy > 1 AND s <> ''),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed, string_agg(l.raw, chr(10) ORDER BY l.n) FILTER (WHERE g.doc_id IS NULL) AS k FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k, '')) END AS kept_sha256 FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
