"""Language ID by hyperdimensional profiles: bundles of bound, permuted letter vectors compared by cosine."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ship, trim
from .simhash_dedup import _slices, with_columns

DIMENSION = 1024
UNKNOWN = "und"
#: Bytes of text whose trigrams are counted together, and texts and trigrams whose vectors are made at a time.
SLICE, ROWS, STEP = 1 << 19, 256, 2048
#: Languages that a task sums up before it passes the sums on.
LANGUAGES = 64


def _folded() -> np.ndarray:
    """For every code point that of its letter in lower case, 0 for anything but letters. Kept by the worker."""
    held = vars(sys).setdefault("_quillon_letters", {})
    if "table" not in held:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                table[c] = ord(x.lower()[0])
        held["table"] = table
    return held["table"]


def letter_vectors(letters: np.ndarray, dimension: int = DIMENSION, seed: int = 7) -> np.ndarray:
    """A random vector of -1 and 1 for each letter, the same one wherever it is made; 0 stands for what parts words."""
    held = vars(sys).setdefault("_quillon_vectors", {})
    if len(held) > 20_000:
        held.clear()
    out = []
    for x in letters.tolist():
        if (x, dimension, seed) not in held:
            held[x, dimension, seed] = np.random.default_rng([seed, x]).integers(0, 2, dimension, dtype=np.int8) * 2 - 1
        out.append(held[x, dimension, seed])
    return np.array(out, np.int8).reshape(-1, dimension)


class Trigrams:
    """The letter trigrams of some texts: those around each letter, with its neighbours, where a run of other characters counts as one.

    letters: the alphabet of the texts. codes: their different trigrams, as three places in the alphabet. row, code, count: how often each text has each, sorted by row.
    n_letters: of each text.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        points = np.frombuffer(("\n".join(texts.to_pylist()) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol, row = _folded()[points], np.repeat(np.arange(len(n)), n)
        self.n_letters = np.bincount(row[symbol > 0], minlength=len(n))
        keep = (symbol > 0) | np.concatenate([[True], symbol[:-1] > 0])
        symbol, row = np.concatenate([np.zeros(1, np.uint32), symbol[keep]]), row[keep]
        there = np.zeros(0x110000, bool)
        there[symbol] = True
        self.letters = np.flatnonzero(there)
        place = np.zeros(0x110000, np.int64)
        place[self.letters] = np.arange(len(self.letters))
        s, size = place[symbol], len(self.letters)
        code = (s[:-2] * size + s[1:-1]) * size + s[2:]
        middle = symbol[1:-1] > 0
        code, row = code[middle], row[: len(code)][middle]
        # texts of a slice have few different letters, so that trigrams are few too: they are told apart by a table, or else by sorting
        if size**3 <= 1 << 24:
            there = np.zeros(size**3, bool)
            there[code] = True
            self.codes = np.flatnonzero(there)
            number = np.zeros(size**3, np.int32)
            number[self.codes] = np.arange(len(self.codes))
            code = number[code]
        else:
            self.codes, code = np.unique(code, return_inverse=True)
        both, self.count = np.unique(row * max(1, len(self.codes)) + code, return_counts=True)
        self.row, self.code = both // max(1, len(self.codes)), both % max(1, len(self.codes))

    def vectors(self, codes: np.ndarray, dimension: int) -> np.ndarray:
        """Vectors of some of the codes: letter vectors rotated by their distance to the end of the trigram and multiplied."""
        letter, size, x = letter_vectors(self.letters, dimension), len(self.letters), self.codes[codes]
        return np.roll(letter, 2, axis=1)[x // size**2] * np.roll(letter, 1, axis=1)[x // size % size] * letter[x % size]

    def bundles(self, group: np.ndarray, n: int, dimension: int) -> np.ndarray:
        """Sums of the vectors of the trigrams of each group, as often as they occur; group: of each (row, code)."""
        out = np.zeros((n, dimension), np.float64)
        used, code = np.unique(self.code, return_inverse=True)
        for lo in range(0, len(used), STEP):
            part = (code >= lo) & (code < lo + STEP)
            count = np.zeros((n, min(STEP, len(used) - lo)), np.float32)
            np.add.at(count, (group[part], code[part] - lo), self.count[part])
            out += count @ self.vectors(used[lo : lo + STEP], dimension).astype(np.float32)
        return out

    def documents(self, dimension: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, vectors of ROWS texts): the bundle of each text's trigrams."""
        for lo in range(0, len(self.n_letters), ROWS):
            hi = min(lo + ROWS, len(self.n_letters))
            a, b = np.searchsorted(self.row, [lo, hi])
            used, code = np.unique(self.code[a:b], return_inverse=True)
            out = np.zeros((hi - lo, dimension), np.float32)
            for k in range(0, len(used), STEP):
                part = (code >= k) & (code < k + STEP)
                count = np.zeros((hi - lo, min(STEP, len(used) - k)), np.float32)
                count[self.row[a:b][part] - lo, code[part] - k] = self.count[a:b][part]
                out += count @ self.vectors(used[k : k + STEP], dimension).astype(np.float32)
            yield lo, out


class Profiles:
    """Language prototypes: the bundles of the vectors of all trigrams of a language's texts, scaled to length 1."""

    def __init__(self, bundles: dict[str, np.ndarray], dimension: int = DIMENSION):
        self.languages, self.dimension = sorted(bundles), dimension
        held = np.array([bundles[x] for x in self.languages], np.float64).reshape(-1, dimension)
        self.prototypes = (held / np.maximum(np.linalg.norm(held, axis=1), 1e-30)[:, None]).T.astype(np.float32)

    def cosines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The cosine of each text's vector with each prototype, and the number of letters of each text."""
        t = Trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for lo, v in t.documents(self.dimension):
            out[lo : lo + len(v)] = (v @ self.prototypes) / np.maximum(np.linalg.norm(v, axis=1), 1e-30)[:, None]
        return out, t.n_letters

    def labels(self, texts: pa.Array) -> list[pa.Array]:
        """The language and the score of each text."""
        if not self.languages:
            return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
        cosine, letters = self.cosines(texts)
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1) * (letters > 0)
        name = pc.if_else(pa.array(letters > 0), pa.array(self.languages).take(pa.array(best)), UNKNOWN)
        return [name, pa.array(score)]


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION) -> Profiles:
    """Profiles from all rows with a language and a text; none from no rows. What reaches the driver is `dimension` sums for each different language, 8 KB by default."""
    ship(rows.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            names = pa.array([x for x in sums for _ in range(dimension)], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(dimension, dtype=np.int32), len(sums))), pa.array(np.concatenate([np.zeros(0), *sums.values()]))], names=["lang", "place", "total"])

        forget()
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in _slices(whole, SLICE):
                t, lang = Trigrams(b.column(1)), b.column(0).dictionary_encode()
                names, of = lang.dictionary.to_pylist(), lang.indices.to_numpy()[t.row]
                for lo in range(0, len(names), LANGUAGES):
                    part = (of >= lo) & (of < lo + LANGUAGES)
                    some = names[lo : lo + LANGUAGES]
                    for name, x in zip(some, t.bundles(np.where(part, of - lo, len(some)), len(some) + 1, dimension), strict=False):
                        sums[name] = sums.get(name, 0) + x
                    if len(sums) >= LANGUAGES:
                        yield told()
                        sums.clear()
        if sums:
            yield told()
        trim()

    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(bundle, "lang string, place int, total double").groupBy("lang", "place").agg(F.sum("total").alias("total")).toLocalIterator():
        found.setdefault(r.lang, np.zeros(dimension))[r.place] = r.total
    return Profiles(found, dimension)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the cosine of the text's vector with that language's prototype (0 to 1); ties go to the first language by name.

    A text that is null or has no letters is "und" with the score 0, and so is any text if there are no profiles. Columns named lang_pred or score are replaced; all others,
    and repeated rows, stay. A text is read in whole, whatever its length.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # as many numbers for each language as vectors have
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    return with_columns(kept, text_col, lambda x: held.value.labels(x), "lang_pred string, score double", SLICE)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 modulo 4. A null id is not held out, but nothing is learnt from it either."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION) -> DataFrame:
    """doc_id, text, held_out, lang_pred and score for every row of docs, learnt from the rows that aren't held out."""
    profiles = learn(docs.where(~held_out(id_col)), text_col, lang_col, dimension)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return predict(rows, profiles)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
