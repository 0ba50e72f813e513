"""Token ids of whole texts through the tokenizers library, one look-up for each repeated word."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: When a worker knows more words than these, it keeps those it has met in at least two slices of text.
KNOWN = 400_000
#: Words that are encoded as one text; ids of a tail at most; tails that a worker tells apart.
JOINED, TAIL, TAILS = 512, 4, 4096
#: Latin-1 letters, then ASCII punctuation: a piece of letters and, if there is any, one of the rest.
_PLAIN = r"^(?P<core>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


LOW = (1 << 32) - 1


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _found(words: pa.Array, among: pa.Array, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each word, and which words are not among those that have one."""
    at = pc.index_in(words, value_set=among)
    new = at.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros(len(words), np.int64)
    out[~new] = values[at.drop_null().to_numpy()]
    return out, new


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space and lowers case, so that a text's ids are those of its words in a row.

    No piece of such a tokenizer spans ASCII white space, and its splitting pattern keeps letters, digits and other characters apart. So words of Latin-1 letters are looked up
    lowered, and ASCII punctuation after them (tails) apart from them; any other word, such as one that holds the text of a special token, goes through the tokenizer as it is.
    This holds for tokenizers that split like word_bpe_49k.json; `check` compares it with whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lowered words of one piece: nothing is left to normalise, and white space is all that parts them
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.tails: dict[str, int] = {"": 0}
        self.tail_ids, self.tail_sizes = np.zeros((1, TAIL), np.uint32), np.zeros(1, np.int32)
        # known words with core + (tail << 32); lowered words with their cores
        self.known, self.codes = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.lowered, self.cores = pa.array([], pa.string()), np.zeros(0, np.int64)
        # the first core stands for the end of a text; after the last one there are spare ids
        self.first, self.sizes, self.ids = np.zeros(1, np.int32), np.ones(1, np.int32), np.zeros(1 + TAIL, np.uint32)
        self.met = np.zeros(1, np.int32)

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        """The encoder of this process, kept between tasks."""
        return kept(("encoder", path), lambda: cls(path))

    def _forget(self) -> None:
        """Keeps the cores that at least two slices had, if they are not too many themselves."""
        stay = self.met >= 2
        stay[0] = True
        if stay.sum() > KNOWN // 2:
            stay[1:] = False
        place = np.cumsum(stay) - 1
        at = np.flatnonzero(stay)
        n = self.sizes[at]
        first = (np.cumsum(n) - n).astype(np.int32)
        self.ids = np.append(self.ids[np.arange(int(n.sum())) + np.repeat(self.first[at] - first, n)], self.ids[-TAIL:])
        self.first, self.sizes, self.met = first, n, np.zeros(len(at), np.int32)
        mine = self.codes & LOW
        self.known, self.codes = self.known.filter(pa.array(stay[mine])), (place[mine] + (self.codes >> 32 << 32))[stay[mine]]
        self.lowered, self.cores = self.lowered.filter(pa.array(stay[self.cores])), place[self.cores][stay[self.cores]]

    def _tail(self, text: str) -> int:
        """The number of a tail, or -1 if it is too long to be one."""
        t = self.tails.get(text)
        if t is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(ids) > TAIL or len(self.tails) >= TAILS:
                return -1
            t = self.tails[text] = len(self.tails)
            self.tail_ids = np.concatenate([self.tail_ids, np.array([ids + [0] * (TAIL - len(ids))], np.uint32)])
            self.tail_sizes = np.append(self.tail_sizes, np.int32(len(ids)))
        return t

    def _learn(self, new: pa.Array) -> np.ndarray:
        """The codes of new words, which are known from now on."""
        found = pc.extract_regex(new, _PLAIN)
        fit = found.is_valid().to_numpy(zero_copy_only=False)
        core, tail = (pc.struct_field(found.filter(pa.array(fit)), i).dictionary_encode() for i in (0, 1))
        tails = np.array([self._tail(t) for t in tail.dictionary.to_pylist()], np.int64)[tail.indices.to_numpy()]
        lowered = pc.utf8_lower(core.dictionary).dictionary_encode()
        number, fresh = _found(lowered.dictionary, self.lowered, self.cores)
        at = len(self.sizes)
        plain = lowered.dictionary.filter(pa.array(fresh))
        number[fresh] = np.arange(at, at + len(plain))
        self.lowered, self.cores = pa.concat_arrays([self.lowered, plain]), np.concatenate([self.cores, number[fresh]])
        number = number[lowered.indices.to_numpy()][core.indices.to_numpy()]
        fine = tails >= 0
        fit[np.flatnonzero(fit)[~fine]] = False
        other = new.filter(pa.array(~fit)).to_pylist()
        codes = np.empty(len(new), np.int64)
        codes[fit] = number[fine] + (tails[fine] << 32)
        codes[~fit] = np.arange(len(other)) + at + len(plain)
        self.known, self.codes = pa.concat_arrays([self.known, new]), np.concatenate([self.codes, codes])
        cuts = np.append(np.arange(0, len(plain), JOINED), len(plain))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), plain), " ").to_pylist() if len(plain) else []
        ids, sizes = [], []
        for i, e in enumerate(self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            n = np.diff(np.flatnonzero(self.closing[got]), prepend=-1)
            some = plain[i * JOINED : (i + 1) * JOINED]
            if len(n) != len(some) or n.sum() != len(got):  # a word is not one piece here
                got, n = self._each(some.to_pylist())
            ids.append(got)
            sizes.append(n)
        for i in range(0, len(other), JOINED):
            got, n = self._each(other[i : i + JOINED])
            ids.append(got)
            sizes.append(n)
        n = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.first = np.concatenate([self.first, (len(self.ids) - TAIL + np.cumsum(n) - n).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, n.astype(np.int32)])
        self.ids = np.concatenate([self.ids[:-TAIL], *ids, self.ids[-TAIL:]])
        self.met = np.concatenate([self.met, np.zeros(len(n), np.int32)])
        return codes

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words through the tokenizer as it is, and how many each has."""
        each = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([x for y in each for x in y], np.uint32), np.array(list(map(len, each)), np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text, end_id at the end of each if it is given; a null is empty."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = split.flatten().dictionary_encode()
        which = flat.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > KNOWN:
            self._forget()
        code, new = _found(flat.dictionary, self.known, self.codes)
        if new.any():
            code[new] = self._learn(flat.dictionary.filter(pa.array(new)))
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        if end_id is not None:
            self.ids[0] = end_id
            place = np.cumsum(per_text + 1) - 1
            whole = np.empty(len(which) + len(place), which.dtype)
            inner = np.ones(len(whole), bool)
            inner[place] = False
            whole[inner], whole[place] = which, len(code)
            which, per_text, code = whole, per_text + 1, np.append(code, 0)
        core, tail = code & LOW, code >> 32
        self.met[core] += 1  # once for each core of the slice
        n = (self.sizes[core] + self.tail_sizes[tail])[which]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int32 if total < 1 << 30 else np.int64)
        at += np.repeat((self.first[core][which] - (ends - n)).astype(at.dtype), n)
        ids = self.ids[at]
        tail = tail[which]
        last = np.flatnonzero(tail)
        tail, stop = tail[last], ends[last]
        size = self.tail_sizes[tail]
        for k in range(int(size.max(initial=0))):
            long = size > k
            ids[stop[long] - size[long] + k] = self.tail_ids[tail[long], k]
        so_far = np.concatenate([[0], ends])
        return ids, np.diff(so_far[np.concatenate([[0], np.cumsum(per_text)])])


def check(path: str, texts: list[str], end_id: int | None = None) -> bool:
    """Whether whole texts get the same ids as from the tokenizer itself."""
    e = WordEncoder(path)
    ids, n = e.encode(pa.array(texts, pa.string()), end_id)
    got = np.split(ids, np.cumsum(n)[:-1])
    end = [] if end_id is None else [end_id]
    return all(g.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids + end for g, t in zip(got, texts, strict=True))
