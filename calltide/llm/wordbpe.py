"""Token ids of a lower-casing word BPE (`word_bpe_49k.json`), computed for a whole batch of texts at once.

The `tokenizers` library spends several microseconds on each token. Here a batch is cut into pre-tokens by array
operations, equal pre-tokens are found by a 64-bit hash, and only pre-tokens not met before by this worker are merged,
all of them together, one merge a word and round. Texts with characters outside `plain` (where normal forms, case or
Unicode versions could differ) go through the library itself, so ids are those of the library for every text. With
``added_tokens``, as operators use it, texts that hold the text of an added token (``<|endoftext|>``) go there too and get
its id, as the unaltered library gives it; without, such a text is one like any other.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from calltide.llm.common import give_back, held
from calltide.llm.textvec import SLICE_CHARS, U64, codepoints, mix, slices, span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Suffixes that the pre-tokeniser splits off after an apostrophe, in the order it tries them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Ranges of code points whose NFC form, case and category are the same everywhere.
PLAIN_RANGES = (
    (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x12F), (0x131, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9),
    (0x410, 0x44F), (0x2010, 0x2027), (0x2030, 0x205E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5),
)
TABLE = 1 << 16


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, lower, plain = np.full(TABLE, OTHER, np.uint8), np.arange(TABLE, dtype=np.uint32), np.zeros(TABLE, bool)
    for a, b in PLAIN_RANGES:
        for c in range(a, b + 1):
            plain[c] = True
            group = unicodedata.category(chr(c))[0]
            kind[c] = LETTER if group == "L" else NUMBER if group == "N" else OTHER
            lower[c] = ord(chr(c).lower())
    for c in (0x09, 0x0A, 0x0D, 0x20):
        plain[c], kind[c] = True, SPACE
    return kind, lower, plain


class _PairTable:
    """(left id, right id) -> (rank, merged id) by two-choice hashing; lookups are array operations."""

    SIZE = 1 << 18

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.keys = left.astype(np.uint64) << U64(32) | right.astype(np.uint64)
        self.merged = merged
        self.seed = 1
        while not self._place():
            self.seed += 1

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + U64(self.seed) * U64(0x9E3779B97F4A7C15))
        mask = U64(self.SIZE - 1)
        return (h & mask).astype(np.int64), (h >> U64(32) & mask).astype(np.int64) + self.SIZE

    def _place(self) -> bool:
        one, two = (x.tolist() for x in self._slots(self.keys))
        owner = [-1] * (2 * self.SIZE)
        for k in range(len(one)):
            at, item = one[k], k
            for _ in range(200):
                owner[at], item = item, owner[at]
                if item < 0:
                    break
                at = two[item] if at == one[item] else one[item]
            else:
                return False
        self.owner = np.array(owner, np.int32)
        self.held = np.where(self.owner >= 0, self.keys[self.owner], U64(0xFFFFFFFFFFFFFFFF))
        return True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        keys = left.astype(np.uint64) << U64(32) | right.astype(np.uint64)
        one, two = self._slots(keys)
        return np.where(self.held[one] == keys, self.owner[one], np.where(self.held[two] == keys, self.owner[two], len(self.keys)))


class WordBPE:
    """ids(texts) -> (all ids as uint32, offsets): the ids the library gives with add_special_tokens=False."""

    def __init__(self, path: str, cache_ids: int = 1_000_000, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added_tokens
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.added = [t["content"].lower() for t in whole.get("added_tokens", [])] if added_tokens else []
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbols, end = _byte_symbols(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in symbols], np.uint32)
        self.final = np.array([vocab[s + end] for s in symbols], np.uint32)
        self.pairs = _PairTable(*(np.array(x, np.uint32) for x in ([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], [vocab[a + b] for a, b in merges])))
        self.kind, self.lower, self.plain = _character_tables()
        self.cache_ids = cache_ids
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, U64)  # sorted hashes of words, with the places of their ids
        self.known_start, self.known_end = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known_ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], []
        for i, j in slices(np.array([len(t) for t in texts], np.int64), SLICE_CHARS):
            made, n = self._slice(texts[i:j])
            parts.append(made)
            counts.append(n)
        offsets = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=offsets[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets = codepoints(texts)
        odd = (codes >= TABLE) | ~self.plain[np.minimum(codes, TABLE - 1)]
        odd_texts = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
        if self.added:
            odd_texts = np.union1d(odd_texts, [k for k, t in enumerate(map(str.lower, texts)) if any(a in t for a in self.added)]).astype(np.int64)
        if len(odd_texts):
            by_library = {int(k): np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32) for k in odd_texts}
            rest = [k for k in range(len(texts)) if k not in by_library]
            made, n = self._slice([texts[k] for k in rest]) if rest else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            bounds = np.concatenate([[0], np.cumsum(n)])
            whole = dict(zip(rest, (made[bounds[k] : bounds[k + 1]] for k in range(len(rest))), strict=True)) | by_library
            return np.concatenate([whole[k] for k in range(len(texts))]), np.array([len(whole[k]) for k in range(len(texts))], np.int64)
        low, starts, ends, first = self._pretokens(codes, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes, first_at, which = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        place = self._places(hashes, low, starts[first_at], ends[first_at])
        begin, size = self.known_start[place], self.known_end[place] - self.known_start[place]
        begin, size = begin[which], size[which]
        total = np.cumsum(size)
        out = self.known_ids[np.arange(total[-1]) + np.repeat(begin - (total - size), size)]
        at = np.concatenate([[0], total])[first]
        return out, np.diff(at)

    def _pretokens(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        low = self.lower[codes]
        kind = self.kind[low]
        start = np.ones(len(kind), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begins = offsets[:-1][np.diff(offsets) > 0]
        start[begins] = True
        marks = np.flatnonzero((low == 0x27) & start)
        if len(marks):
            ends = offsets[np.searchsorted(offsets, marks, side="right")]
            low_padded = np.concatenate([low, np.zeros(3, low.dtype)])
            open_ = np.ones(len(marks), bool)
            for tail in CONTRACTIONS:
                fits = open_ & (marks + len(tail) < ends)
                for k, c in enumerate(tail):
                    fits &= low_padded[marks + 1 + k] == ord(c)
                at = marks[fits]
                open_ &= ~fits
                after = at + 1 + len(tail)
                start[at + 1] = False
                start[after[after < len(start)]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(low)) if len(starts) else starts
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
        return low, starts, ends, np.searchsorted(starts, offsets)

    def _places(self, hashes: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places among the known words of sorted hashes; words not met before are merged."""
        if self.n_ids > self.cache_ids:
            self._forget()
        place = np.searchsorted(self.known, hashes)
        met = place < len(self.known)
        met[met] = self.known[place[met]] == hashes[met]
        new = np.flatnonzero(~met)
        if len(new):
            ids, offsets = self._merge(*self._bytes(low, starts[new], ends[new]))
            while self.n_ids + len(ids) > len(self.known_ids):
                self.known_ids = np.concatenate([self.known_ids, np.zeros_like(self.known_ids)])
            self.known_ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.known_start, self.known_end = np.insert(self.known_start, place[new], self.n_ids + offsets[:-1]), np.insert(self.known_end, place[new], self.n_ids + offsets[1:])
            self.known = np.insert(self.known, place[new], hashes[new])
            self.n_ids += len(ids)
            place = np.searchsorted(self.known, hashes)
        return place

    @staticmethod
    def _bytes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the words, end to end, and offsets."""
        size = ends - starts
        first = np.cumsum(size) - size
        codes = low[np.repeat(starts - first, size) + np.arange(int(size.sum()))]
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800)
        raw = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        return raw, np.concatenate([[0], np.cumsum(np.add.reduceat(width, first))])

    def _merge(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words together: in each round each word makes its best-ranked, leftmost merge."""
        n, none = len(offsets) - 1, len(self.pairs.keys)
        token = self.inner[raw]
        token[offsets[1:] - 1] = self.final[raw[offsets[1:] - 1]]
        word = np.repeat(np.arange(n), np.diff(offsets))
        done_token, done_word = [], []
        rank = np.full(len(token), none, np.int64)
        fresh = np.flatnonzero(word[1:] == word[:-1])
        rank[fresh] = self.pairs.ranks(token[fresh], token[fresh + 1])
        while len(token):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(token)))
            order = rank * (1 << 32) + np.arange(len(rank))
            best = np.minimum.reduceat(order, begin)
            live = best < none * (1 << 32)
            stay = np.repeat(live, size)
            if not live.all():
                done_token.append(token[~stay])
                done_word.append(word[~stay])
            at = best[live] & 0xFFFFFFFF
            token[at] = self.pairs.merged[rank[at]]
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            token, word, rank, at = token[stay], word[stay], rank[stay], moved[at]
            near = np.stack([at - 1, at], axis=1).ravel()
            near = near[near >= 0]
            rank[near] = none
            joined = near[near < len(word) - 1]
            joined = joined[word[joined] == word[joined + 1]]
            rank[joined] = self.pairs.ranks(token[joined], token[joined + 1])
        tokens, words = np.concatenate(done_token), np.concatenate(done_word)
        sort = np.argsort(words, kind="stable")
        return tokens[sort], np.searchsorted(words[sort], np.arange(n + 1))


def word_bpe(path: str) -> WordBPE:
    """The tokenizer of this Python worker; its cache of words lasts from task to task."""

    def load() -> WordBPE:
        loaded = WordBPE(path, added_tokens=True)
        give_back()  # what the file was read into
        return loaded

    return held(f"word_bpe {path}", load)
