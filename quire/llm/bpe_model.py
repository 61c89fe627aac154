"""A byte-pair vocabulary with word ends, its pre-tokens, and rank-synchronous merging on ragged numpy arrays."""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from functools import cached_property

import numpy as np

from .common import MEMO_KEY, forgets

NO_RANK = np.int64(1 << 40)
#: Below this code point the pre-tokeniser is a character-class pattern built from Unicode categories; texts with
#: characters from here on are normalised and split by the library's own components.
PLAIN_BELOW = 0x250
BLANKS = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _plain_pattern() -> re.Pattern:
    kinds: dict[str, list[str]] = {"L": [], "N": [], "S": []}
    for c in map(chr, range(PLAIN_BELOW)):
        kind = unicodedata.category(c)[0]
        if kind in "LN":
            kinds[kind].append(c)
        elif c in "\t\n\x0b\x0c\r \x85\xa0":
            kinds["S"].append(c)
    letters, digits, spaces = (re.escape("".join(kinds[k])) for k in "LNS")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+|\n")


def _beyond_plain() -> re.Pattern:
    """Characters that the class pattern can't be used for, in upper or lower case."""
    grow = "".join(c for c in map(chr, range(PLAIN_BELOW)) if ord(max(c.lower())) >= PLAIN_BELOW)
    return re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}]|[{re.escape(grow)}]")


class BpeModel:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("expected a BPE vocabulary with word ends")
        self.path = path
        # the library's normaliser and pre-tokeniser, without its vocabulary
        self.splitter = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "decoder": None, "model": model | {"vocab": {}, "merges": [], "unk_token": None}}))
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        alphabet = byte_alphabet()
        self.to_byte = {c: b for b, c in enumerate(alphabet)}
        self.first = np.array([self.vocab[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([self.vocab[c + "</w>"] for c in alphabet], dtype=np.int64)
        rank, made = {}, {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            key = self.vocab[a] * self.size + self.vocab[b]
            rank[key], made[key] = r, self.vocab[a + b]
        keys = np.array(sorted(rank), dtype=np.int64)
        self.keys = keys
        self.ranks = np.array([rank[k] for k in keys.tolist()], dtype=np.int64)
        self.made = np.zeros(len(model["merges"]), dtype=np.int64)
        for k in rank:
            self.made[rank[k]] = made[k]
        # A rank may be applied everywhere at once if no later pair that uses its token has a lower rank.
        least = np.full(self.size, NO_RANK)
        np.minimum.at(least, keys // self.size, self.ranks)
        np.minimum.at(least, keys % self.size, self.ranks)
        self.together = least[self.made] > np.arange(len(self.made))
        self.pattern, self.beyond = _plain_pattern(), _beyond_plain()
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @cached_property
    def library(self):
        """The library's own tokenizer, to compare with."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    # -- tokens by their bytes, for greedy proposals ---------------------------------------------------------------

    @cached_property
    def inner(self) -> dict[bytes, int]:
        return {bytes(self.to_byte[c] for c in t): i for t, i in self.vocab.items() if not t.endswith("</w>")}

    @cached_property
    def final(self) -> dict[bytes, int]:
        return {bytes(self.to_byte[c] for c in t[:-4]): i for t, i in self.vocab.items() if t.endswith("</w>")}

    @cached_property
    def longest(self) -> int:
        return max(map(len, [*self.inner, *self.final]))

    @cached_property
    def spell(self) -> dict[int, tuple[bytes, bool]]:
        return {i: (b, False) for b, i in self.inner.items()} | {i: (b, True) for b, i in self.final.items()}

    # -- pre-tokens ---------------------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Blank-free pieces; special strings are pieces of their own. No pre-token crosses a blank."""
        if self.cut_special is not None and "<|" in text:
            out: list[str] = []
            for part in self.cut_special.split(text):
                out += [part] if part in self.special else self._blank_free(part)
            return out
        return self._blank_free(text)

    @staticmethod
    def _blank_free(text: str) -> list[str]:
        # str.split() also cuts at U+001C..U+001F, which are no blanks here
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in BLANKS.split(text) if x]
        return text.split()

    def words(self, pieces: list[str]) -> tuple[list[str], list[str], list[int]]:
        """The pre-tokens of pieces, all at once: the pieces in some order, their pre-tokens, flat, and each piece's end
        among them."""
        text = "\n".join(pieces)
        other: list[str] = []
        if not text.isascii() and self.beyond.search(text):
            other = [p for p in pieces if self.beyond.search(p)]
            pieces = [p for p in pieces if not self.beyond.search(p)]
            text = "\n".join(pieces)
        flat, ends = [], []
        if pieces:
            found = self.pattern.findall(text.lower())
            flat = [w for w in found if w != "\n"]
            ends = [i - k for k, i in enumerate([i for i, w in enumerate(found) if w == "\n"])]
            ends.append(len(flat))
        for p in other:
            normal = self.splitter.normalizer.normalize_str(p)
            flat += [bytes(self.to_byte[c] for c in w).decode() for w, _ in self.splitter.pre_tokenizer.pre_tokenize_str(normal)]
            ends.append(len(flat))
        return [*pieces, *other], flat, ends

    # -- merging ------------------------------------------------------------------------------------------------

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The byte symbols of non-empty words, flat, and the words' lengths."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        flat = self.first[raw]
        ends = np.cumsum(sizes) - 1
        flat[ends] = self.last[raw[ends]]
        return flat, sizes

    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all sequences in step: each round applies each sequence's lowest-ranked pair.

        flat: symbols, sizes: symbols per sequence (1 at least). Returns the surviving symbols, flat, and their
        counts. All occurrences of the pair go at once, left to right without overlap, where that can't change the
        order of merges; elsewhere the leftmost alone.
        """
        n = len(sizes)
        if n == 0:
            return flat, sizes
        seq = np.repeat(np.arange(n), sizes)
        done_seq: list[np.ndarray] = []
        done_sym: list[np.ndarray] = []
        sym = flat.copy()
        rank = np.full(len(sym), NO_RANK)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = self.rank_of(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            over = least == NO_RANK
            if over.any():
                gone = np.repeat(over, counts)
                done_seq.append(seq[gone])
                done_sym.append(sym[gone])
                left = ~gone
                sym, seq, rank = sym[left], seq[left], rank[left]
                if not len(sym):
                    break
                least, counts = least[~over], counts[~over]
                starts = np.cumsum(counts) - counts
            low = np.repeat(least, counts)
            at = np.flatnonzero(rank == low)
            if len(at) > len(starts):
                joined = np.r_[False, at[1:] == at[:-1] + 1]
                opens = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                keep = (np.arange(len(at)) - opens) % 2 == 0
                alone = ~self.together[low[at]]
                if alone.any():
                    leads = np.r_[True, seq[at][1:] != seq[at][:-1]]
                    keep &= ~alone | leads
                at = at[keep]
            sym[at] = self.made[low[at]]
            left = np.ones(len(sym), dtype=bool)
            left[at + 1] = False
            moved = at - np.arange(len(at))
            sym, seq, rank = sym[left], seq[left], rank[left]
            touched = np.r_[moved, moved[moved > 0] - 1]
            rank[touched] = NO_RANK
            touched = touched[touched + 1 < len(sym)]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched] = self.rank_of(sym[touched], sym[touched + 1])
        all_seq, all_sym = np.concatenate(done_seq), np.concatenate(done_sym)
        order = np.argsort(all_seq, kind="stable")
        return all_sym[order], np.bincount(all_seq, minlength=n)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.merge(*self.symbols(words))


class Encoder:
    """Encodes texts by merging each new pre-token; bounded memos of short pieces and words keep what was merged."""

    #: Entries of a memo; when full, it keeps what the current batch uses. Long keys go with their batch.
    MEMO = 400_000

    def __init__(self, model: BpeModel, width: int = 4):
        self.model, self.width = model, width
        self.special = {p: i.to_bytes(width, "little") for p, i in model.special.items()}
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, bytes] = dict(self.special)
        self.known: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned integers of `width` bytes."""
        merged, counts = self.model.merge_words(words)
        raw, ends = merged.astype(f"<u{self.width}").tobytes(), np.cumsum(counts) * self.width
        return [raw[a:b] for a, b in zip((ends - counts * self.width).tolist(), ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in that form."""
        m, memo = self.model, self.memo
        cut = [m.pieces(t) for t in texts]
        used = set(itertools.chain.from_iterable(cut))
        new = list(used.difference(memo))
        if new:
            if len(memo) + len(new) > self.MEMO:
                memo = self.memo = {p: memo[p] for p in used if p in memo} | self.special
            new, flat, ends = m.words(new)
            missing = list(set(flat).difference(self.known))
            if missing:
                if len(self.known) + len(missing) > self.MEMO:
                    self.known.clear()
                    missing = list(set(flat))
                self.known.update(zip(missing, self.encode_words([w.encode() for w in missing]), strict=True))
            ids = list(map(self.known.__getitem__, flat))
            memo.update(zip(new, [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        out = [b"".join(map(memo.__getitem__, ps)) for ps in cut]
        if new:
            for held, keys in ((memo, new), (self.known, missing)):
                if max(map(len, keys), default=0) > MEMO_KEY:
                    for k in keys:
                        if len(k) > MEMO_KEY:
                            held.pop(k, None)
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int = 4) -> Encoder:
    """One encoder per Python worker and width."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(load(path), width)
    return _ENCODERS[path, width]


@forgets
def _forget() -> None:
    for e in _ENCODERS.values():
        e.forget()


_MODELS: dict[str, BpeModel] = {}


def load(path: str) -> BpeModel:
    """One model per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


_TOKENS: dict[str, list[str]] = {}


def tokens(path: str) -> list[str]:
    """The token of each id, without the rest of the model."""
    if path not in _TOKENS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        out = [""] * (max(named.values()) + 1)
        for t, i in named.items():
            out[i] = t
        _TOKENS[path] = out
    return _TOKENS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
