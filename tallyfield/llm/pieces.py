"""Encode a batch of texts by looking up space-separated pieces.

A byte-level BPE tokenizer never merges across pre-tokens, and a single space before a
character that is not white space always begins a pre-token of the pattern it uses. So a text
cut before such spaces encodes to the concatenation of its pieces' encodings, and a piece to
that of its pre-tokens'. Each new pre-token is merged once by the library; pieces and
pre-tokens met before are looked up in one table, which is bounded in bytes.

A text is encoded whole by the library only if it holds a string of an added token, or a
character that the library's pattern and ours class differently (each character is put to
both once).
"""

from __future__ import annotations

import gc
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

LONG = 64  # bytes; longer pieces are cut each time and not kept
KEEP_BYTES = 128 << 20  # of a worker's table, about
ENTRY = 230  # bytes of an entry besides its string and ids: dictionary, numbers, string head
# The pre-token pattern of the byte-level vocabulary (GPT-2's).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_find = regex.compile(PATTERN).findall
_cut = re.compile(r" (?=\S)").split


def pre_tokens(piece: str) -> list[str]:
    """Pre-tokens of a piece that may begin with a space; plain words without the pattern."""
    word = piece[1:] if piece[:1] == " " else piece
    if word.isalpha():
        return [piece]
    if word[-1:] in (",", ".") and word[:-1].isalpha():
        return [piece[:-1], word[-1]]
    return _find(piece)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = byte_alphabet()


def spelled(text: str) -> str:
    """A string's UTF-8 bytes in the alphabet of the vocabulary."""
    if text.isascii() and text[1:].isalnum() and text[0] == " ":
        return "Ġ" + text[1:]
    return text.encode().decode("latin-1").translate(_ALPHABET)


class Pool:
    """Id lists (or only their lengths) by slot, in arrays that grow."""

    def __init__(self, with_ids: bool):
        self.with_ids = with_ids
        self.n = self.used = 0
        self.lens = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def add(self, lens: np.ndarray, ids: np.ndarray | None) -> range:
        first, k = self.n, len(lens)
        self._room("lens", first + k)
        self.lens[first : first + k] = lens
        if self.with_ids:
            self._room("starts", first + k)
            self._room("ids", self.used + len(ids))
            self.starts[first : first + k] = self.used + np.cumsum(lens) - lens
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        self.n += k
        return range(first, first + k)

    def gather(self, slots: np.ndarray) -> np.ndarray:
        lens = self.lens[slots]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat((self.starts[slots] - (ends - lens)).astype(np.int32), lens)
        index += np.arange(total, dtype=np.int32)
        return self.ids.take(index)


class PieceTable:
    """Ids (or counts) of pieces and pre-tokens, each under its string with any leading space."""

    def __init__(self, tokenizer, with_ids: bool, proven: frozenset[str] = frozenset(), keep: int = KEEP_BYTES):
        self.tk, self.with_ids, self.proven, self.keep = tokenizer, with_ids, proven, keep
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.agreed, self.apart = set(map(chr, range(128))) - set("\x1c\x1d\x1e\x1f"), set("\x1c\x1d\x1e\x1f")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = Pool(self.with_ids)
        self.bytes = 0
        self.batches = np.zeros(0, np.uint8)

    def whole(self, text: str) -> list[int]:
        return self.tk.encode(text, add_special_tokens=False).ids

    def _agrees(self, c: str) -> bool:
        """Whether the library's pattern and ours put a character in the same class."""
        probe = f"a{c}1{c}!{c} {c}"
        try:
            theirs = [b - a for _, (a, b) in self.tk.pre_tokenizer.pre_tokenize_str(probe)]
        except Exception:  # noqa: BLE001  a character the library can't take
            return False
        return theirs == [len(p) for p in _find(probe)]

    def plain(self, text: str) -> bool:
        """Whether a text may be cut: no added token in it, and only characters agreed on."""
        new = set(text) - self.agreed
        if new:
            for c in new - self.apart:
                (self.agreed if self._agrees(c) else self.apart).add(c)
            if new & self.apart:
                return False
        return not any(a in text for a in self.added)

    def _put(self, keys: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(keys, self.pool.add(lens, ids)))
        self.bytes += ENTRY * len(keys) + sum(map(len, keys)) + 4 * len(ids)

    def _merge(self, words: list[str]) -> None:
        """Put pre-tokens not met before into the table."""
        tokenize, lens, ids = self.tk.model.tokenize, [], []
        for w in words:
            s = spelled(w)
            if not self.with_ids:
                lens.append(1 if s in self.proven else len(tokenize(s)))
                continue
            got = [t.id for t in tokenize(s)]
            lens.append(len(got))
            ids.extend(got)
        self._put(words, np.array(lens, np.int64), np.array(ids, np.uint32))

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of pieces by their pre-tokens."""
        cut = [pre_tokens(p) for p in pieces]
        flat = list(chain.from_iterable(cut))
        self._merge([w for w in dict.fromkeys(flat) if w not in self.known])
        slots = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(pieces)), [len(c) for c in cut])
        lens = np.bincount(owner, weights=self.pool.lens[slots], minlength=len(pieces)).astype(np.int64)
        return lens, self.pool.gather(slots) if self.with_ids else np.zeros(0, np.uint32)

    def slots(self, pieces: list[str]) -> np.ndarray:
        """Slot of each piece of plain texts."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            words = list(dict.fromkeys(pieces[i] for i in new))
            for k in range(0, len(words), 20_000):
                some = words[k : k + 20_000]
                single = [w for w in some if (w[1:] if w[0] == " " else w).isalpha()]
                self._merge(single)
                rest = [w for w in some if w not in self.known]
                self._put(rest, *self._encode_pieces(rest))
            at[new] = [self.known[pieces[i]] for i in new]
        return at

    def cut_text(self, text: str) -> tuple[int, np.ndarray]:
        """Number of ids and ids of one plain text of any spacing; long pieces aren't kept."""
        first, *rest = _cut(text)
        pieces = [*([first] if first else []), *(" " + p for p in rest)]
        if not pieces:
            return 0, np.zeros(0, np.uint32)
        short = [len(p) <= LONG for p in pieces]
        self.slots([p for p, s in zip(pieces, short) if s])
        n, parts = 0, []
        for p, s in zip(pieces, short):
            if s:
                slot = self.known[p]
                n += int(self.pool.lens[slot])
                if self.with_ids:
                    at = self.pool.starts[slot]
                    parts.append(self.pool.ids[at : at + self.pool.lens[slot]])
            else:
                for w in pre_tokens(p):
                    got = self.tk.model.tokenize(spelled(w)) if len(w) > LONG or w not in self.known else None
                    if got is None:
                        slot = self.known[w]
                        n += int(self.pool.lens[slot])
                        parts.append(self.pool.ids[self.pool.starts[slot] : self.pool.starts[slot] + self.pool.lens[slot]] if self.with_ids else [])
                    else:
                        n += len(got)
                        parts.append([t.id for t in got])
        return n, np.concatenate([np.zeros(0, np.uint32), *parts]) if self.with_ids else np.zeros(0, np.uint32)

    def after_batch(self, used: np.ndarray) -> None:
        """Count the batches that use an entry; once there is too much, the rarest go."""
        self.batches = np.append(self.batches, np.zeros(self.pool.n - len(self.batches), np.uint8))
        mark = np.zeros(self.pool.n, bool)
        mark[used] = True
        self.batches[mark & (self.batches < 255)] += 1
        if self.bytes <= self.keep:
            return
        old, pool, batches = self.known, self.pool, self.batches
        self.clear()
        counts = np.bincount(batches, minlength=256)
        least = int(np.flatnonzero(counts[::-1].cumsum()[::-1] * (ENTRY + 20) <= self.keep // 2)[0]) if counts[255] * (ENTRY + 20) <= self.keep // 2 else 256
        keys = [k for k, slot in old.items() if batches[slot] >= max(least, 2)]
        slots = np.fromiter(map(old.__getitem__, keys), np.int64, len(keys))
        self._put(keys, pool.lens[slots], pool.gather(slots) if self.with_ids else np.zeros(0, np.uint32))
        self.batches = np.ones(len(keys), np.uint8)


def encode_batch(texts: pa.Array, table: PieceTable) -> tuple[np.ndarray, np.ndarray | None]:
    """Number of ids of each text and, if the table keeps ids, all ids in one array."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    collecting = gc.isenabled()
    gc.disable()  # many small lists and no cycles among them
    try:
        return _encode_batch(texts, table)
    finally:
        if collecting:
            gc.enable()


def _encode_batch(texts: pa.Array, table: PieceTable) -> tuple[np.ndarray, np.ndarray | None]:
    n = len(texts)
    parts = pc.split_pattern(texts, " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coding = parts.flatten().dictionary_encode()
    codes, words = coding.indices.to_numpy(zero_copy_only=False), coding.dictionary
    size = pc.binary_length(words)
    # an empty part, or white space at its end, is a space that doesn't stand alone
    odd = pc.or_(pc.or_(pc.equal(size, 0), pc.not_equal(size, pc.binary_length(pc.utf8_trim_whitespace(words)))), pc.greater(size, LONG))
    odd = odd.to_numpy(zero_copy_only=False).copy()
    words = words.to_numpy(zero_copy_only=False).tolist()
    good = np.flatnonzero(~odd)
    some = [words[i] for i in good]
    if not table.plain(" ".join(some)):
        odd[good] = [not table.plain(w) for w in some]
    # an added token that holds a space shows only in the text
    spaced = [a for a in table.added if " " in a]
    plain = ~np.logical_or.reduceat(odd[codes], bounds[:-1])
    for a in spaced:
        plain &= ~pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
    counts = np.diff(bounds)
    inner = np.repeat(plain, counts)
    good = np.flatnonzero(~odd)
    slot_of = np.zeros(len(words), np.int64)
    slot_of[good] = table.slots([" " + words[i] for i in good])
    slots = slot_of[codes]
    first = bounds[:-1][plain]
    slots[first] = table.slots([words[i] for i in codes[first]])
    slots = slots[inner]
    lens = np.zeros(n, np.int64)
    if len(slots):
        starts = np.cumsum(counts[plain]) - counts[plain]
        lens[plain] = np.add.reduceat(table.pool.lens[slots], starts)
    rest = np.flatnonzero(~plain)
    encoded: list = []
    for i in rest:
        text = texts[int(i)].as_py()
        if table.plain(text):
            k, x = table.cut_text(text)
        else:
            x = table.whole(text)
            k = len(x)
        lens[i] = k
        encoded.append(x)
    ids = None
    if table.with_ids:
        ids = table.pool.gather(slots)
        if len(rest):
            ends = np.cumsum(lens)
            every = np.empty(int(ends[-1]), np.uint32)
            every[np.repeat(plain, lens)] = ids
            for i, x in zip(rest, encoded):
                every[ends[i] - lens[i] : ends[i]] = x
            ids = every
    table.after_batch(slots)
    return lens, ids
