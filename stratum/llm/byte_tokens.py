"""Token ids of many texts with a public byte-level tokenizer.

The tokenizers library encodes; what it would encode again and again is remembered. Its pre-tokenizer never
joins characters across a space that stands alone between two others, so a text cut before such spaces and
before and behind single line ends has the ids of its pieces, one after the other. Texts that may not be cut
so (two white-space characters in a row, or a special token's string) go to the library whole. Cutting and
counting equal pieces once is Arrow's work, a block of texts at a time.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; when it has more, it keeps those that it met again.
REMEMBERED = 300_000
#: Characters of the longest piece that is remembered.
LONGEST = 40
#: Two of the plain white-space characters in a row, or any other one: as RE2 writes them.
_WIDE_SPACE = r"[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The visible character by which byte-level BPE writes each byte."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + rest.index(b)) for b in range(256)]


class PieceCache:
    """Lists of ids of repeated pieces, kept flat. encode: pieces to their lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.bounds = np.zeros(1 << 18, np.int64)
        self.met_again = np.zeros(1 << 18, bool)

    def forget(self) -> None:
        """All but the pieces that were met again since the last time."""
        kept = np.flatnonzero(self.met_again[: len(self.index)])
        if len(kept) > self.remembered // 2:
            kept = kept[: self.remembered // 2]
        chosen = set(kept.tolist())
        start, count = self.bounds[kept], self.bounds[kept + 1] - self.bounds[kept]
        ends = np.cumsum(count)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)
        self.ids[: len(where)] = self.ids[where]
        self.bounds[1 : len(kept) + 1] = ends
        self.index = dict(zip((p for p, k in self.index.items() if k in chosen), range(len(kept))))
        self.met_again[:] = False

    def __call__(self, pieces: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and the offsets of each piece's."""
        if len(self.index) > self.remembered:
            self.forget()
        coded = pc.dictionary_encode(pieces if isinstance(pieces, pa.Array) else pa.array(pieces, pa.string()))
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, different, itertools.repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(known < 0)
        self.met_again[known[known >= 0]] = True
        if len(new):
            first = len(self.index)
            self._add([different[k] for k in new])
            known[new] = np.arange(first, first + len(new))
        at = known[coded.indices.to_numpy()]
        start, count = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        offsets = np.concatenate(([0], np.cumsum(count)))
        where = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], count)
        return self.ids[where], offsets

    def _add(self, new: list[str]) -> None:
        lists = self.encode(new)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        n, size = len(self.index), int(self.bounds[len(self.index)])
        end = size + int(counts.sum())
        while end > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(new) + 1 > len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
            self.met_again = np.concatenate((self.met_again, np.zeros_like(self.met_again)))
        self.ids[size:end] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, end - size)
        self.bounds[n + 1 : n + len(new) + 1] = size + np.cumsum(counts)
        self.index.update(zip(new, range(n, n + len(new))))


class ByteTokens:
    """Ids of texts, with the tokenizer file at path; made once in each Python worker."""

    _of: dict[str, ByteTokens] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_WIDE_SPACE, *special])
        self.known_marks: dict[str, list[int]] = {}
        self.visible = byte_letters()
        self.cache = PieceCache(self._pieces)

    @classmethod
    def at(cls, path: str) -> ByteTokens:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces. A word of plain letters, with marks behind it or without, goes straight to the library's
        BPE model, as its pre-tokenizer would pass it on; any other piece goes through the whole library."""
        out: list = [None] * len(pieces)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for k, p in enumerate(pieces):
            body = p.rstrip(".,;:!?")
            word = body[1:] if body[:1] == " " else body
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                ids = [t.id for t in tokenize(body.replace(" ", "\u0120") if word.isascii() else body.encode().decode("latin-1").translate(self.visible))]
                if len(body) < len(p):
                    ids += self.marks(p[len(body) :])
                out[k] = ids
            else:
                rest.append(k)
        for k, ids in zip(rest, self._library([pieces[k] for k in rest])):
            out[k] = ids
        return out

    def marks(self, text: str) -> list[int]:
        if text not in self.known_marks:
            if len(self.known_marks) > 10_000:
                self.known_marks.clear()
            self.known_marks[text] = self._library([text])[0]
        return self.known_marks[text]

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, none of them null, as uint32, and the offsets of each text's."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        apart = pc.match_substring_regex(texts, self.whole)
        whole = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        plain = pc.if_else(apart, "", texts) if len(whole) else texts
        cut = pc.replace_substring(pc.replace_substring(plain, " ", "\x1f "), "\n", "\x1f\n\x1f")
        lists = pc.split_pattern(cut, "\x1f")
        pieces, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        size = pc.binary_length(pieces).to_numpy()
        long = np.flatnonzero(size > LONGEST)
        far = pieces.take(pa.array(long)).to_pylist() if len(long) else []
        if far:
            pieces = pc.if_else(pa.array(size > LONGEST), "", pieces)
        ids, offsets = self.cache(pieces)
        out = offsets[ends]
        if not (far or len(whole)):
            return ids, out
        # What was encoded apart is put in its place.
        owners = np.searchsorted(ends, long, "right") - 1
        parts: list[tuple[int, int, list[int]]] = [(int(offsets[k]), int(o), x) for k, o, x in zip(long, owners, self._library(far))]
        parts += [(int(out[k]), int(k), x) for k, x in zip(whole, self._library(texts.take(pa.array(whole)).to_pylist()))]
        parts.sort(key=lambda x: x[:2])
        merged, last, extra = [], 0, np.zeros(len(texts), np.int64)
        for at, owner, x in parts:
            merged += [ids[last:at], np.asarray(x, np.uint32)]
            last = at
            extra[owner] += len(x)
        merged.append(ids[last:])
        return np.concatenate(merged), out + np.concatenate(([0], np.cumsum(extra)))
