"""Encoding and decoding with a word-level BPE vocabulary, in batched numpy merge rounds.

The symbols of many words stand in one flat array. A round looks up every adjacent pair of a word by binary search in
the sorted keys of the merge table, finds each word's lowest rank, and joins all its pairs of that rank, from the left
where they overlap; words without a pair to join are done. Joining makes pairs of higher ranks only, so a round settles
one rank of each word. Words are deduplicated and remembered, so the rounds run over words that are new to a worker.

Texts are normalised and split as the vocabulary's file asks: NFC, white space to single spaces, lower case, then its
pattern. For characters whose treatment is the same in every Unicode version this is done here; a text with any other
character is normalised by the tokenizers library, and a piece with one is split by it. The strings of special tokens
are cut out first and become their ids.

Defined cases: a null text counts as empty and has no ids; rows are encoded one by one, so ties, repeated rows and
other columns make no difference.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import PieceCache, byte_letters
from .common import text_lists

#: Only such characters: no normal form changes them, and letters, digits, case and white space are beyond doubt.
PLAIN = re.compile("[\x00-\x1b\x20-\x7e\xa1-įı-ɏ]*")


class WordBPE:
    _of: dict[str, WordBPE] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = said["model"]["vocab"]
        self.suffix = said["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.inner = np.asarray([vocab[c] for c in self.letters], np.int64)
        self.last = np.asarray([vocab[c + self.suffix] for c in self.letters], np.int64)
        self.letter_byte = {c: b for b, c in enumerate(self.letters)}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in said["model"]["merges"]]
        keys = np.asarray([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.asarray([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        #: Sorted pair keys; of each its rank, and the symbol that it makes.
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        written = [tokens.get(i, "").encode() + b" " for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(written), np.uint8)
        self.token_starts = np.concatenate(([0], np.cumsum([len(x) for x in written])))
        self.cache = PieceCache(self._pieces)

    @classmethod
    def at(cls, path: str) -> WordBPE:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, none of them empty, and the offsets of each word's."""
        sizes = np.asarray([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[flat], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        never = len(self.keys)
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), never - 1)
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], never), never)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            active = low < never
            if not active.all():
                done.append((symbols[~active], word[~active]))
                symbols, word, rank, low = symbols[active], word[active], rank[active], low[active]
                if not len(symbols):
                    break
                pair = symbols[:-1] << 32 | symbols[1:]
            join = np.flatnonzero(rank == low)
            # Of pairs that overlap, as in a run of one symbol, every second one is joined.
            new_run = np.append(True, np.diff(join) > 1)
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(join)), 0))
            join = join[(np.arange(len(join)) - run_start) % 2 == 0]
            symbols[join] = self.made[np.searchsorted(self.keys, pair[join])]
            keep = np.ones(len(symbols), bool)
            keep[join + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = (np.concatenate(x) for x in zip(*done)) if done else (symbols, word)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def _words(self, piece: str) -> list[bytes]:
        if PLAIN.fullmatch(piece):
            return [w.encode() for w in self.pattern.findall(piece)]
        return [bytes(map(self.letter_byte.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        of = [self._words(p) for p in pieces]
        known = {w: k for k, w in enumerate(dict.fromkeys(w for words in of for w in words))}
        if not known:
            return [[] for _ in pieces]
        ids, offsets = self.merge_words(list(known))
        ids, offsets = ids.tolist(), offsets.tolist()
        return [[i for w in words for i in ids[offsets[known[w]] : offsets[known[w] + 1]]] for words in of]

    def _split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return text.lower().split()
        return [p for p in self.library.normalizer.normalize_str(text).split(" ") if p]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as uint32, and the offsets of each text's."""
        pieces: list[str] = []
        ends, marks = [], []
        for text in texts:
            if self.cut and "<|" in text and self.cut.search(text):
                for part in self.cut.split(text):
                    if part in self.special:
                        marks.append((len(pieces), len(ends), self.special[part]))
                    else:
                        pieces += self._split(part)
            elif text:
                pieces += self._split(text)
            ends.append(len(pieces))
        ids, offsets = self.cache(pieces)
        out = offsets[np.concatenate(([0], np.asarray(ends, np.int64)))]
        if marks:
            at, owner, mark = (np.asarray(x, np.int64) for x in zip(*marks))
            ids = np.insert(ids, offsets[at], mark)
            out = out + np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
        return ids, out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of the tokens of each text's ids, with a space between them: the file names no decoder."""
        start = self.token_starts[ids]
        size = self.token_starts[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        flat = self.token_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)].tobytes()
        bounds = np.concatenate(([0], ends))[offsets]
        return [flat[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:])]


def encode_documents(docs: DataFrame, tokenizer_path: str, with_outputs: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_outputs

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE.at(tokenizer_path)
        for batch in batches:
            for at, end, texts in text_lists(batch, 1):
                ids, offsets = bpe.encode(texts)
                ids = ids.astype("<u4")
                decoded = bpe.decode(ids, offsets)
                columns = [batch.column(0).slice(at, end - at), pa.array(np.diff(offsets))]
                columns.append(pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]))
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in decoded]))
                if with_outputs:
                    columns += [pa.array([ids[a:b].astype(np.int32) for a, b in zip(offsets[:-1], offsets[1:])], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return slim.mapInArrow(encode, schema)
