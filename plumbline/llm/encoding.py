"""Byte-level BPE with the tokenizers library, with a bounded memory of words already encoded.

A single space between two characters that are not white space always begins a new pre-token of these
vocabularies, so a text may be encoded word by word and the ids joined. The distinct words of a batch are looked
up together, and a worker keeps those it met in ``MEMORY_BYTES`` of packed arrays. Texts with any other arrangement
of spaces, or with the string of an added token such as <|endoftext|>, are encoded as they are. Either way the ids
are those of the library for the whole text.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY_BYTES = 48 << 20
#: White space other than single spaces and line feeds, and line feeds beside a space.
_ODD_SPACES = ("  ", " \n", "\n ", *(chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _odd(text: str) -> bool:
    return text[0] == " " or text[-1] == " " or any(map(text.__contains__, _ODD_SPACES))


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start: start + length]`` one after the other."""
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(starts) else starts
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


class WordMemory:
    """Numbers learned for words, those of the words met last kept in a bounded number of bytes."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = MEMORY_BYTES):
        self.learn, self.limit = learn, limit
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.starts, self.lengths, self.met, self.turn = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def find(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words; they hold until the next call."""
        if self.words.nbytes + self.flat.nbytes + 3 * self.starts.nbytes > self.limit:
            self._forget()
        self.turn += 1
        places = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(places))
        where = pc.fill_null(places, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            flat, lengths = self.learn(fresh.to_pylist())
            where[where < 0] = len(self.words) + np.arange(len(fresh))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.flat, self.lengths = np.concatenate((self.flat, flat)), np.concatenate((self.lengths, lengths))
            self.words, self.met = pa.concat_arrays([self.words, fresh]), np.concatenate((self.met, np.zeros(len(fresh), np.int64)))
        self.met[where] = self.turn
        return where

    def _forget(self) -> None:
        """Keeps the words met last, up to half of the limit."""
        order = np.argsort(-self.met, kind="stable")
        each = 4 * self.lengths[order] + pc.binary_length(self.words).to_numpy(zero_copy_only=False)[order] + 28
        kept = np.sort(order[: np.searchsorted(np.cumsum(each), self.limit // 2)])
        self.flat = spread(self.flat, self.starts[kept], self.lengths[kept])
        self.words, self.lengths, self.met = self.words.take(pa.array(kept)), self.lengths[kept], self.met[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def numbers(self, places: np.ndarray) -> np.ndarray:
        return spread(self.flat, self.starts[places], self.lengths[places])


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)  # the byte alphabet has one character per byte
        self.memory = WordMemory(self._learn)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _has_added(self, text: str) -> bool:
        return any(map(text.__contains__, self.added))

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word behind a space and how many there are, encoded as one text and cut by the bytes of its tokens."""
        ids = self._plain([" " + " ".join(words)])[0]
        ends = np.cumsum(self.bytes_of[ids])
        wanted = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        cuts = np.searchsorted(ends, wanted) + 1
        if not (ends[cuts - 1] == wanted).all():  # never so for these vocabularies
            parts = self._plain([" " + w for w in words])
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, np.diff(cuts, prepend=0)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where those of each text end."""
        parts: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and (_odd(t) or self._has_added(t))]
        for i, ids in zip(whole, self._plain([texts[i] for i in whole]) if whole else []):
            parts[i] = ids
        odd = set(whole)
        split = [i for i, t in enumerate(texts) if t and i not in odd]
        if split:
            words = pc.split_pattern(pa.array([texts[i] for i in split], pa.large_string()).cast(pa.string()), " ")
            firsts = words.offsets.to_numpy()
            heads = self._plain(pc.list_element(words, 0).to_pylist())
            coded = words.flatten().dictionary_encode()
            places = self.memory.find(coded.dictionary)[coded.indices.to_numpy()]
            behind = np.ones(len(places), bool)
            behind[firsts[:-1]] = False  # the first word of a text stands behind no space
            lengths = np.where(behind, self.memory.lengths[places], 0)
            flat = self.memory.numbers(places[behind])
            ends = np.concatenate(([0], np.cumsum(lengths)))[firsts]
            for i, head, a, b in zip(split, heads, ends, ends[1:]):
                parts[i] = np.concatenate((head, flat[a:b]))
        return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        flat, ends = self.encoded(texts)
        return [flat[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, path and life of the process."""
    return Encoder(path)
