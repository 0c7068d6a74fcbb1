"""Token ids of whole texts, with every different piece between white space encoded once per task.

Texts are cut where ASCII white space follows an ASCII graphic character or a two-byte letter of the
C3 page (which holds no white space). Both tokenizers used here split there before they merge
anything, so the ids of the pieces in a row are the ids of the text. Pieces are told apart by 64-bit
hashes; pieces of over ``LONG`` bytes are encoded one by one.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from paidup.llm.text import GRAPHIC, LOWER, span_hashes, utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Longest piece in bytes that is kept, and the number of kept pieces after which a task starts anew.
LONG, KEPT = 256, 1_000_000
#: Words that are encoded as one text.
JOINED = 1024

_SPACE = ~GRAPHIC

#: ASCII letters, and the second bytes of the letters of the C3 page.
_LETTER, _C3_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_C3_LETTER[0x80:0xC0] = True
_C3_LETTER[[0x97, 0xB7]] = False


def _gather(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``count`` values from ``first`` on, in a row."""
    edges = np.concatenate(([0], np.cumsum(count)))
    return pool[np.arange(edges[-1]) + np.repeat(first - edges[:-1], count)]


class _Known:
    """Ids by hash, found by bisection."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def places(
        self, different: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each hash has its ids, and how many; ``encode`` gives those of the rows not known yet."""
        at = np.searchsorted(self.keys, different)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == different[known]
        if not known.all():
            if len(self.keys) + len(different) > KEPT:
                self.clear()
                at, known = np.zeros(len(different), np.int64), np.zeros(len(different), bool)
            new, count = encode(np.flatnonzero(~known))
            first = len(self.ids) + np.concatenate(([0], np.cumsum(count)[:-1]))
            self.ids = np.concatenate((self.ids, new))
            self.keys = np.insert(self.keys, at[~known], different[~known])
            self.first = np.insert(self.first, at[~known], first)
            self.count = np.insert(self.count, at[~known], count)
            at = np.searchsorted(self.keys, different)
        return self.first[at], self.count[at]


class PieceEncoder:
    def __init__(self, path: str, drops_space: bool):
        """``drops_space``: the tokenizer ignores white space, lower-cases, and splits letters from other characters
        but for contractions. A piece is then kept without the white space before it, and a new one is encoded word by word."""
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space = Tokenizer.from_file(path), drops_space
        self.pieces, self.words = _Known(), _Known()
        if drops_space:
            # Where letters and these meet, a new token begins: ASCII that stands in no added token.
            self.apart = np.zeros(256, bool)
            self.apart[33:127] = ~_LETTER[33:127]
            for token in self.tokenizer.get_added_tokens_decoder().values():
                self.apart[list(token.content.encode())] = False
            self.before_letter = self.apart.copy()
            self.before_letter[ord("'")] = False
            suffix = self.tokenizer.model.end_of_word_suffix
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            if suffix:
                self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for own in ids for x in own), np.uint32, int(count.sum())), count

    def _encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._encode([data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())])

    def _encode_joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, many to a text: the token that ends a word tells where the next one begins."""
        sizes = ends - starts
        text, bounds = with_end(_gather(data, starts, sizes), sizes, ord(" "))
        text, cuts = text.astype(np.uint8), [*bounds[:-1:JOINED].tolist(), int(bounds[-1])]
        ids, _ = self._encode([text[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])])
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) != len(starts):
            return self._encode_spans(data, starts, ends)
        return ids, np.diff(last, prepend=-1)

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spans without white space, from those of the words and the rest that they are made of."""
        sizes = ends - starts
        own = _gather(data, starts, sizes)
        begins = np.zeros(len(own), bool)
        begins[np.cumsum(sizes) - sizes] = True
        letter = _LETTER[own]
        lead = np.flatnonzero(own == 0xC3)
        lead = lead[_C3_LETTER[own[lead + 1]]]
        letter[lead] = letter[lead + 1] = True
        cut = begins.copy()
        cut[1:] |= (letter[:-1] & self.apart[own[1:]]) | (self.before_letter[own[:-1]] & letter[1:])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(own))
        span = np.cumsum(begins)[first] - 1
        is_word = np.logical_and.reduceat(letter, first)
        own = np.where(np.repeat(is_word, last - first), LOWER[own], own)
        different, example, word = np.unique(span_hashes(own, first, last), return_index=True, return_inverse=True)

        def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = example[rows]
            joined = is_word[rows]
            place, count = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            pool = np.zeros(0, np.uint32)
            for chosen, method in ((joined, self._encode_joined), (~joined, self._encode_spans)):
                if chosen.any():
                    ids, n = method(own, first[rows[chosen]], last[rows[chosen]])
                    place[chosen], count[chosen] = len(pool) + np.cumsum(n) - n, n
                    pool = np.concatenate((pool, ids))
            return _gather(pool, place, count), count

        place, count = (x[word] for x in self.words.places(different, encode))
        return _gather(self.words.ids, place, count), np.bincount(span, count, len(starts)).astype(np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; null is empty."""
        data, offsets = utf8(column)
        n_texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        before = (data > 32) & (data < 127)
        before[1:] |= data[:-1] == 0xC3
        cut = _SPACE[data]
        cut[1:] &= before[:-1]
        cut[0] = True
        cut[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        text = np.searchsorted(offsets, starts, side="right") - 1
        if self.drops_space:
            starts = starts + _SPACE[data[starts]]
            full = starts < ends
            starts, ends, text = starts[full], ends[full], text[full]
        long = ends - starts > LONG
        hashes = np.zeros(len(starts), np.uint64)
        hashes[~long] = span_hashes(data, starts[~long], ends[~long])
        different, example, piece = np.unique(hashes[~long], return_index=True, return_inverse=True)
        where = np.flatnonzero(~long)[example]
        method = self._encode_words if self.drops_space else self._encode_spans
        places = self.pieces.places(different, lambda rows: method(data, starts[where[rows]], ends[where[rows]]))
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first[~long], count[~long] = (x[piece] for x in places)
        pool = self.pieces.ids
        if long.any():
            new, own = self._encode_spans(data, starts[long], ends[long])
            first[long], count[long] = len(pool) + np.concatenate(([0], np.cumsum(own)[:-1])), own
            pool = np.concatenate((pool, new))
        return _gather(pool, first, count), np.bincount(text, count, n_texts).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool) -> PieceEncoder:
    """One per Python worker, kept over its tasks."""
    return PieceEncoder(path, drops_space)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text, and the bounds of the texts."""
    bounds = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.full(bounds[-1], end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, bounds


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
