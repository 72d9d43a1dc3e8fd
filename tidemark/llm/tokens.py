"""Subword ids of whole documents, each different word of a batch encoded once."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.shared import coded_words

#: Ids of the words of an array: all in turn, and how many each word has.
WordIds = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each of the ranges, one after another."""
    ends = np.cumsum(lengths)
    out = np.repeat((starts - (ends - lengths)).astype(np.int64), lengths)
    out += np.arange(len(out))
    return out


def encode(texts: pa.Array, ids_of: WordIds, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, id ``last`` after each, and where each text begins (and the end).

    The ids of a text must be those of its words in turn.
    """
    at, codes, words = coded_words(texts)
    pool, lengths = ids_of(words)
    begin = np.cumsum(lengths) - lengths
    of_word = lengths[codes]
    before = np.concatenate([[0], np.cumsum(of_word, dtype=np.int64)])
    starts = before[at] + np.arange(len(at))  # one more id after each text before it
    out = np.full(int(starts[-1]), last, np.uint32)
    place = np.ones(len(out), bool)
    place[starts[1:] - 1] = False
    out[place] = pool[spread(begin[codes], of_word)]
    return out, starts


class WordEndTokenizer:
    """Word ids by a ``tokenizers`` file whose last token of a piece of a word carries a word end.

    Such a file parts words of plain Latin letters into runs of letters, digits and the rest, as
    ``_PIECES`` does. The different pieces of a list are encoded a thousand at a time, parted by spaces,
    and told apart again by their word ends. Words with anything else in them are encoded alone.
    """

    _PLAIN = "^[!-~À-ÿ]+$"
    # fixed values: the file's own pattern, for lower-case Latin-1
    _PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        suffix = described["model"]["end_of_word_suffix"]
        self.special = tuple(token["content"] for token in described["added_tokens"])
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _alone(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for first in range(0, len(pieces), 1000):
            some = pieces[first : first + 1000]
            found = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) != len(some):
                lists = self._alone(some)
                found = np.array(list(chain.from_iterable(lists)), np.uint32)
                ends = np.cumsum([len(x) for x in lists])
            ids.append(found)
            lengths.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, self._PLAIN)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        lower = pc.utf8_lower(pc.if_else(plain, words, ""))
        starts, part, pieces = coded_words(pc.replace_substring_regex(lower, self._PIECES, r"\1 "))
        pool, sizes = np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(pieces):
            pool, sizes = self._pieces(pieces.to_pylist())
        begin = np.cumsum(sizes) - sizes
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes[part], dtype=np.int64)])[starts])
        ids = pool[spread(begin[part], sizes[part])]
        if len(odd):
            lists = self._alone(words.take(pa.array(odd)).to_pylist())
            lengths[odd] = [len(x) for x in lists]
            out = np.empty(int(lengths.sum()), np.uint32)
            alone = np.zeros(len(words), bool)
            alone[odd] = True
            belongs = np.repeat(alone, lengths)
            out[belongs] = np.array(list(chain.from_iterable(lists)), np.uint32)
            out[~belongs] = ids
            ids = out
        return ids, lengths
