"""Token ids of whole texts with a public word-level BPE vocabulary, through a cache of words.

The vocabulary's normaliser and splitter treat every white-space-separated word on its
own, so a text's ids are its words' ids in order.  Distinct words are looked up by hash
and compared byte by byte; new ones are encoded by the tokenizers library, many at a time, with a separator word
between them.  The cache is bounded and lives as long as its Python worker.
"""

from __future__ import annotations

import os

import numpy as np

from .words import WordTable, spans

SEPARATOR = "\x01"  # a word of its own; words that hold it are encoded alone
CACHE_WORDS = 1_000_000
_caches: dict[str, WordIds] = {}


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words = WordTable(CACHE_WORDS)
        (self.separator,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.at = np.empty(0, np.int32)
        self.size = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        """Append each word's ids, many words encoded at a time."""
        mark = SEPARATOR.encode()
        every = b" ".join(words)
        alone = {i for i, w in enumerate(words) if mark in w or b"<|" in w} if mark in every or b"<|" in every else set()
        plain = [w for i, w in enumerate(words) if i not in alone] if alone else words
        found, sizes = [self.ids], [np.empty(0, np.int64)]
        for i in range(0, len(plain), 1000):
            group = plain[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([(b" " + mark + b" ").join(group).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) + 1 != len(group):
                raise ValueError("a separator was lost")
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            found.append(np.delete(ids, cuts))
        size = np.zeros(len(words), np.int64)
        size[np.array([i for i in range(len(words)) if i not in alone], np.int64) if alone else slice(None)] = np.concatenate(sizes)
        at = np.cumsum(size) - size + len(self.ids)
        end = len(self.ids) + int(size.sum())
        for i in sorted(alone):
            ids = np.array(self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids, np.uint32)
            found.append(ids)
            size[i], at[i] = len(ids), end
            end += len(ids)
        self.ids = np.concatenate(found)
        self.at, self.size = np.concatenate([self.at, at.astype(np.int32)]), np.concatenate([self.size, size.astype(np.int32)])

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first): text t has ids[first[t]:first[t+1]], its last one being ``end``."""
        buf, starts, ends, first = spans(texts)
        before = self.words.cleared
        number, new = self.words.number(buf, starts, ends)
        if self.words.cleared != before:
            self._clear()
        if len(new):
            raw = buf.tobytes()
            self._learn([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        size = self.size[number]
        until = np.concatenate([[0], np.cumsum(size)])
        total = int(until[-1])
        source = np.repeat(self.at[number] - until[:-1], size) + np.arange(total)
        counts = until[first[1:]] - until[first[:-1]]
        bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        ids = np.full(total + len(texts), end, np.uint32)
        ids[np.arange(total) + np.repeat(np.arange(len(texts)), counts)] = self.ids[source]
        return ids, bounds


def word_ids(path: str) -> WordIds:
    if path not in _caches:
        _caches[path] = WordIds(path)
    return _caches[path]
