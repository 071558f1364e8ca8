"""A weighted backoff automaton in memory, which the distributed one must equal."""

from __future__ import annotations

import numpy as np

from plumbline.llm.lm_score import ADD, DISCOUNT, Stream


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place in the sorted table, -1 for those that it lacks."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[place] == keys, place, -1)


class Automaton:
    """Words, states, arcs and failure arcs as sorted arrays in memory: the plain version of the model."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.norm = total + ADD * (distinct + 1)
        self.root = np.log10((counts + ADD) / self.norm)
        self.pairs = self.triples = np.zeros(0, dtype=np.int64)
        self.pair_p = self.triple_p = self.word_back = self.pair_back = np.zeros(0)

    def with_pairs(self, keys: np.ndarray, counts: np.ndarray) -> Automaton:
        """Arcs out of word states. keys: first word's place << 32 | second's."""
        self.pairs, self.pair_counts = keys, counts
        first = keys >> 32
        kept = (counts - DISCOUNT) / self.counts[first]
        rest = 1 - np.bincount(first, weights=kept, minlength=len(self.words))
        self.word_back = np.log10(np.maximum(rest, 1e-12))
        self.pair_p = np.log10(kept + rest[first] * 10 ** self.root[keys & 0xFFFFFFFF])
        self.pair_back = np.zeros(len(keys))
        return self

    def with_triples(self, keys: np.ndarray, counts: np.ndarray) -> Automaton:
        """Arcs out of pair states. keys: pair's place << 32 | word's place."""
        self.triples = keys
        pair, word = keys >> 32, keys & 0xFFFFFFFF
        kept = (counts - DISCOUNT) / self.pair_counts[pair]
        rest = 1 - np.bincount(pair, weights=kept, minlength=len(self.pairs))
        self.pair_back = np.log10(np.maximum(rest, 1e-12))
        lower = self._after_word(self.pairs[pair] & 0xFFFFFFFF, word)
        self.triple_p = np.log10(kept + rest[pair] * 10**lower)
        return self

    def _after_word(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 of the second word's probability in the first one's state."""
        at = lookup(self.pairs, first << 32 | second)
        return np.where(at >= 0, self.pair_p[at] if len(self.pairs) else 0.0, self.word_back[first] + self.root[second])

    def places(self, stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its word's place, that of the pair it ends, and that of the triple it ends; -1: none kept."""
        w = lookup(self.words, stream.tokens)
        before = np.append(-1, w[:-1])
        before[stream.begin] = -1
        pair = np.full(len(w), -1, dtype=np.int64)
        both = np.flatnonzero((w >= 0) & (before >= 0))
        pair[both] = lookup(self.pairs, before[both] << 32 | w[both])
        earlier = np.append(-1, pair[:-1])
        earlier[stream.begin] = -1
        triple = np.full(len(w), -1, dtype=np.int64)
        all3 = np.flatnonzero((pair >= 0) & (earlier >= 0))
        triple[all3] = lookup(self.triples, earlier[all3] << 32 | w[all3])
        return w, pair, triple

    def traverse(self, stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its word's place, and what the traversal adds, with and without the root arcs of words not kept.

        The state before a token is the pair that ends there, else the word, else
        the root; so all states of a batch follow from ``places`` at once.
        """
        w, pair, triple = self.places(stream)
        known = w >= 0
        root = np.where(known, self.root[w] if len(self.words) else 0.0, 0.0)
        state_pair = np.append(-1, pair[:-1])
        state_word = np.append(-1, w[:-1])
        state_pair[stream.begin] = state_word[stream.begin] = -1
        fall = np.where(state_word >= 0, self.word_back[state_word] if len(self.words) else 0.0, 0.0)
        value = np.where(pair >= 0, self.pair_p[pair] if len(self.pairs) else 0.0, fall + root)
        fail = np.where(state_pair >= 0, self.pair_back[state_pair] if len(self.pairs) else 0.0, 0.0)
        value = np.where(triple >= 0, self.triple_p[triple] if len(self.triples) else 0.0, fail + value)
        return w, root, value
