"""All phrases of a lexicon found in one pass over a batch of texts.

A goto table over byte classes is built level by level. Texts of a batch lie in one
buffer, which is cut into lanes that are walked side by side, one numpy step for a byte
of every lane. Lanes overlap by the longest phrase; a match across two texts is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LANE_BYTES = 1024
SLICE_BYTES = 1 << 20


class Automaton:
    """``phrases``: distinct, not empty, as UTF-8 bytes. Numbers of phrases are places in it."""

    def __init__(self, phrases: list[bytes]) -> None:
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        data = np.frombuffer(b"".join(phrases), np.uint8)
        self.classes = np.zeros(256, np.int64)  # class 0: bytes of no phrase
        used = np.unique(data)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        levels, at = [], np.zeros(len(phrases), np.int64)
        states, depth, active = 1, 0, np.arange(len(phrases))
        while len(active):
            step = self.classes[data[bounds[active] + depth]]
            keys, inverse = np.unique(at[active] * self.width + step, return_inverse=True)
            at[active] = states + inverse
            levels.append((keys // self.width, keys % self.width, states))
            states, depth = states + len(keys), depth + 1
            active = active[self.lengths[active] > depth]
        self.phrase = np.full(states, -1, np.int64)
        self.phrase[at] = np.arange(len(phrases))
        self.goto = np.zeros((states, self.width), np.int32)
        fail, self.other = np.zeros(states, np.int64), np.zeros(states, np.int64)
        for parents, steps, first in levels:
            own = np.arange(first, first + len(parents))
            fail[own] = np.where(parents > 0, self.goto[fail[parents], steps], 0)
            self.goto[parents, steps] = own
            self.goto[own] = self.goto[fail[own]]
            # the longest shorter phrase that ends here too
            self.other[own] = np.where(self.phrase[fail[own]] >= 0, fail[own], self.other[fail[own]])
        self.ends = (self.phrase >= 0) | (self.other > 0)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, phrase) of every pair that occurs, in that order, each once."""
        if not len(data) or not len(self.lengths):
            return (np.empty(0, np.int64),) * 2
        warm = int(self.lengths.max()) - 1
        lane = max(LANE_BYTES, 4 * warm)
        lanes = -(-len(data) // lane)
        steps = np.zeros(warm + lanes * lane, np.int64)
        steps[warm : warm + len(data)] = self.classes[data]
        flat = self.goto.ravel()
        state = np.zeros(lanes, np.int64)
        places, states = [], []
        for k in range(warm + lane):
            state = flat[state * self.width + steps[k :: lane][:lanes]].astype(np.int64)
            if k >= warm:
                hit = np.flatnonzero(self.ends[state])
                if len(hit):
                    places.append(hit * lane + (k - warm))
                    states.append(state[hit])
        if not places:
            return (np.empty(0, np.int64),) * 2
        place, state = np.concatenate(places), np.concatenate(states)
        pairs = []
        while len(state):
            found = self.phrase[state]
            some = found >= 0
            text = np.searchsorted(offsets, place[some], "right") - 1
            inside = place[some] + 1 - self.lengths[found[some]] >= offsets[text]
            pairs.append((text * len(self.lengths) + found[some])[inside])
            state = self.other[state]
            place, state = place[state > 0], state[state > 0]
        both = np.unique(np.concatenate(pairs))
        return both // len(self.lengths), both % len(self.lengths)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of stretches of about ``SLICE_BYTES``; a null has no bytes."""
    values = texts.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(values):
        end = int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(values))
        yield row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def phrases_of_texts(own: Automaton, texts: pa.Array) -> pa.ListArray:
    """The numbers of the phrases in each text, ascending."""
    rows, found = [], []
    for row, data, offsets in slices(texts):
        text, phrase = own.find(data, offsets)
        rows.append(row + text)
        found.append(phrase)
    rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
    found = np.concatenate(found) if found else np.empty(0, np.int64)
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
