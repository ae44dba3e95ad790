"""A finite automaton run over chunks of many texts side by side, in numpy.

A chunk gives, for each state that it may be entered in, the state that it is left in
and how many events it emits. Such functions compose associatively, so chunks are
scanned without knowing what stands before them; composing them gives each chunk's
entry state and the events before it."""

from __future__ import annotations

import numpy as np

#: Bytes of a chunk; all chunks of a call are scanned byte by byte together.
CHUNK = 256


class Automaton:
    """kind: the class of each byte value; step and emits: [class, state] -> state left
    in, events emitted before the byte; last: events at the end, by state. A text is
    entered in state 0."""

    def __init__(self, kind: np.ndarray, step: np.ndarray, emits: np.ndarray, last: np.ndarray):
        self.states = step.shape[1]
        # one more class fills chunks up and changes nothing
        self.kind, self.fill = kind.astype(np.uint8), len(step)
        self.step = np.concatenate((step, [np.arange(self.states)])).astype(np.int64).ravel()
        self.emits = np.concatenate((emits, np.zeros((1, self.states)))).astype(np.int64).ravel()
        self.last = np.asarray(last, np.int64)


class Scan:
    """The texts that stand one after the other in `data`, of the given lengths."""

    def __init__(self, automaton: Automaton, data: np.ndarray, lengths: np.ndarray):
        self.automaton, self.lengths = automaton, np.asarray(lengths, np.int64)
        chunks = np.maximum(-(-self.lengths // CHUNK), 1)
        self.end = np.cumsum(chunks)
        self.first = self.end - chunks
        # chunks of a text stand together, the last one filled up
        shift = self.first * CHUNK - (np.cumsum(self.lengths) - self.lengths)
        flat = np.full(int(chunks.sum()) * CHUNK, automaton.fill, np.uint8)
        flat[np.arange(len(data)) + np.repeat(shift, self.lengths)] = automaton.kind[data]
        self.columns = np.ascontiguousarray(flat.reshape(-1, CHUNK).T)
        self._compose(chunks)

    def _compose(self, chunks: np.ndarray) -> None:
        """after[s, c], count[s, c]: where a text that is entered in state s stands
        behind its chunk c, and the events so far."""
        a, n = self.automaton, self.columns.shape[1]
        after = np.repeat(np.arange(a.states)[:, None], n, 1)
        count = np.zeros((a.states, n), np.int64)
        for kinds in self.columns:
            at = kinds.astype(np.int64) * a.states + after
            count += a.emits[at]
            after = a.step[at]
        first, d = np.repeat(self.first, chunks), 1
        while d < chunks.max(initial=1):
            right = np.flatnonzero(np.arange(n) - d >= first)
            f = after[:, right - d]
            total = count[:, right - d] + np.take_along_axis(count[:, right], f, 0)
            after[:, right] = np.take_along_axis(after[:, right], f, 0)
            count[:, right] = total
            d *= 2
        self.after, self.count = after, count

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """[text, state]: the state that each text is left in, and its events without
        those at the end."""
        return self.after[:, self.end - 1].T, self.count[:, self.end - 1].T

    def find(self, entry: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The byte before which each text, entered in `entry`, emits the event of this
        number, counted from 1; 0 for number 0, the text's length beyond its last."""
        a, texts = self.automaton, len(self.lengths)
        owner = np.repeat(np.arange(texts), self.end - self.first)
        so_far = self.count[entry[owner], np.arange(len(owner))]
        base = int(max(so_far.max(initial=0), number.max(initial=0))) + 1
        # counts rise inside a text: one search finds all chunks
        chunk = np.searchsorted(owner * base + so_far, np.arange(texts) * base + number)
        wanted = np.flatnonzero((number > 0) & (chunk < self.end))
        at = chunk[wanted]
        inside = at > self.first[wanted]
        state = np.where(inside, self.after[entry[wanted], at - 1], entry[wanted])
        need = number[wanted] - np.where(inside, so_far[at - 1], 0)
        place = np.zeros(len(wanted), np.int64)
        for i, kinds in enumerate(self.columns[:, at]):
            k = kinds.astype(np.int64) * a.states + state
            hit = (a.emits[k] > 0) & (need > 0)
            need = need - hit
            place[hit & (need == 0)] = i
            state = a.step[k]
        out = np.where(number > 0, self.lengths, 0)
        out[wanted] = (at - self.first[wanted]) * CHUNK + place
        return out
