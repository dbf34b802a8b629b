"""A generalised suffix automaton over token sequences, and matching statistics of many streams at once."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """All substrings of the sequences. goto[s, t] and reach[s, t] are the state and match length after token t in state s; a reach of
    -1 means one more than before. ends[s] lists (sequence, end position) of the occurrences of state s."""

    def __init__(self, sequences: list[list[int]], tokens: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                own += [[] for _ in range(len(self.next) - len(own))]
                own[last].append((number, place))
        n = len(self.next)
        order = sorted(range(n), key=self.size.__getitem__)
        self.ends = own
        for s in reversed(order[1:]):  # what ends in a state ends in its suffixes too
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})
        self.goto, self.reach = np.zeros((n, tokens), np.int32), np.zeros((n, tokens), np.int32)
        for s in order:
            if s:
                up = self.link[s]
                self.goto[s] = self.goto[up]
                self.reach[s] = np.where(self.reach[up] < 0, self.size[up] + 1, self.reach[up])
            for token, to in self.next[s].items():
                self.goto[s, token], self.reach[s, token] = to, -1

    def _copy(self, of: int, size: int) -> int:
        self.next.append(dict(self.next[of]))
        self.size.append(size)
        self.link.append(self.link[of])
        return len(self.next) - 1

    def _redirect(self, p: int, token: int, old: int, new: int) -> None:
        while p >= 0 and self.next[p].get(token) == old:
            self.next[p][token] = new
            p = self.link[p]

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            if self.size[q] == self.size[last] + 1:
                return q
            twin = self._copy(q, self.size[last] + 1)
            self.link[q] = twin
            self._redirect(last, token, q, twin)
            return twin
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        new, p = len(self.next) - 1, last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            if self.size[q] != self.size[p] + 1:
                twin = self._copy(q, self.size[p] + 1)
                self.link[q] = twin
                self._redirect(p, token, q, twin)
                q = twin
            self.link[new] = q
        return new

    def state_of(self, sequence: list[int]) -> int:
        s = 0
        for token in sequence:
            s = self.next[s][token]
        return s

    def having_suffix(self, state: int) -> np.ndarray:
        """Which states' strings end in those of `state`: the state itself and all below it in the tree of links."""
        out = np.zeros(len(self.next), bool)
        out[state] = True
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            out[s] |= out[self.link[s]]
        return out

    def matching(self, token: np.ndarray, longest: int, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """State and match length after each entry of token; -1 entries belong to no sequence and end every match.

        Runs of known tokens are walked in lockstep. A long run is cut into chunks that start `longest` tokens early: no match is longer,
        so that the statistics from the chunk's own start on are exact.
        """
        state, length = np.zeros(len(token), np.int32), np.zeros(len(token), np.int32)
        known = np.concatenate([[False], token >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        first, last = edge[::2], edge[1::2]
        parts = np.maximum(1, -(-(last - first) // chunk))
        run = np.repeat(np.arange(len(first)), parts)
        k = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        own = first[run] + k * chunk
        end = np.minimum(own + chunk, last[run])
        at = np.maximum(own - longest, first[run])
        order = np.argsort(at - end, kind="stable")  # the longest first: those still walking are a prefix
        own, end, at = own[order], end[order], at[order]
        s, n = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        walking = len(at)
        step = 0
        while walking:
            place = at[:walking] + step
            t = token[place]
            r = self.reach[s[:walking], t]
            n[:walking] = np.where(r < 0, n[:walking] + 1, r)
            s[:walking] = self.goto[s[:walking], t]
            mine = place >= own[:walking]
            state[place[mine]], length[place[mine]] = s[:walking][mine], n[:walking][mine]
            step += 1
            walking = int(np.searchsorted(at - end, -step, side="left"))
        return state, length
