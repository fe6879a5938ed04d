"""Finite automata over long sequences: maps from entry to exit states, composed by a parallel scan.

A sequence of symbols is cut into lanes of equal length. All lanes are run side by side from every
state at once, which gives each lane's map. Maps compose associatively, so the states in which lanes
are entered come from a prefix scan that doubles its reach in each round. Only then is each lane run
once more from its own entry state, to see what its transitions emit.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a lane.
LANE = 128


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """``maps[s, k]``: the state after lane k when entered in s. Gives the same for lanes 0 to k."""
    out, reach = maps.astype(np.intp), 1
    while reach < out.shape[1]:
        out[:, reach:] = np.take_along_axis(out[:, reach:], out[:, :-reach], axis=0)
        reach *= 2
    return out


class Scan:
    """One pass of an automaton over ``symbols``. ``table[symbol, state]`` is the next state."""

    def __init__(self, table: np.ndarray, symbols: np.ndarray, lane: int = LANE):
        kinds, self.states = table.shape
        if (kinds + 1) * self.states >= 1 << 15:
            raise ValueError("the automaton is too large")
        self.count, self.lane = len(symbols), lane
        # A symbol more that leaves every state as it is fills the last lane.
        self.table = np.concatenate([table, np.arange(self.states, dtype=table.dtype)[None]]).astype(np.int16).ravel()
        self.lanes = max(1, -(-len(symbols) // lane))
        padded = np.full(self.lanes * lane, kinds, dtype=np.int16)
        padded[: len(symbols)] = symbols
        self.columns = np.ascontiguousarray(padded.reshape(self.lanes, lane).T)
        self.columns *= np.int16(self.states)
        state = np.repeat(np.arange(self.states, dtype=np.int16)[:, None], self.lanes, axis=1)
        for column in self.columns:
            state = self.table[column + state]
        self.upto = prefix_maps(state)

    def exit(self, state: int) -> int:
        """The state after all symbols, begun in ``state``."""
        return int(self.upto[state, -1])

    def states_before(self, state: int) -> np.ndarray:
        """The state before each symbol, begun in ``state``."""
        now = np.concatenate([[state], self.upto[state, :-1]]).astype(np.int16)
        out = np.empty((self.lane, self.lanes), dtype=np.int8)
        for k, column in enumerate(self.columns):
            out[k] = now
            now = self.table[column + now]
        return out.T.ravel()[: self.count]
