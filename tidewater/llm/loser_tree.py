"""A loser tree: merges k sorted runs with one comparison a level."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def merge(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in one order; equal items in order of the runs.

    Inner nodes hold the loser of the match below them and the root's winner is
    the next item. Its run's next item then plays the losers on the way up."""
    its = [iter(r) for r in runs]
    k = len(its)
    if not k:
        return
    heads: list = [next(it, None) for it in its]
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def play(run: int) -> int:
        node, winner = (run + k) // 2, run
        while node:
            if losers[node] < 0:
                losers[node] = winner
                return -1  # waits for its opponent: only while the tree is built
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        return winner

    winner = -1
    for run in range(k):
        winner = max(winner, play(run)) if winner < 0 else winner
    while heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(its[winner], None)
        winner = play(winner)
