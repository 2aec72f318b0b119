"""A suffix automaton of some texts, and the matching statistics of other texts against it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """All substrings of the given pieces; a match never runs over the border of two pieces."""

    def __init__(self, pieces: Sequence[str]) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        self.place: list[tuple[int, int]] = []
        last, total = 0, 0
        for number, piece in enumerate(pieces):
            self.place.append((total, number))
            for c in piece:
                last = self._extend(c, last, total)
                total += 1
            last = self._extend(number, last, total)  # a number is no character: nothing matches it
            total += 1

    def _extend(self, c, last: int, at: int) -> int:
        nxt, link, length, end = self.next, self.link, self.length, self.end
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(at)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            return new
        q = nxt[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        end.append(end[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = link[new] = clone
        return new

    def maximal_spans(self, text: str, least: int) -> Iterator[tuple[int, int, int]]:
        """(start in text, length, end in the pieces' joint numbering) of the matches that
        cannot be extended, of at least ``least`` characters."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, c in enumerate(text):
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
                continue
            if matched >= least:
                yield i - matched, matched, self.end[state] + 1
            while state >= 0 and c not in nxt[state]:
                state = link[state]
            if state < 0:
                state = matched = 0
            else:
                matched = length[state] + 1
                state = nxt[state][c]
        if matched >= least:
            yield len(text) - matched, matched, self.end[state] + 1
