"""Cheapest repair of a run of turns, by Wagner-Fischer tables against an alternating grammar string.

A turn is (initial of its role, fault). The repaired turns must read `s?(ua)+` or be none. Edits, with
their letters in an audit: K keep, R give the role that the grammar wants, D delete, I insert.

One table holds the costs of aligning the turns from the i-th on with the last k roles of the grammar
string. Strings of different lengths end alike, so their tables are parts of one another, and the row
of the first turn has the cost of every feasible length. A greedy repair gives the incumbent cost; only
cells that can lie on a repair of at most that cost are filled (Ukkonen's band). Because a table is
filled from the last turn, it is traced from the first one, and of equally cheap steps the one whose
letter comes first gives the least audit of a length. Audits of equally cheap lengths are compared.

Long runs are cut into segments. What a segment needs to know of those before it is only how their
roles ended, one of four states, so segments are aligned apart, for each state, and put together. Each
audit of a segment ends with the letter of a turn, so none is the start of another one, and the least
audit of the whole is made of least audits of the segments.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

SEGMENT = 256

NONE, TRUNCATED, FORCED = range(3)  # faults; blank and duplicate turns are forced out

# What the turns so far read: nothing, the system turn, a user's turn last, an assistant's turn last.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STATES = (BEGIN, SYSTEM, USER, ASSISTANT)

# Costs of the edits.
CHANGE, DELETE, INSERT, KEEP_TRUNCATED = 3, 4, 3, 3

# Turns missing at the end.
_MISSING = {BEGIN: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

# From any state one can go on as from a user's or assistant's turn at no more than this extra cost.
_MARGIN = 8

Turn = tuple[str, int]
Ways = dict[tuple[int, int], tuple[int, str]]


def wanted(state: int) -> str:
    return "a" if state == USER else "u"


def _greedy(turns: list[Turn], start: int) -> tuple[int, int]:
    """(cost, end) of a repair that inserts where a role is out of turn."""
    cost, state = 0, start
    for initial, fault in turns:
        if fault == FORCED:
            cost += DELETE
            continue
        cost += KEEP_TRUNCATED * (fault == TRUNCATED)
        if initial == "s" and state == BEGIN:
            state = SYSTEM
        elif initial in ("u", "a"):
            cost += INSERT * (initial != wanted(state))
            state = USER if initial == "u" else ASSISTANT
        else:
            cost += CHANGE
            state = ASSISTANT if wanted(state) == "a" else USER
    return cost, state


class _Table:
    """Costs of turns i.. against the last k roles of a string that ends in `end`."""

    def __init__(self, turns: list[Turn], end: int, incumbent: int) -> None:
        self.turns, self.last = turns, "u" if end == USER else "a"
        self.first = "a" if end == USER else "u"  # the role of an even place from the end
        forced = sum(f == FORCED for _, f in turns)
        cut = sum(f == TRUNCATED for _, f in turns)
        spare = incumbent - DELETE * forced - KEEP_TRUNCATED * cut
        more = spare // INSERT
        # A turn deleted by choice costs 4, or 1 more than a truncated one that stays.
        less = min(spare, cut + max(0, spare - cut) // DELETE)
        size = len(turns)
        self.low, self.rows = [0] * (size + 1), [[]] * (size + 1)
        self.rows[size] = [0]
        left = 0  # turns from i on that may stay
        for i in range(size - 1, -1, -1):
            initial, fault = turns[i]
            left += fault != FORCED
            low, high = max(0, left - less), left + more
            below, below_low = self.rows[i + 1], self.low[i + 1]
            row, before = [], None
            for k in range(low, high + 1):
                at = k - below_low
                best = below[at] + DELETE if 0 <= at < len(below) and below[at] is not None else None
                if before is not None and (best is None or before + INSERT < best):
                    best = before + INSERT
                if fault != FORCED and 1 <= at <= len(below) and below[at - 1] is not None:
                    step = below[at - 1] + self.stay(i, k)
                    if best is None or step < best:
                        best = step
                row.append(best)
                before = best
            self.low[i], self.rows[i] = low, row

    def role(self, k: int) -> str:
        return self.last if k & 1 else self.first

    def stay(self, i: int, k: int) -> int:
        initial, fault = self.turns[i]
        return (CHANGE if initial != self.role(k) else 0) + (KEEP_TRUNCATED if fault == TRUNCATED else 0)

    def cost(self, i: int, k: int) -> int | None:
        row, at = self.rows[i], k - self.low[i]
        return row[at] if 0 <= at < len(row) else None

    def lengths(self, i: int, first: str, least: int) -> Iterator[tuple[int, int]]:
        """(cost, k) of the strings of at least `least` roles whose first role is `first`."""
        for at, cost in enumerate(self.rows[i]):
            k = at + self.low[i]
            if cost is not None and k >= least and (k == 0 or self.role(k) == first):
                yield cost, k

    def audit(self, i: int, k: int) -> str:
        """The least audit among the cheapest ones from this cell."""
        out, size = [], len(self.turns)
        while i < size or k:
            cost = self.cost(i, k)
            below = self.cost(i + 1, k) if i < size else None
            if below is not None and below + DELETE == cost:
                out.append("D")
                i += 1
                continue
            beside = self.cost(i, k - 1) if k else None
            if beside is not None and beside + INSERT == cost:
                out.append("I")
                k -= 1
                continue
            out.append("K" if self.turns[i][0] == self.role(k) else "R")
            i, k = i + 1, k - 1
        return "".join(out)


def segment_ways(turns: list[Turn], starts: Iterable[int]) -> Ways:
    """(cost, least audit) by start and end state; audits end with the letter of a turn. `turns` is not empty."""
    starts, size, out = list(starts), len(turns), {}
    greedy = {start: _greedy(turns, start) for start in starts}
    for end in (USER, ASSISTANT):
        # Six more than the greedy cost are enough to end otherwise: an insert and a change, or two inserts.
        table = _Table(turns, end, max(cost + (0 if at == end else 2 * CHANGE) for cost, at in greedy.values()))
        for start in starts:
            options = [(cost, k, -1) for cost, k in table.lengths(
                0, wanted(start), 0 if start == end else 1)]
            if start == BEGIN:  # the system turn is the first one that stays
                for i, (initial, fault) in enumerate(turns):
                    if initial == "s" and fault != FORCED:
                        own = DELETE * i + KEEP_TRUNCATED * (fault == TRUNCATED)
                        options += [(own + cost, k, i) for cost, k in table.lengths(i + 1, "u", 1)]
            if options:
                cost = min(o[0] for o in options)
                out[start, end] = cost, min(
                    table.audit(0, k) if i < 0 else "D" * i + "K" + table.audit(i + 1, k)
                    for c, k, i in options if c == cost)
    for start in (BEGIN, SYSTEM):
        if start in starts:
            out[start, start] = DELETE * size, "D" * size
    if BEGIN in starts:
        kept = [(DELETE * (size - 1) + KEEP_TRUNCATED * (fault == TRUNCATED), "D" * i + "K" + "D" * (size - 1 - i))
                for i, (initial, fault) in enumerate(turns) if initial == "s" and fault != FORCED]
        if kept:
            out[BEGIN, SYSTEM] = min(kept)
    return out


def _joined(best: dict[int, tuple[int, str]], ways: Ways) -> dict[int, tuple[int, str]]:
    out: dict[int, tuple[int, str]] = {}
    for (start, end), (cost, audit) in ways.items():
        if start in best:
            whole = best[start][0] + cost, best[start][1] + audit
            if end not in out or whole < out[end]:
                out[end] = whole
    limit = min((out[s][0] for s in (USER, ASSISTANT) if s in out), default=None)
    return {s: w for s, w in out.items() if limit is None or w[0] <= limit + _MARGIN}


def run_ways(turns: list[Turn], start: int) -> dict[int, tuple[int, str]]:
    """(cost, least audit) by end state, of a run of any length."""
    best = {start: (0, "")}
    for first in range(0, len(turns), SEGMENT):
        best = _joined(best, segment_ways(turns[first:first + SEGMENT], list(best)))
    return best


def completed(best: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation: turns missing at its end are inserted."""
    return min((cost + INSERT * _MISSING[s], audit + "I" * _MISSING[s]) for s, (cost, audit) in best.items())


def joined_runs(runs: list[Ways]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, per run its start state and audit) of a conversation whose runs were aligned apart."""
    best: dict[int, tuple[int, str, tuple]] = {BEGIN: (0, "", ())}
    for ways in runs:
        out: dict[int, tuple[int, str, tuple]] = {}
        for (start, end), (cost, audit) in ways.items():
            if start in best:
                before = best[start]
                whole = before[0] + cost, before[1] + audit, (*before[2], (start, audit))
                if end not in out or whole[:2] < out[end][:2]:
                    out[end] = whole
        best = out
    cost, _, pieces, missing = min(
        (w[0] + INSERT * _MISSING[s], w[1] + "I" * _MISSING[s], w[2], _MISSING[s]) for s, w in best.items())
    start, last = pieces[-1]
    return cost, [*pieces[:-1], (start, last + "I" * missing)]


def repaired(turns: Iterable[tuple[str, str]], audit: str, start: int = BEGIN) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that an audit leaves."""
    own, state = iter(turns), start
    for letter in audit:
        if letter == "D":
            next(own)
            continue
        role, text = ("", "") if letter == "I" else next(own)
        if letter == "K" and state == BEGIN and role[:1] == "s":
            state = SYSTEM
        else:
            if letter != "K":
                role = "assistant" if state == USER else "user"
            state = ASSISTANT if state == USER else USER
        yield role, text
