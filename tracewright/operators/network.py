"""Selection programs that are network flows, in the memory of one task.

Where an equation says that the sum of n variables is n times another sum, its n variables are
equal (the other sum is 0 or 1) and become one. If then, after scaling, every variable stands with
+1 in at most one equation and with -1 in at most one, the equations are the balance of a network:
a variable is an arc of capacity one from the equation it leaves to the one it enters, and variables
without one or the other come from a source or go to a drain. An incidence matrix is totally
unimodular, so the heaviest flow is an exact optimum. It is found by longest augmenting paths, after
nodes that carry one unit are contracted and parallel arcs beyond what their ends can carry are
dropped. Equal totals are then told apart on the whole network.

All arithmetic is on whole numbers: doubles are scaled by a power of two (``whole``), in 64 bits
where their sum fits and in Python's integers where not. Each path's places are then exact sums, and
a place's best was met before the places it leads to, so a walk back along a path always ends.
"""

from __future__ import annotations

import heapq
from math import gcd

import numpy as np

Rows = list[dict[int, int]]
SOURCE, DRAIN, SINK = 0, 1, 2


def whole(weights: list[float]) -> tuple[list[int], int]:
    """Doubles as whole numbers times 2**-shift, exactly, and the shift."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    shift = max((d.bit_length() - 1 for _, d in ratios), default=0)
    return [n << (shift - d.bit_length() + 1) for n, d in ratios], shift


def numbers(weights: list[int]) -> np.ndarray:
    """Whole numbers as an array whose sums, several times over, are exact."""
    return np.array(weights, np.int64 if sum(map(abs, weights)) < 1 << 58 else object)


def merged(n: int, rows: Rows) -> tuple[list[int], Rows] | None:
    """(class of each variable, rows over classes with coefficients of +1 and -1), or None."""
    head = list(range(n))

    def find(v: int) -> int:
        while head[v] != v:
            head[v] = head[head[v]]
            v = head[v]
        return v

    for row in rows:
        plus = [v for v, c in row.items() if c > 0]
        minus = {-c for c in row.values() if c < 0}
        if len(plus) > 1 and all(row[v] == 1 for v in plus) and minus == {len(plus)}:
            for v in plus[1:]:
                head[find(v)] = find(plus[0])
    out = []
    for row in rows:
        sums: dict[int, int] = {}
        for v, c in row.items():
            sums[find(v)] = sums.get(find(v), 0) + c
        sums = {v: c for v, c in sums.items() if c}
        if not sums:
            continue
        scale = gcd(*map(abs, sums.values()))
        if any(abs(c) != scale for c in sums.values()):
            return None
        out.append({v: c // scale for v, c in sums.items()})
    return [find(v) for v in range(n)], out


def arcs(weights: list[int], rows: Rows, sink: dict[int, int]) -> tuple | None:
    """(tail, head, weight, variables) of the network's arcs and the number of nodes, or None."""
    found = merged(len(weights), rows)
    if found is None or any(c != 1 for c in sink.values()):
        return None
    kind, rows = found
    members: dict[int, list[int]] = {}
    for v, k in enumerate(kind):
        members.setdefault(k, []).append(v)
    tail, head = dict.fromkeys(members, SOURCE), dict.fromkeys(members, DRAIN)
    for node, row in enumerate(rows, 3):
        for v, c in row.items():
            side = head if c > 0 else tail
            if side[v] > 2:
                return None
            side[v] = node
    for v in sink:
        if head[kind[v]] != DRAIN or len(members[kind[v]]) > 1:
            return None
        head[kind[v]] = SINK
    order = sorted(members)
    return (
        np.array([tail[v] for v in order]), np.array([head[v] for v in order]), numbers([sum(weights[x] for x in members[v]) for v in order]), [members[v] for v in order], len(rows) + 3,
    )


def _has_cycle(ends: list[tuple[int, int]], n: int) -> bool:
    ahead: list[list[int]] = [[] for _ in range(n)]
    open_ = [0] * n
    for a, b in ends:
        if a > 2 and b > 2:
            ahead[a].append(b)
            open_[b] += 1
    ready = [k for k in range(n) if not open_[k]]
    seen = 0
    while ready:
        k = ready.pop()
        seen += 1
        for b in ahead[k]:
            open_[b] -= 1
            if not open_[b]:
                ready.append(b)
    return seen < n


def _joined(tail, head, weight, members, n):
    """One pass of contraction. A node with one way out goes where that way leads to a node with one
    way out too: that node carries one unit at most, so the ways in exclude each other there as well.
    The same holds backwards, and for any node with one way in and one way out."""
    for back in (False, True):
        into, out = np.bincount(head, minlength=n), np.bincount(tail, minlength=n)
        a, b, one, ways = (head, tail, into, out) if back else (tail, head, out, into)
        far = b.copy()  # of the node's one arc: the end away from it
        goes = (one[a] == 1) & (a > 2) & (a != far) & ((ways[a] == 1) | ((far > 2) & (one[far] == 1)))
        node = np.zeros(n, bool)
        node[a[goes]] = True
        goes &= ~node[far]  # the last of a chain goes first
        arc = np.full(n, -1)
        arc[a[goes]] = np.flatnonzero(goes)
        moved = np.flatnonzero(arc[b] >= 0)
        by = arc[b[moved]]
        weight = weight.copy()
        weight[moved] += weight[by]
        for k, o in zip(moved.tolist(), by.tolist(), strict=True):
            members[k] = members[k] + members[o]
        b = b.copy()
        b[moved] = far[by]
        keep = np.flatnonzero(~goes)
        tail, head = (b[keep], a[keep]) if back else (a[keep], b[keep])
        weight, members = weight[keep], [members[k] for k in keep.tolist()]
    return tail, head, weight, members


def _pruned(tail, head, weight, members, n):
    """Of parallel arcs as many of the heaviest as their ends can carry."""
    into, out = np.bincount(head, minlength=n), np.bincount(tail, minlength=n)
    carry = np.minimum(into, out)
    carry[:3] = len(tail)
    order = np.lexsort((-weight, head, tail))
    first = np.concatenate(([True], (tail[order][1:] != tail[order][:-1]) | (head[order][1:] != head[order][:-1])))
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    keep = np.sort(order[place < np.minimum(carry[tail[order]], carry[head[order]])])
    return tail[keep], head[keep], weight[keep], [members[k] for k in keep.tolist()]


def reduced(tail, head, weight, members, n):
    """The same network with fewer arcs."""
    made, size = (tail, head, weight, list(members)), -1
    while len(made[0]) not in (0, size):
        size = len(made[0])
        made = _pruned(*_joined(*made, n), n)
    return made


def _best(a, b, gain, n, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The heaviest walks from the start nodes (0 each) along arcs without a gaining cycle: for each
    node whether it is reached, the walk's gain and its last arc."""
    best, by, reached = np.zeros(n, gain.dtype), np.full(n, -1), np.zeros(n, bool)
    reached[start] = True
    fixed = reached.copy()
    for _ in range(n + 1):
        arc = np.flatnonzero(reached[a] & ~fixed[b])
        to, reach = b[arc], best[a[arc]] + gain[arc]
        order = np.lexsort((arc, -reach, to)) if gain.dtype != object else np.array(sorted(range(len(arc)), key=lambda k: (to[k], -reach[k], arc[k])), int)
        arc, to, reach = arc[order], to[order], reach[order]
        top = np.concatenate(([True], to[1:] != to[:-1])) if len(to) else np.zeros(0, bool)
        arc, to, reach = arc[top], to[top], reach[top]
        better = (~reached[to] | (reach > best[to])).astype(bool)
        if not better.any():
            return reached, best, by
        by[to[better]], best[to[better]], reached[to[better]] = arc[better], reach[better], True
    raise ArithmeticError("a cycle gains")


def _augmented(tail, head, weight, n):
    """Which arcs the heaviest flow takes. Without a directed cycle: longest augmenting paths from
    the source to the drain while they gain. With one: all arcs that gain are taken, and what nodes
    then have too much goes on along the paths that lose least."""
    used, outside = np.zeros(len(tail), bool), [SOURCE, DRAIN]

    def turned():
        return np.where(used, head, tail), np.where(used, tail, head), np.where(used, -weight, weight)

    def flip(by, a, at, ends):
        while at not in ends:
            k = by[at]
            used[k] = ~used[k]
            at = a[k]
        return at

    if not _has_cycle(list(zip(tail.tolist(), head.tolist(), strict=True)), n):
        while True:
            a, b, gain = turned()
            reached, best, by = _best(a, b, gain, n, [SOURCE])
            if not (reached[DRAIN] and best[DRAIN] > 0):
                return used
            flip(by, a, DRAIN, [SOURCE])
    used = (weight > 0).astype(bool)
    while True:
        over = np.bincount(head[used], minlength=n) - np.bincount(tail[used], minlength=n)
        over[outside] = 0
        if not over.any():
            return used
        a, b, gain = turned()
        more, less = np.flatnonzero(over > 0).tolist(), np.flatnonzero(over < 0).tolist()
        reached, best, by = _best(a, b, gain, n, [*more, *outside])  # from where there is too much
        ends = [x for x in less if reached[x]] or [x for x in outside if reached[x]]
        if less:
            flip(by, a, max(ends, key=lambda x: best[x]), [*more, *outside])
            continue
        reached, best, by = _best(a, b, gain, n, more[:1])
        flip(by, a, max((x for x in outside if reached[x]), key=lambda x: best[x]), more[:1])


def potentials(tail, head, weight, n, used) -> np.ndarray:
    """A price for each node, 0 for source and drain, under which no arc that is left out gains and
    none that is taken loses: the proof that no flow with as many units in the sink is heavier."""
    tail, head = np.where(tail == DRAIN, SOURCE, tail), np.where(head == DRAIN, SOURCE, head)  # flow goes round
    a, b, gain = np.where(used, head, tail), np.where(used, tail, head), np.where(used, -weight, weight)
    high = np.zeros(n, weight.dtype)
    for _ in range(n + 2):
        top = high.copy()
        np.maximum.at(top, b, high[a] + gain)
        if (top == high).all():
            return high - high[SOURCE]
        high = top
    raise ArithmeticError("the flow is not the heaviest")


def _smallest(tail, head, weight, members, n, used):
    """Of all flows as heavy as this one, that which takes the smallest variables. Two such flows
    differ by cycles of no gain, which lie on arcs that the potentials make tight."""
    price = potentials(tail, head, weight, n, used)
    price[DRAIN] = 0
    tied = np.flatnonzero((weight + price[tail] == price[head]).astype(bool))
    return smallest(tail, head, [m[0] for m in members], n, used, tied)


def smallest(tail, head, key, n, used, tied):
    """used after all cycles among the tied arcs that take a smaller key in, smallest first."""
    tail, head = np.where(tail == DRAIN, SOURCE, tail), np.where(head == DRAIN, SOURCE, head)
    a, b = np.where(used, head, tail), np.where(used, tail, head)
    while True:
        into, out = np.bincount(b[tied], minlength=n), np.bincount(a[tied], minlength=n)
        left = tied[(into[a[tied]] > 0) & (out[b[tied]] > 0)]
        if len(left) == len(tied):
            break
        tied = left
    used, free = used.copy(), set(tied.tolist())
    at: dict[int, list[int]] = {}
    for k in free:
        for end in {int(tail[k]), int(head[k])}:
            at.setdefault(end, []).append(k)
    for k in sorted(free, key=lambda k: key[k]):
        free.discard(k)
        if used[k]:
            continue
        goal, came, todo = int(tail[k]), {int(head[k]): -1}, [int(head[k])]
        while todo and goal not in came:
            x = todo.pop()
            for o in at.get(x, ()):
                y = int(tail[o] if used[o] else head[o])
                if o in free and x == (head[o] if used[o] else tail[o]) and y not in came:
                    came[y] = o
                    todo.append(y)
        if goal not in came:
            continue
        used[k], x = True, goal
        while came[x] >= 0:
            o = came[x]
            x = int(head[o] if used[o] else tail[o])
            used[o] = ~used[o]
    return used


def cheapest_turn(tail, head, weight, n, used, price) -> tuple[int, list[int]] | None:
    """(loss, arcs): the arcs to turn over that give the next heaviest flow with as many units in the
    sink. Two flows differ by cycles of arcs left out and arcs taken backwards, each losing what its
    arcs are off at the potentials; the next flow differs by the one that loses least."""
    tail, head = np.where(tail == DRAIN, SOURCE, tail), np.where(head == DRAIN, SOURCE, head)
    price = price.copy()
    price[DRAIN] = 0
    a, b = np.where(used, head, tail).tolist(), np.where(used, tail, head).tolist()
    loss = [abs(int(x)) for x in (weight + price[tail] - price[head]).tolist()]
    ways: list[list[int]] = [[] for _ in range(n)]
    for k, x in enumerate(a):
        ways[x].append(k)
    best: tuple[int, list[int]] | None = None
    for first in sorted(range(len(a)), key=lambda k: loss[k]):
        if best is not None and loss[first] >= best[0]:
            break
        # the rest of the cycle: the shortest way back, over arcs that lose no less
        near, by, todo = {b[first]: loss[first]}, {}, [(loss[first], b[first])]
        while todo:
            far, x = heapq.heappop(todo)
            if far > near[x] or (best is not None and far >= best[0]):
                continue
            if x == a[first]:
                path = [first]
                while x != b[first]:
                    path.append(by[x])
                    x = a[by[x]]
                best = (far, path)
                break
            for k in ways[x]:
                y, d = b[k], far + loss[k]
                if loss[k] >= loss[first] and d < near.get(y, d + 1):
                    near[y], by[y] = d, k
                    heapq.heappush(todo, (d, y))
    return best


def _holds(chosen: list[int], rows: Rows, sink: dict[int, int], units: int) -> bool:
    found = set(chosen)
    return sum(c for v, c in sink.items() if v in found) == (units if sink else 0) and all(sum(c for v, c in row.items() if v in found) == 0 for row in rows)


def flow(tail, head, weight, n, units) -> np.ndarray | None:
    """Which arcs a heaviest flow takes with `units` (0 or 1) into the sink; None if there is none."""
    used = np.zeros(len(tail), bool)
    alone = (tail == SOURCE) & (head == DRAIN)  # bound by nothing
    used[alone] = (weight[alone] > 0).astype(bool)
    bound = np.flatnonzero(~alone & (units | (head != SINK)).astype(bool))
    if not len(bound):
        return None if units else used
    t, h, w, m = reduced(tail[bound], head[bound], weight[bound], [[k] for k in bound.tolist()], n)
    if units:
        bonus = 2 * int(np.abs(weight).sum()) + 1
        w = numbers([*w.tolist(), bonus])
        t, h, m = np.append(t, SINK), np.append(h, DRAIN), [*m, []]
    nodes, ends = np.unique(np.concatenate(([SOURCE, DRAIN, SINK], t, h)), return_inverse=True)
    taken = _augmented(ends[3 : 3 + len(t)], ends[3 + len(t) :], w, len(nodes))
    if units and not taken[-1]:
        return None
    for k in np.flatnonzero(taken).tolist():
        used[m[k]] = True
    return used


def heaviest(weights: list[float], rows: Rows, sink: dict[int, int], units: int) -> tuple[float, list[int]] | bool | None:
    """The best choice with `units` (0 or 1) into the sink, of equal ones the smallest list; False
    if there is none, None if the program is no network. The total is the exact one, rounded once."""
    exact, shift = whole(weights)
    made = arcs(exact, rows, sink)
    if made is None:
        return None
    tail, head, weight, members, n = made
    if units == 0:
        keep = np.flatnonzero(head != SINK)
        tail, head, weight, members = tail[keep], head[keep], weight[keep], [members[k] for k in keep.tolist()]
    if not len(tail):
        return False if units else (0.0, [])
    used = flow(tail, head, weight, n, units)
    if used is None:
        return False
    used = _smallest(tail, head, weight, members, n, used)
    chosen = sorted(v for k in np.flatnonzero(used).tolist() for v in members[k])
    end = len(chosen)
    while end and weights[chosen[end - 1]] == 0:
        end -= 1
    chosen = next(chosen[:k] for k in range(end, len(chosen) + 1) if k == len(chosen) or _holds(chosen[:k], rows, sink, units))
    return sum(exact[v] for v in chosen) / (1 << shift), chosen
