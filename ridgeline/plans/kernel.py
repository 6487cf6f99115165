"""Path search in memory, on one compact graph: pure numpy and heapq, no Spark. Seeded, so results repeat.

An edge takes 28 to 44 bytes (arrays only, 32-bit where values allow), a search what it reaches, a whole map 8 bytes a state.
"""

from __future__ import annotations

import heapq
import time
from array import array
from dataclasses import dataclass
from enum import IntEnum

import numpy as np

INFINITE = 1 << 62
#: A map goes state by state below FEW open states, and by arrays from MANY on.
FEW, MANY = 16, 64


class Duplicates(IntEnum):
    """What a route may pass twice: anything, no directed edge, or no road in either direction."""

    IGNORE = 0
    DIRECTED = 1
    UNDIRECTED = 2


@dataclass
class Path:
    edges: list[int]
    length: int
    elevation: int
    optimal: bool = False


class Adjacent:
    """The edges at each node, as slices of one permutation."""

    def __init__(self, order: np.ndarray, cuts: np.ndarray):
        self.order, self.cuts = order, cuts
        self._order, self._cuts = memoryview(order), memoryview(cuts)

    @classmethod
    def of(cls, end: np.ndarray, n: int) -> Adjacent:
        return cls(narrow(np.argsort(end, kind="stable")), narrow(np.concatenate([[0], np.cumsum(np.bincount(end, minlength=n))])))

    def __getitem__(self, k: int) -> memoryview:
        return self._order[self._cuts[k] : self._cuts[k + 1]]

    def all(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges at all these nodes, one node after another, and how many each has."""
        first = self.cuts[nodes].astype(np.int64)
        size = self.cuts[nodes + 1] - first
        ends = np.cumsum(size)
        return self.order[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class Turns:
    """Pairs of edges that may not follow each other: sorted codes, and which edges begin one."""

    def __init__(self, codes: np.ndarray, edges: int):
        self.codes, self.edges = codes, edges
        ruled = np.zeros(edges, bool)
        ruled[codes // max(edges, 1)] = True
        self.ruled, self.begins = ruled, memoryview(ruled)

    def __contains__(self, pair: tuple[int, int]) -> bool:
        if not self.begins[pair[0]]:
            return False
        code = pair[0] * self.edges + pair[1]
        k = int(np.searchsorted(self.codes, code))
        return k < len(self.codes) and int(self.codes[k]) == code

    def __len__(self) -> int:
        return len(self.codes)

    def hold(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Which of these pairs are among them."""
        found = self.ruled[before]
        some = np.flatnonzero(found)
        if len(some):
            code = before[some].astype(np.int64) * self.edges + after[some]
            found[some] = self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
        return found


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in 32 bits, if they fit."""
    fits = not len(x) or (-(1 << 31) <= int(x.min()) and int(x.max()) < 1 << 31)
    return np.ascontiguousarray(x, np.int32 if fits else np.int64)


class Graph:
    """Directed edges as arrays sorted by did; adjacency as slices of permutations."""

    def __init__(self, did, u, v, length, elevation, banned=()):
        whole = lambda x: x if isinstance(x, np.ndarray) else np.asarray(x, np.int64)
        order = narrow(np.argsort(whole(did), kind="stable"))
        take = lambda x: whole(x)[order]
        did, u, v = take(did).astype(np.int64), take(u), take(v)
        nodes = np.union1d(np.unique(u), np.unique(v)).astype(np.int64)
        u, v, n = narrow(np.searchsorted(nodes, u)), narrow(np.searchsorted(nodes, v)), len(nodes)
        out, into = Adjacent.of(u, n), Adjacent.of(v, n)
        pairs = np.asarray(banned if isinstance(banned, np.ndarray) else list(banned), np.int64).reshape(-1, 2)
        at = np.searchsorted(did, pairs)
        known = (did[np.minimum(at, len(did) - 1)] == pairs).all(1) if len(did) else np.zeros(len(pairs), bool)
        codes = np.unique(at[known, 0] * len(did) + at[known, 1])
        self._set(did, nodes, u, v, narrow(take(length)), narrow(take(elevation)), out.order, out.cuts, into.order, into.cuts, codes)

    def _set(self, *columns: np.ndarray) -> None:
        self.columns = columns
        self.did, self.nodes, self.u, self.v, self.length, self.elevation, out_order, out_cuts, into_order, into_cuts, codes = columns
        self.out, self.into = Adjacent(out_order, out_cuts), Adjacent(into_order, into_cuts)
        self.tail, self.head = memoryview(self.u), memoryview(self.v)
        self.weights = {"length": memoryview(self.length), "elevation": memoryview(self.elevation)}
        self.banned = Turns(codes, len(self.did))

    @classmethod
    def of(cls, columns: tuple[np.ndarray, ...]) -> Graph:
        """A graph again from its columns, which it shares."""
        graph = cls.__new__(cls)
        graph._set(*columns)
        return graph

    def node(self, node_id: int) -> int | None:
        k = int(np.searchsorted(self.nodes, node_id))
        return k if k < len(self.nodes) and int(self.nodes[k]) == node_id else None

    def path(self, edges: list[int], optimal: bool = False) -> Path:
        length, elevation = self.weights["length"], self.weights["elevation"]
        return Path(edges, sum(length[e] for e in edges), sum(elevation[e] for e in edges), optimal)

    # --- shortest paths ----------------------------------------------------------------------------------------

    def from_node(self, source: int, weight: str = "length", reverse: bool = False, bound: int = INFINITE, target: int | None = None, allowed=None) -> tuple[dict[int, int], dict[int, int]]:
        """Distance of every node within bound of source (to it, reversed), and the edge by which it is reached.

        Only nodes that allowed (a flag for each) admits are entered. At target the bound becomes its distance.
        """
        ends, adjacent = (self.tail, self.into) if reverse else (self.head, self.out)
        cost = self.weights[weight]
        dist, by, heap, done = {source: 0}, {}, [(0, source)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            if d > bound:
                break
            done.add(x)
            if x == target:
                bound = min(bound, d)
            for e in adjacent[x]:
                y, new = ends[e], d + cost[e]
                if new <= bound and (allowed is None or allowed[y]) and new < dist.get(y, INFINITE):
                    dist[y], by[y] = new, e
                    heapq.heappush(heap, (new, y))
        return dist, by

    def from_edges(self, source: int, weight: str = "length", reverse: bool = False, bound: int = INFINITE, target: int | None = None, only=None) -> tuple[dict[int, int], dict[int, int], int | None]:
        """The same on directed edges, banned turns left out: a distance holds its own edge's cost. Also the
        cheapest edge that touches target, by which the bound is drawn in."""
        starts, adjacent, ends, goal = (self.into, self.into, self.tail, self.tail) if reverse else (self.out, self.out, self.head, self.head)
        cost, banned, ruled = self.weights[weight], self.banned, self.banned.begins
        dist, by, heap, done, last = {}, {}, [], set(), None
        for e in starts[source]:
            if cost[e] <= bound and (only is None or only[e]):
                dist[e] = cost[e]
                heapq.heappush(heap, (cost[e], e))
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            if d > bound:
                break
            done.add(x)
            if goal[x] == target and last is None:
                last, bound = x, min(bound, d)
            for y in adjacent[ends[x]]:
                if only is not None and not only[y]:
                    continue
                if ruled[y if reverse else x] and ((y, x) if reverse else (x, y)) in banned:
                    continue
                new = d + cost[y]
                if new <= bound and new < dist.get(y, INFINITE):
                    dist[y], by[y] = new, x
                    heapq.heappush(heap, (new, y))
        return dist, by, last

    def shortest(self, start: int, end: int, weight: str = "length", turns: bool = False, allowed=None) -> Path | None:
        """The cheapest path, or None. From a node to itself it is empty."""
        if start == end:
            return Path([], 0, 0, True)
        edges: list[int] = []
        if turns:
            _, by, e = self.from_edges(start, weight, target=end, only=allowed)
            if e is None:
                return None
            while e is not None:
                edges.append(e)
                e = by.get(e)
        else:
            dist, by = self.from_node(start, weight, target=end, allowed=allowed)
            if end not in dist:
                return None
            x = end
            while x != start:
                edges.append(by[x])
                x = self.tail[by[x]]
        return self.path(edges[::-1])

    def map_of_nodes(self, source: int, weight: str = "length", reverse: bool = False, bound: int = INFINITE) -> np.ndarray:
        """The same distances as one array, INFINITE where nothing arrives within bound."""
        ends, adjacent, cost = (self.u, self.into, getattr(self, weight)) if reverse else (self.v, self.out, getattr(self, weight))
        end, price = memoryview(ends), memoryview(cost)

        def onward(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            e, size = adjacent.all(x)
            return ends[e], np.repeat(d, size) + cost[e]

        def step(x: int, d: int) -> list[tuple[int, int]]:
            return [(d + price[e], end[e]) for e in adjacent[x]]

        return self._map(len(self.nodes), np.array([source]), np.zeros(1, np.int64), onward, step, cost, bound)

    def map_of_edges(self, source: int, weight: str = "length", reverse: bool = False, bound: int = INFINITE) -> np.ndarray:
        """The same on directed edges, banned turns left out."""
        ends, adjacent, cost = (self.u, self.into, getattr(self, weight)) if reverse else (self.v, self.out, getattr(self, weight))
        end, price, banned = memoryview(ends), memoryview(cost), self.banned

        def onward(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            y, size = adjacent.all(ends[x])
            before, new = np.repeat(x, size), np.repeat(d, size) + cost[y]
            if len(banned):
                legal = ~(banned.hold(y, before) if reverse else banned.hold(before, y))
                y, new = y[legal], new[legal]
            return y, new

        def step(x: int, d: int) -> list[tuple[int, int]]:
            return [(d + price[y], y) for y in adjacent[end[x]] if ((y, x) if reverse else (x, y)) not in banned]

        first = np.asarray(adjacent[source])
        return self._map(len(self.did), first, cost[first].astype(np.int64), onward, step, cost, bound)

    @staticmethod
    def _map(n: int, first: np.ndarray, at: np.ndarray, onward, step, cost: np.ndarray, bound: int) -> np.ndarray:
        """Distances by rounds over arrays while many states are open: what is nearest, up to a mean edge's cost, goes on;
        what gets nearer goes again. While few are open, one by one from a heap."""
        dist = np.full(n, INFINITE, np.int64)
        known, width = memoryview(dist), max(1, int(cost.mean())) if len(cost) else 1
        pending = first[at <= bound]
        dist[pending] = at[at <= bound]
        while len(pending):
            if len(pending) < FEW:
                heap = [(known[x], x) for x in pending.tolist()]
                heapq.heapify(heap)
                while heap and len(heap) < MANY:
                    d, x = heapq.heappop(heap)
                    if d == known[x]:
                        for new, y in step(x, d):
                            if new < known[y] and new <= bound:
                                known[y] = new
                                heapq.heappush(heap, (new, y))
                pending = np.unique(np.array([x for _, x in heap], np.int64))
                continue
            d = dist[pending]
            near = d < int(d.min()) + width
            y, new = onward(pending[near], d[near])
            better = (new < dist[y]) & (new <= bound)
            y, new = y[better], new[better]
            np.minimum.at(dist, y, new)
            pending = np.unique(np.concatenate([pending[~near], y]))
        return dist

    # --- what a length bound leaves ------------------------------------------------------------------------------

    def flags_of_nodes(self, start: int, end: int, bound: int) -> np.ndarray:
        """Which nodes lie on some walk from start to end of at most bound."""
        there, back = self.map_of_nodes(start, bound=bound), self.map_of_nodes(end, reverse=True, bound=bound)
        return (there <= bound) & (back <= bound) & (there + back <= bound)

    def flags_of_edges(self, start: int, end: int, bound: int) -> np.ndarray:
        """Which directed edges lie on some walk without banned turns from start to end of at most bound."""
        there, back = self.map_of_edges(start, bound=bound), self.map_of_edges(end, reverse=True, bound=bound)
        return (there <= bound) & (back <= bound) & (there - self.length + back <= bound)

    def reachable_nodes(self, start: int, end: int, bound: int) -> set[int]:
        return set(np.flatnonzero(self.flags_of_nodes(start, end, bound)).tolist())

    def reachable_edges(self, start: int, end: int, bound: int) -> set[int]:
        return set(np.flatnonzero(self.flags_of_edges(start, end, bound)).tolist())

    def least_elevation(self, start: int, end: int, bound: int, turns: bool = False) -> Path | None:
        """The path of least elevation among what the bound leaves; its length may exceed the bound."""
        left = self.flags_of_edges(start, end, bound) if turns else self.flags_of_nodes(start, end, bound)
        return self.shortest(start, end, "elevation", turns, memoryview(left))

    # --- duplicates ---------------------------------------------------------------------------------------------

    def turn_ok(self, before: int | None, after: int | None, turns: bool) -> bool:
        return not turns or before is None or after is None or (before, after) not in self.banned

    def without_directed_repeats(self, edges: list[int], turns: bool = False) -> list[int]:
        """Loops go: at each edge the path continues after its last occurrence, unless that turn is banned."""
        last = {e: k for k, e in enumerate(edges)}
        out: list[int] = []
        k = 0
        while k < len(edges):
            e, to = edges[k], last[edges[k]]
            if to != k and not self.turn_ok(e, edges[to + 1] if to + 1 < len(edges) else None, turns):
                to = k
            out.append(e)
            k = to + 1
        return out

    def without_repeats(self, edges: list[int], turns: bool = False) -> list[int]:
        """The same for roads: a road passed again the same way is a loop; one passed back is left out with all between."""
        road = lambda e: int(self.did[e]) // 2
        last = {road(e): k for k, e in enumerate(edges)}
        out: list[int] = []
        k = 0
        while k < len(edges):
            e, to = edges[k], last[road(edges[k])]
            after = edges[to + 1] if to + 1 < len(edges) else None
            if to != k and edges[to] != e and self.turn_ok(out[-1] if out else None, after, turns):
                k = to + 1
                continue
            if to != k and (edges[to] != e or not self.turn_ok(e, after, turns)):
                to = k
            out.append(e)
            k = to + 1
        return out

    def deduplicated(self, edges: list[int], policy: Duplicates, turns: bool) -> list[int]:
        """Repeats the removal until nothing changes: a cut can bring new neighbours together."""
        while policy:
            new = self.without_directed_repeats(edges, turns) if policy is Duplicates.DIRECTED else self.without_repeats(edges, turns)
            if new == edges:
                break
            edges = new
        return edges

    # --- genetic search -------------------------------------------------------------------------------------------

    def evolve(self, start: int, end: int, shortest: Path, bound: int, maximise: bool, policy: Duplicates = Duplicates.IGNORE, turns: bool = False, offspring: int = 100, kept: int = 30, epochs: int = 10_000, least_epochs: int = 10, milliseconds: float | None = None, seed: int = 0) -> Path:
        """The path of most or least elevation found within the length bound; never worse than the shortest.

        Epochs alone bound a run, unless milliseconds are given too.
        """
        if start == end:
            return Path([], 0, 0, True)
        if not maximise:
            direct = self.least_elevation(start, end, bound, turns)
            if direct is not None and direct.length <= bound:
                edges = self.deduplicated(direct.edges, policy, turns)
                if edges and self._joined(edges, start, end):
                    return self.path(edges, len(edges) == len(direct.edges))
        rng = np.random.default_rng(seed)
        inside = memoryview(self.flags_of_edges(start, end, bound) if turns else self.flags_of_nodes(start, end, bound))
        trees = [self._trees(end, turns, True, inside), self._trees(start, turns, False, inside)]
        began = time.monotonic()
        pool: dict[tuple[int, ...], Path] = {tuple(shortest.edges): shortest}
        sign = -1 if maximise else 1
        rank = lambda p: (sign * p.elevation, p.length, p.edges)
        for epoch in range(epochs):
            if milliseconds is not None and epoch >= least_epochs and (time.monotonic() - began) * 1000 > milliseconds:
                break
            parents = list(pool.values())
            for _ in range(offspring):
                back = int(rng.integers(2))
                child = self._mutant(parents[int(rng.integers(len(parents)))].edges, start, end, bound, trees[back], bool(back), maximise, policy, turns, rng)
                self._admit(pool, child, start, end, bound, policy, turns)
            for child in self._crossed(list(pool.values()), offspring, bound, turns, rng):
                self._admit(pool, child, start, end, bound, policy, turns)
            pool = {tuple(p.edges): p for p in sorted(pool.values(), key=rank)[:kept]}
        return min(pool.values(), key=rank)

    def _trees(self, root: int, turns: bool, reverse: bool, inside=None) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
        """How far each node (or edge, itself included) is from root, or to it; and the next edge on the shortest and on
        the least climbing way there. inside: flags of what a length bound leaves; no walk within it needs more."""
        found = [self.from_edges(root, w, reverse, only=inside)[:2] if turns else self.from_node(root, w, reverse, allowed=inside) for w in ("length", "elevation")]
        return found[0][0], found[0][1], found[1][1]

    def _joined(self, edges: list[int], start: int, end: int) -> bool:
        return bool(edges) and self.tail[edges[0]] == start and self.head[edges[-1]] == end and all(self.head[a] == self.tail[b] for a, b in zip(edges, edges[1:]))

    def _admit(self, pool, edges, start, end, bound, policy, turns) -> None:
        if edges is None:
            return
        edges = self.deduplicated(edges, policy, turns)
        if not self._joined(edges, start, end) or (turns and any(p in self.banned for p in zip(edges, edges[1:]))):
            return
        child = self.path(edges)
        if child.length <= bound:
            pool.setdefault(tuple(edges), child)

    def _mutant(self, edges, start, end, bound, trees, back: bool, maximise, policy, turns, rng) -> list[int] | None:
        """Keeps a random front part and walks on at random to the end, or keeps a random rear part and walks back to the
        start; always near enough to arrive within the bound. Without a policy nothing is kept.

        trees: of the place that the walk makes for (the end, or the start when it goes back).
        """
        length, (dist, short, climb) = self.weights["length"], trees
        grow, far, at, goal = (self.into, self.tail, end, start) if back else (self.out, self.head, start, end)
        whole = edges[::-1] if back else edges
        out = list(whole[: int(rng.integers(len(whole)))]) if len(whole) and policy is not Duplicates.IGNORE else []
        used = sum(length[e] for e in out)
        at = far[out[-1]] if out else at
        mark = (lambda e: int(self.did[e]) // 2) if policy is Duplicates.UNDIRECTED else (lambda e: e)
        passable = (lambda x, e: self.turn_ok(e, x, turns)) if back else (lambda x, e: self.turn_ok(x, e, turns))
        seen = {mark(e) for e in out}
        for step in range(3 * len(edges) + 50):
            if at == goal and out and rng.random() < 0.5:
                break
            last = out[-1] if out else None
            options = [e for e in grow[at] if passable(last, e) and used + (dist.get(e, INFINITE) if turns else length[e] + dist.get(far[e], INFINITE)) <= bound]
            fresh = options if policy is Duplicates.IGNORE else [e for e in options if mark(e) not in seen]
            options = fresh or ([] if at == goal and out else options)
            if not options:
                break
            e = climb.get(last if turns else at) if not maximise and step > 0 else None
            if e is None or e not in options:
                e = options[int(rng.integers(len(options)))]
            out.append(e)
            seen.add(mark(e))
            used += length[e]
            at = far[e]
        while at != goal:  # the shortest way there
            e = None if turns and not out else short.get(out[-1] if turns else at)
            if e is None:
                return None
            out.append(e)
            at = far[e]
        return out[::-1] if back else out

    def _crossed(self, parents: list[Path], most: int, bound: int, turns: bool, rng) -> list[list[int]]:
        """Front of one parent and rear of another, joined at an edge that both pass."""
        where: dict[int, list[int]] = {}
        for k, p in enumerate(parents):
            for e in set(p.edges):
                where.setdefault(e, []).append(k)
        shared = sorted(e for e, ks in where.items() if len(ks) > 1)
        out, length = [], self.weights["length"]
        for _ in range(most if shared else 0):
            e = shared[int(rng.integers(len(shared)))]
            a, b = (parents[where[e][i]].edges for i in rng.choice(len(where[e]), 2, replace=False))
            for one, two in ((a, b), (b, a)):
                child = one[: one.index(e)] + two[len(two) - 1 - two[::-1].index(e) :]
                if sum(length[x] for x in child) <= bound:
                    join = one.index(e)
                    if self.turn_ok(child[join - 1] if join else None, child[join], turns):
                        out.append(child)
                    break
        return out

    # --- components -----------------------------------------------------------------------------------------------

    def largest_component(self, turns: bool = True) -> tuple[set[int], set[int]]:
        """Nodes and edges of the strongly connected component of edges that touches most nodes (banned turns aren't
        passed); ties go to the component that holds the smallest edge."""
        edges = self.component(turns)
        return set(self.u[edges].tolist()) | set(self.v[edges].tolist()), set(edges.tolist())

    def component(self, turns: bool = True) -> np.ndarray:
        """The edges of that component, sorted. Tarjan's search, after Pearce: an edge goes on the stack when it is left,
        unless it is the first of its component."""
        n, head, banned, ruled = len(self.did), self.head, self.banned, self.banned.begins
        order, cuts = memoryview(self.out.order), memoryview(self.out.cuts)
        low, at = array("q", bytes(8 * n)), array("q", bytes(8 * n))  # low: 0 before an edge is met, n + 1 when settled
        lowered = bytearray(n)
        stack, todo = array("q"), array("q")
        best: tuple[int, int] | None = None
        found = np.zeros(0, np.int64)
        count = 0
        for root in range(n):
            if low[root]:
                continue
            count += 1
            low[root], at[root] = count, cuts[head[root]]
            todo.append(root)
            while todo:
                e = todo[-1]
                x, k, least, rule = head[e], at[e], low[e], turns and ruled[e]
                stop = cuts[x + 1]
                while k < stop:
                    y = order[k]
                    if rule and (e, y) in banned:
                        k += 1
                        continue
                    met = low[y]
                    if not met:
                        break
                    if met < least:
                        least = met
                    k += 1
                if least < low[e]:
                    low[e], lowered[e] = least, 1
                at[e] = k
                if k < stop:  # y is met for the first time; e looks at it again when it is done
                    count += 1
                    low[y], at[y] = count, cuts[head[y]]
                    todo.append(y)
                    continue
                todo.pop()
                if lowered[e]:
                    stack.append(e)
                    continue
                own = [e]
                while stack and low[stack[-1]] >= least:
                    own.append(stack.pop())
                for y in own:
                    low[y] = n + 1
                edges = np.array(own, np.int64)
                if best is None or len(edges) + 1 >= -best[0]:
                    size = (-len(np.union1d(self.u[edges], self.v[edges])), int(edges.min()))
                    if best is None or size < best:
                        best, found = size, edges
        return np.sort(found)
