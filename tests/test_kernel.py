"""Properties of path search on random graphs, against plain algorithms."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.plans.kernel import Duplicates, Graph


def random_graph(seed, n=24, m=70, bans=12):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(m)
    u, v = rng.integers(0, n, m), rng.integers(0, n, m)
    length, elevation = rng.integers(1, 50, m), rng.integers(0, 20, m)
    rows = [(2 * i, a, b, w, e) for i, a, b, w, e in zip(ids, u, v, length, elevation)] + [(2 * i + 1, b, a, w, e) for i, a, b, w, e in zip(ids, u, v, length, elevation) if i % 3 and a != b]
    did, u, v, length, elevation = (np.array(x) for x in zip(*rows))
    pairs = [(int(a), int(b)) for a, x in zip(did, v) for b, y in zip(did, u) if x == y]
    banned = [pairs[k] for k in rng.choice(len(pairs), min(bans, len(pairs)), replace=False)]
    return Graph(did, u, v, length, elevation, banned)


def bellman_ford(graph, source, reverse):
    dist = {source: 0}
    for _ in graph.nodes:
        for e in range(len(graph.did)):
            a, b = (graph.head[e], graph.tail[e]) if reverse else (graph.tail[e], graph.head[e])
            if a in dist and dist[a] + graph.weights["length"][e] < dist.get(b, 1 << 60):
                dist[b] = dist[a] + graph.weights["length"][e]
    return dist


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_distances(seed):
    graph = random_graph(seed)
    for reverse in (False, True):
        assert graph.from_node(0, reverse=reverse)[0] == bellman_ford(graph, 0, reverse)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_turn_aware_distances_are_those_of_the_line_graph(seed):
    graph = random_graph(seed)
    dist = {e: graph.weights["length"][e] for e in graph.out[0]}
    for _ in range(len(graph.did)):
        for a, b in itertools.product(range(len(graph.did)), repeat=2):
            if a in dist and graph.head[a] == graph.tail[b] and (a, b) not in graph.banned:
                dist[b] = min(dist.get(b, 1 << 60), dist[a] + graph.weights["length"][b])
        if seed % 7:
            break
    got = graph.from_edges(0)[0]
    if seed % 7 == 0:
        assert got == dist
    assert all(got[e] <= d for e, d in dist.items())


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), st.sampled_from(list(Duplicates)), st.booleans())
def test_evolution_keeps_its_promises(seed, maximise, policy, turns):
    graph = random_graph(seed)
    start, end = 0, len(graph.nodes) - 1
    base = graph.shortest(start, end, turns=turns)
    if base is None:
        return
    assert (base.length == 0) == (start == end)
    bound = int(base.length * 1.5)
    path = graph.evolve(start, end, base, bound, maximise, policy, turns, offspring=20, kept=8, epochs=4, seed=seed)
    assert base.length <= path.length <= bound or path.length >= base.length
    assert path.length <= bound
    assert path.elevation >= base.elevation if maximise else 0 <= path.elevation <= base.elevation
    assert graph._joined(path.edges, start, end)
    assert path.length == sum(graph.weights["length"][e] for e in path.edges)
    if turns:
        assert not any(p in graph.banned for p in zip(path.edges, path.edges[1:]))
    else:
        if policy is Duplicates.DIRECTED:
            assert len(set(path.edges)) == len(path.edges)
        if policy is Duplicates.UNDIRECTED:
            roads = [int(graph.did[e]) // 2 for e in path.edges]
            assert len(set(roads)) == len(roads)
    again = graph.evolve(start, end, base, bound, maximise, policy, turns, offspring=20, kept=8, epochs=4, seed=seed)
    assert again.edges == path.edges


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), st.booleans(), st.sampled_from(list(Duplicates)), st.booleans())
def test_mutants_of_both_halves(seed, back, maximise, policy, turns):
    """A front or a rear of the parent stays; the rest is walked within the bound, without banned turns."""
    graph = random_graph(seed)
    start, end = 0, len(graph.nodes) - 1
    base = graph.shortest(start, end, turns=turns)
    if base is None or not base.edges:
        return
    bound, rng = int(base.length * 1.6), np.random.default_rng(seed)
    trees = graph._trees(start, turns, False) if back else graph._trees(end, turns, True)
    for _ in range(20):
        child = graph._mutant(base.edges, start, end, bound, trees, back, maximise, policy, turns, rng)
        assert graph._joined(child, start, end) and sum(graph.weights["length"][e] for e in child) <= bound
        assert not turns or not any(p in graph.banned for p in zip(child, child[1:]))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_component_is_strong_and_largest(seed):
    graph = random_graph(seed)
    nodes, edges = graph.largest_component()

    def reach(e, back):
        seen, todo = {e}, [e]
        while todo:
            x = todo.pop()
            for y in graph.into[graph.tail[x]] if back else graph.out[graph.head[x]]:
                if ((y, x) if back else (x, y)) not in graph.banned and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    best = max((reach(e, False) & reach(e, True) for e in range(len(graph.did))), key=lambda c: len({graph.tail[e] for e in c} | {graph.head[e] for e in c}))
    assert len(nodes) == len({graph.tail[e] for e in best} | {graph.head[e] for e in best})
    assert edges == reach(min(edges), False) & reach(min(edges), True)


def test_reachable_sets():
    graph = random_graph(3)
    base = graph.shortest(0, 5)
    assert base is not None
    inside = graph.reachable_nodes(0, 5, int(base.length * 1.4))
    there, back = graph.from_node(0)[0], graph.from_node(5, reverse=True)[0]
    assert inside == {x for x in there if x in back and there[x] + back[x] <= int(base.length * 1.4)}
    edges = graph.reachable_edges(0, 5, 10**9)
    assert edges <= set(graph.from_edges(0)[0])


@pytest.mark.parametrize("edges, expected", [([1, 2, 3], [1, 2, 3]), ([1, 2, 1, 3], [1, 3]), ([1, 1, 1], [1])])
def test_directed_repeats(edges, expected):
    graph = Graph([0, 2, 4, 6], [0, 0, 0, 0], [0, 0, 0, 0], [1] * 4, [1] * 4)
    assert graph.without_directed_repeats(edges) == expected


def test_mutants_keep_a_front_or_a_rear():
    """A ladder: what stays of the parent is where it should be, and both halves differ from the parent somewhere."""
    rungs = 12
    edges = [(k, k, k + 1) for k in range(rungs)] + [(20 + k, 100 + k, 101 + k) for k in range(rungs)] + [(50 + k, k, 100 + k) for k in range(rungs + 1)]
    did, u, v = (np.array(x) for x in zip(*((2 * i + d, (a, b)[d], (b, a)[d]) for i, a, b in edges for d in (0, 1))))
    graph = Graph(did, u, v, np.full(len(did), 10), did % 7)
    start, end = graph.node(0), graph.node(rungs)
    base = graph.shortest(start, end)
    for back, root, reverse in ((False, end, True), (True, start, False)):
        trees, rng, kept = graph._trees(root, False, reverse), np.random.default_rng(1), set()
        for _ in range(60):
            child = graph._mutant(base.edges, start, end, base.length * 2, trees, back, True, Duplicates.DIRECTED, False, rng)
            pairs = list(zip(child[::-1], base.edges[::-1])) if back else list(zip(child, base.edges))
            kept.add(next((k for k, (a, b) in enumerate(pairs) if a != b), len(pairs)))
        assert max(kept) >= 5 and min(kept) < 3
