"""Search of parameter sets: a generation is scored by one Spark job, the next one is made from its few rows.

Individuals are dictionaries of numbers within bounds. The search holds a population, hundreds of them, on the driver; all
backtests run as grouped Spark work.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from math import erf, exp, pi, sqrt

import numpy as np

Individual = dict[str, float]
Bounds = dict[str, tuple[int, int]]


def key(x: Individual) -> tuple:
    """What makes two individuals the same."""
    return tuple(sorted(x.items()))


def initial(bounds: Bounds, n: int, rng: random.Random) -> list[Individual]:
    """n different individuals by a Latin hypercube: each parameter's range is cut into n parts that are all used."""
    columns = {}
    for name, (low, high) in bounds.items():
        cells = list(range(n))
        rng.shuffle(cells)
        columns[name] = [low + int((high - low + 1) * (c + rng.random()) / n) for c in cells]
    return distinct([{k: v[i] for k, v in columns.items()} for i in range(n)], bounds, n, rng)


def distinct(population: list[Individual], bounds: Bounds, n: int, rng: random.Random) -> list[Individual]:
    """The population without repeats, filled up with fresh individuals as far as there are any."""
    out = {key(x): x for x in population}
    room = 1
    for low, high in bounds.values():
        room *= high - low + 1
    while len(out) < min(n, room):
        x = {k: rng.randint(low, high) for k, (low, high) in bounds.items()}
        out[key(x)] = x
    return list(out.values())[:n]


def shared(scores: list[float], population: list[Individual], bounds: Bounds, radius: float = 0.1) -> list[float]:
    """Scores divided by how crowded an individual's surroundings are, so that a population keeps several peaks."""
    at = np.array([[(x[k] - low) / max(1, high - low) for k, (low, high) in bounds.items()] for x in population])
    apart = np.sqrt(((at[:, None] - at[None]) ** 2).mean(axis=2))
    crowd = np.maximum(0, 1 - apart / radius).sum(axis=1)
    low = min(scores)
    return [(s - low) / c for s, c in zip(scores, crowd, strict=True)]


def next_generation(population: list[Individual], scores: list[float], bounds: Bounds, rng: random.Random, elite: int = 2, mutation: float = 0.3, fresh: float = 0.1) -> list[Individual]:
    """The best as they are, then children of tournament winners, crossed and mutated, and some fresh blood."""
    n = len(population)
    order = sorted(range(n), key=lambda i: (-scores[i], key(population[i])))
    out = [population[i] for i in order[:elite]]
    worth = shared(scores, population, bounds)

    def winner() -> Individual:
        return population[max(rng.sample(range(n), min(3, n)), key=lambda i: worth[i])]

    while len(out) < n - int(fresh * n):
        a, b = winner(), winner()
        child = {k: rng.choice((a[k], b[k])) for k in bounds}
        for k, (low, high) in bounds.items():
            if rng.random() < mutation:
                child[k] = min(high, max(low, child[k] + rng.choice((-1, 1)) * max(1, round((high - low) * 0.2 * rng.random()))))
        out.append(child)
    return distinct(out, bounds, n, rng)


def evolve(score: Callable[[list[Individual]], list[float]], bounds: Bounds, size: int = 20, generations: int = 5, seed: int = 1) -> tuple[Individual, float, list[float]]:
    """The best individual, its score and the best score of each generation. ``score`` is one Spark job."""
    rng = random.Random(seed)
    population, best, course = initial(bounds, size, rng), None, []
    for _ in range(generations):
        scores = score(population)
        top = max(range(len(population)), key=lambda i: scores[i])
        best = max(best or (float("-inf"), ()), (scores[top], key(population[top])))
        course.append(best[0])
        population = next_generation(population, scores, bounds, rng)
    return dict(best[1]), best[0], course


def suggested(tried: list[Individual], scores: list[float], bounds: Bounds, n: int, seed: int = 1, length: float = 0.3, noise: float = 1e-4) -> list[Individual]:
    """The n untried individuals of largest expected improvement under a Gaussian process on those tried; fewer, or none,
    where fewer are left."""
    rng = random.Random(seed)
    unit = lambda xs: np.array([[(x[k] - low) / max(1, high - low) for k, (low, high) in bounds.items()] for x in xs])
    pool = [x for x in distinct([], bounds, 500, rng) if key(x) not in {key(t) for t in tried}]
    if not pool or not tried:
        return pool[:n]
    a, b, y = unit(tried), unit(pool), np.array(scores)
    y = (y - y.mean()) / (y.std() or 1.0)
    kernel = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(axis=2) / (2 * length**2))
    solve = np.linalg.solve(kernel(a, a) + noise * np.eye(len(a)), np.column_stack([y, kernel(a, b)]))
    cross = kernel(b, a)
    mean, dev = cross @ solve[:, 0], np.sqrt(np.maximum(1e-12, 1 - (cross * solve[:, 1:].T).sum(axis=1)))
    z = (mean - y.max()) / dev
    gain = [(m - y.max()) * 0.5 * (1 + erf(v / sqrt(2))) + d * exp(-v * v / 2) / sqrt(2 * pi) for m, d, v in zip(mean, dev, z, strict=True)]
    return [pool[i] for i in sorted(range(len(pool)), key=lambda i: -gain[i])[:n]]
