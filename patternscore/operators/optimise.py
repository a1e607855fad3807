"""Seeded searches for group weights and a threshold share. The loop over generations is the driver's; fitness.Judge judges each generation in tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .fitness import LEAST_SHARE, MOST_SHARE, Candidate

Judge = Callable[[list[Candidate]], list[float]]


@dataclass
class Found:
    """The best candidate and, per generation, (generation, best, mean, deviation) of fitness."""

    best: Candidate | None = None
    fitness: float = -1.0
    history: list[tuple[int, float, float, float]] = field(default_factory=list)

    def see(self, people: list[Candidate], values: list[float]) -> None:
        i = int(np.argmax(values))
        if values[i] > self.fitness:
            self.best, self.fitness = people[i], values[i]
        self.history.append((len(self.history), float(max(values)), float(np.mean(values)), float(np.std(values))))


def genetic(judge: Judge, k: int, population: int = 100, generations: int = 50, crossing: float = 0.8, mutation: float = 0.15, seed: int = 42) -> Found:
    """Tournaments of three, blended weights, Gaussian mutation, full replacement; the best ever seen is kept apart."""
    rng, found = np.random.default_rng(seed), Found()
    low, high = np.array([0.1] * k + [LEAST_SHARE]), np.array([1.0] * k + [MOST_SHARE])
    step = np.array([0.1] * k + [0.5])
    people = rng.uniform(low, high, (population, k + 1))
    for g in range(generations + 1):
        own = [Candidate.of(p) for p in people]
        values = judge(own)
        found.see(own, values)
        if g == generations:
            break
        rounds = rng.integers(0, population, (population, 3))
        people = people[rounds[np.arange(population), np.array(values)[rounds].argmax(axis=1)]].copy()
        for a in range(0, population - 1, 2):
            if rng.random() >= crossing:
                continue
            x, y = people[a].copy(), people[a + 1].copy()
            share = np.where(rng.random(k + 1) < 0.5, rng.uniform(-0.3, 1.3, k + 1), 0.0)
            share[-1] = float(rng.random() < 0.5)  # the threshold share is swapped whole
            people[a], people[a + 1] = x + share * (y - x), y + share * (x - y)
        people += (rng.random(people.shape) < mutation) * rng.normal(0, step, people.shape)
        people = np.clip(people, low, high)
    return found


def cma_es(judge: Judge, k: int, sigma: float = 0.3, population: int | None = None, generations: int = 100, seed: int = 42, tolerance: float = 1e-9, patience: int = 25) -> Found:
    """Covariance matrix adaptation as in its published tutorial, in coordinates scaled to the bounds."""
    rng, found, d = np.random.default_rng(seed), Found(), k + 1
    low, high = np.array([0.01] * k + [LEAST_SHARE]), np.array([1.0] * k + [MOST_SHARE])
    many = population or int(np.clip(4 + int(3 * np.log(d)), 12, 50))
    w = np.log(many / 2 + 0.5) - np.log(np.arange(1, many // 2 + 1))
    w /= w.sum()
    mass = 1 / (w**2).sum()
    c_path, c_step = (4 + mass / d) / (d + 4 + 2 * mass / d), (mass + 2) / (d + mass + 5)
    c_one = 2 / ((d + 1.3) ** 2 + mass)
    c_many = min(1 - c_one, 2 * (mass - 2 + 1 / mass) / ((d + 2) ** 2 + mass))
    damping = 1 + 2 * max(0.0, np.sqrt((mass - 1) / (d + 1)) - 1) + c_step
    length = np.sqrt(d) * (1 - 1 / (4 * d) + 1 / (21 * d * d))
    mean = (np.array([1 / k] * k + [5.0]) - low) / (high - low)
    cov, path, step_path = np.eye(d), np.zeros(d), np.zeros(d)
    for g in range(1, generations + 1):
        values, basis = np.linalg.eigh(cov)
        root = np.sqrt(np.maximum(values, 1e-20))
        moves = rng.standard_normal((many, d)) * root @ basis.T
        inside = np.clip(mean + sigma * moves, 0, 1)
        moves = (inside - mean) / sigma
        own = [Candidate.of(low + x * (high - low)) for x in inside]
        fit = judge(own)
        found.see(own, fit)
        best = moves[np.argsort(-np.array(fit), kind="stable")[: len(w)]]
        move = w @ best
        mean = mean + sigma * move
        step_path = (1 - c_step) * step_path + np.sqrt(c_step * (2 - c_step) * mass) * (basis / root) @ (basis.T @ move)
        short = np.linalg.norm(step_path) / np.sqrt(1 - (1 - c_step) ** (2 * g)) < (1.4 + 2 / (d + 1)) * length
        path = (1 - c_path) * path + short * np.sqrt(c_path * (2 - c_path) * mass) * move
        cov = (1 - c_one - c_many) * cov + c_one * (np.outer(path, path) + (1 - short) * c_path * (2 - c_path) * cov) + c_many * (best.T * w) @ best
        sigma *= float(np.exp((c_step / damping) * (np.linalg.norm(step_path) / length - 1)))
        recent = [h[1] for h in found.history[-patience:]]
        if sigma * root.max() < 1e-11 or (len(recent) == patience and max(recent) - min(recent) < tolerance):
            break
    return found
