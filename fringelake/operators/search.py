"""Source models where chi-square has many valleys: search by a population, and samples of what the data allow.

A generation is one pass: each task evaluates all its rows for all parameter vectors at once, as arrays of vectors by rows, and sends
back one number a vector. The population lives on the driver; its size, and the number of parameters, are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .imaging import DATA, _pull
from .models import Component, sample

#: Numbers of an array of vectors by rows.
CELLS = 1 << 18
Free = list[tuple[int, str]]


class Population:
    """Chi-squares of many parameter vectors against a table of one of ``imaging.DATA``'s kinds.

    ``free`` lists (number of the component, name of the parameter). Rows with nulls, and those whose last column (an error) is not above 0,
    take no part. Persist a table that is read for many generations.
    """

    def __init__(self, table: DataFrame, kind: str, components: list[Component], free: Free):
        columns, self.legs = DATA[kind]
        self.kind, self.components, self.free, self.columns = kind, components, free, columns
        self.rows = table.select(*columns, *[c for leg in self.legs for c in leg]).dropna().filter(F.col(columns[-1]) > 0)

    def placed(self, vectors: np.ndarray) -> list[Component]:
        """The components with parameters of one vector, or with columns of many."""
        out = list(self.components)
        for j, (i, name) in enumerate(self.free):
            x = np.asarray(vectors)[..., j]
            out[i] = replace(out[i], **{name: float(x) if x.ndim == 0 else x[:, None]})
        return out

    def chisq(self, vectors: np.ndarray) -> np.ndarray:
        """The reduced chi-square of each vector (infinite where it is no number); a table without usable rows raises an error."""
        kind, columns, size, parts = self.kind, len(self.columns), len(vectors), self.placed(np.asarray(vectors, float))
        step = max(1, CELLS // max(1, size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 1)
            for batch in batches:
                cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(batch.num_columns)]
                for a in range(0, batch.num_rows, step):
                    part = [c[None, a : a + step] for c in cols]
                    uv = part[columns:]
                    legs = [np.broadcast_to(sum(sample(c, u, v) for c in parts), (size, u.shape[1])) for u, v in zip(uv[::2], uv[1::2], strict=True)]
                    with np.errstate(all="ignore"):
                        total[:size] += _pull(kind, part[:columns], legs)[0].sum(axis=1)
                    total[size] += part[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], ["at", "value"])

        got = self.rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")["value"].to_numpy()
        if not len(got) or not got[-1]:
            raise ValueError("no usable rows")
        chi = got[:-1] / got[-1]
        return np.where(np.isfinite(chi), chi, np.inf)


def search_components(table: DataFrame, kind: str, components: list[Component], free: Free, bounds: list[tuple[float, float]], members: int = 48, rounds: int = 80, seed: int = 0, tolerance: float = 1e-6) -> tuple[list[Component], float, list[float]]:
    """(components, chi-square, best of each round) of the least chi-square within ``bounds``, by differential evolution.

    The first population fills the bounds evenly in each parameter. A member's rival is its better half moved towards the best member and along the difference of two others,
    parameter by parameter at random; what leaves the bounds is reflected. A round is one pass. Ends early once all members are within ``tolerance`` of the best.
    One seed gives one result, but for the order of distributed sums.
    """
    if members < 4:
        raise ValueError("a population has at least four members")
    rng, k = np.random.default_rng(seed), len(free)
    low, high = np.array(bounds, float).T
    population = Population(table, kind, components, free)
    # One member in each of equal slices of every parameter.
    unit = (np.array([rng.permutation(members) for _ in range(k)]).T + rng.uniform(size=(members, k))) / members
    score = population.chisq(low + unit * (high - low))
    path = [float(score.min())]
    for _ in range(rounds):
        best, spread = unit[score.argmin()], score.max() - score.min()
        if spread <= tolerance * abs(score.min()):
            break
        order = np.array([rng.permutation(np.delete(np.arange(members), i))[:2] for i in range(members)])
        pull, size = rng.uniform(0.0, 0.6, (members, 1)), rng.uniform(0.4, 1.0, (members, 1))
        moved = unit + pull * (best - unit) + size * (unit[order[:, 0]] - unit[order[:, 1]])
        taken = rng.uniform(size=(members, k)) < 0.8
        taken[np.arange(members), rng.integers(k, size=members)] = True
        rival = np.where(taken, moved, unit)
        rival = np.abs(np.mod(rival + 1, 2) - 1)  # reflected at 0 and 1
        new = population.chisq(low + rival * (high - low))
        wins = new <= score
        unit, score = np.where(wins[:, None], rival, unit), np.where(wins, new, score)
        path.append(float(score.min()))
    return population.placed(low + unit[score.argmin()] * (high - low)), float(score.min()), path


def sample_components(table: DataFrame, kind: str, components: list[Component], free: Free, bounds: list[tuple[float, float]], start: np.ndarray, count: int, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Parameter vectors (rounds, walkers, parameters) from the posterior under an even prior within ``bounds``, by stretch moves of an ensemble.

    ``start`` holds an even number of vectors, more than twice the parameters; ``count`` is the number of real data of the table, half of
    which times chi-square is the negative log-likelihood (complex rows count twice). Half the ensemble moves along lines to the other half: two passes a round.
    """
    rng = np.random.default_rng(seed)
    walkers, k = start.shape
    if walkers % 2 or walkers <= 2 * k:
        raise ValueError("an even number of walkers, more than twice the parameters")
    low, high = np.array(bounds, float).T
    population = Population(table, kind, components, free)
    x = np.array(start, float)
    score, out = population.chisq(x), np.empty((rounds, walkers, k))
    halves = np.arange(walkers) % 2
    for step in range(rounds):
        for side in (0, 1):
            own, other = np.flatnonzero(halves == side), np.flatnonzero(halves != side)
            z = (rng.uniform(size=len(own)) + 1) ** 2 / 2  # density 1 / sqrt(z) on [1/2, 2]
            partner = x[rng.choice(other, len(own))]
            there = partner + z[:, None] * (x[own] - partner)
            inside = ((there >= low) & (there <= high)).all(axis=1)
            new = np.where(inside, population.chisq(np.clip(there, low, high)), np.inf)
            go = np.log(rng.uniform(size=len(own))) < (k - 1) * np.log(z) - count / 2 * (new - score[own])
            x[own], score[own] = np.where(go[:, None], there, x[own]), np.where(go, new, score[own])
        out[step] = x
    return out
