"""Expectation-maximisation over votes of rules that may abstain.

Votes are -1, 0 (abstain) or 1. Rows enter as counted vote patterns: n rules have at most
3^n patterns (per group), however many rows there are, so the fit is arithmetic on a small
table that Spark has aggregated over all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Chances of the votes (-1, 0, 1) before any data, for rows that are what rules look for and for rows that are not.
START = ((0.05, 0.15, 0.8), (0.4, 0.3, 0.3))


@dataclass(frozen=True)
class VoteModel:
    """For each rule the log odds that its vote (-1, 0 or 1) adds, and each group's prior log odds."""

    weights: tuple[tuple[float, float, float], ...]
    priors: dict[str, float]

    def log_odds(self, votes: list[Column], group: Column | None = None) -> Column:
        out = F.lit(0.0)
        for name, prior in self.priors.items():
            out = F.when(group.eqNullSafe(F.lit(name)), F.lit(prior)).otherwise(out) if group is not None else F.lit(prior)
        for (against, none, for_), vote in zip(self.weights, votes):
            out = out + F.when(vote == 1, for_).when(vote == -1, against).otherwise(none)
        return out


def fit_votes(counted: DataFrame, rules: list[str], group: str | None = None, start=START, prior: float = 0.5, rounds: int = 60,
              firm: float = 10.0) -> VoteModel:
    """``counted`` has the rule columns, optionally a group column, and ``n``; at most groups * 3^rules rows are collected.

    Each rule has its chances of each vote on either side, shared by groups, and each group one prior; ``firm``
    pseudo-counts pull chances to ``start`` and priors to ``prior``, so rare groups and rules stay sane; their number is
    fixed, so the rows outweigh them as the table grows."""
    rows = [(str(r[group]) if group else "", [int(r[c]) + 1 for c in rules], float(r["n"])) for r in counted.collect()]
    chances = [[list(side) for side in start] for _ in rules]  # rule, side (0: yes, 1: no), vote + 1
    priors = {g: prior for g, _, _ in rows} or {"": prior}
    for _ in range(rounds):
        votes_by = [[[firm * c for c in side] for side in start] for _ in rules]
        yes, total = {g: firm * prior for g in priors}, {g: firm for g in priors}
        for g, votes, n in rows:
            odds = math.log(priors[g] / (1 - priors[g])) + sum(math.log(c[0][v] / c[1][v]) for c, v in zip(chances, votes))
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
            yes[g] += n * p
            total[g] += n
            for by, v in zip(votes_by, votes):
                by[0][v] += n * p
                by[1][v] += n * (1 - p)
        chances = [[[max(x / sum(side), 1e-4) for x in side] for side in by] for by in votes_by]
        priors = {g: min(max(yes[g] / total[g], 0.01), 0.99) for g in priors}
    return VoteModel(tuple(tuple(math.log(a / b) for a, b in zip(*c)) for c in chances), {g: math.log(p / (1 - p)) for g, p in priors.items()})
