"""A label model over noisy labelling functions, fitted by expectation maximisation on counts of vote patterns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Votes: the defect is there, it is not, no opinion.
YES, NO, ABSTAIN = 1, 0, -1


@dataclass
class LabelModel:
    """The share of the defect, and for each function the chance of each vote given that the defect is there or not."""

    share: float
    given_yes: np.ndarray  # functions x (no, yes, abstain)
    given_no: np.ndarray
    cutoff: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of the defect for rows of votes."""
        column = np.where(votes == YES, 1, np.where(votes == NO, 0, 2))
        k = np.arange(votes.shape[1])
        yes = np.log(self.share) + np.log(self.given_yes[k, column]).sum(axis=1)
        no = np.log(1 - self.share) + np.log(self.given_no[k, column]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 60, start: float = 0.02) -> LabelModel:
    """votes: distinct patterns (rows) of the functions' votes, counts: how many records have each.

    Starts from functions that are right nine times in ten; the counts are smoothed by a small prior, so that a function that
    never fires stays defined. The cutoff is the one with the best expected F1 of the posteriors, between 0.3 and 0.9.
    """
    n = votes.shape[1]
    column = np.where(votes == YES, 1, np.where(votes == NO, 0, 2))
    model = LabelModel(start, np.tile([0.08, 0.62, 0.30], (n, 1)), np.tile([0.62, 0.03, 0.35], (n, 1)), 0.5)
    total = max(float(counts.sum()), 1.0)
    for _ in range(rounds):
        p = model.posterior(votes)
        yes, no = np.full((n, 3), 0.5), np.full((n, 3), 0.5)
        for k in range(n):
            np.add.at(yes[k], column[:, k], p * counts)
            np.add.at(no[k], column[:, k], (1 - p) * counts)
        model = LabelModel(float(np.clip((p * counts).sum() / total, 1e-6, 0.5)), yes / yes.sum(axis=1, keepdims=True), no / no.sum(axis=1, keepdims=True), 0.5)
    p = model.posterior(votes)
    best = max((0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), key=lambda c: (round(_expected_f1(p, counts, c), 6), -abs(c - 0.5)))
    return LabelModel(model.share, model.given_yes, model.given_no, best)


def _expected_f1(p: np.ndarray, counts: np.ndarray, cutoff: float) -> float:
    chosen = p >= cutoff
    hit = float((p * counts)[chosen].sum())
    return 2 * hit / max(float(counts[chosen].sum() + (p * counts).sum()), 1e-9)


def validated_cutoff(model: LabelModel, votes: np.ndarray, counts: np.ndarray, planted: np.ndarray, times: np.ndarray) -> float:
    """The cutoff between 0.3 and 0.9 with the best F1 on planted defects.

    Recall is the share of the planted defects over the cutoff; precision follows from it, the defect's share and what the
    cutoff flags of all records. Ties go to the cutoff nearest 0.5.
    """
    p, q = model.posterior(votes), model.posterior(planted)
    said, own = (votes == YES).any(axis=1), (planted == YES).any(axis=1)

    def f1(cutoff: float) -> float:
        recall = float(times[(q >= cutoff) & own].sum()) / max(float(times.sum()), 1.0)
        flagged = float(counts[(p >= cutoff) & said].sum()) / max(float(counts.sum()), 1.0)
        return 2 * min(model.share * recall, flagged) / max(flagged + model.share, 1e-12)

    return max((0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), key=lambda c: (round(f1(c), 6), -abs(c - 0.5)))
