"""Running best lists of many claims over blocks of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Scores that differ by less are ties, and ties go to the smaller id.
DIGITS = 9
#: New hits that wait, at least, before they are sorted into the best lists; or as many as these hold.
WAITING = 1 << 14


class Best:
    """The k best ids of every claim so far: a few numbers for each, however many scores pass by."""

    def __init__(self, claims: int, k: int) -> None:
        self.k = k
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(claims, -np.inf)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: claims x ids; NaN is no hit."""
        if not scores.size:
            return
        scores, slack = np.where(np.isnan(scores), -np.inf, scores), 2 * 10.0**-DIGITS
        least = self.least
        if (more := scores.shape[1] - self.k) > 0:
            least = np.maximum(least, np.partition(scores, more, axis=1)[:, more])
        row, col = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
        self.waiting.append((row, ids[col], scores[row, col]))
        if sum(len(w[0]) for w in self.waiting) > max(len(self.row), WAITING):
            self._merge()

    def _merge(self) -> None:
        row, ids, score = (np.concatenate(x) for x in zip((self.row, self.id, self.score), *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((ids, -np.round(score, DIGITS), row))
        row = row[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        order, row = order[place < self.k], row[place < self.k]
        self.row, self.id, self.score = row, ids[order], score[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[row[last]] = self.score[last]

    def rows(self, claims: np.ndarray) -> Iterator[pa.RecordBatch]:
        """claim_id, id, score."""
        self._merge()
        yield pa.RecordBatch.from_arrays([pa.array(claims[self.row], pa.int64()), pa.array(self.id, pa.int64()), pa.array(self.score)], ["claim_id", "id", "score"])
