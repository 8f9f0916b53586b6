"""A ball tree over integer vectors, searched for the greatest inner products.

A node's ball, a centre and a radius, bounds the inner product of a query with
any vector in it: that with the centre plus the query's norm times the radius.
Leaves wait in the order of their bounds; for queries whose k-th score known so far,
here or in another tree, is beyond a leaf's bound, it is not opened.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 64
#: Bounds are floating-point numbers; this share of their terms covers rounding.
SLACK = 1e-9
#: No score is known yet.
UNKNOWN = np.iinfo(np.int64).min


@dataclass
class BallTree:
    vectors: np.ndarray  # int64, a row each, nodes' rows side by side
    ids: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    spans: np.ndarray  # begin, end, first child (0: a leaf; its sibling is next)

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
        """Halves each node at the median along the line between two far points."""
        points = vectors.astype(np.float64)
        order = np.arange(len(ids))
        centres, radii, spans = [], [], [[0, len(ids), 0]]
        node = 0
        while node < len(spans):
            begin, end, _ = spans[node]
            own = points[order[begin:end]]
            centre = own.mean(axis=0)
            from_centre = np.linalg.norm(own - centre, axis=1)
            centres.append(centre)
            radii.append(float(from_centre.max()))
            if end - begin > leaf:
                a = own[from_centre.argmax()]
                b = own[np.linalg.norm(own - a, axis=1).argmax()]
                half = (end - begin) // 2
                # By position, so that equal vectors are halved too.
                order[begin:end] = order[begin:end][np.argpartition(own @ (b - a), half)]
                spans[node][2] = len(spans)
                spans += [[begin, begin + half, 0], [begin + half, end, 0]]
            node += 1
        return cls(
            vectors[order], ids[order], np.array(centres), np.array(radii), np.array(spans)
        )

    def parts(self) -> list[bytes]:
        """The arrays as bytes; ``from_parts`` reads them."""
        return [
            self.vectors.astype("<i8").tobytes(),
            self.ids.astype("<i8").tobytes(),
            self.centres.astype("<f8").tobytes(),
            self.radii.astype("<f8").tobytes(),
            self.spans.astype("<i8").tobytes(),
        ]

    @classmethod
    def from_parts(cls, parts: list[bytes], dim: int) -> BallTree:
        vectors, ids, centres, radii, spans = parts
        own_ids, own_radii = np.frombuffer(ids, "<i8"), np.frombuffer(radii, "<f8")
        return cls(
            np.frombuffer(vectors, "<i8").reshape(len(own_ids), dim),
            own_ids,
            np.frombuffer(centres, "<f8").reshape(len(own_radii), dim),
            own_radii,
            np.frombuffer(spans, "<i8").reshape(-1, 3),
        )

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products, a row for each query and a column for each node."""
        points = queries.astype(np.float64)
        norms = np.linalg.norm(points, axis=1)
        far = np.linalg.norm(self.centres, axis=1) + self.radii
        reach = np.outer(norms, self.radii + SLACK * far)
        return points @ self.centres.T + reach + SLACK

    def search(
        self, query: np.ndarray, own_id: int, bounds: np.ndarray, k: int, least: int | None
    ) -> list[tuple[int, int]]:
        """Up to k pairs ``(score, id)`` among vectors with other ids, best first: see ``search_all``."""
        floor = None if least is None else np.array([least])
        found = self.search_all(query[None], np.array([own_id]), bounds[None], k, floor)
        return list(zip(found[1].tolist(), found[2].tolist(), strict=True))

    def search_all(
        self,
        queries: np.ndarray,
        own_ids: np.ndarray,
        bounds: np.ndarray,
        k: int,
        least: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(at, score, id)``: for each query up to k vectors with other ids, best first.

        Ties go to the smaller id. Scores below ``least``, the k-th known from elsewhere
        (``UNKNOWN`` if none is), are left out. ``bounds`` has a row for each query.
        Leaves come in the order of their bounds; one is opened for all queries that it
        may still have something for, by one product of matrices.
        """
        whole = self._needs_integers(queries)
        vectors = self.vectors if whole else self.vectors.astype(np.float64)
        points = queries if whole else queries.astype(np.float64)
        floor = np.full(len(queries), UNKNOWN) if least is None else least.astype(np.int64)
        reach = np.ascontiguousarray(bounds.T)
        for node in np.flatnonzero(self.spans[:, 2]).tolist():  # parents come before children
            child = self.spans[node, 2]
            np.minimum(reach[child : child + 2], reach[node], out=reach[child : child + 2])
        leaves = np.flatnonzero(self.spans[:, 2] == 0)
        first = leaves[np.argsort(-reach[leaves].max(axis=1, initial=-np.inf), kind="stable")]
        best = (np.empty(0, np.int64),) * 3
        more, waiting = [], 0
        for leaf in first.tolist():
            open_ = np.flatnonzero(reach[leaf] >= floor)
            if not len(open_):
                continue
            begin, end, _ = self.spans[leaf].tolist()
            scores = (points if len(open_) == len(points) else points[open_]) @ vectors[begin:end].T
            row, column = np.nonzero(scores >= floor[open_, None])
            at, ids = open_[row], self.ids[begin:end][column]
            other = ids != own_ids[at]
            more.append((at[other], scores[row, column][other].astype(np.int64), ids[other]))
            waiting += len(more[-1][0])
            if 2 * waiting >= k * len(queries):
                best, more, waiting = _best([best, *more], k, floor), [], 0
        return _best([best, *more], k, floor)

    def _needs_integers(self, query: np.ndarray) -> bool:
        """Whether sums could leave the integers that floating point holds exactly."""
        most = float(np.abs(query).max(initial=0)) * self._largest() * query.shape[-1]
        return most >= 2.0**53

    def _largest(self) -> float:
        return float(np.abs(self.vectors).max(initial=0))


def _best(
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ``(at, score, id)`` of each query, in order; raises ``floor`` to the k-th scores."""
    at, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -score, at))
    rank = np.arange(len(at)) - np.searchsorted(at[order], at[order])
    order, rank = order[rank < k], rank[rank < k]
    last = order[rank == k - 1]
    floor[at[last]] = np.maximum(floor[at[last]], score[last])
    return at[order], score[order], ids[order]
