"""Runs of several detectors and clusterers over one cloud.

A detector turns points into (segments, members), a clusterer turns discontinuities into (labels, centres); both are
any callables with a name. A detection is made once and used by every clusterer; results carry an explicit run id.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..shared_store import written


@dataclass(frozen=True)
class Step:
    """A named algorithm with its parameters."""

    name: str
    call: Callable
    settings: dict = field(default_factory=dict)

    def __call__(self, *tables):
        return self.call(*tables, **self.settings)


@dataclass(frozen=True)
class Result:
    run_id: str
    segments: DataFrame
    members: DataFrame
    labels: DataFrame
    settings: dict


def runs(points: DataFrame, detectors: list[Step], clusterers: list[Step]) -> list[Result]:
    """Every detector with every clusterer."""
    out = []
    for i, detect in enumerate(detectors):
        segments, members = (written(t, "detected") for t in detect(points))
        for j, cluster in enumerate(clusterers):
            out.append(Result(f"{i}-{detect.name}__{j}-{cluster.name}", segments, members, cluster(segments), {detect.name: detect.settings, cluster.name: cluster.settings}))
    return out
