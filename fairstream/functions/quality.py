"""Quality class of a reported item by its true frequency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(freq: Column | str, n: int, phi: float, epsilon: float) -> Column:
    freq = F.col(freq) if isinstance(freq, str) else freq
    return (
        F.when(freq >= n * phi, "frequent").when(freq >= n * (phi - epsilon), "almost").otherwise("rare")
    )
