"""Left lookups of one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Mapping[str, str] | Sequence[str],
    null_safe: Sequence[str] = (),
) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row per key.

    ``on`` maps a column of ``rows`` to its column in ``table``; the key columns of ``table``
    do not appear in the result. Whether the table is broadcast is left to Spark: pass a stored
    table, so that its size is known and not guessed. Where both sides are shuffled, the adaptive
    plan cuts the rows of a hot key (NULL included) into as many tasks as their measured size asks
    for and repeats only that key's row of the table; see ``session.SETTINGS``.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    right_key = {left: f"_key_{i}" for i, left in enumerate(pairs)}
    right = table.withColumnsRenamed({pairs[left]: new for left, new in right_key.items()})
    condition = F.lit(True)
    for left, new in right_key.items():
        equal = F.col(left).eqNullSafe(F.col(new)) if left in null_safe else F.col(left) == F.col(new)
        condition = condition & equal
    return rows.join(right, condition, "left").drop(*right_key.values())
