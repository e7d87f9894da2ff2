"""Reproducible random draws: every uniform is a pure function of its key."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The uniform of a key is the first 8 hex digits of its md5 over 2^32.
HEX_DIGITS = 8
UNIFORM_RANGE = 4294967296.0


def uniform(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1) of the key ``part|part|...``. Columns enter as columns,
    strings and numbers as literals. Does not depend on partitioning or row order."""
    columns = [
        part.cast("string") if isinstance(part, Column) else F.lit(str(part)) for part in parts
    ]
    key = F.concat_ws("|", *columns)
    return F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("double") / UNIFORM_RANGE


def uniform_value(*parts: str | int) -> float:
    """The same number for a key known to the driver."""
    digest = hashlib.md5("|".join(str(part) for part in parts).encode()).hexdigest()
    return int(digest[:HEX_DIGITS], 16) / UNIFORM_RANGE


def largest(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def log_sum_exp(scores: Sequence[Column]) -> Column:
    """log of the sum of exponentials of several columns of one row."""
    top = largest(scores)
    return top + F.log(reduce(lambda a, b: a + b, [F.exp(s - top) for s in scores]))


def pick_category(weights: Sequence[Column], u: Column) -> Column:
    """First index whose running weight reaches ``u`` times the total weight. The last
    index is taken when rounding keeps the running weight below."""
    running, total = [], None
    for weight in weights:
        total = weight if total is None else total + weight
        running.append(total)
    index = F.lit(0)
    for partial in running[:-1]:
        index = index + (partial < u * total).cast("int")
    return index


def pick_from_log_scores(scores: Sequence[Column], u: Column) -> Column:
    """Draw an index with probability proportional to exp(score)."""
    top = largest(scores)
    return pick_category([F.exp(s - top) for s in scores], u)
