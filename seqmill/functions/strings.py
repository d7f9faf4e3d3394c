"""String column helpers (built-in expressions, but for ``space_out``)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_prefix(idcol) -> Column:
    """Drop the first dot-separated component; an id without a dot becomes ''."""
    parts = F.split(_c(idcol), r"\.")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ".")


def normalize_residues(s) -> Column:
    """Rare residues U, Z, O, B and gap '-' become X."""
    return F.regexp_replace(_c(s), "[UZOB-]", "X")


def space_out(s) -> Column:
    """'ABC' -> 'A B C'; none beside the end of a line."""
    ends = "\n\r\u0085\u2028\u2029"

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        lined, between = re.compile(f"[{ends}]"), re.compile(f"(?<=[^{ends}])(?=[^{ends}])")
        return pa.array([None if x is None else between.sub(" ", x) if lined.search(x) else " ".join(x)
                         for x in texts.to_pylist()], pa.string())

    return run(_c(s))


def letters_upper(text) -> Column:
    """All letters of a text, upper-cased; a letter beyond A-Z becomes the unknown residue X."""
    letters = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\P{L}", "")
    return F.upper(F.regexp_replace(letters, "[^A-Za-z]", "X"))


def hamming(a, b) -> Column:
    """Number of differing positions; NULL when the lengths differ."""
    a, b = _c(a), _c(b)
    diff = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b),
                  F.when(F.length(a) == 0, F.lit(0)).otherwise(
                      F.aggregate(diff, F.lit(0), lambda s, v: s + v)))


def char_at(s, pos0) -> Column:
    """Character at 0-based position."""
    return F.substring(_c(s), _c(pos0) + 1, 1) if not isinstance(pos0, int) else F.substring(_c(s), pos0 + 1, 1)


def shift_string(s, offset: int, direction: str = "right", pad: str = "-") -> Column:
    """Shift right (prepend pad) or left (drop head, append pad), keeping the length."""
    s = _c(s)
    n = F.length(s)
    if direction == "right":
        return F.when(F.lit(offset) < n, F.substring(F.concat(F.repeat(F.lit(pad), offset), s), 1, n))
    return F.when(F.lit(offset) < n, F.rpad(F.substring(s, offset + 1, n), n, pad))
