"""M5: the vector and string functions under SQL names, as expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, t) -> s + t)"
_DEFINITIONS = {
    "seq_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE":
        f"{_DOT.format(a='a', b='b')} / nullif(sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')}), 0D)",
    "seq_cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "1D - seq_cosine(a, b)",
    "seq_ranks(a ARRAY<FLOAT>) RETURNS ARRAY<DOUBLE>":
        "transform(a, x -> size(filter(a, y -> y < x)) + (size(filter(a, y -> y = x)) + 1) / 2D)",
    # ranks add up to n (n + 1) / 2, so centring needs no sum
    "seq_centred_ranks(a ARRAY<FLOAT>) RETURNS ARRAY<DOUBLE>": "transform(seq_ranks(a), r -> r - (size(a) + 1) / 2D)",
    "seq_spearman(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE":
        "IF(size(a) = size(b), aggregate(zip_with(seq_centred_ranks(a), seq_centred_ranks(b), (x, y) -> x * y), 0D, (s, t) -> s + t) / nullif("
        "sqrt(aggregate(seq_centred_ranks(a), 0D, (s, t) -> s + t * t)) * sqrt(aggregate(seq_centred_ranks(b), 0D, (s, t) -> s + t * t)), 0D), NULL)",
    "seq_l2_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE":
        "sqrt(aggregate(zip_with(a, b, (x, y) -> power(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)), 0D, (s, t) -> s + t))",
    "seq_strip_prefix(s STRING) RETURNS STRING": "array_join(slice(split(s, '[.]'), 2, greatest(size(split(s, '[.]')) - 1, 0)), '.')",
    "seq_normalize(s STRING) RETURNS STRING": "translate(s, 'UZOB-', 'XXXXX')",
    "seq_hamming(a STRING, b STRING) RETURNS INT":
        "IF(length(a) = length(b), IF(length(a) = 0, 0, aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> IF(x = y, 0, 1)), 0, (s, v) -> s + v)), NULL)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions callable from SQL in this session; returns their names."""
    for head, body in _DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in _DEFINITIONS]
