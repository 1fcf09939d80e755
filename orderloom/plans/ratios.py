"""SQL of the Indel ratio, so that DuckDB can check what the similarity functions give."""

from __future__ import annotations


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns: a fold over a's characters of the row of lengths, each row a fold over b's."""
    numbers = lambda text: f"list_transform(range(1, length({text}) + 1), lambda z: [z])"
    cell = f"CASE WHEN substr({a}, i[1], 1) = substr({b}, j[1], 1) THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], row[-1]) END"
    row = f"list_reduce({numbers(b)}, lambda row, j: list_append(row, {cell}), [CAST(0 AS BIGINT)])"
    return f"list_reduce({numbers(a)}, lambda above, i: {row}, list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT)))[-1]"


def indel(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {lcs(a, b)} / (length({a}) + length({b})) END"
