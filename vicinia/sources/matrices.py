"""Substitution score matrices: loading, checking, and a lookup that tries both orders.

The widely used protein matrices are public text tables; point ``load_matrix`` (or the
``matrix_dir`` of ``named_matrix``) at a folder that holds them. None is kept here.
"""

from __future__ import annotations

from pathlib import Path

Score = float


def parse_matrix(lines: list[str]) -> dict[str, Score]:
    """A white-space table: comments after ``#``, a header row of symbols, then a row for each symbol."""
    rows = [line.split() for line in (x.split("#", 1)[0] for x in lines) if line.strip()]
    if not rows:
        raise ValueError("the table is empty")
    header, out = rows[0], {}
    for row in rows[1:]:
        symbol, values = row[0], row[1:]
        if len(values) != len(header):
            raise ValueError(f"the row of {symbol!r} has {len(values)} scores for {len(header)} symbols")
        for other, value in zip(header, values, strict=True):
            out[symbol + other] = float(value)
    return checked(out)


def load_matrix(path: str | Path) -> dict[str, Score]:
    return parse_matrix(Path(path).read_text().splitlines())


def checked(matrix: dict[str, Score]) -> dict[str, Score]:
    """Keys are two symbols; values are of one number type."""
    if not isinstance(matrix, dict) or not matrix:
        raise ValueError("a score matrix is a dict that isn't empty")
    if any(not isinstance(k, str) or len(k) != 2 for k in matrix):
        raise ValueError("keys of a score matrix are two symbols")
    kinds = {type(v) for v in matrix.values()}
    if len(kinds) != 1 or not kinds <= {int, float}:
        raise ValueError("values of a score matrix are all int or all float")
    return matrix


def named_matrix(name: str, matrix_dir: str | Path) -> dict[str, Score]:
    """The table of a name (blosum62, blosum, pam250 or pam) in a folder, whatever the case and suffix of its file."""
    want = {"blosum": "blosum62", "pam": "pam250"}.get(name.lower(), name.lower())
    for path in sorted(Path(matrix_dir).iterdir()):
        if path.is_file() and path.name.lower().split(".")[0] == want:
            return load_matrix(path)
    raise ValueError(f"no table for {name!r} in {matrix_dir}")


def score(matrix: dict[str, Score], a: str, b: str) -> Score:
    if (found := matrix.get(a + b)) is None and (found := matrix.get(b + a)) is None:
        raise KeyError(a + b)
    return found
