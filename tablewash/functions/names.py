"""Column-name helpers. Flattened JSON gives names such as ``a.b``; every
reference to a column goes through ``c`` so dots are never read as struct access."""

from pyspark.sql import Column, functions as F


def q(name: str) -> str:
    """Backquote a column name for use in a column reference or SQL text."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def header_names(cells) -> list[str]:
    """Column names of a header row: an empty cell is named by its place, a repeated name gets the
    next free number."""
    given = [v if v not in (None, "") else f"Unnamed: {i}" for i, v in enumerate(cells)]
    taken, names = set(given), []
    for name in given:
        own, n = name, 0
        while own in names or (n and own in taken):
            n += 1
            own = f"{name}.{n}"
        names.append(own)
    return names
