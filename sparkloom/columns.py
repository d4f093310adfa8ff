"""Names of columns that a table doesn't have yet."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem that is neither among ``taken`` (letter case aside, as Spark compares names) nor given twice."""
    seen = {t.lower() for t in taken}
    out = []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in seen:
            n += 1
            name = f"{stem}_{n}"
        seen.add(name.lower())
        out.append(name)
    return out
