"""Plumbing that the operators share with the rest of the library."""

from collections.abc import Iterable

from quern.tables import components, new_path, salted_join, scratch_dir, settle

__all__ = ["components", "fresh", "new_path", "salted_join", "scratch_dir", "settle"]


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of those taken equals, whatever the case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name
