"""Size-tiered compaction: which runs to merge, the merge, and which tombstones may go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import merge


@dataclass(frozen=True)
class Merge:
    level: int
    run_ids: tuple[int, ...]


def plan(levels: dict[int, list[tuple[int, int]]], factor: int, max_level: int = 9) -> list[Merge]:
    """Of each level with `factor` runs or more (run_id, max_seq), its oldest `factor` go one level up. The levels are
    those before the pass: what a merge adds counts in the next one."""
    out = []
    for level in range(max_level + 1):
        runs = sorted(levels.get(level, []), key=lambda r: r[1])
        if len(runs) >= factor:
            out.append(Merge(level, tuple(r[0] for r in runs[:factor])))
    return out


def merged(inputs: DataFrame, older: DataFrame | None = None, complete: int | None = None) -> DataFrame:
    """The newest version of each key of the inputs. A tombstone stays if an older run outside may hold its key, or if its seq is
    above `complete`, up to which all changes are known to have come (None: all have)."""
    rows = merge(inputs)
    dead, kept = rows.where("is_deleted"), rows.where(~F.col("is_deleted"))
    if complete is not None:
        kept = kept.unionByName(dead.where(F.col("seq") > complete))
        dead = dead.where(F.col("seq") <= complete)
    if older is None:
        return kept
    return kept.unionByName(dead.join(older.select("key").distinct(), "key", "left_semi"))


def passes(n_runs: int, factor: int) -> dict[int, int]:
    """Runs by level after `n_runs` flushes with one pass after each that leaves `factor` level-0 runs."""
    levels: dict[int, list[tuple[int, int]]] = {}
    for i in range(n_runs):
        levels.setdefault(0, []).append((i, i))
        if len(levels[0]) >= factor:
            for m in plan(levels, factor):
                gone = [r for r in levels[m.level] if r[0] in m.run_ids]
                levels[m.level] = [r for r in levels[m.level] if r[0] not in m.run_ids]
                levels.setdefault(m.level + 1, []).append((max(r[0] for r in gone), max(r[1] for r in gone)))
    return {k: len(v) for k, v in levels.items() if v}
