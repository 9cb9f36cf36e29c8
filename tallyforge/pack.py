"""City packs: what a city's data is made of, as data.

A pack names the sources of the ledger with their renames and coercions, maps, flags, enrichment tables, summaries and
labels.  It is read from YAML or made in Python, and drives the DataFrame builders of ``catalog``.
"""

from __future__ import annotations

import csv
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

PLACEHOLDER = re.compile(r"\{(\w+)\}")


@dataclass
class Source:
    """One source of the ledger: files, and how their columns become the ledger's."""

    path: str
    reader: str = "union"  # union: by name, unknown columns are an error; mapped: renamed, extra columns go
    years: tuple[int, int] | None = None
    rename: dict[str, str] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    coerce: dict[str, str] = field(default_factory=dict)


@dataclass
class Pack:
    name: str
    sources: list[Source] = field(default_factory=list)
    canonical: list[dict] = field(default_factory=list)  # source, target, exact, prefix, case_insensitive
    flags: dict = field(default_factory=dict)  # offsetting: {keys, tolerance}; artifact: {keys, threshold}
    amount: str = "extended_amount"
    enrichment: dict[str, str] = field(default_factory=dict)
    summaries: dict[str, dict] = field(default_factory=dict)  # name -> {sql, requires}
    labels: dict[str, dict[str, str]] = field(default_factory=dict)
    facts: list[str] = field(default_factory=list)
    fiscal_year_start: int = 1
    base_dir: str = "."

    def load_map(self, file: str) -> list[tuple[str, str]]:
        """(source, canonical) rows of a map file in file order; a missing file raises."""
        with open(os.path.join(self.base_dir, file), newline="", encoding="utf-8") as f:
            rows = csv.reader(f)
            next(rows, None)
            return [(r[0], r[1]) for r in rows if len(r) >= 2]

    def facts_for(self, values: dict | None = None) -> list[str]:
        """Facts with their placeholders filled; a fact with one that has no value is left out."""
        values = values or {}
        out = []
        for fact in self.facts:
            names = PLACEHOLDER.findall(fact)
            if all(values.get(n) is not None for n in names):
                out.append(PLACEHOLDER.sub(lambda m: str(values[m[1]]), fact))
        return out

    def dictionary(self) -> dict[str, str]:
        """Labels of all tables in one mapping."""
        return {c: label for cols in self.labels.values() for c, label in cols.items()}


def load_pack(path: str) -> Pack:
    """A pack from its YAML file; unknown keys raise."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    sources = [Source(**{**s, "years": tuple(s["years"]) if s.get("years") else None}) for s in raw.pop("sources", [])]
    return Pack(sources=sources, base_dir=str(Path(path).parent), **raw)
