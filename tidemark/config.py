"""Configuration: dataclasses per section, layered from defaults, a root file, an explicit file; unknown keys are errors."""

from __future__ import annotations

import dataclasses as dc
import tomllib
from pathlib import Path

from tidemark.functions import classify
from tidemark.operators import rank

FILE_NAME = "tidemark.toml"


@dc.dataclass
class History:
    since: str = "6 months ago"
    fix_words: list[str] = dc.field(default_factory=lambda: list(classify.FIX_WORDS))
    max_cochange_commit_size: int = 25
    bot_patterns: list[str] = dc.field(default_factory=lambda: list(classify.BOTS))
    min_cochange_together: int = 3
    min_cochange_strength: float = 0.4
    sweep_fraction: float = 0.5
    sweep_min_dir_files: int = 4
    sweep_min_files: int = 6
    min_lift: float = 3.0
    min_commits_for_lift: int = 20
    explained_min_share: float = 0.5


@dc.dataclass
class Discover:
    exclude: list[str] = dc.field(default_factory=list)
    data_min_lines: int = 150
    data_max_logic_density: float = 0.04


@dc.dataclass
class Metrics:
    cognitive_hard: int = 15
    brain_lines: int = 100
    brain_cognitive: int = 15
    brain_locals: int = 15


@dc.dataclass
class Clones:
    k: int = 30
    window: int = 20
    min_tokens: int = 70
    max_files: int = 40


@dc.dataclass
class Strings:
    min_len: int = 20
    min_words: int = 2
    min_files: int = 3
    near_jaccard: float = 0.8
    rare_word_df: int = 40


@dc.dataclass
class Clumps:
    min_group: int = 3
    max_group: int = 4
    max_params: int = 8
    min_functions: int = 4
    min_files: int = 2
    min_typed_slots: int = 2


@dc.dataclass
class Plan:
    max_steps: int = 6
    fold_test_clones: bool = True
    kind_priority: list[str] = dc.field(default_factory=lambda: ["fold_test_clones", "canonicalise_clone", "extract", "cut_cycle_edge"])


@dc.dataclass
class Report:
    with_history: dict[str, float] = dc.field(default_factory=lambda: dict(rank.WITH_HISTORY))
    without_history: dict[str, float] = dc.field(default_factory=lambda: dict(rank.WITHOUT_HISTORY))
    no_tests_multiplier: float = 1.15
    complexity_max_share: float = 0.6
    cycle_coupling: float = 0.6


@dc.dataclass
class Config:
    discover: Discover = dc.field(default_factory=Discover)
    history: History = dc.field(default_factory=History)
    metrics: Metrics = dc.field(default_factory=Metrics)
    clones: Clones = dc.field(default_factory=Clones)
    strings: Strings = dc.field(default_factory=Strings)
    clumps: Clumps = dc.field(default_factory=Clumps)
    plan: Plan = dc.field(default_factory=Plan)
    report: Report = dc.field(default_factory=Report)

    @classmethod
    def load(cls, root: str | Path, explicit: str | Path | None = None) -> "Config":
        cfg = cls()
        for path, must in ((Path(root) / FILE_NAME, False), (Path(explicit) if explicit else None, True)):
            if path and (must or path.is_file()):
                cfg = cfg.overlaid(tomllib.loads(path.read_text()), str(path))
        return cfg

    def overlaid(self, tables: dict, where: str = "config") -> "Config":
        """A copy with the given tables spliced over, key by key."""
        sections = {}
        for f in dc.fields(self):
            base, over = getattr(self, f.name), tables.get(f.name, {})
            known = {x.name for x in dc.fields(base)}
            for k in over:
                if k not in known:
                    raise ValueError(f"invalid {where}: unknown key {f.name}.{k}")
            new = {}
            for k, v in over.items():
                old = getattr(base, k)
                if isinstance(old, dict):
                    for name in v:
                        if name not in old:
                            raise ValueError(f"invalid {where}: unknown key {f.name}.{k}.{name}")
                    v = old | v
                new[k] = v
            sections[f.name] = dc.replace(base, **new)
        for k in tables:
            if k not in sections:
                raise ValueError(f"invalid {where}: unknown key {k}")
        return dc.replace(self, **sections)

    def to_toml(self) -> str:
        """The effective configuration; reads back to an equal one."""

        def value(v) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, str):
                return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
            if isinstance(v, list):
                return "[" + ", ".join(map(value, v)) + "]"
            if isinstance(v, dict):
                return "{ " + ", ".join(f"{k} = {value(x)}" for k, x in v.items()) + " }"
            return repr(v)

        return "\n".join(f"[{f.name}]\n" + "".join(f"{x.name} = {value(getattr(getattr(self, f.name), x.name))}\n" for x in dc.fields(getattr(self, f.name))) for f in dc.fields(self))
