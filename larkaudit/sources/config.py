"""Where inputs are: environment first, then a JSON file, then a given place."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path


@lru_cache(maxsize=4)
def settings(path: str | None = None) -> dict:
    path = path or os.environ.get("LARKAUDIT_CONFIG", "larkaudit.json")
    return json.loads(Path(path).read_text()) if os.path.exists(path) else {}


def place(name: str, otherwise: str | None = None) -> str:
    """LARKAUDIT_<NAME> of the environment, else the setting, else ``otherwise``."""
    found = os.environ.get(f"LARKAUDIT_{name.upper()}") or settings().get(name) or otherwise
    if not found:
        raise KeyError(f"{name} is not set")
    return found


@dataclass(frozen=True)
class RunConfig:
    """One audit run over three input files."""

    expression: str
    clinical: str
    gene_sets: str
    output: str
    gene_id: str = "gene_id"
    patient_id: str = "patient_id"
    endpoint: str = "stage_group"
    classes: tuple[tuple[str, int], ...] = (("early", 0), ("advanced", 1))
    folds: int = 3
    repeats: int = 2
    seed: int = 20260707

    @classmethod
    def load(cls, path: str) -> RunConfig:
        """From JSON; relative paths are against the folder above the file's."""
        raw = json.loads(Path(path).read_text())
        base = Path(path).resolve().parent.parent
        for k in ("expression", "clinical", "gene_sets", "output"):
            raw[k] = str(base / raw[k])
        raw["classes"] = tuple(raw.get("classes", dict(cls.classes)).items())
        return cls(**raw)
