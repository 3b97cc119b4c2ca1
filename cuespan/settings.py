"""Typed settings, read from a YAML file of nested sections (or the defaults)."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Chunking:
    window_seconds: float = 45.0
    overlap_seconds: float = 10.0

    @property
    def stride(self) -> float:
        return self.window_seconds - self.overlap_seconds


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 4
    k_values: tuple[int, ...] = (1, 3, 5)


@dataclass(frozen=True)
class Frames:
    interval_seconds: float = 15.0


@dataclass(frozen=True)
class Evaluation:
    hit_iou: float = 0.3
    report_iou: tuple[float, ...] = (0.3, 0.5)
    oracle_margin_seconds: float = 120.0
    min_gap_seconds: float = 70.0


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    frames: Frames = field(default_factory=Frames)
    evaluation: Evaluation = field(default_factory=Evaluation)
    paths: dict[str, str] = field(default_factory=dict)


def _build(kind: type, given: dict) -> object:
    known = {f.name: f for f in fields(kind)}
    out = {}
    for name, value in given.items():
        if name not in known:
            continue  # sections may carry keys for other tools
        default = getattr(kind(), name)
        out[name] = _build(type(default), value or {}) if is_dataclass(default) else tuple(value) if isinstance(default, tuple) else value
    return kind(**out)


def load_settings(path: str | None = None) -> Settings:
    """Settings of a YAML file; relative paths are taken from the file's folder."""
    if path is None:
        return Settings()
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    base = Path(path).resolve().parent
    given["paths"] = {k: str(v) if Path(v).is_absolute() else str(base / v) for k, v in (given.get("paths") or {}).items()}
    return _build(Settings, given)  # type: ignore[return-value]
