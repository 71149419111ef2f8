"""Names in running text by an optional recogniser; absent, it says so and finds nothing."""

from __future__ import annotations

import json
import re
from pathlib import Path

DEFAULTS = {"entities": ["PERSON"], "language": "en", "score_threshold": 0.5}
_engine = None


def load_config(path: str | None) -> dict:
    """The recogniser's settings; defaults where there are none."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    except (OSError, ValueError):
        data = {}
    return DEFAULTS | (data if isinstance(data, dict) else {})


def _recogniser():
    """One recogniser per worker, made when first needed."""
    global _engine
    if _engine is None:
        from presidio_analyzer import AnalyzerEngine

        _engine = AnalyzerEngine()
    return _engine


def keep_span(text: str, allow: frozenset[str]) -> bool:
    """Whether a recognised span is a name: no identifier of code, not allowed, two letters or more."""
    value = text.strip()
    if len(value) < 2 or value.lower() in allow or value.startswith(("UH_", "Glide")):
        return False
    return not re.fullmatch(r"[A-Z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+", value)


def recognised_names(text: str, allow: frozenset[str], config: str | None = None) -> tuple[str, list[str]]:
    """('ok' or 'skipped', names in order, spellings that differ by case once)."""
    settings = load_config(config)
    try:
        spans = _recogniser().analyze(text=text, entities=settings["entities"], language=settings["language"])
    except Exception:  # the recogniser is optional: whatever fails in it, the run goes on
        return "skipped", []
    names: dict[str, str] = {}
    for s in sorted(spans, key=lambda s: s.start):
        value = text[s.start : s.end].strip()
        if s.entity_type == "PERSON" and s.score >= settings["score_threshold"] and keep_span(value, allow):
            names.setdefault(value.lower(), value)
    return "ok", list(names.values())
