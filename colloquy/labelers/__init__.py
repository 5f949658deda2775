"""Labelers: who answers the prompt of a window. A model labeler is opened once per task; the rule-based one is an expression."""

from __future__ import annotations

from colloquy.labelers.base import HeuristicLabeler, Labeler, ModelLabeler, Reply, Request
from colloquy.labelers.chat import chat_labeler
from colloquy.labelers.gemini import gemini_labeler
from colloquy.labelers.local import local_labeler

__all__ = ["HeuristicLabeler", "Labeler", "ModelLabeler", "Reply", "Request", "get_labeler", "labeler_kind"]

#: The names under which the labelers are known.
LABELERS: dict[str, str] = {
    "gemini": "gemini", "golden": "gemini", "openai": "openai", "gpt": "openai",
    "qwen": "endpoint", "endpoint": "endpoint", "candidate": "endpoint", "local": "local", "hf": "local", "vllm": "local",
    "mock": "heuristic", "heuristic": "heuristic",
}


def labeler_kind(name: str) -> str:
    """gemini, openai, endpoint, local or heuristic for any of its names, letter case ignored; ValueError for others."""
    kind = LABELERS.get(name.strip().lower())
    if kind is None:
        raise ValueError(f"no labeler {name!r}")
    return kind


def get_labeler(name: str, **options) -> Labeler:
    """The labeler of a name with its options; nothing is imported, loaded or connected before a task opens it."""
    kind = labeler_kind(name)
    if kind == "heuristic":
        return HeuristicLabeler(**options)
    if kind == "gemini":
        return gemini_labeler(**options)
    if kind == "local":
        if name.strip().lower() in ("hf", "vllm"):
            options.setdefault("engine", name.strip().lower())
        return local_labeler(**options)
    return chat_labeler(golden=kind == "openai", **options)
