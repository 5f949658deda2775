"""What a labeler is: a name, a system prompt, and a way to open it."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Request:
    """One window: its prompt, and where in which recording it was spoken (seconds), if there is one."""

    system: str
    prompt: str
    audio_path: str | None = None
    audio_start: float | None = None
    audio_seconds: float | None = None


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


Answer = Callable[[Request], Reply | str]

TASK = (
    "You are given part of a conversation with several people. For every line marked [>> ] decide to whom it is spoken. Name the "
    "people addressed as they are written in the list of speakers, answer GROUP where everyone is meant, and UNKNOWN where it cannot "
    "be told. Nobody addresses themselves. Lines marked [CTX] only help you to understand; do not label them."
)
FORM = 'Answer with one JSON object and nothing else: {"labels": [{"turn_id": 0, "addressees": ["name"], "confidence": 0.0, "rationale": "a few words"}]}'
GOLDEN_SYSTEM = f"{TASK} If you hear the recording, let voices, pauses and who answers decide over the words alone. {FORM}"
CANDIDATE_SYSTEM = f"{TASK} You only have the words: look for names, for who spoke before and who answers, and for questions. {FORM}"


@dataclass(frozen=True)
class ModelLabeler:
    """A labeler that answers prompts. ``open`` is called once per task and returns the function that answers one request."""

    name: str
    open: Callable[[], Answer]
    system: str = CANDIDATE_SYSTEM
    model: str = ""
    engine: str = ""
    audio_pad: float = 0.5
    options: dict = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class HeuristicLabeler:
    """The rule-based labeler with a share of answers changed by a hash."""

    noise: float = 0.0
    seed: int = 0

    @property
    def name(self) -> str:
        return f"heuristic(noise={self.noise:g})"


Labeler = ModelLabeler | HeuristicLabeler


def ffmpeg_cut(path: str, start: float, seconds: float) -> bytes:
    """A stretch of a recording as a WAV of one channel, 16 kHz, 16 bits; needs ffmpeg on the executor."""
    if shutil.which("ffmpeg") is None:
        raise RuntimeError("ffmpeg is not installed")
    command = ["ffmpeg", "-v", "error", "-ss", f"{start:.3f}", "-t", f"{seconds:.3f}", "-i", path, "-ac", "1", "-ar", "16000", "-c:a", "pcm_s16le", "-f", "wav", "-"]
    return subprocess.run(command, capture_output=True, check=True).stdout
