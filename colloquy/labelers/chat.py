"""Labelers behind a chat-completions endpoint: a hosted golden one that may hear the recording, or a served candidate."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

from colloquy.labelers.base import CANDIDATE_SYSTEM, GOLDEN_SYSTEM, ModelLabeler, Reply, Request
from colloquy.labelers.http import HttpError, Transport, transport


def chat_labeler(
    golden: bool = False, model: str = "", base_url: str = "", api_key: str | None = None, max_output_tokens: int = 8192, temperature: float | None = 0.0,
    cut: Callable[[str, float, float], bytes] | None = None, audio_pad: float = 0.5, send: Transport | None = None,
) -> ModelLabeler:
    """``golden``: the hosted model; else a served one at ``base_url``, which gets text only.

    With ``cut`` the recording of the window is sent along. A request that is refused because the model takes no temperature is
    repeated without one, and so are all after it in that task. The key comes from ``api_key``, else the environment variable
    COLLOQUY_API_KEY of the executor.
    """
    model = model or ("gpt-4o-audio-preview" if golden and cut else "gpt-4o" if golden else "qwen")
    base_url = (base_url or ("https://api.openai.com/v1" if golden else "http://localhost:8000/v1")).rstrip("/")
    limit = "max_completion_tokens" if golden else "max_tokens"

    def open_():
        post, key = send or transport(), api_key if api_key is not None else os.environ.get("COLLOQUY_API_KEY", "")
        headers, heat = ({"Authorization": f"Bearer {key}"} if key else {}), [temperature]

        def body(request: Request) -> dict:
            content: str | list = request.prompt
            out: dict = {"model": model, limit: max_output_tokens}
            if golden and cut and request.audio_path and request.audio_seconds:
                sound = cut(request.audio_path, request.audio_start or 0.0, request.audio_seconds)
                data = {"data": base64.b64encode(sound).decode(), "format": "wav"}
                content = [{"type": "text", "text": request.prompt}, {"type": "input_audio", "input_audio": data}]
                out["modalities"] = ["text"]
            else:
                out["response_format"] = {"type": "json_object"}
            if heat[0] is not None:
                out["temperature"] = heat[0]
            return out | {"messages": [{"role": "system", "content": request.system}, {"role": "user", "content": content}]}

        def answer(request: Request) -> Reply:
            try:
                got = post("POST", f"{base_url}/chat/completions", headers, body(request))
            except HttpError as error:
                if heat[0] is None or error.status != 400 or "temperature" not in error.text:
                    raise
                heat[0] = None
                got = post("POST", f"{base_url}/chat/completions", headers, body(request))
            used = got.get("usage") or {}
            return Reply(got["choices"][0]["message"].get("content") or "", used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0)

        return answer

    return ModelLabeler(model, open_, GOLDEN_SYSTEM if golden else CANDIDATE_SYSTEM, model, "openai" if golden else "endpoint", audio_pad)
