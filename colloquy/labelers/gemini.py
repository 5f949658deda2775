"""A hosted golden labeler that hears the recording of a window."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from colloquy.labelers.base import GOLDEN_SYSTEM, ModelLabeler, Reply, Request
from colloquy.labelers.http import Transport, transport

BASE = "https://generativelanguage.googleapis.com"


def gemini_labeler(
    model: str = "gemini-2.5-pro", api_key: str | None = None, max_output_tokens: int = 8192, temperature: float = 0.0, audio_pad: float = 0.5,
    cut: Callable[[str, float, float], bytes] | None = None, base_url: str = BASE, patience: float = 60.0, send: Transport | None = None, sleep: Callable[[float], None] = time.sleep,
) -> ModelLabeler:
    """Text alone, or with ``cut`` the window's recording: uploaded, awaited for ``patience`` seconds, and deleted whatever happens.

    The key comes from ``api_key``, else the environment variable COLLOQUY_API_KEY of the executor.
    """

    def open_():
        call, key = send or transport(), api_key if api_key is not None else os.environ.get("COLLOQUY_API_KEY", "")
        headers = {"x-goog-api-key": key}

        def upload(sound: bytes) -> dict:
            kind = {"X-Goog-Upload-Protocol": "raw", "Content-Type": "audio/wav"}
            file, waited = call("POST", f"{base_url}/upload/v1beta/files", headers | kind, sound)["file"], 0.0
            try:
                while file.get("state") == "PROCESSING" and waited < patience:
                    sleep(1.0)
                    waited += 1.0
                    file = call("GET", f"{base_url}/v1beta/{file['name']}", headers, None)
                if file.get("state", "ACTIVE") != "ACTIVE":
                    raise TimeoutError(f"the recording is {file.get('state')} after {waited:.0f} s")
            except Exception:
                call("DELETE", f"{base_url}/v1beta/{file['name']}", headers, None)
                raise
            return file

        def answer(request: Request) -> Reply:
            parts: list[dict] = [{"text": request.prompt}]
            file = None
            if cut and request.audio_path and request.audio_seconds:
                file = upload(cut(request.audio_path, request.audio_start or 0.0, request.audio_seconds))
                parts.append({"file_data": {"mime_type": "audio/wav", "file_uri": file["uri"]}})
            body = {
                "system_instruction": {"parts": [{"text": request.system}]},
                "contents": [{"role": "user", "parts": parts}],
                "generationConfig": {"temperature": temperature, "maxOutputTokens": max_output_tokens, "responseMimeType": "application/json"},
            }
            try:
                got = call("POST", f"{base_url}/v1beta/models/{model}:generateContent", headers, body)
            finally:
                if file:
                    call("DELETE", f"{base_url}/v1beta/{file['name']}", headers, None)
            used = got.get("usageMetadata") or {}
            text = "".join(p.get("text", "") for p in got["candidates"][0]["content"]["parts"])
            return Reply(text, used.get("promptTokenCount") or 0, used.get("candidatesTokenCount") or 0)

        return answer

    return ModelLabeler(model, open_, GOLDEN_SYSTEM, model, "gemini", audio_pad)
