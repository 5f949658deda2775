"""The one place that would use the network: a transport, which tests replace."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

#: (method, url, headers, body) to the decoded JSON of the answer; a dict is sent as JSON, bytes as they are.
Transport = Callable[[str, str, dict[str, str], dict | bytes | None], dict]


class HttpError(Exception):
    """An answer of status 400 or more, with its text."""

    def __init__(self, status: int, text: str):
        super().__init__(f"{status}: {text[:500]}")
        self.status, self.text = status, text


def transport(timeout: float = 600.0) -> Transport:
    """A transport over urllib."""

    def send(method: str, url: str, headers: dict[str, str], body: dict | bytes | None) -> dict:
        data = json.dumps(body).encode() if isinstance(body, dict) else body
        kind = {"Content-Type": "application/json"} if isinstance(body, dict) else {}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, kind | headers, method=method), timeout=timeout) as answer:
                text = answer.read()
        except urllib.error.HTTPError as error:
            raise HttpError(error.code, error.read().decode("utf-8", "replace")) from error
        return json.loads(text) if text.strip() else {}

    return send
