"""Clients of chat-completion endpoints for decisions, with an injected transport.

A client maps a prompt to a Reply. What a provider answers is judged by one
table of status ranges; every failure is an error whose class name is what
an attempt records, and no message ever holds the key, a body or a header.
make_client() returns what a task calls once, so nothing but plain values
travels to the tasks and the key is read where the call is made.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: (url, body, headers, seconds) -> (HTTP status, body)
Transport = Callable[[str, bytes, dict, float], tuple[int, bytes]]


class LLMClientError(RuntimeError):
    """A call that gave no usable answer."""


class LLMTimeoutError(LLMClientError):
    """No answer in time."""


class LLMRateLimitError(LLMClientError):
    """The provider asks to slow down."""


class LLMServerError(LLMClientError):
    """The provider failed."""


class LLMAuthError(LLMClientError):
    """No key, or one that is refused."""


class LLMProtocolError(LLMClientError):
    """An answer that is no chat completion."""


#: First and last status of a range, and the error it means; any other status but 200 is a plain LLMClientError.
STATUSES = ((401, 401, LLMAuthError), (403, 403, LLMAuthError), (429, 429, LLMRateLimitError), (500, 599, LLMServerError))

#: Errors after which another try can't succeed are still tried as often as any other: attempts are counted alike, and the
#: evidence gate rejects runs with an LLMAuthError.
CATEGORIES = tuple(c.__name__ for c in (LLMTimeoutError, LLMRateLimitError, LLMServerError, LLMAuthError, LLMProtocolError, LLMClientError))


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    finish_reason: str | None = None


@dataclass(frozen=True)
class Endpoint:
    """Where and how to ask; key_env names the environment variable of the key, or of several with commas between."""

    url: str
    model: str
    key_env: str
    system: str = ""
    temperature: float = 0.0
    max_tokens: int = 256
    timeout: float = 30.0

    def key(self) -> str:
        found = [k for k in map(str.strip, os.environ.get(self.key_env, "").split(",")) if k]
        if not found:
            raise LLMAuthError(f"the environment variable {self.key_env} holds no key")
        return found[0]

    def body(self, prompt: str) -> bytes:
        said = [("system", self.system)] * bool(self.system) + [("user", prompt)]
        return json.dumps({
            "model": self.model, "messages": [{"role": r, "content": c} for r, c in said],
            "temperature": self.temperature, "max_tokens": self.max_tokens, "stream": False,
        }).encode()


def over_http(url: str, body: bytes, headers: dict, seconds: float) -> tuple[int, bytes]:
    """The default transport; an error status is an answer like any other."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=seconds) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def completion(raw: bytes) -> Reply:
    """The first choice of an envelope; an answer without content is an empty text, without choices an error."""
    try:
        envelope = json.loads(raw)
        choice, used = envelope["choices"][0], envelope.get("usage") or {}
        said = (choice or {}).get("message") or {}
        return Reply(said.get("content") or "", int(used.get("prompt_tokens") or 0), int(used.get("completion_tokens") or 0), (choice or {}).get("finish_reason"))
    except (ValueError, LookupError, TypeError, AttributeError) as e:
        raise LLMProtocolError(f"no chat completion: {type(e).__name__}") from None


def ask(endpoint: Endpoint, prompt: str, transport: Transport = over_http) -> Reply:
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {endpoint.key()}"}
    try:
        status, raw = transport(endpoint.url.rstrip("/") + "/chat/completions", endpoint.body(prompt), headers, endpoint.timeout)
    except OSError as e:  # URLError and TimeoutError are OSErrors
        cause = getattr(e, "reason", e)
        if isinstance(cause, TimeoutError):
            raise LLMTimeoutError(f"no answer in {endpoint.timeout} s") from None
        raise LLMClientError(f"network error: {type(cause).__name__}") from None
    for first, last, error in STATUSES:
        if first <= status <= last:
            raise error(f"HTTP status {status}")
    if status != 200:
        raise LLMClientError(f"HTTP status {status}")
    return completion(raw)


def make_client(endpoint: Endpoint, transport: Transport = over_http) -> Callable[[], Callable[[str], Reply]]:
    """For decide(): made once in a task, asked for each try."""
    return lambda: lambda prompt: ask(endpoint, prompt, transport)
