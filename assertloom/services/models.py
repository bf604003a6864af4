"""Text models behind one interface: a deterministic built-in one, and any server with a chat-completions endpoint."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from dataclasses import dataclass
from typing import Protocol

SYSTEM = "You are an expert in hardware verification and temporal assertions."
TO_TEXT = "Describe in English what this assertion checks.\n\n{signals}\n\n{sva}"
TO_CODE = "Write one assertion for this description. Answer with code only.\n\n{svad}"


class TextModel(Protocol):
    name: str

    def generate(self, prompt: str, system: str | None = None, temperature: float | None = None) -> str: ...


@dataclass(frozen=True)
class Echo:
    """Answers with the last paragraph of the prompt: enough to run pipelines without a server."""

    name: str = "echo"

    def generate(self, prompt: str, system: str | None = None, temperature: float | None = None) -> str:
        return prompt.rsplit("\n\n", 1)[-1]


@dataclass(frozen=True)
class Server:
    """A model behind HTTP; the key is read from an environment variable on the machine that calls."""

    base_url: str
    name: str
    key_variable: str = "TEXT_MODEL_KEY"
    temperature: float = 0.7
    max_tokens: int = 4096
    seconds: float = 120.0

    def messages(self, messages: list[dict], temperature: float | None = None, **more) -> str:
        body = {"model": self.name, "messages": messages, "temperature": temperature or self.temperature, "max_tokens": self.max_tokens} | more
        return self._post("/chat/completions", body)["choices"][0]["message"]["content"]

    def generate(self, prompt: str, system: str | None = None, temperature: float | None = None) -> str:
        head = [{"role": "system", "content": system}] if system else []
        return self.messages([*head, {"role": "user", "content": prompt}], temperature)

    def models(self) -> list[str]:
        return [m["id"] for m in self._post("/models", None).get("data", [])]

    def _post(self, path: str, body: dict | None) -> dict:
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        request = urllib.request.Request(self.base_url.rstrip("/") + path, None if body is None else json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=self.seconds) as r:
            return json.load(r)


def health(models: list[TextModel], pause: float = 0.0) -> list[tuple[str, bool, str]]:
    """(name, ok, reply or error) of each model, asked one after the other."""
    out = []
    for i, m in enumerate(models):
        time.sleep(pause if i else 0)
        try:
            out.append((m.name, True, m.generate("Say OK.", temperature=0.1)))
        except Exception as e:  # a server that fails is the finding
            out.append((m.name, False, f"{type(e).__name__}: {e}"))
    return out
