"""The last resort of a scan: a provider asked about a column's small sample on the driver. Providers are pluggable."""

from __future__ import annotations

import json
import math
import os
import re
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from palimpsest.plans.documents import pairs_once


class Provider(Protocol):
    def ask(self, prompt: str) -> tuple[str, int]:
        """The answer's text and the tokens used."""


@dataclass(frozen=True)
class Result:
    sensitive: bool
    rule: str | None
    confidence: float


class ResponseError(ValueError):
    """An answer that isn't what was asked for. The message never quotes it."""


def prompt(table: str, column: str, data_type: str, values: list[str] | None) -> str:
    body = {"table": table, "column": column, "type": data_type}
    if values is not None:
        body["values"] = values
    return "Does this column hold personal or otherwise sensitive data? Answer with one JSON object with the fields sensitive (true or false), rule (snake_case, null if not sensitive) and confidence (0 to 1).\n" + json.dumps(body, ensure_ascii=False)


def parse(answer: str) -> Result:
    fenced = re.fullmatch(r"\s*```(?:json)?\s*\n(.*?)\n\s*```\s*", answer, re.DOTALL)
    try:
        found = json.loads(fenced[1] if fenced else answer, object_pairs_hook=pairs_once)
    except ValueError:
        raise ResponseError("the answer is no JSON object with each field once") from None
    if not isinstance(found, dict) or set(found) != {"sensitive", "rule", "confidence"}:
        raise ResponseError("the answer doesn't have the three fields")
    sensitive, rule, confidence = found["sensitive"], found["rule"], found["confidence"]
    if not isinstance(sensitive, bool):
        raise ResponseError("sensitive must be true or false")
    if isinstance(confidence, bool) or not isinstance(confidence, int | float) or not math.isfinite(confidence) or not 0 <= confidence <= 1:
        raise ResponseError("confidence must be from 0 to 1")
    if sensitive and not (isinstance(rule, str) and len(rule) <= 128 and re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", rule)):
        raise ResponseError("rule must be in snake_case")
    if not sensitive and rule is not None:
        raise ResponseError("rule must be null")
    return Result(sensitive, rule, float(confidence))


class BudgetSpent(RuntimeError):
    pass


class Classifier:
    """Asks within a budget of tokens; answers of little confidence don't count."""

    def __init__(self, provider: Provider, budget: int = 1_000_000, sample_size: int = 50, send_values: bool = True, min_confidence: float = 0.8):
        self.provider, self.budget, self.sample_size = provider, budget, sample_size
        self.send_values, self.min_confidence, self.used = send_values, min_confidence, 0

    def classify(self, table: str, column: str, data_type: str, values: list[str]) -> Result | None:
        if self.used >= self.budget:
            raise BudgetSpent("the budget of tokens is spent")
        try:
            answer, tokens = self.provider.ask(prompt(table, column, data_type, values[: self.sample_size] if self.send_values else None))
        except Exception as e:  # the text may hold values
            raise RuntimeError(f"the provider failed: {type(e).__name__}") from None
        if isinstance(tokens, bool) or not isinstance(tokens, int) or tokens < 0:
            raise ResponseError("the token count must be a whole number")
        self.used += tokens
        found = parse(answer)
        return found if found.confidence >= self.min_confidence else None


class HttpProvider:
    """A service that answers over HTTP. style "chat": messages in, choices and usage out; "generate": a prompt in, a
    response and evaluation counts out. key_variable: the environment variable that holds the key, if there is one."""

    def __init__(self, url: str, model: str, style: str = "chat", key_variable: str | None = None, timeout: float = 60):
        if style not in ("chat", "generate"):
            raise ValueError("style must be chat or generate")
        self.url, self.model, self.style, self.key_variable, self.timeout = url, model, style, key_variable, timeout

    def ask(self, prompt: str) -> tuple[str, int]:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]} if self.style == "chat" else {"model": self.model, "prompt": prompt, "stream": False}
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as f:
            found = json.load(f)
        if self.style == "chat":
            return found["choices"][0]["message"]["content"], found["usage"]["total_tokens"]
        return found["response"], found.get("prompt_eval_count", 0) + found.get("eval_count", 0)


PROVIDERS: dict[str, Callable[..., Provider]] = {"http": HttpProvider}


def register_provider(name: str, factory: Callable[..., Provider]) -> None:
    PROVIDERS[name] = factory


def from_settings(settings) -> Classifier | None:
    """What the configuration's section llm asks for; None if it is off."""
    if not settings.enabled:
        return None
    if settings.provider not in PROVIDERS:
        raise ValueError(f"unknown provider; there are {', '.join(sorted(PROVIDERS))}")
    return Classifier(PROVIDERS[settings.provider](**settings.options), settings.budget, settings.sample_size, settings.send_values, settings.min_confidence)
