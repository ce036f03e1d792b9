"""Models as column functions: a protocol, registries, a mock, an HTTP chat model, and Arrow-batched recognition."""

from __future__ import annotations

import base64
import http.client
import importlib
import json
import os
import urllib.parse
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import images
from pagemill.operators.codecs import otsl_html


class ModelError(Exception):
    """A request that failed; kind is one of the failure kinds."""

    def __init__(self, message: str, kind: str = "model_error"):
        super().__init__(message)
        self.kind = kind


class Model(Protocol):
    def infer(self, image: bytes | None, prompt: str) -> str: ...


def infer_batch(model: Model, requests: list[tuple[bytes | None, str]]) -> list[str | ModelError]:
    """Answers in order, one for each request; a model without infer_batch is asked one by one."""
    if hasattr(model, "infer_batch"):
        out = model.infer_batch(requests)
        if len(out) != len(requests):
            raise ModelError("a batch answer of a wrong length")
        return out
    out = []
    for image, prompt in requests:
        try:
            out.append(model.infer(image, prompt))
        except ModelError as e:
            out.append(e)
    return out


class Registry:
    """Named factories; an id can't be taken twice."""

    def __init__(self, what: str):
        self.what, self.entries = what, {}

    def add(self, name: str, entry: Callable) -> Callable:
        if not name or name in self.entries:
            raise ValueError(f"{self.what} {name!r} is empty or taken")
        self.entries[name] = entry
        return entry

    def get(self, name: str) -> Callable:
        if name not in self.entries:
            raise ValueError(f"unknown {self.what} {name!r}")
        return self.entries[name]


BACKENDS, DECODERS, CROPPERS = Registry("backend"), Registry("recognition adapter"), Registry("cropper")


class MockModel:
    """Answers the same text always, or what a table says for the prompt; for tests."""

    def __init__(self, settings: dict):
        self.response, self.by_prompt, self.fails = settings.get("response", ""), settings.get("responses", {}), settings.get("fails")

    def infer(self, image: bytes | None, prompt: str) -> str:
        if self.fails:
            raise ModelError(self.fails)
        return self.by_prompt.get(prompt, self.response)


class HttpService:
    """Posts JSON over one connection that is kept: timeouts, size cap, bearer from the environment, no redirects, 2xx only."""

    def __init__(self, settings: dict):
        self.url = urllib.parse.urlsplit(settings["url"])
        self.timeout, self.most, self.key = settings.get("timeout_seconds", 120), settings.get("max_response_bytes", 16 << 20), settings.get("api_key_env")
        self.connection: http.client.HTTPConnection | None = None

    def post(self, body: dict) -> bytes:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[self.key]}"} if self.key else {})
        path = (self.url.path or "/") + (f"?{self.url.query}" if self.url.query else "")
        used = self.connection is not None
        try:
            if not used:
                kind = http.client.HTTPSConnection if self.url.scheme == "https" else http.client.HTTPConnection
                self.connection = kind(self.url.hostname, self.url.port, timeout=self.timeout)
            self.connection.request("POST", path, json.dumps(body).encode(), headers)
            answer = self.connection.getresponse()
            data = answer.read(self.most + 1)
        except TimeoutError:
            self.drop()
            raise ModelError("timeout", "http_timeout") from None
        except (http.client.RemoteDisconnected, ConnectionResetError, BrokenPipeError) as e:
            self.drop()
            if used:  # the service closed an idle connection: once more on a new one
                return self.post(body)
            raise ModelError(f"no connection: {e}", "http_connection") from None
        except (OSError, http.client.HTTPException) as e:
            self.drop()
            raise ModelError(f"no connection: {e}", "http_connection") from None
        if len(data) > self.most:
            self.drop()
            raise ModelError("the response is over the limit", "http_response_limit")
        if not 200 <= answer.status < 300:
            raise ModelError(f"HTTP {answer.status}", f"http_{answer.status}")
        return data

    def drop(self) -> None:
        if self.connection is not None:
            self.connection.close()
        self.connection = None


def data_url(image: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(image).decode()


class ChatModel(HttpService):
    """A chat service that takes an image and a prompt."""

    def __init__(self, settings: dict):
        super().__init__(settings)
        self.model = settings["model"]
        self.temperature, self.max_tokens = settings.get("temperature", 0.0), settings.get("max_tokens", 4096)

    def infer(self, image: bytes | None, prompt: str) -> str:
        content = [{"type": "text", "text": prompt}]
        if image is not None:
            content.insert(0, {"type": "image_url", "image_url": {"url": data_url(image)}})
        data = self.post({"model": self.model, "messages": [{"role": "user", "content": content}], "temperature": self.temperature, "max_tokens": self.max_tokens})
        try:
            first = json.loads(data)["choices"][0]
            text = first["message"]["content"]
        except (ValueError, LookupError, TypeError):
            raise ModelError("an answer without content") from None
        if first.get("finish_reason") == "length":
            raise ModelError("the answer was cut short")
        return text


class JsonModel(HttpService):
    """A service that takes {image, prompt} and answers an object: its text, or the whole object (layout boxes) where it has none.

    A batch is sent as {items} and answered as {results} of the same length and order, where the service says so.
    """

    def __init__(self, settings: dict):
        super().__init__(settings)
        if settings.get("batch_requests"):
            self.infer_batch = self.many

    @staticmethod
    def item(image: bytes | None, prompt: str) -> dict:
        return {"prompt": prompt} | ({"image": data_url(image)} if image is not None else {})

    @staticmethod
    def text(answer: object) -> str:
        if not isinstance(answer, dict):
            raise ModelError("an answer that isn't an object")
        return answer["text"] if isinstance(answer.get("text"), str) else json.dumps(answer)

    def parsed(self, data: bytes) -> object:
        try:
            return json.loads(data)
        except ValueError:
            raise ModelError("an answer that isn't JSON") from None

    def infer(self, image: bytes | None, prompt: str) -> str:
        return self.text(self.parsed(self.post(self.item(image, prompt))))

    def many(self, requests: list[tuple[bytes | None, str]]) -> list[str]:
        answer = self.parsed(self.post({"items": [self.item(*r) for r in requests]}))
        results = answer.get("results") if isinstance(answer, dict) else None
        if not isinstance(results, list) or len(results) != len(requests):
            raise ModelError("a batch answer of a wrong length")
        return [self.text(r) for r in results]


BACKENDS.add("mock", MockModel)
BACKENDS.add("chat", ChatModel)
BACKENDS.add("http_json", JsonModel)
for _name in ("text", "generic", "ctc"):
    DECODERS.add(_name, lambda raw: raw)
DECODERS.add("table", otsl_html)
DECODERS.add("table.otsl", otsl_html)
CROPPERS.add("bbox", lambda image, box, points, fallback: images.crop(image, box))
CROPPERS.add("polygon_mask", lambda image, box, points, fallback: images.polygon_crop(image, box, points, fallback=fallback))


def load_plugin(module: str) -> None:
    """Import a module whose register(backends, decoders, croppers) adds to the registries."""
    importlib.import_module(module).register(BACKENDS, DECODERS, CROPPERS)


def default_decoder(kind: str) -> str:
    return "table" if kind == "table" else "text"


ANSWERS = "response string, raw_text string, error string, kind string"


def recognise(regions: DataFrame, settings: dict, keys: list[str], image: str | None = None, batch_size: int = 1, plugins: tuple[str, ...] = ()) -> DataFrame:
    """keys, model, response, raw_text, error and kind of asking one model for each region (keys, type, prompt[, image]).

    The model is made once a task and asked in batches of batch_size.
    """
    settings = dict(settings)

    @F.pandas_udf(ANSWERS)
    def ask(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for p in plugins:
            load_plugin(p)
        model = BACKENDS.get(settings["backend"])(settings)
        for kinds, prompts, pictures in parts:
            rows = []
            for at in range(0, len(kinds), batch_size):
                some = [(bytes(i) if i is not None else None, p or "") for i, p in zip(pictures[at : at + batch_size], prompts[at : at + batch_size], strict=True)]
                try:
                    answers = infer_batch(model, some)
                except ModelError as e:
                    answers = [e] * len(some)
                for kind, a in zip(kinds[at : at + batch_size], answers, strict=True):
                    if isinstance(a, ModelError):
                        rows.append((None, None, str(a), a.kind))
                        continue
                    try:
                        rows.append((DECODERS.get(settings.get("adapter") or default_decoder(kind))(a), a, None, None))
                    except ValueError as e:
                        rows.append((None, a, str(e), "model_error"))
            yield pd.DataFrame(rows, columns=["response", "raw_text", "error", "kind"])

    picture = F.col(image) if image else F.lit(None).cast("binary")
    asked = regions.select(*keys, F.lit(settings["id"]).alias("model"), ask.asNondeterministic()("type", "prompt", picture).alias("a"))
    return asked.select(*keys, "model", "a.*")
