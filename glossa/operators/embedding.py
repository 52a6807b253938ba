"""Vectors of texts from a model's server, asked from inside the partitions."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.classify import URL, Provider

#: An address and a body, to status, its text, and the answer's body.
Transport = Callable[[str, dict], tuple[int, str, str]]

BATCH_TEXTS = 32
RETRIES, PAUSE = 2, 0.5
SHOWN = 200  # characters of an answer in an error
_FOUND = "text string, model string, vector array<double>, error string"


def over_http(address: str, body: dict, timeout: float = 60.0) -> tuple[int, str, str]:
    request = urllib.request.Request(address, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.reason, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as failed:
        return failed.code, failed.reason, failed.read().decode("utf-8", "replace")


class Client:
    """Asks for many texts at once, and where the server doesn't know that address, one by one at its older one."""

    def __init__(self, transport: Transport, url: str, retries: int, pause: float):
        self.transport, self.url, self.retries, self.pause = transport, url.rstrip("/"), retries, pause

    def ask(self, path: str, body: dict) -> tuple[int, str, str]:
        """The answer, asked for again after broken connections and answers that say to come back."""
        for k in range(self.retries + 1):
            try:
                answer = self.transport(f"{self.url}{path}", body)
            except OSError as failed:
                answer = 0, str(failed), ""
            if answer[0] and answer[0] != 429 and answer[0] < 500:
                break
            if k < self.retries:
                time.sleep(self.pause * 2**k)
        return answer

    def vectors(self, texts: list[str], model: str) -> list[tuple[list[float] | None, str | None]]:
        """A vector or an error for each text."""
        answer = self.ask("/api/embed", {"model": model, "input": texts})
        if answer[0] == 404:
            return [self.older(text, model) for text in texts]
        if 200 <= answer[0] < 300:
            found = _read(answer[2], "embeddings")
            if isinstance(found, list) and len(found) == len(texts) and all(map(_is_vector, found)):
                return [(v, None) for v in found]
            error = "Invalid embedding response from /api/embed"
        else:
            error = _failed(answer)
        if len(texts) == 1:
            return [(None, error)]
        return [self.vectors([text], model)[0] for text in texts]  # so that one text's failure isn't all others'

    def older(self, text: str, model: str) -> tuple[list[float] | None, str | None]:
        answer = self.ask("/api/embeddings", {"model": model, "prompt": text})
        if not 200 <= answer[0] < 300:
            return None, _failed(answer)
        found = _read(answer[2], "embedding")
        return (found, None) if _is_vector(found) else (None, "Invalid embedding response from /api/embeddings")


def _read(body: str, name: str):
    try:
        answer = json.loads(body)
    except ValueError:
        return None
    return answer.get(name) if isinstance(answer, dict) else None


def _is_vector(v) -> bool:
    return isinstance(v, list) and all(isinstance(x, (int, float)) for x in v)


def _failed(answer: tuple[int, str, str]) -> str:
    status, said, body = answer
    return f"Embedding request failed: {status} {said}" + (f" — {body[:SHOWN]}" if body else "")


def asked(transport: Transport = over_http, url: str = URL, retries: int = RETRIES, pause: float = PAUSE) -> Provider:
    """The provider that asks a server: text, model, vector, error for distinct (text, model), one of vector and error being null.

    A text is asked for once for each model, whatever the number of records, as the answers
    are kept; those that an executor takes with it when it is lost are asked for again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(transport, url, retries, pause)
        for batch in batches:
            of: dict[str, list[str]] = defaultdict(list)
            for text, model in zip(*(c.to_pylist() for c in batch.columns)):
                of[model].append(text)
            for model, texts in of.items():
                for lo in range(0, len(texts), BATCH_TEXTS):
                    part = texts[lo : lo + BATCH_TEXTS]
                    vectors, errors = zip(*client.vectors(part, model))
                    vectors = [None if v is None else [float(x) for x in v] for v in vectors]
                    columns = [pa.array(part, pa.string()), pa.array([model] * len(part), pa.string()), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["text", "model", "vector", "error"])

    def provided(wanted: DataFrame) -> DataFrame:
        distinct = wanted.select(F.coalesce("text", F.lit("")).alias("text"), "model").where("model is not null").distinct()
        return distinct.mapInArrow(run, _FOUND).persist()

    return provided
