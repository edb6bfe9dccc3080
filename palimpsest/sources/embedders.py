"""Embedders behind HTTP, as Arrow-batched column functions."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import functions as F

RETRY_STATUS = {408, 429, 500, 502, 503, 504}


def post(url: str, body: dict, headers: dict | None = None, tries: int = 3, timeout: float = 60.0, wait: Callable[[float], None] = time.sleep) -> dict:
    """A JSON answer; tries again after half a second, one, two, with jitter, where the status or the line may heal."""
    data = json.dumps(body).encode()
    for n in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})}), timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or n == tries - 1:
                raise
        except urllib.error.URLError:
            if n == tries - 1:
                raise
        wait(0.5 * 2**n + random.random() * 0.1)
    raise AssertionError


def http_embedder(url: str, model: str, kind: str = "openai", key: str | None = None, batch: int = 128):
    """A column function text -> array<double>; `kind` is openai (/embeddings) or ollama (/api/embed). Null texts are embedded as empty ones."""
    headers = {"Authorization": f"Bearer {key}"} if key else {}

    def ask(texts: list[str]) -> list[list[float]]:
        if kind == "ollama":
            return post(f"{url.rstrip('/')}/api/embed", {"model": model, "input": texts}, headers)["embeddings"]
        got = post(f"{url.rstrip('/')}/embeddings", {"model": model, "input": texts}, headers)["data"]
        return [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]

    def embed(batches: Iterator) -> Iterator:
        import pandas as pd

        for s in batches:
            texts = [t or "" for t in s]
            yield pd.Series([v for i in range(0, len(texts), batch) for v in ask(texts[i : i + batch])])

    # An iterator function: its types are told by hints, which must name real classes.
    import pandas as pd

    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<double>")
