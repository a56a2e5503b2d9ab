"""Models as opaque functions: what an embedder, reranker, reader of pictures and generator must be, with retries and offline stand-ins."""

from __future__ import annotations

import base64
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column

from ..functions.text import private_types, redacted
from .answer import NO_EVIDENCE
from .embed import feature_hashing


class QuotaError(RuntimeError):
    """The model's quota is used up; try again after so many seconds."""

    def __init__(self, retry_after: float = 30.0) -> None:
        super().__init__(f"quota used up, again in {retry_after} s")
        self.retry_after = retry_after


def retried(call: Callable[..., Any], attempts: int, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """``call`` tried up to ``attempts`` times, waiting twice as long each time; the last error is raised."""

    def run(*args: Any) -> Any:
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k + 1 == attempts:
                    raise
                sleep(min(most, first * 2**k))

    return run


def quota_checked(call: Callable[..., Any]) -> Callable[..., Any]:
    """Errors that speak of a rate limit become QuotaError."""

    def run(*args: Any) -> Any:
        try:
            return call(*args)
        except QuotaError:
            raise
        except Exception as e:
            said = str(e).lower()
            if "429" in said or "rate limit" in said:
                raise QuotaError() from e
            raise

    return run


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class BatchEmbedder:
    """Texts in batches of ``size``; each batch is tried five times, and after a used-up quota once more; counts must agree."""

    model: Embedder = feature_hashing
    size: int = 32
    pause: float = 0.1
    attempts: int = 5
    sleep: Callable[[float], None] = time.sleep
    on_quota: Callable[[], None] = lambda: None

    def batch(self, texts: list[str]) -> np.ndarray:
        call = retried(quota_checked(self.model), self.attempts, sleep=self.sleep)
        try:
            got = call(texts)
        except QuotaError as e:
            self.on_quota()
            self.sleep(e.retry_after)
            got = call(texts)
        if len(got) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(got)} vectors")
        return np.asarray(got)

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = []
        for at in range(0, len(texts), self.size):
            parts.append(self.batch(texts[at : at + self.size]))
            if at + self.size < len(texts):
                self.sleep(self.pause)
        return np.concatenate(parts) if parts else np.zeros((0, 0))


def image_url(path: str, data: bytes) -> str:
    """An image as a data URL; the kind follows the file name, PNG where it says nothing."""
    ext = path.rpartition(".")[2].lower()
    kind = {"jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "gif": "gif"}.get(ext, "png")
    return f"data:image/{kind};base64,{base64.b64encode(data).decode()}"


def image_hashing(images: list[str]) -> np.ndarray:
    """Deterministic stand-in for an image model: the hashed pieces of the data URL."""
    return feature_hashing([" ".join(u[i : i + 8] for i in range(0, len(u), 8)) for u in images])


def lexical_rerank(query: str, texts: list[str]) -> list[float]:
    """Share of the query's different words that each text has; stands in for a cross-encoder."""
    import re

    words = set(re.findall(r"\w+", query.lower()))
    return [len(words & set(re.findall(r"\w+", t.lower()))) / len(words) if words else 0.0 for t in texts]


def reranked(query: str, candidates: list[dict], k: int, score: Callable[[str, list[str]], list[float]] = lexical_rerank, most: int = 50, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """The best ``k`` of the first ``most`` candidates by a model tried three times; on failure, or without a query, as they come."""
    few = candidates[:most]
    if not few or not query.strip():
        return few[:k]
    try:
        got = retried(score, 3, sleep=sleep)(query, [c["content"] or "" for c in few])
    except Exception:
        return few[:k]
    order = sorted(range(len(few)), key=lambda i: (-round(got[i], 4), i))
    return [few[i] | {"score": round(float(got[i]), 4)} for i in order[:k]]


EMPTY_VISION = {"functional_summary": "", "components": [], "relationships": [], "spatial_layout": ""}


def analysed(look: Callable[[bytes], str], read: Callable[[str], bytes], sleep: Callable[[float], None] = time.sleep) -> Callable[[str | None], str | None]:
    """Raw analysis of a figure by its path: three tries; no path gives null, a failure an empty object."""

    def run(path: str | None) -> str | None:
        if not path:
            return None
        try:
            return retried(lambda: look(read(path)), 3, sleep=sleep)()
        except Exception:
            return "{}"

    return run


def joined_regions(regions: list[str]) -> str:
    """What a second reader of pictures found, region by region, as one text."""
    return " ".join(regions)


@dataclass(frozen=True)
class Prompt:
    """Fixed wording of the prompt; version and assistant are labels of it."""

    assistant_id: str = "default"
    version: str = "v1"
    system: str = "You are an enterprise AI assistant. Answer the user's question using ONLY the provided evidence. If evidence is insufficient, state that clearly."
    user: str = "EVIDENCE:\n{evidence}\n\nQUESTION:\n{query}\n\nANSWER:"


def prompt(assistant_id: str = "default", version: str = "v1") -> Prompt:
    return Prompt(assistant_id, version)


# What is answered when the model says nothing or fails.
NOTHING_SAID = "Unable to generate an answer from the evidence."
FAILED = "An error occurred while generating the answer from retrieved evidence."


def generated(query: str, evidence: list[dict], model: Callable[[str], str] | None = None, template: Prompt | None = None) -> str:
    """The answer of a model to the evidence as numbered blocks; without a model, the best block's content."""
    if not evidence:
        return NO_EVIDENCE
    blocks = [f"[Source {i} - Chunk {e['chunk_id']} - Page {e.get('page_number')}" + (f" [{e['context_prefix']}]" if e.get("context_prefix") else "") + f"]\n{e['content']}" for i, e in enumerate(evidence, 1)]
    try:
        t = template or Prompt()
        said = model(f"{t.system}\n\n{t.user.format(evidence='\n\n'.join(blocks), query=query)}") if model else evidence[0]["content"]
    except Exception:
        return FAILED
    return said.strip() or NOTHING_SAID


class PIIDetector(Protocol):
    """Gives the redacted text and the types found, as columns of a column of text."""

    def __call__(self, text: Column) -> tuple[Column, Column]: ...


def private_patterns(text: Column) -> tuple[Column, Column]:
    """The detector by the fixed patterns."""
    return redacted(text), private_types(text)


@dataclass
class Services:
    """The registry of models; each may be replaced."""

    embedder: Embedder = field(default_factory=BatchEmbedder)
    image_embedder: Embedder = image_hashing
    rerank: Callable[[str, list[str]], list[float]] = lexical_rerank
    generate: Callable[[str], str] | None = None
    pii: PIIDetector = private_patterns
    look: Callable[[bytes], str] | None = None
    policy: Callable[[dict], bool | dict] | None = None
