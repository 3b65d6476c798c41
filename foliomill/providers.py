"""Models behind a small interface, with deterministic offline implementations and retries."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from foliomill.operators.retrieve import overlap_order
from foliomill.operators.segment import word_target_chunker


class Provider(ABC):
    """What the pipeline asks of a model."""

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...

    @abstractmethod
    def chunk(self, sentences: list[str]) -> list[tuple[int, str]]: ...

    @abstractmethod
    def rerank(self, question: str, chunks: list[str]) -> list[int]: ...

    @abstractmethod
    def answer(self, question: str, chunks: list[tuple[str, str]]) -> dict: ...

    def vision(self, image: bytes, mode: str) -> str | None:
        """Text of an image (mode ``ocr`` or ``entity``); None if it can't be told.  Without a model there is none."""
        return None

    def models(self) -> str:
        """What tells the models apart; part of every cache key."""
        return type(self).__name__


class Offline(Provider):
    """Feature hashing, word targets and word overlap; equal input gives equal output everywhere."""

    def __init__(self, size: int = 256, words: int = 200) -> None:
        self.size, self._chunk = size, word_target_chunker(words)

    def models(self) -> str:
        return f"offline-{self.size}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def chunk(self, sentences: list[str]) -> list[tuple[int, str]]:
        return self._chunk(sentences)

    def rerank(self, question: str, chunks: list[str]) -> list[int]:
        return overlap_order(question, chunks)

    def answer(self, question: str, chunks: list[tuple[str, str]]) -> dict:
        """Extractive: the first sentence of every chunk (hash, text); rejected without chunks."""
        items = [{"answer": t.split("\n\n", 1)[-1].split(". ")[0].strip(), "chunk_ref_list": [h]} for h, t in chunks]
        return {"question_rephrased": question, "answer_list": items, "answer_conclusion": items[0]["answer"] if items else "", "follow_up_questions_list": [],
                "is_rejected": not items, "rejection_reason": "" if items else "no context"}


REGISTRY: dict[str, Callable[[], Provider]] = {"offline": Offline}


def retry(call: Callable, attempts: int = 10, first: float = 1.0, factor: float = 2.0, most: float = 60.0, retryable: tuple = (ConnectionError, TimeoutError), sleep=time.sleep):
    """Call until it succeeds; waits grow by ``factor`` up to ``most`` seconds; other errors and the last one are raised."""
    wait = first
    for k in range(attempts):
        try:
            return call()
        except retryable:
            if k == attempts - 1:
                raise
            sleep(min(wait, most))
            wait *= factor


def embed_with_ladder(provider: Provider, text: str, too_long: type[Exception] = ValueError) -> np.ndarray | None:
    """Embed; where the text is too long, again with 90 %, 80 %, ... of its words; None if nothing is short enough."""
    words = text.split()
    for tenths in range(10, 0, -1):
        try:
            return provider.embed([text if tenths == 10 else " ".join(words[: len(words) * tenths // 10])])[0]
        except too_long:
            continue
    return None


def embed_all(provider: Provider, texts: list[str], too_long: type[Exception] = ValueError) -> list:
    """Vectors of all texts with retries; where one of them is too long or fails, each goes alone, shortened, and what still fails has None."""
    try:
        return list(retry(lambda: provider.embed(texts), attempts=3))
    except Exception:  # one bad text costs itself only
        out = []
        for t in texts:
            try:
                out.append(retry(lambda t=t: embed_with_ladder(provider, t, too_long)))
            except Exception:
                out.append(None)
        return out


def vision_text(provider: Provider, image: bytes, mode: str) -> str | None:
    """Text of an image: ``ocr``, ``entity``, ``both`` (OCR text, a space and the entities' text; null if either is) or ``none``."""
    if mode == "none":
        return None
    parts = [retry(lambda m=m: provider.vision(image, m)) for m in (("ocr", "entity") if mode == "both" else (mode,))]
    return None if any(p is None for p in parts) else " ".join(parts)


def vision_mode(ocr: bool, entity: bool) -> str:
    """Which questions an image is asked."""
    return "both" if ocr and entity else "ocr" if ocr else "entity" if entity else "none"


def embed(rows: DataFrame, provider: Provider, text: str = "chunk_text") -> DataFrame:
    """Rows with ``vector array<float>``; null texts and texts whose embedding fails have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = embed_all(provider, [t or "" for t in b[text]])
            b["vector"] = [v if t is not None else None for v, t in zip(vectors, b[text], strict=True)]
            yield b

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(work, f"{fields}, vector array<float>")
