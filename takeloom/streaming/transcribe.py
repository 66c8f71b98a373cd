"""A place for an external recogniser: any object with a name and transcribe(path), made once per worker."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from takeloom.streaming.resume import with_retry

HYPOTHESES = "utt_id string, hypothesis string, recognizer string, elapsed_ms double, error string"


class Transcribing(Protocol):
    name: str

    def transcribe(self, path: str) -> str: ...


class Spelled:
    """A recogniser without audio: it reads the words of the file's own name, and fails for a file without one. For tests, and to try a pipeline out."""

    name = "spelled"

    def transcribe(self, path: str) -> str:
        stem = (path or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if not stem.strip():
            raise ValueError("no file name")
        return stem.replace("_", " ").lower()


def with_timeout(call: Callable, seconds: float) -> Callable:
    """call, given up with a TimeoutError after so many seconds; what it was doing goes on in a thread of its own until it ends."""

    def wrapped(*args):
        done: queue.SimpleQueue = queue.SimpleQueue()

        def work() -> None:
            try:
                done.put((True, call(*args)))
            except Exception as e:
                done.put((False, e))

        threading.Thread(target=work, daemon=True).start()
        try:
            good, result = done.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer within {seconds:g} s") from None
        if not good:
            raise result
        return result

    return wrapped


def hypotheses(manifest: DataFrame, make: Callable[[], Transcribing], attempts: int = 5, first_wait: float = 2.0, timeout: float = 90.0) -> DataFrame:
    """Hypotheses of (utt_id, wav_path). Each attempt may take `timeout` seconds. A file that fails after all attempts has its error instead, so the run goes on and only it need be done again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser = make()
        call = with_retry(with_timeout(recogniser.transcribe, timeout), attempts, first_wait)
        for pdf in frames:
            rows = []
            for utt, path in zip(pdf["utt_id"], pdf["wav_path"], strict=True):
                began = time.monotonic()
                try:
                    text, error = call(path), None
                except Exception as e:
                    text, error = None, str(e)
                rows.append((utt, text, recogniser.name, (time.monotonic() - began) * 1000, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HYPOTHESES.split(", ")])

    return manifest.select("utt_id", "wav_path").mapInPandas(run, HYPOTHESES)
