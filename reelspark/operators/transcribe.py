"""Speech to text through a provider: any function of a payload, run where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class ProviderError(Exception):
    """A failed request; ``status`` is that of the answer, none if there was no answer."""

    def __init__(self, status: int | None = None) -> None:
        super().__init__(status)
        self.status = status


#: text and language of the speech in a payload of a content type; a blank text is silence.
Provider = Callable[[bytes, str], tuple[str | None, str | None]]

RESULT = "text string, language string, outcome string, category string"


def category(status: int | None) -> str:
    if status == 429:
        return "rate_limited"
    if status in (401, 403):
        return "configuration"
    return "transient" if status is None or status in (408, 425) or status >= 500 else "permanent"


def transcribe(work: DataFrame, provider: Provider, key: str = "utterance_id") -> DataFrame:
    """(key, text, language, outcome, category) of ``work``'s rows (key, payload, content_type): succeeded,
    no_speech, retry or failed. Errors of the provider end a row, not the task; a null payload fails. Rows
    are asked about anew when a task runs again, so a provider must bear repeated requests."""

    def one(payload, content_type) -> tuple:
        if payload is None:
            return None, None, "failed", "permanent"
        try:
            text, language = provider(bytes(payload), content_type)
        except ProviderError as error:
            kind = category(error.status)
            return None, None, "retry" if kind in ("transient", "rate_limited") else "failed", kind
        text = (text or "").strip()
        return (text, language, "succeeded", None) if text else (None, None, "no_speech", None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(*r) for r in zip(batch["payload"], batch["content_type"], strict=True)]
            yield pd.DataFrame({key: batch[key], **{n.split()[0]: pd.Series([r[k] for r in rows], index=batch.index, dtype=object) for k, n in enumerate(RESULT.split(", "))}})

    kind = work.schema[key].dataType.simpleString()
    return work.select(key, "payload", "content_type").mapInPandas(run, f"{key} {kind}, {RESULT}")
