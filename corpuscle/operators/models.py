"""Slots for neural models, and the backends that an upload is sent to.

A slot is a pair of functions: `load()` makes a model, once for each worker process; `call(model, row)` gives a row's
result. No model is included: the stand-ins here are deterministic, say what they are, and serve tests.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.operators.media import backend

SEGMENTS = "array<struct<start:double,end:double,text:string>>"
#: What a speech or reading backend returns of an upload; fields that a backend lacks are null.
RESULT = f"text string, language string, probability double, segments {SEGMENTS}, lines array<string>"
#: Samples that a streaming recogniser takes at once.
FRAMES = 4000

_LOADED: dict[str, Any] = {}


@dataclass(frozen=True)
class Slot:
    """name: under which a worker keeps the model."""

    name: str
    load: Callable[[], Any]
    call: Callable[[Any, dict], dict]

    def over(self, df: DataFrame, columns: list[str], schema: str = RESULT) -> DataFrame:
        """df with the slot's result columns, made of the named columns; results replace columns of their names."""
        made = T.StructType.fromDDL(schema)
        kept = [f for f in df.schema.fields if f.name not in made.fieldNames()]
        needed = [c for c in columns if c not in {f.name for f in kept}]
        rows = df.select(*(F.col(f"`{f.name}`") for f in kept), *(F.col(c).alias(f"_in_{c}") for c in needed))
        slot, names = self, [f.name for f in kept]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if slot.name not in _LOADED:
                _LOADED[slot.name] = slot.load()
            model = _LOADED[slot.name]
            for b in batches:
                got = [slot.call(model, {c: r[f"_in_{c}" if c in needed else c] for c in columns}) for r in b.to_dict("records")]
                yield pd.concat([b[names].reset_index(drop=True), pd.DataFrame([[g.get(n) for n in made.names] for g in got], columns=made.names)], axis=1)

        return rows.mapInPandas(run, T.StructType([*kept, *made.fields]))


def dispatched(uploads: DataFrame, wanted: str, default: str, slots: dict[str, Slot], columns: list[str], schema: str = RESULT) -> DataFrame:
    """Each upload through the backend it wants, in lower case, or the default: a branch for each backend. Uploads that
    want an unknown one come back with `refused` true and no result."""
    named = uploads.withColumn("backend", backend(F.col(wanted), default, list(slots)))
    branches = [slot.over(named.where(F.col("backend") == name), columns, schema).withColumn("refused", F.lit(False)) for name, slot in slots.items()]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields]
    kept = [c for c in named.columns if c not in T.StructType.fromDDL(schema).fieldNames()]
    return reduce(DataFrame.unionByName, [*branches, named.where(F.col("backend").isNull()).select(*kept, *none, F.lit(True).alias("refused"))])


# --- stand-ins


def _samples(content: bytes | None) -> tuple[np.ndarray, int]:
    """Samples and rate of a WAV file; none of what is no WAV file."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            return np.frombuffer(w.readframes(w.getnframes()), f"<i{w.getsampwidth()}" if w.getsampwidth() != 1 else np.uint8), w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0, np.int16), 16_000


def _transcriber() -> Callable[[bytes | None, str | None], dict]:
    def heard(content: bytes | None, language: str | None) -> dict:
        x, rate = _samples(content)
        text = f"{len(x)} samples"
        return {"text": text, "language": language or "en", "probability": 1.0, "segments": [{"start": 0.0, "end": len(x) / rate, "text": text}], "lines": None}

    return heard


class LevelRecogniser:
    """A stand-in for a streaming recogniser: a piece is a word, loud or quiet; a quiet piece ends an utterance."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def accept(self, piece: np.ndarray) -> bool:
        loud = bool(len(piece)) and float(np.abs(piece.astype(float)).mean()) > 100
        self.words.append("loud" if loud else "quiet")
        return not loud

    def result(self) -> str:
        out, self.words = " ".join(self.words), []
        return out


def recognised(samples: np.ndarray, recogniser, step: int = FRAMES) -> list[str]:
    """Results of a recogniser that takes `step` samples at once: one wherever it says that an utterance has ended,
    and what is left at the end."""
    found = [recogniser.result() for at in range(0, len(samples), step) if recogniser.accept(samples[at : at + step])]
    return [t for t in (*found, recogniser.result()) if t]


def _streaming(make: Callable[[], Any], row: dict) -> dict:
    parts = recognised(_samples(row["content"])[0], make())
    return {"text": " ".join(parts), "lines": parts}


def _reader(_: Any, row: dict) -> dict:
    lines = (row["content"] or b"").decode("utf-8", "ignore").split("\n")
    return {"text": "\n".join(lines).strip(), "lines": [x for x in lines if x.strip()], "language": row.get("language")}


def whisper_standin() -> Slot:
    """Tells how many samples a recording has, as one segment."""
    return Slot("whisper_standin", _transcriber, lambda model, row: model(row["content"], row.get("language")))


def vosk_standin() -> Slot:
    """Feeds a recording to a recogniser of loudness, piece by piece."""
    return Slot("vosk_standin", lambda: LevelRecogniser, _streaming)


def reading_standin(name: str) -> Slot:
    """Takes the bytes of an image for its text."""
    return Slot(name, lambda: None, _reader)


def speech_slots() -> dict[str, Slot]:
    return {"whisper": whisper_standin(), "vosk": vosk_standin()}


def reading_slots() -> dict[str, Slot]:
    return {"tesseract": reading_standin("tesseract_standin"), "easyocr": reading_standin("easyocr_standin")}


def transcribed(files: DataFrame, slot: Slot | None = None) -> DataFrame:
    """(path, text, segments, language) of (path, content, language) rows: many recordings in one call."""
    return (slot or whisper_standin()).over(files, ["content", "language"], RESULT).select("path", "text", "segments", "language")


def hashed_logits(rows: DataFrame, key: str, mel: str, classes: int) -> DataFrame:
    """(key, t, logits): a stand-in for an acoustic model over frames of features, one row of logits for each frame."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.pmod(F.xxhash64(F.col(mel), c), F.lit(1000)) / 1000.0))
    return rows.select(key, F.col("frame").alias("t"), mel).select(key, "t", at.alias("c", "x")).groupBy(key, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("logits"))


def embedding_standin(text: Column, size: int = 64) -> Column:
    """A stand-in for an embedder: signed counts of hashed tokens."""
    from corpuscle.functions.text import tokens

    hashes = F.transform(tokens(text), lambda w: F.xxhash64(w))
    count = lambda i: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(size)) == i, F.when(h > 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), count)


def silent_voice(rate: int = 24_000, per_char: float = 0.05) -> Slot:
    """A stand-in for a synthesiser: silence as long as the text, in 16-bit samples."""
    return Slot("silent_voice", lambda: (rate, per_char), lambda m, row: {"samples": b"\0\0" * int(len(row["text"] or "") * m[1] * m[0]), "rate": m[0]})
