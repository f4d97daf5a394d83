"""Energy endpoint detector: speech segments of a stream of frames.

A frame is speech when its level reaches the larger of an absolute threshold and the noise floor
plus a margin, the floor being that before the frame. The floor follows frames without speech, also
within a segment, and outlives a reset. A segment begins with the pre-roll; it ends after enough
silence or at a hard maximum, and only with enough voiced frames is it kept.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.settle import settle
from reelspark.sources.shared import cut


@dataclass
class Settings:
    """Defaults in milliseconds and dBFS."""

    rate: int = 16_000
    pre_roll: int = 200
    min_voiced: int = 160
    silence: int = 600
    hard_max: int = 180_000
    absolute: float = -50.0
    margin: float = 12.0
    noise: float = -65.0
    alpha: float = 0.95

    def samples(self, ms: int) -> int:
        return max(1, round(ms * self.rate / 1000)) if ms else 0


@dataclass
class Detector:
    settings: Settings
    noise: float = math.nan
    start: int | None = None
    voiced: int = 0
    quiet: int = 0
    lead: deque[tuple[int, int]] = field(default_factory=deque)
    out: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if math.isnan(self.noise):
            self.noise = self.settings.noise

    def reset(self) -> None:
        self.start, self.voiced, self.quiet, self.lead = None, 0, 0, deque()

    def _close(self, end: int) -> None:
        if self.voiced >= self.settings.samples(self.settings.min_voiced):
            self.out.append((self.start, end, self.voiced))
        self.reset()

    def frame(self, offset: int, size: int, level: float) -> None:
        s = self.settings
        speech = level >= max(s.absolute, self.noise + s.margin)
        if not speech:
            self.noise = s.alpha * self.noise + (1 - s.alpha) * level
        if self.start is None:
            if speech:
                self.start = self.lead[0][0] if self.lead else offset
                self.voiced, self.quiet, self.lead = size, 0, deque()
            else:
                self.lead.append((offset, size))
                while self.lead and offset + size - self.lead[0][0] > s.samples(s.pre_roll):
                    self.lead.popleft()
            return
        self.voiced += size if speech else 0
        self.quiet = 0 if speech else self.quiet + size
        if self.quiet >= s.samples(s.silence) or offset + size - self.start >= s.samples(s.hard_max):
            self._close(offset + size)

    def finish(self, end: int) -> None:
        if self.start is not None:
            self._close(end)


class Endpoints:
    """The detector as a fold of (frame_no, sample_offset, size, level); a jump of the offset drops what is in flight."""

    #: ``place`` counts a block's segments.
    ddl = "place bigint, start_sample bigint, end_sample bigint, voiced bigint"

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def start(self) -> str:
        return self._text(Detector(self.settings), None)

    @staticmethod
    def _text(d: Detector, end: int | None) -> str:
        return json.dumps([d.noise.hex(), d.start, d.voiced, d.quiet, list(d.lead), end])

    def _steps(self, rows: Iterator[tuple], state: str) -> Iterator[tuple[Detector, int | None]]:
        noise, start, voiced, quiet, lead, end = json.loads(state)
        detector = Detector(self.settings, 0.0, start, voiced, quiet, deque(map(tuple, lead)))
        detector.noise = float.fromhex(noise)
        yield detector, end
        for _, offset, size, level in rows:
            if end is not None and offset != end:
                detector.reset()
            detector.frame(int(offset), int(size), math.nan if level is None else float(level))
            end = offset + size
            yield detector, end

    def leave(self, rows: Iterator[tuple], state: str) -> str:
        for detector, end in self._steps(rows, state):
            detector.out.clear()
        return self._text(detector, end)

    def run(self, rows: Iterator[tuple], state: str, last: bool) -> Iterator[tuple]:
        place = 0
        for detector, end in self._steps(rows, state):
            for out in detector.out:
                place += 1
                yield place, *out
            detector.out.clear()
        if last:
            detector.finish(int(end))
            for k, out in enumerate(detector.out, place + 1):
                yield k, *out


class NoiseFloor:
    """The floor alone, as a fold of (frame_no, level); of each block the number of speech frames."""

    ddl = "speech_frames bigint"

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def start(self) -> str:
        return self.settings.noise.hex()

    def _steps(self, rows: Iterator[tuple], state: str) -> tuple[float, int]:
        s, noise, speech = self.settings, float.fromhex(state), 0
        for _, level in rows:
            level = math.nan if level is None else level
            if level >= max(s.absolute, noise + s.margin):
                speech += 1
            else:
                noise = s.alpha * noise + (1 - s.alpha) * level
        return noise, speech

    def leave(self, rows: Iterator[tuple], state: str) -> str:
        return self._steps(rows, state)[0].hex()

    def run(self, rows: Iterator[tuple], state: str, last: bool) -> Iterator[tuple]:
        yield (self._steps(rows, state)[1],)


def speech_frames(levels: DataFrame, settings: Settings | None = None, blocks: int | None = None, stretch: int = 1 << 17) -> DataFrame:
    """(stream_id, speech_frames) of ``levels``: stream_id, frame_no, level. A null level is no speech, and the
    floor is unknown from there on, so that the absolute threshold alone decides."""
    found = settle(levels.select("stream_id", "frame_no", "level"), ["frame_no"], NoiseFloor(settings or Settings()), blocks, stretch)
    return found.groupBy("stream_id").agg(F.sum("speech_frames").alias("speech_frames"))


SEGMENTS = "stream_id bigint, ordinal bigint, start_sample bigint, end_sample bigint, voiced bigint"


def segments(frames: DataFrame, settings: Settings | None = None, blocks: int | None = None, stretch: int = 1 << 17) -> DataFrame:
    """SEGMENTS of ``frames``: stream_id, frame_no, sample_offset, size, level. A stream's frames may lie in many
    tasks; a task holds the detector only. Ordinals count on from the numbers of the blocks before."""
    settings = settings or Settings()
    found = cut(settle(frames.select("stream_id", "frame_no", "sample_offset", "size", "level"), ["frame_no"], Endpoints(settings), blocks, stretch))
    counts = found.groupBy("stream_id", "_block").agg(F.count("*").alias("n"))
    before = counts.selectExpr("stream_id as s", "_block as b", "sum(n) over (partition by stream_id order by _block) - n as before")
    numbered = found.join(before, F.col("stream_id").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")))
    return numbered.select("stream_id", (F.col("before") + F.col("place")).alias("ordinal"), "start_sample", "end_sample", "voiced")


def dbfs(samples: str = "samples"):
    """Level of an array of 16-bit samples in dBFS, -120 at least."""
    return F.expr(f"greatest(-120D, 20 * log10(sqrt(aggregate({samples}, 0D, (a, x) -> a + cast(x as double) * x) / size({samples})) / 32768))")
