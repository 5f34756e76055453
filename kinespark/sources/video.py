"""Frames of video files as rows of statistics, by whatever decoder is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SourceError
from .recording import FRAMES, Recording

#: The widest grid that a frame is reduced to.
GRID = 64
#: (path, first frame, frames) -> grey images
Decoder = Callable[[str, int, int], Iterator[np.ndarray]]


def grid(image: np.ndarray) -> np.ndarray:
    """The image's means over a grid at most GRID cells wide, of the image's shape."""
    h, w = image.shape
    if w <= GRID:
        return image.astype(float)
    rows, cols = max(1, round(h * GRID / w)), GRID
    y, x = np.linspace(0, h, rows + 1).astype(int), np.linspace(0, w, cols + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(image.astype(float), y[:-1], axis=0), x[:-1], axis=1)
    return sums / np.outer(np.diff(y), np.diff(x))


def opencv(path: str, first: int, frames: int) -> Iterator[np.ndarray]:
    import cv2

    video = cv2.VideoCapture(path)
    video.set(cv2.CAP_PROP_POS_FRAMES, first)
    for _ in range(frames):
        ok, image = video.read()
        if not ok:
            break
        yield cv2.cvtColor(image, cv2.COLOR_BGR2GRAY)
    video.release()


def decoded(recording: Recording, decoder: Decoder | None = None) -> DataFrame:
    """The columns of FRAMES; an episode's mean grid stands in the row of its first frame."""
    if decoder is None:
        try:
            import cv2  # noqa: F401
        except ImportError as e:
            raise SourceError("video cannot be decoded here: OpenCV is not installed") from e
        decoder = opencv
    fps, base = float(recording.fps or 1.0), recording.store.root
    each = recording.episodes.select("pos", "episode", F.explode("video_files").alias("stream", "source"), F.col("video_ranges"))
    wanted = each.select("pos", "episode", "stream", "source", F.col("video_ranges")[F.col("stream")]["start"].alias("a"), F.col("video_ranges")[F.col("stream")]["end"].alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pos, episode, stream, source, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                first, rows, before, total = round(a * fps), [], None, None
                path = f"{base}/{source}".removeprefix("file://").removeprefix("file:")
                for k, image in enumerate(decoder(path, first, round(b * fps) - first)):
                    cells = grid(image)
                    step = np.abs(cells - before) if before is not None else None
                    total = cells if total is None else total + cells
                    rows.append([pos, episode, stream, source, k, k / fps, float(cells.mean()), float(cells.std()), None if step is None else float(step.mean()), None if step is None else float(step.max()), None])
                    before = cells
                if rows:
                    rows[0][-1] = (total / len(rows)).ravel().tolist()
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 5, pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in FRAMES.split(", ")])

    parts = max(1, min(recording.n_episodes, 4 * recording.spark.sparkContext.defaultParallelism))
    return wanted.repartition(parts, "pos", "stream").mapInArrow(run, FRAMES)
