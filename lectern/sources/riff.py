"""Sound in RIFF files, read in blocks: whole numbers of 8, 16, 24 and 32 bits, floats of 32 and 64, plain or as an extensible format, also
with 64-bit sizes (RF64). Chunks of no use are passed over, with the byte that fills up odd ones."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

# Codes of the formats.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Frames of a block.
BLOCK = 1 << 16


class RiffError(ValueError):
    pass


@dataclass(frozen=True)
class Format:
    code: int
    channels: int
    rate: int
    bits: int

    @property
    def width(self) -> int:
        return self.bits // 8


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise RiffError("the file ends early")
    return data


def _skip(f: BinaryIO, n: int) -> None:
    while n > 0:
        n -= len(_exactly(f, min(n, 1 << 20)))


def _format(data: bytes) -> Format:
    if len(data) < 16:
        raise RiffError("format chunk too short")
    code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", data[:16])
    if code == EXTENSIBLE:
        if len(data) < 40:
            raise RiffError("extensible format chunk too short")
        code = struct.unpack("<H", data[24:26])[0]
    if (code, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
        raise RiffError(f"format {code} with {bits} bits a sample")
    if not channels or not rate or align != channels * bits // 8:
        raise RiffError("format without channels, rate or a fitting block size")
    return Format(code, channels, rate, bits)


def _samples(data: bytes, form: Format) -> np.ndarray:
    """Samples from -1 to 1, channels averaged."""
    if form.code == FLOAT:
        x = np.frombuffer(data, f"<f{form.width}").astype(np.float64)
    elif form.bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif form.bits == 24:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{form.width}") / float(1 << (form.bits - 1))
    return x.reshape(-1, form.channels).mean(axis=1)


def walk(f: BinaryIO, block: int = BLOCK) -> tuple[Format, Iterator[np.ndarray]]:
    """The format, and the samples of the first data chunk, block by block. The file is read forwards once and never held as a whole."""
    kind, _, wave = struct.unpack("<4sI4s", _exactly(f, 12))
    if kind not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise RiffError("no RIFF sound")
    form, long = None, None
    while True:
        name, size = struct.unpack("<4sI", _exactly(f, 8))
        if name == b"data":
            break
        if name == b"fmt ":
            form = _format(_exactly(f, size))
        elif name == b"ds64" and size >= 16:
            long = struct.unpack("<Q", _exactly(f, size)[8:16])[0]
        else:
            _skip(f, size)
        _skip(f, size % 2)
    if form is None:
        raise RiffError("no format before the data")
    left = long if kind == b"RF64" and size == 0xFFFFFFFF and long is not None else size
    if left % (form.width * form.channels):
        raise RiffError("data of part of a frame")

    def blocks() -> Iterator[np.ndarray]:
        todo = left
        while todo:
            data = _exactly(f, min(todo, block * form.width * form.channels))
            todo -= len(data)
            yield _samples(data, form)

    return form, blocks()


@dataclass
class Levels:
    """Measures of samples as they come; `edge` of them are kept at either end."""

    edge: int
    n: int = 0
    peak: float = 0.0
    square: float = 0.0
    head: float = 0.0
    tail: np.ndarray = None

    def add(self, x: np.ndarray) -> None:
        if self.n < self.edge:
            self.head = max(self.head, float(np.abs(x[: self.edge - self.n]).max(initial=0)))
        self.n += len(x)
        self.peak = max(self.peak, float(np.abs(x).max(initial=0)))
        self.square += float((x * x).sum())
        both = x if self.tail is None or len(x) >= self.edge else np.concatenate([self.tail, x])
        self.tail = both[max(0, len(both) - self.edge) :].copy()

    @property
    def rms(self) -> float:
        return float(np.sqrt(self.square / self.n)) if self.n else 0.0

    @property
    def tail_peak(self) -> float:
        return float(np.abs(self.tail).max(initial=0)) if self.tail is not None else 0.0
