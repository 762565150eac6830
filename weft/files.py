"""The file object: what rows say of a file, and its bytes. User functions that hint ``File`` get one for a file column."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
import struct
import wave
from pathlib import PurePosixPath

from .sinks import destination
from .storage import filesystem


@dataclasses.dataclass
class File:
    """A file under an address; ``location`` tells where in an archive it lies."""

    path: str = ""
    source: str = ""
    size: int = 0
    version: str = ""
    etag: str = ""
    is_latest: bool = True
    last_modified: datetime.datetime | None = None
    location: str | None = None

    @property
    def uri(self) -> str:
        return f"{self.source.rstrip('/')}/{self.path}" if self.source else self.path

    @property
    def name(self) -> str:
        return PurePosixPath(self.path).name

    @property
    def parent(self) -> str:
        return str(PurePosixPath(self.path).parent).removeprefix(".")

    def get_file_stem(self) -> str:
        return PurePosixPath(self.path).stem

    def get_file_ext(self) -> str:
        return PurePosixPath(self.path).suffix.strip(".")

    def get_uri(self) -> str:
        return self.uri

    def open(self):
        """A seekable binary stream."""
        import io

        if self.location:
            return io.BytesIO(self._member())
        fs, at = filesystem(self.uri)
        return fs.open_input_file(at)

    def _member(self) -> bytes:
        part = json.loads(self.location)[0]
        fs, base = filesystem(self.source)
        with fs.open_input_file(f"{base}/{part['parent']}") as f:
            f.seek(part["offset"])
            return f.read(part["size"])

    def read(self, length: int = -1):
        with self.open() as f:
            return f.read() if length < 0 else f.read(length)

    read_bytes = read

    def read_text(self, encoding: str = "utf-8", errors: str = "strict") -> str:
        return File.read(self).decode(encoding, errors)

    def save(self, destination: str) -> str:
        """The bytes written to an address, in pieces."""
        fs, at = filesystem(destination)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with self.open() as source, fs.open_output_stream(at, compression=None) as out:
            while piece := source.read(8 << 20):
                out.write(piece)
        return destination

    def export(self, output: str, placement: str = "fullpath") -> str:
        return self.save(destination(output, self.source, self.path, self.etag, placement))

    def exists(self) -> bool:
        fs, at = filesystem(self.uri)
        return fs.get_file_info(at).is_file

    def ensure(self) -> File:
        """Itself, or FileNotFoundError."""
        if not self.location and not self.exists():
            raise FileNotFoundError(self.uri)
        return self

    @classmethod
    def at(cls, uri: str) -> File:
        """The file at an address, with what its store says of it."""
        fs, path = filesystem(uri)
        info = fs.get_file_info(path)
        folder, _, name = uri.rpartition("/")
        stamp = info.mtime if info.is_file else None
        etag = hashlib.md5(f"{path}:{info.size}:{stamp}".encode(), usedforsecurity=False).hexdigest() if info.is_file else ""
        return cls(path=name, source=folder, size=info.size or 0, etag=etag, last_modified=stamp)

    @classmethod
    def upload(cls, data: bytes, uri: str) -> File:
        fs, at = filesystem(uri)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at, compression=None) as out:
            out.write(data)
        return cls.at(uri)

    def as_text_file(self) -> TextFile:
        return TextFile(**dataclasses.asdict(self))

    def as_image_file(self) -> ImageFile:
        return ImageFile(**dataclasses.asdict(self))

    def as_audio_file(self) -> AudioFile:
        return AudioFile(**dataclasses.asdict(self))


@dataclasses.dataclass
class TextFile(File):
    """A file whose ``read`` gives text."""

    def read(self, length: int = -1) -> str:
        text = self.read_text()
        return text if length < 0 else text[:length]


@dataclasses.dataclass
class ImageInfo:
    width: int = -1
    height: int = -1
    format: str = ""


@dataclasses.dataclass
class ImageFile(File):
    def get_info(self) -> ImageInfo:
        return image_info(File.read(self))


@dataclasses.dataclass
class AudioInfo:
    sample_rate: int = -1
    channels: int = -1
    samples: int = -1
    duration: float = -1.0
    format: str = ""


@dataclasses.dataclass
class AudioFragment:
    start: float
    end: float


@dataclasses.dataclass
class AudioFile(File):
    """Uncompressed WAV; other formats need a decoder that this package doesn't bring."""

    def get_info(self) -> AudioInfo:
        with self.open() as f, wave.open(f) as w:
            return AudioInfo(w.getframerate(), w.getnchannels(), w.getnframes(), w.getnframes() / w.getframerate(), "wav")

    def to_numpy(self, start: float = 0.0, duration: float | None = None):
        """(samples by channel as shares of full scale, sample rate)."""
        import numpy as np

        with self.open() as f, wave.open(f) as w:
            rate = w.getframerate()
            w.setpos(min(w.getnframes(), int(start * rate)))
            raw = w.readframes(w.getnframes() if duration is None else int(duration * rate))
            kind = {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
            data = np.frombuffer(raw, kind).reshape(-1, w.getnchannels()).astype(np.float64)
            return ((data - 128) / 128 if kind is np.uint8 else data / np.iinfo(kind).max), rate

    def get_fragments(self, duration: float, start: float = 0.0, end: float | None = None) -> list[AudioFragment]:
        """Consecutive parts of a duration; the last may be shorter."""
        if duration <= 0 or start < 0:
            raise ValueError("duration must be above 0 and start not below it")
        end = self.get_info().duration if end is None else end
        out = []
        while start < end:
            out.append(AudioFragment(start, min(start + duration, end)))
            start += duration
        return out


def image_info(data: bytes) -> ImageInfo:
    """Size and format from an image's header; -1 where the format isn't PNG, GIF, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return ImageInfo(*struct.unpack(">II", data[16:24]), "png")
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return ImageInfo(*struct.unpack("<HH", data[6:10]), "gif")
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return ImageInfo(w, abs(h), "bmp")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        mark, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return ImageInfo(w, h, "jpeg")
        at += 2 + length
    return ImageInfo()
