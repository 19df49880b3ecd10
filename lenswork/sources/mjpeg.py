"""Motion-JPEG files as a data source of Spark, `mjpeg`, for tables and streams.

An image belongs to the range of bytes in which it ends. Where a range begins, the last end of an image before it is
looked for backwards: after an end, whatever came before, the stream is outside of any image. So ranges of one file
are read apart, by several tasks, and give what one pass over the file gives: bytes before a start and an unfinished
tail are dropped. As a stream the source reads files that grow: an offset is how far each file has been read, and
an image comes once its end is there.
"""

from __future__ import annotations

import posixpath

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.common import open_file

#: First and last bytes of a JPEG.
JPEG_START, JPEG_END = b"\xff\xd8", b"\xff\xd9"
#: Bytes read at once, and bytes of a file in a task.
PIECE, RANGE = 1 << 20, 64 << 20
SCHEMA = "path string, start long, jpeg binary"


def split_jpegs(pieces, start: bytes = JPEG_START, end: bytes = JPEG_END):
    """(offset, JPEG) of each complete image in a stream of bytes; bytes before a start and an unfinished tail are dropped."""
    held, base = bytearray(), 0
    looked = 0  # where the search for an end goes on
    for piece in pieces:
        held += piece
        while True:
            a = held.find(start)
            if a < 0:  # the last byte may be half a start
                base, looked = base + max(0, len(held) - 1), 0
                del held[:-1]
                break
            z = held.find(end, max(a + len(start), looked))
            if z < 0:
                base += a
                del held[:a]
                looked = max(len(start), len(held) - 1)
                break
            yield base + a, bytes(held[a : z + len(end)])
            base, looked = base + z + len(end), 0
            del held[: z + len(end)]


def last_end(f, at: int) -> int:
    """Where the last image end at or before a place of a file stops; 0 without one."""
    after = b""
    while at > 0:
        lo = max(0, at - PIECE)
        f.seek(lo)
        piece = f.read(at - lo) + after
        k = piece.rfind(JPEG_END)
        if k >= 0:
            return lo + k + len(JPEG_END)
        at, after = lo, piece[:1]
    return 0


def images_ending_in(f, lo: int, hi: int):
    """(offset, JPEG) of the images of a file that end after `lo` and at or before `hi`."""
    begin = last_end(f, lo)
    f.seek(begin)

    def pieces():
        left = hi - begin
        while left > 0 and (piece := f.read(min(PIECE, left))):
            left -= len(piece)
            yield piece

    for at, jpeg in split_jpegs(pieces()):
        yield begin + at, jpeg


class ByteRange(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


def file_sizes(path: str) -> dict[str, int]:
    """The files of a folder, or one file, with their sizes."""
    from pyarrow import fs

    prefix, inner = (path.split("://", 1)[0] + "://", None) if "://" in path else ("", None)
    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    [info] = system.get_file_info([inner])
    found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    return {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and posixpath.basename(f.path)[:1] not in "._"}


def _read(part: ByteRange):
    with open_file(part.path) as f:
        for at, jpeg in images_ending_in(f, part.lo, part.hi):
            yield part.path, at, jpeg


def _cut(before: dict[str, int], now: dict[str, int], width: int) -> list[ByteRange]:
    return [ByteRange(path, lo, min(lo + width, size)) for path, size in sorted(now.items()) for lo in range(before.get(path, 0), size, width)]


class MjpegReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[ByteRange]:
        return _cut({}, file_sizes(self.path), self.width) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        return _read(partition) if partition.path else iter(())


class MjpegStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return file_sizes(self.path)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return _cut(start, end, self.width) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        return _read(partition) if partition.path else iter(())


class MjpegSource(DataSource):
    """spark.dataSource.register(MjpegSource), then spark.read or spark.readStream.format("mjpeg").load(path); option range: bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "mjpeg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MjpegReader:
        return MjpegReader(self.options["path"], int(self.options.get("range", RANGE)))

    def streamReader(self, schema) -> MjpegStreamReader:
        return MjpegStreamReader(self.options["path"], int(self.options.get("range", RANGE)))
