"""Two-level index of sorted lines in the shared folder: compressed blocks, and a sparse directory of them.

Spark sorts ``(key, value)`` rows by range. Each task writes its range as one part: blocks of so many lines, each a gzip
member of its own, and a directory with the first key, place and length of every block. A look-up searches the first
keys of the parts, then the directory of a part, reads the one byte range that may hold the key and searches its lines.
The driver holds one row per part, of which there are as many as shuffle partitions.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from roompulse.session import staged

LINES = 1000            # lines of a block
HELD_BLOCKS = 64        # blocks that a reader keeps
GZIP = 31               # zlib's name for one whole gzip member


def packed(data: bytes, level: int = 6) -> bytes:
    """One gzip member, the same bytes on every run."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return squeeze.compress(data) + squeeze.flush()


class Store:
    """Files of one folder, by byte ranges; the last file stays open."""

    def __init__(self, folder: str):
        self.files, self.root = pafs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def create(self, name: str):
        self.files.create_dir(self.root, recursive=True)
        return self.files.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, at: int | None = None, size: int | None = None) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.files.open_input_file(f"{self.root}/{name}")
        if at is not None:
            self.file.seek(at)
        else:
            self.file.seek(0)
        return self.file.read(size) if size is not None else self.file.read()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name, self.file = None, None


def _part_writer(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, store, out, at, block, directory = uuid.uuid4().hex, Store(folder), None, 0, [], []

        def flush() -> None:
            nonlocal at
            data = packed(b"".join(k + b" " + v + b"\n" for k, v in block))
            out.write(data)
            directory.append((block[0][0], at, len(data)))
            at += len(data)
            block.clear()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = out or store.create(f"{name}.blocks")
                block.append((key.encode(), value.encode()))
                if len(block) == lines:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with store.create(f"{name}.directory") as listed:
            for key, start, size in directory:
                listed.write(key + b" %d %d\n" % (start, size))
        yield pa.RecordBatch.from_pydict({"part": [name], "first": [directory[0][0]], "blocks": [len(directory)]})
    return run


class BlockIndex:
    """A written index: its folder, and name and first key of its parts in order."""

    def __init__(self, folder: str, parts: Sequence[tuple[bytes, str]]):
        self.folder = folder
        self.firsts = [first for first, _ in sorted(parts)]
        self.names = [name for _, name in sorted(parts)]


def build(rows: DataFrame, folder: str, lines: int = LINES) -> BlockIndex:
    """Index the ``(key, value)`` rows, both texts without line ends, keys without blanks, under ``folder``.

    Rows of one key may spread over blocks and parts, so no key is too large. A part whose task was run twice
    leaves a file that no directory names.
    """
    sorted_rows = rows.select("key", "value").repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    parts = staged(sorted_rows.mapInArrow(_part_writer(folder, lines), "part string, first binary, blocks bigint"),
                   "index-parts")
    return BlockIndex(folder, [(bytes(r["first"]), r["part"]) for r in parts.collect()])


def _holders(firsts: Sequence[bytes], key: bytes) -> range:
    """Places of the sorted ranges that may hold the key: from the last that begins before it to the last that begins
    with it."""
    return range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key))


class Reader:
    """Look-ups in one task."""

    def __init__(self, index: BlockIndex):
        self.index, self.store = index, Store(index.folder)
        self.directories: dict[str, tuple[list, list]] = {}
        self.blocks: OrderedDict = OrderedDict()

    def _directory(self, name: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        if name not in self.directories:
            listed = [line.split(b" ") for line in self.store.read(f"{name}.directory").splitlines()]
            self.directories = {name: ([x[0] for x in listed], [(int(x[1]), int(x[2])) for x in listed])}
        return self.directories[name]

    def places(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """Part, place and size of the blocks that may hold the key."""
        for part in _holders(self.index.firsts, key):
            firsts, blocks = self._directory(self.index.names[part])
            for i in _holders(firsts, key):
                yield self.index.names[part], *blocks[i]

    def lines(self, part: str, at: int, size: int, key: bytes) -> Iterator[bytes]:
        """Values of the key in one block."""
        if (part, at) not in self.blocks:
            data = zlib.decompress(self.store.read(f"{part}.blocks", at, size), GZIP)
            self.blocks[part, at] = list(zip(*(line.split(b" ", 1) for line in data[:-1].split(b"\n"))))
            while len(self.blocks) > HELD_BLOCKS:
                self.blocks.popitem(last=False)
        keys, values = self.blocks[part, at]
        yield from values[bisect_left(keys, key):bisect_right(keys, key)]

    def get(self, keys: Iterable[bytes]) -> dict[bytes, bytes]:
        """One value of each key that there is; keys are looked up in order, so that neighbours share a block."""
        out = {}
        for key in sorted(set(keys)):
            for place in self.places(key):
                for value in self.lines(*place, key):
                    out[key] = value
        return out


def _locator(index: BlockIndex):
    def run(batches):
        reader = Reader(index)
        for batch in batches:
            found = [(key, *place) for key in sorted(batch.column(0).to_pylist()) for place in reader.places(key.encode())]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("key", "part", "at", "size"), x)) for x in found],
                pa.schema([("key", pa.string()), ("part", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))
        reader.store.close()
    return run


def _finder(index: BlockIndex):
    def run(batches):
        reader = Reader(index)
        for batch in batches:
            keys, values = [], []
            for key, *place in zip(*(c.to_pylist() for c in batch.columns)):
                found = [v.decode() for v in reader.lines(*place, key.encode())]
                keys += [key] * len(found)
                values += found
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "value": pa.array(values, pa.string())})
        reader.store.close()
    return run


def look_up(index: BlockIndex, keys: DataFrame) -> DataFrame:
    """``(key, value)`` of every line whose key is among ``keys`` (column ``key``).

    Directories are searched first, in ranges of keys; then the blocks they name are dealt out, so that a key that
    fills many blocks is read by many tasks, and each block is read once.
    """
    asked = keys.filter("key IS NOT NULL").select("key").distinct().repartitionByRange("key")
    places = asked.mapInArrow(_locator(index), "key string, part string, at bigint, size bigint")
    dealt = places.repartition("part", "at").sortWithinPartitions("part", "at", "key")
    return dealt.mapInArrow(_finder(index), "key string, value string")
