"""Arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith(("/", "file:")) else (fs.LocalFileSystem(), uri)


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Writes the array under its name; a second attempt of the task replaces it by equal bytes."""
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
    system.move(part, f"{root}/{name}")


def load(folder: str, name: str, kind) -> np.ndarray:
    """The array, memory-mapped.  A file in a remote store is first copied to a local file without a
    name, which goes away with the mapping."""
    system, root = _open(folder)
    path = f"{root}/{name}"
    info = system.get_file_info(path)
    if not info.size:
        return np.zeros(0, dtype=kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    handle, local = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as out, system.open_input_stream(path) as stream:
            while block := stream.read(1 << 24):
                out.write(block)
        return np.memmap(local, dtype=kind, mode="r")
    finally:
        os.unlink(local)


class Writer:
    """Writes an array piece by piece; the file has its name once it is whole."""

    def __init__(self, folder: str, name: str, kind):
        self.system, root = _open(folder)
        self.system.create_dir(root, recursive=True)
        self.kind, self.part, self.path = kind, f"{root}/.{name}-{uuid.uuid4().hex}", f"{root}/{name}"
        self.out = self.system.open_output_stream(self.part)

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.out.write(memoryview(np.ascontiguousarray(values, dtype=self.kind)).cast("B"))

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.path)


class Counts:
    """Counts of any size as bytes; those of 255 and more stand apart with their positions."""

    def __init__(self, folder: str, name: str):
        self.small = load(folder, name, np.uint8)
        self.at, self.value = load(folder, f"{name}-at", np.int64), load(folder, f"{name}-of", np.int64)

    @staticmethod
    def save(folder: str, name: str, counts: np.ndarray) -> None:
        at = np.flatnonzero(counts >= 255)
        save(folder, name, np.minimum(counts, 255).astype(np.uint8))
        save(folder, f"{name}-at", at.astype(np.int64))
        save(folder, f"{name}-of", counts[at].astype(np.int64))

    def __getitem__(self, positions: np.ndarray) -> np.ndarray:
        out = self.small[positions].astype(np.int64)
        many = np.flatnonzero(out == 255)
        if len(many):
            out[many] = self.value[np.searchsorted(self.at, positions[many])]
        return out


class SortedHashes:
    """Positions in sorted 64-bit hashes by a table over their top bits, both mapped."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hashes, self.first = hashes, first
        self.shift = np.uint64(64 - self.bits(len(hashes)))

    @staticmethod
    def bits(n: int) -> int:
        return max(1, n.bit_length())

    @staticmethod
    def save_table(folder: str, name: str, hashes: np.ndarray, step: int = 1 << 20) -> None:
        """Where the hashes of each value of the top bits begin."""
        bits = SortedHashes.bits(len(hashes))
        out = Writer(folder, name, np.int64)
        for at in range(0, 1 << bits, step):
            edges = np.arange(at, min(at + step, 1 << bits), dtype=np.uint64) << np.uint64(64 - bits)
            out.add(np.searchsorted(hashes, edges))
        out.add(np.array([len(hashes)]))
        out.close()

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions, or -1 where a hash is missing."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        if not len(self.hashes) or not len(wanted):
            return out
        bucket = (wanted >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            hit = self.hashes[here] == wanted[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out
