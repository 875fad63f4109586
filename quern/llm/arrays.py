"""Arrays that workers share: written by tasks to the shared folder, mapped into memory by whoever reads them.

A file holds arrays end to end.  Where the shared folder is a mounted one, readers map it, so that all workers of a
machine share one copy in the page cache and what they don't touch isn't read; elsewhere it is read through
pyarrow's file systems.  A file appears under its name only once it is whole, and tasks that are run again write
files of their own, so that a lost executor leaves nothing half-written in use.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Values in one file of a set.
SET_ROWS = 8_000_000


def _local(uri: str) -> str | None:
    found = urlparse(uri)
    return unquote(found.path) if found.scheme in ("", "file") else None


def write(folder: str, arrays: list[np.ndarray]) -> str:
    """The name of a new file in folder that holds the arrays."""
    name = f"{uuid.uuid4().hex}.bin"
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/_{name}", "wb") as f:
            for a in arrays:
                a.tofile(f)
        os.replace(f"{path}/_{name}", f"{path}/{name}")
        return name
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/_{name}") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).data)
    system.move(f"{path}/_{name}", f"{path}/{name}")
    return name


def read(folder: str, name: str, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    """The arrays of a file, by their types and lengths; not to be written to."""
    path = _local(folder)
    if path is not None:
        raw = np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r")) if any(n for _, n in kinds) else np.zeros(0, np.uint8)
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        with system.open_input_file(f"{path}/{name}") as f:
            raw = np.frombuffer(f.read(), np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size
    return out


def _set_task(folder: str):
    def task(batches):
        parts = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if parts:
            values = np.concatenate(parts)
            row = {"lo": int(values[0]), "n": len(values), "file": write(folder, [values])}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("lo", pa.int64()), ("n", pa.int64()), ("file", pa.string())]))

    return task


def write_set(values: DataFrame, rows: int, folder: str, per_file: int = SET_ROWS) -> list[dict]:
    """The one column of longs of values, of which there are ``rows``, as sorted files: what to know of each."""
    name = values.columns[0]
    ranged = values.repartitionByRange(max(1, -(-rows // per_file)), name).sortWithinPartitions(name)
    return [r.asDict() for r in ranged.mapInArrow(_set_task(folder), "lo long, n long, file string").collect()]  # a row a file


class SortedSet:
    """A set of longs in sorted files."""

    def __init__(self, folder: str, files: list[dict]):
        files = sorted(files, key=lambda r: r["lo"])
        self.low = np.array([r["lo"] for r in files], np.int64)
        self.parts = [read(folder, r["file"], [(np.int64, r["n"])])[0] for r in files]

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether each of the values is in the set."""
        out = np.zeros(len(values), bool)
        of = np.searchsorted(self.low, values, "right") - 1
        for p, part in enumerate(self.parts):
            own = np.flatnonzero(of == p) if len(self.parts) > 1 else np.flatnonzero(of >= 0)
            if len(own):
                at = np.minimum(np.searchsorted(part, values[own]), len(part) - 1)
                out[own] = part[at] == values[own]
        return out
