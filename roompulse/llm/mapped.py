"""Binary files in the shared folder: written whole by tasks, mapped into memory by others."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow.fs as pafs


def write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file per array. A file appears under its name only when it is complete, so a task may run twice."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    for part, array in arrays.items():
        draft = f"{root}/.{name}.{part}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(np.ascontiguousarray(array).tobytes())
        with contextlib.suppress(FileNotFoundError):
            store.move(draft, f"{root}/{name}.{part}")


def read(folder: str, name: str, part: str, dtype) -> np.ndarray:
    """The array, mapped where the folder is a mounted file system, else read."""
    store, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{name}.{part}"
    if not store.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def write_together(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file for all arrays, so that many of them may be open at a time: their sizes in bytes, then the arrays, each
    from a multiple of 8 bytes on."""
    raw = [np.ascontiguousarray(a).view(np.uint8).ravel() for a in arrays.values()]
    filled = [np.concatenate([r, np.zeros(-len(r) % 8, np.uint8)]) for r in raw]
    write(folder, name, {"all": np.concatenate([np.array([len(r) for r in raw], np.int64).view(np.uint8), *filled])})


def read_together(folder: str, name: str, types: dict[str, type]) -> dict[str, np.ndarray]:
    """The arrays, in the order in which they were written; all empty where there is no such file."""
    raw = np.asarray(read(folder, name, "all", np.uint8))
    if not len(raw):
        return {k: np.zeros(0, t) for k, t in types.items()}
    at, out = 8 * len(types), {}
    for (key, dtype), n in zip(types.items(), raw[:at].view(np.int64).tolist()):
        out[key] = raw[at:at + n].view(dtype)
        at += n + -n % 8
    return out
