"""Files in the shared folder, opened by tasks: local, HDFS and object-store addresses through ``pyarrow.fs``."""

from __future__ import annotations

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))


def write_to(uri: str):
    """A stream into a new file; folders are made."""
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def read_from(uri: str):
    """A file to read at any offset."""
    system, path = place(uri)
    return system.open_input_file(path)
