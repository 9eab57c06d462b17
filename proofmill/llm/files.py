"""Files that executors write to, and read from, the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark import TaskContext


def filesystem(uri: str):
    """pyarrow's file system for a URI and the path in it; Hadoop writes file:/x where URIs want file:///x."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write(folder: str, name: str, data: bytes) -> str:
    """Writes a file under a name that no other attempt of the task uses; a manifest says which attempts count."""
    context = TaskContext.get()
    name = f"{name}-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}"
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name
