"""Files that Python workers write and read in shared storage, by URI (local, HDFS, S3, GCS through Arrow).

A file without bytes is a file; one that is written twice under a name is the later one, whole.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it. A plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Atomic:
    """A file that gets its name when it is complete: attempts of a task that was lost or repeated leave no partial file."""

    def __init__(self, uri: str):
        self.fs, self.path = store(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)
