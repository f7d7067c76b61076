"""Paths that tasks open themselves: local and mounted folders, HDFS and object stores, by pyarrow."""

from __future__ import annotations

import os
import re

from pyarrow import fs as pafs


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it. Names are taken as they are (``%`` too)."""
    remote = re.match(r"([a-z][a-z0-9+.-]*://[^/]*)(/.*)?$", path)
    if not remote or path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:(//[^/]*)?", "", path))
    system, base = pafs.FileSystem.from_uri(remote[1] + "/")
    return system, base.rstrip("/") + (remote[2] or "")


def exists(system: pafs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != pafs.FileType.NotFound
