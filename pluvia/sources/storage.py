"""Seekable files on any file system: plain paths and URIs, through Arrow's file systems, so that readers fetch ranges only."""

from __future__ import annotations

import re
from typing import BinaryIO

#: Schemes of Hadoop's names whose file systems Arrow knows under another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def uri(path: str) -> str | None:
    """The URI as Arrow takes it; None for a plain path."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(/.*)", path)
    if not found:
        return None
    scheme, rest = found[1].lower(), found[2]
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def opened(path: str) -> BinaryIO:
    """The file for reading; ``seek`` and ``read`` fetch only what they ask for."""
    from urllib.parse import unquote

    whole = uri(path)
    if whole is None:
        return open(path, "rb")
    if whole.startswith("file:///"):
        return open(unquote(whole[len("file://") :]), "rb")
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(whole)
    return system.open_input_file(inside)
