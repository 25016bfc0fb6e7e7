"""File systems by URL, with their options and a choice of backend."""

from __future__ import annotations

import json
import re

import pyarrow.fs as pafs

_ARROW = {"": pafs.LocalFileSystem, "file": pafs.LocalFileSystem, "s3": pafs.S3FileSystem, "gs": pafs.GcsFileSystem, "gcs": pafs.GcsFileSystem, "az": getattr(pafs, "AzureFileSystem", None), "abfs": getattr(pafs, "AzureFileSystem", None)}


def filesystem(url: str, options: dict | str | None = None, backend: str = "arrow") -> tuple[pafs.FileSystem, str]:
    """The file system of a URL and the path in it. options: what its class takes (region, endpoint_override, anonymous, access_key, account_name ...
    for the backend ``arrow``; storage options, such as requester_pays, for ``fsspec``), as a dict or as JSON."""
    own = json.loads(options) if isinstance(options, str) and options else dict(options or {})
    if short := re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(/[^/].*)$", url):  # as Hadoop writes a path without a host
        url = f"{short[1]}://{short[2]}"
    scheme, _, path = url.partition("://") if "://" in url else ("", "", url)
    if backend == "fsspec":
        try:
            import fsspec
        except ImportError as e:
            raise ImportError("fsspec is not installed; install the 'fsspec' extra") from e
        if scheme in ("", "file"):
            own.setdefault("auto_mkdir", True)
        return pafs.PyFileSystem(pafs.FSSpecHandler(fsspec.filesystem(scheme or "file", **own))), path
    if backend != "arrow":
        raise ValueError(f"backend is arrow or fsspec, not {backend!r}")
    if not own:
        return pafs.FileSystem.from_uri(url) if scheme else (pafs.LocalFileSystem(), url)
    if not _ARROW.get(scheme):
        raise ValueError(f"no options are known for {scheme}://")
    return _ARROW[scheme](**own), path


def read_whole(fs: pafs.FileSystem, path: str) -> bytes | None:
    """The bytes of a file; None where there is none."""
    try:
        with fs.open_input_stream(path, compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return None
