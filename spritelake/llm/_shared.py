"""The folder that driver and executors share, tables written there, and the path by which workers reach it."""

from __future__ import annotations

from ..sources.tables import delete, drop, shared_dir, written

__all__ = ["delete", "drop", "local_path", "shared_dir", "written"]


def local_path(uri: str) -> str:
    """The path by which workers reach a shared folder that is mounted as a file system."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: worker files need a shared folder that is mounted; set spark.checkpoint.dir to one")
    return uri
