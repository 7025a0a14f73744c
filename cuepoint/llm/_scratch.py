"""Intermediate tables in the folder that the whole cluster shares."""

from ..shared import dropped, release, scratch_path, shared_root, step, written

__all__ = ["dropped", "release", "scratch_path", "shared_root", "step", "written"]
