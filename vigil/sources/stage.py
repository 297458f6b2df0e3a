"""Fetching raw files and staging them: from a URL (file:// or one that a network reaches) or a local path."""

from __future__ import annotations

import shutil
import tarfile
import urllib.request
from pathlib import Path

_CHUNK = 1 << 20


def fetch(source: str, target: str | Path, timeout: float = 60.0) -> int:
    """Copy what source names to target, redirects followed, and return its size; target appears only when it is whole."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.part")
    try:
        opened = urllib.request.urlopen(source, timeout=timeout) if "://" in source else open(source, "rb")
        with opened as raw, open(part, "wb") as out:
            shutil.copyfileobj(raw, out, _CHUNK)
        part.replace(target)
    finally:
        part.unlink(missing_ok=True)
    return target.stat().st_size


def unpack(archive: str | Path, folder: str | Path, wanted: tuple[str, ...] = ()) -> list[str]:
    """Extract a tar archive's plain files (those whose names end in one of `wanted`, if given) flat into folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    with tarfile.open(archive) as tar:
        for member in tar:
            name = Path(member.name).name
            if member.isfile() and (not wanted or name.endswith(wanted)):
                with tar.extractfile(member) as raw, open(Path(folder) / name, "wb") as out:
                    shutil.copyfileobj(raw, out, _CHUNK)
                names.append(name)
    return sorted(names)


def stage(sources: dict[str, tuple[str, ...]], root: str | Path, only: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Fetch each named source's files below root/<name>, archives unpacked; the names of the staged files by source."""
    unknown = set(only) - set(sources)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    staged = {}
    for name in only or sources:
        folder, staged[name] = Path(root) / name, []
        for source in sources[name]:
            target = folder / source.rsplit("/", 1)[-1]
            fetch(source, target)
            if tarfile.is_tarfile(target):
                staged[name] += unpack(target, folder)
                target.unlink()
            else:
                staged[name].append(target.name)
    return staged
