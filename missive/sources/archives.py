"""Archives unpacked with bounds, before a scan."""

from __future__ import annotations

import tarfile
import zipfile
from pathlib import Path, PurePosixPath


class UnsafeArchive(ValueError):
    """A member that would leave the target or pass a bound."""


def _checked(names: list[tuple[str, int, bool]], max_members: int, max_bytes: int) -> None:
    if len(names) > max_members:
        raise UnsafeArchive("too many members")
    seen, total = set(), 0
    for name, size, plain in names:
        parts = PurePosixPath(name.replace("\\", "/")).parts
        if not plain or not parts or name.startswith(("/", "\\")) or ".." in parts or any(":" in p for p in parts):
            raise UnsafeArchive("a member is no plain file below the target")
        if (low := "/".join(parts).casefold()) in seen:
            raise UnsafeArchive("two members of one name")
        seen.add(low)
        total += size
    if total > max_bytes:
        raise UnsafeArchive("too many bytes")


def unpack(archive: str, target: str, max_members: int = 100_000, max_bytes: int = 10 << 30) -> list[str]:
    """Unpacks a zip or tar archive; all members are checked before any is written. Returns the files' paths."""
    out = []
    root = Path(target)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            files = [m for m in z.infolist() if not m.is_dir()]
            _checked([(m.filename, m.file_size, (m.external_attr >> 16) & 0o170000 in (0, 0o100000)) for m in files], max_members, max_bytes)
            for m in files:
                out.append(str(root / m.filename))
                z.extract(m, root)
    else:
        with tarfile.open(archive) as t:
            files = [m for m in t.getmembers() if not m.isdir()]
            _checked([(m.name, m.size, m.isreg()) for m in files], max_members, max_bytes)
            for m in files:
                out.append(str(root / m.name))
                t.extract(m, root, filter="data")
    return out
