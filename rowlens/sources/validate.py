"""Checks of a file before it is read: presence, access, type, size, header."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..errors import FileError, FileForbidden, FileLocked, FileMissing, InvalidFormat, InvalidStructure
from . import xlsx
from .encoding import detect_encoding
from .files import FORMATS, header

MAX_BYTES = 500_000_000
REQUIRED_COLUMNS = ("id", "name", "value")


@dataclass
class ValidationResult:
    is_valid: bool
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    error: FileError | None = None


def check_exists(path: str) -> None:
    if not os.path.exists(path):
        raise FileMissing(f"no such file: {path}", path=path)


def check_access(path: str) -> None:
    try:
        with open(path, "rb"):
            pass
    except PermissionError as e:
        raise FileForbidden(f"no permission to read {path}", path=path) from e
    except OSError as e:
        raise FileLocked(f"{path} cannot be opened: {e}", path=path) from e


def check_format(path: str) -> None:
    if os.path.splitext(path)[1].lower() not in FORMATS:
        raise InvalidFormat(f"files of this type are not read: {path}", path=path, supported=list(FORMATS))


def check_size(path: str, most: int | None = MAX_BYTES) -> None:
    size = os.path.getsize(path)
    if most is not None and size > most:
        raise InvalidFormat(f"{path} has {size} bytes; {most} are allowed", path=path, size=size, max_size=most)


def check_structure(path: str, required: tuple[str, ...] = REQUIRED_COLUMNS, encoding: str | None = None) -> None:
    """The header must have the required columns; only the header is read."""
    if path.lower().endswith(".csv"):
        names = header(path, encoding or detect_encoding(path).encoding)
    else:
        names = [str(x) for x in next(xlsx.rows(path), []) if x is not None]
    if not names:
        raise InvalidStructure(f"the file is empty: {path}", path=path)
    lost = [c for c in required if c not in names]
    if lost:
        raise InvalidStructure(f"missing columns: {', '.join(lost)}", path=path, missing_columns=lost)


def validate_file(path: str, required: tuple[str, ...] = REQUIRED_COLUMNS, max_bytes: int | None = MAX_BYTES, strict: bool = False, encoding: str | None = None) -> ValidationResult:
    """All checks in order, up to the first that fails. ``strict`` raises the error instead of returning it."""
    try:
        check_exists(path)
        check_access(path)
        check_format(path)
        check_size(path, max_bytes)
        check_structure(path, required, encoding)
    except FileError as e:
        if strict:
            raise
        return ValidationResult(False, [str(e)], error=e)
    return ValidationResult(True)
