"""Errors. File errors carry a code, details and what to do about them."""

from __future__ import annotations

from datetime import datetime, timezone


class RowlensError(Exception):
    """Base of all errors of this package."""


class MatchingError(RowlensError):
    """Column names cannot be matched."""


class NormalizationError(RowlensError):
    """A table cannot be normalised."""


class ComparisonError(RowlensError):
    """Two tables cannot be compared."""


class FileError(RowlensError):
    """Base of file errors: ``code``, ``details``, ``suggested_action`` and ``timestamp``."""

    code = "FILE"
    suggested_action = "Check the file."

    def __init__(self, message: str, **details):
        super().__init__(f"[{self.code}] {message}")
        self.message = message
        self.details = details
        self.timestamp = datetime.now(timezone.utc)


class FileMissing(FileError):
    code, suggested_action = "FA-001", "Check that the path is right and the file exists."


class FileForbidden(FileError):
    code, suggested_action = "FA-002", "Grant read permission on the file."


class FileLocked(FileError):
    code, suggested_action = "FA-003", "Close other programs that use the file and try again."


class InvalidFormat(FileError):
    code, suggested_action = "FMT-001", "Use a .csv, .xlsx or .xls file."


class CorruptFile(FileError):
    code, suggested_action = "FMT-002", "Restore or export the file anew."


class InvalidStructure(FileError):
    code, suggested_action = "FMT-003", "Check the header and the required columns."


class UnknownEncoding(FileError):
    code, suggested_action = "ENC-001", "Name the encoding or save the file as UTF-8."


class EncodingMismatch(FileError):
    code, suggested_action = "ENC-002", "Name the encoding that was detected."


class DecodeError(FileError):
    code, suggested_action = "ENC-003", "Convert the file to UTF-8."


#: Documented numeric codes of the service interface and the errors they stand for (fixed values).
ERROR_CODES = {1001: FileMissing, 1002: InvalidFormat, 1003: UnknownEncoding, 2001: MatchingError, 2002: NormalizationError, 2003: ComparisonError, 3001: RowlensError, 3002: RowlensError, 3003: RowlensError}


def error_response(error: Exception) -> dict:
    """code, message, details, suggested action and time of an error, for logs and interfaces."""
    stamp = getattr(error, "timestamp", None) or datetime.now(timezone.utc)
    return {"code": getattr(error, "code", type(error).__name__), "message": str(error), "details": getattr(error, "details", {}), "suggested_action": getattr(error, "suggested_action", ""), "timestamp": stamp.isoformat()}
