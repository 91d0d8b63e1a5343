"""User-correctable errors, each with a stable code."""

from __future__ import annotations


class CodedError(ValueError):
    code = "error"

    def __init__(self, message: str, *, code: str | None = None):
        super().__init__(message)
        self.code = code or self.code


class QueryError(CodedError):
    code = "invalid_query"


class ConfigError(CodedError):
    code = "invalid_config_value"


class IngestError(CodedError):
    code = "ingest_failed"


class PrivacyError(CodedError):
    code = "privacy_error"


class MigrationError(CodedError):
    code = "migration_failed"


class SnapshotError(CodedError):
    code = "restore_verification_failed"


class ReplayError(CodedError):
    code = "replay_vectors_invalid"


class EvaluationError(CodedError):
    code = "evaluation_invalid"
