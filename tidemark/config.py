"""Settings: explicit values over environment over a JSON or TOML file over defaults."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field, fields

from .errors import ConfigError
from .schema import EMBED_DIM

PREFIX = "TIDEMARK_"
PROVIDERS = ("table", "hashed", "replay", "remote")
ENVIRONMENTS = ("production", "test")


@dataclass(frozen=True)
class Settings:
    warehouse: str = "warehouse"
    environment: str = "production"
    embedding_provider: str = "table"
    embedding_model: str = "default"
    embedding_revision: str = ""
    embedding_dim: int = EMBED_DIM
    embedding_table: str = ""
    embedding_url: str = ""
    embedding_key_file: str = ""
    allow_hashed: bool = False
    replay_manifest: str = ""
    replay_vectors: str = ""
    sessions_root: str = ""
    chat_root: str = ""
    store_path: str = ""
    chunk_tokens: int = 400
    chunk_overlap: int = 80
    chunk_vocabulary: str = ""
    chunk_pattern: str = "gpt2"
    batch_size: int = 128
    max_retries: int = 3
    timeout_seconds: float = 60.0
    requests_per_second: float = 8.0
    fetch_tasks: int = 4
    trigram_threshold: float = 0.3
    max_failed_files: int = 20
    retention_sessions: int = 90
    retention_store: int = 90
    retention_chat: int = 30
    origin: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if self.environment not in ENVIRONMENTS:
            raise ConfigError(f"environments are {', '.join(ENVIRONMENTS)}", code="invalid_environment")
        if self.embedding_provider not in PROVIDERS:
            raise ConfigError(f"providers are {', '.join(PROVIDERS)}", code="unsupported_embedding_provider")
        if self.embedding_dim <= 0:
            raise ConfigError("the dimension must be positive", code="unsupported_embedding_dimension")
        if not 0 <= self.chunk_overlap < self.chunk_tokens:
            raise ConfigError("the overlap must be smaller than the window", code="invalid_config_value")
        if self.embedding_provider == "remote" and not (self.embedding_url and self.embedding_table):
            raise ConfigError("a remote provider needs embedding_url and, to keep what it sends, embedding_table", code="invalid_config_value")
        if min(self.batch_size, self.max_retries, self.fetch_tasks) < 1 or min(self.timeout_seconds, self.requests_per_second) <= 0:
            raise ConfigError("batches, attempts, tasks, time and rate must be positive", code="invalid_config_value")
        if self.embedding_provider == "hashed":
            if self.environment != "test":
                raise ConfigError("hashed vectors are for tests", code="fake_embedding_environment_required")
            if not self.allow_hashed:
                raise ConfigError("hashed vectors must be allowed", code="fake_embedding_not_allowed")
            if not self.embedding_model.startswith("hashed"):
                raise ConfigError("hashed vectors need a model name of their own", code="fake_embedding_model_reserved")

    def source(self, name: str) -> str:
        places = {"sessions": self.sessions_root, "chat": self.chat_root, "store": self.store_path}
        if name not in places:
            raise ConfigError(f"sources are {', '.join(places)}", code="unknown_source")
        if not places[name]:
            raise ConfigError(f"{name} is not configured", code="source_not_configured")
        return places[name]


KINDS = {f.name: f.type for f in fields(Settings) if f.name != "origin"}


def _cast(name: str, value):
    kind = KINDS[name]
    try:
        if kind == "bool":
            if isinstance(value, bool):
                return value
            return {"true": True, "1": True, "false": False, "0": False}[str(value).lower()]
        if kind in ("int", "float"):
            if isinstance(value, bool):
                raise ValueError(value)
            return {"int": int, "float": float}[kind](value)
        if not isinstance(value, str):
            raise ValueError(value)
        return value
    except (KeyError, ValueError) as e:
        raise ConfigError(f"{name}: not a {kind}", code="invalid_config_value") from e


def load(path: str | None = None, env: dict | None = None, **explicit) -> Settings:
    found: dict = {}
    origin: dict[str, str] = {}
    parts = []
    if path:
        try:
            with open(path, "rb") as f:
                parts.append(("file", tomllib.load(f) if path.endswith(".toml") else json.load(f)))
        except (OSError, ValueError) as e:
            raise ConfigError("the file can't be read", code="invalid_config_file") from e
        if not isinstance(parts[0][1], dict):
            raise ConfigError("the file holds no table", code="invalid_config_file")
    env = os.environ if env is None else env
    parts.append(("environment", {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)}))
    parts.append(("explicit", {k: v for k, v in explicit.items() if v is not None}))
    for place, values in parts:
        for key, value in values.items():
            if key not in KINDS:
                raise ConfigError(f"unknown setting {key}", code="unknown_config_key")
            found[key], origin[key] = _cast(key, value), place
    return Settings(**found, origin=origin)


def redact_url(url: str) -> str:
    """A connection string without its password."""
    url = re.sub(r"(://[^:/@\s]+):[^@/\s]+@", r"\1:***@", url)
    return re.sub(r"(?i)\b(password|passwd|pwd)=('[^']*'|\S+)", r"\1=***", url)
