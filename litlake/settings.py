"""Settings from the environment, and signed requests.  Secrets stay on the driver."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import urllib.parse
from collections.abc import Mapping
from dataclasses import dataclass, field

TRUE = frozenset({"1", "true", "yes", "y", "on"})


def first_env(*names: str, default: str = "", env: Mapping[str, str] | None = None) -> str:
    """The first of the variables that is filled."""
    source = os.environ if env is None else env
    return next((v for n in names if (v := source.get(n, "").strip())), default)


@dataclass(frozen=True)
class Settings:
    """Limits and folders of the pipeline."""

    parsed_dir: str = "data/parsed"
    reports_dir: str = "data/reports"
    max_chars: int = 60_000
    single_call_chars: int = 32_000
    chunk_chars: int = 12_000
    max_chunks: int = 8
    retries: int = 2
    timeout_seconds: float = 120.0
    overwrite: bool = False
    token: str = field(default="", repr=False)

    @classmethod
    def from_env(cls, prefix: str = "LITLAKE_", env: Mapping[str, str] | None = None) -> Settings:
        """Each field from ``PREFIX`` + its name in capitals; errors name the variable."""
        found = {}
        for name, kind in cls.__annotations__.items():
            text = first_env(prefix + name.upper(), env=env)
            if text:
                convert = {"int": int, "float": float, "bool": lambda x: x.lower() in TRUE}.get(kind, str)
                try:
                    found[name] = convert(text)
                except ValueError as e:
                    raise ValueError(f"{prefix}{name.upper()} is no {kind}: {text}") from e
        return cls(**found)


def canonical_query(parameters: Mapping[str, object] | None) -> str:
    """Sorted, percent-encoded parameters; None is empty."""
    quote = lambda x: urllib.parse.quote("" if x is None else str(x), safe="")
    return "&".join(f"{quote(k)}={quote(parameters[k])}" for k in sorted(parameters or {}))


def signature(secret: str, text: bytes) -> str:
    """Base64 of HMAC-SHA256."""
    return base64.b64encode(hmac.new(secret.encode(), text, hashlib.sha256).digest()).decode()
