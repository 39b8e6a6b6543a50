"""Settings of the command line: arguments first, then the environment, then an INI file."""

from __future__ import annotations

import configparser
import os
from collections.abc import Mapping
from dataclasses import dataclass

TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Persistence:
    enabled: bool
    path: str | None


def truthy(value: str | None) -> bool:
    return value is not None and value.strip().lower() in TRUE


def persistence(persist: bool | None = None, path: str | None = None, ini: str | None = None, env: Mapping[str, str] = os.environ) -> Persistence:
    """Whether and where to keep results: INDICANT_PERSIST and INDICANT_STORE, or persist and path under [database]."""
    file = configparser.ConfigParser()
    if ini:
        file.read(ini, encoding="utf-8")
    own = file["database"] if file.has_section("database") else {}
    if persist is None:
        persist = truthy(env["INDICANT_PERSIST"]) if "INDICANT_PERSIST" in env else truthy(own.get("persist"))
    return Persistence(persist, path or env.get("INDICANT_STORE") or own.get("path") or None)
