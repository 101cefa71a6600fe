"""Parameters of a run: limits, and which credentials are there."""

from __future__ import annotations

import os
from collections.abc import Mapping

#: Credentials and the variables that hold them.
CREDENTIALS = {"elsevier": "ELSEVIER_API_KEY", "openalex": "OPENALEX_API_KEY", "contactEmail": "CONTACT_EMAIL"}
#: Papers enriched and files fetched in a run without a limit.
ENRICH_LIMIT, DOWNLOAD_LIMIT = 100, 10


def credential_status(env: Mapping[str, str] | None = None) -> dict[str, bool]:
    """Whether each credential is there; never its value."""
    env = os.environ if env is None else env
    return {name: bool(env.get(variable)) for name, variable in CREDENTIALS.items()}


def limit(value: str | None, default: int | None = None) -> int | None:
    """A whole number from 0 on."""
    if value is None:
        return default
    if not value.strip().isascii() or not value.strip().isdigit():
        raise ValueError("limits must be whole numbers from 0 on")
    return int(value)
