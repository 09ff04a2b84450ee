"""Constants and settings of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass

INDEX_VERSION = 2
#: Results limit, context lines, longest term, sizes of expansions.
MAX_RESULTS, CONTEXT_LINES = 100, 1
MAX_TERM, MAX_CLASS, MAX_STRINGS, MAX_REPEAT = 24, 8, 8, 4
MAX_TERMS_SHOWN = 256
#: Name of the index folder inside a workspace.
CACHE_DIR = ".textsieve"


def flag(value: str | None, default: bool) -> bool:
    """A boolean setting from text; what is neither yes nor no gives the default."""
    word = (value or "").strip().lower()
    if word in ("1", "true", "yes", "on"):
        return True
    return False if word in ("0", "false", "no", "off") else default


@dataclass(frozen=True)
class EngineConfig:
    """Where a file corpus and its index lie; the environment gives defaults."""

    workspace: str
    index_dir: str
    bootstrap_ignore: bool = True

    @classmethod
    def resolve(cls, workspace: str | None = None, index_dir: str | None = None, bootstrap_ignore: bool | None = None) -> EngineConfig:
        root = os.path.abspath(workspace or os.environ.get("TEXTSIEVE_WORKSPACE") or os.getcwd())
        index = index_dir or os.environ.get("TEXTSIEVE_INDEX_DIR") or os.path.join(root, CACHE_DIR)
        boot = flag(os.environ.get("TEXTSIEVE_BOOTSTRAP_IGNORE"), True) if bootstrap_ignore is None else bootstrap_ignore
        return cls(root, index, boot)
