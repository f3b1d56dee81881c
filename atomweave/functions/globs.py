"""Glob patterns as regular expressions over relative paths."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files that are documents.
DOCUMENT_GLOBS = ("**/*.md", "**/*.mdx", "**/*.markdown", "**/*.txt", "**/*.rst", "**/*.adoc")
#: Folders of version control, packages, builds and caches, and files that editors and tools leave; a caller may add others.
IGNORED_FOLDERS = (".git", ".hg", ".svn", "node_modules", "vendor", "venv", ".venv", "site-packages", "build", "dist", "target", "out", "coverage", "*cache", "*cache__", ".tox", ".idea", ".gradle", ".terraform", "tmp")
IGNORED_FILES = ("*~", "*.bak", "*.orig", "*.swp", "*.tmp", "*.log", "*.lock", "*.pyc", ".DS_Store")

_TOKENS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def default_ignored() -> list[str]:
    """A folder is passed over itself and with all below it."""
    return [g for f in IGNORED_FOLDERS for g in (f"**/{f}", f"**/{f}/**")] + [f"**/{f}" for f in IGNORED_FILES]


def glob_regex(pattern: str) -> str:
    """``**/`` crosses folders, ``*`` and ``?`` stay within one; anchored at both ends."""
    return "^" + "".join(_TOKENS.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)) + "$"


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    joined = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return path.rlike(joined) if joined else F.lit(False)


def wanted(path: Column, include: Iterable[str] | None = None, ignore: Iterable[str] = ()) -> Column:
    """A caller's include replaces the default; a caller's ignore is added to it."""
    return matches_any(path, include or DOCUMENT_GLOBS) & ~matches_any(path, [*default_ignored(), *ignore])
