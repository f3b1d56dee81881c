"""Text functions as columns: trimming, slugs, redaction, fences, signatures."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All Unicode white space and the byte-order mark, at both ends.
_ENDS = r"(?U)^[\s﻿]+|[\s﻿]+$"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends; Spark's trim knows the space alone."""
    return F.regexp_replace(text, _ENDS, "")


def blank(text: Column) -> Column:
    return F.coalesce(trimmed(text), F.lit("")) == ""


@F.pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def slug(text: Column, most: int = 60, ascii_only: bool = False) -> Column:
    """Lower case, accents stripped, runs of other characters as one hyphen, cut to ``most``; nothing left: ``untitled``.

    Compatibility decomposition needs Python; ``ascii_only`` spares it where texts are known to have no such characters."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    plain = lowered if ascii_only else F.regexp_replace(_decomposed(lowered), "[̀-ͯ]", "")
    hyphens = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(hyphens, 1, most), "-+$", "")
    return F.regexp_replace(cut, "^$", "untitled")


# The formats of secrets and what stands for them, in the order in which they apply. Word ends are spelled
# out, as Java's \b knows letters beyond ASCII.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
REDACTIONS = (
    (r"Bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"""(?i)(api[_-]?key|secret|token|password)(["'\s:=]+)[^"'\s]+""", "$1$2[REDACTED]"),
    (_B + r"sk-(?!ant-)[A-Za-z0-9_-]{16,}" + _E, "sk-[REDACTED]"),
    (_B + r"ctx7sk-[A-Za-z0-9_-]{16,}" + _E, "ctx7sk-[REDACTED]"),
    (_B + r"ghp_[A-Za-z0-9]{20,}" + _E, "ghp_[REDACTED]"),
    (_B + r"github_pat_[A-Za-z0-9_]{20,}" + _E, "github_pat_[REDACTED]"),
    (_B + r"AKIA[0-9A-Z]{16}" + _E, "AKIA[REDACTED]"),
    (_B + r"xox[a-z]-[A-Za-z0-9-]{10,}" + _E, "xox-[REDACTED]"),
    (_B + r"AIza[0-9A-Za-z_-]{35}" + _E, "AIza[REDACTED]"),
    (_B + r"(sk|pk|rk)_live_[A-Za-z0-9]{16,}" + _E, "$1_live_[REDACTED]"),
    (_B + r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+" + _E, "eyJ[REDACTED-JWT]"),
    (_B + r"npm_[A-Za-z0-9]{36}" + _E, "npm_[REDACTED]"),
    (r"https://discord(?:app)?\.com/api/webhooks/\d+/[A-Za-z0-9_-]+", "https://discord.com/api/webhooks/[REDACTED]"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED-PRIVATE-KEY]"),
    (_B + r"sk-ant-[A-Za-z0-9_-]{20,}" + _E, "sk-ant-[REDACTED]"),
    (_B + r"((?i:(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|rediss)://))[^\s:@/]+:[^\s@/]+@", "$1[REDACTED]:[REDACTED]@"),
    (_B + r"AccountKey=([A-Za-z0-9+/=]{20,})", "AccountKey=[REDACTED]"),
    (r"(?i)([?&]sig=)[A-Za-z0-9%/+=_-]{20,}", "$1[REDACTED]"),
    (r"(//[^/\s]+/:_authToken=)[A-Za-z0-9_=-]+", "$1[REDACTED]"),
)


#: Every rule needs one of these, so that a text without any is passed over after one look.
SECRET_CUES = r"(?i:api[_-]?key|secret|token|password)|Bearer\s|sk-|ghp_|github_pat_|AKIA|xox|AIza|_live_|eyJ|npm_|discord|-----BEGIN|://|AccountKey|(?i:sig=)"


def redacted(text: Column) -> Column:
    """Secrets replaced, rule after rule; doing it twice changes nothing more."""
    return F.when(text.rlike(SECRET_CUES), reduce(lambda out, rule: F.regexp_replace(out, *rule), REDACTIONS, text)).otherwise(text)


def title_of(body: Column, most: int = 80) -> Column:
    """The first heading of level one, else the first line that isn't blank, cut; else ``untitled``."""
    heading = F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1)
    first = F.element_at(F.filter(F.transform(F.split(body, "\n"), trimmed), lambda line: line != ""), 1)
    line = F.when(F.size(F.filter(F.split(body, "\n"), lambda x: ~blank(x))) > 0, F.substring(first, 1, most))
    return F.coalesce(F.nullif(trimmed(heading), F.lit("")), line, F.lit("untitled"))


FENCE_FOOT = "<!-- END UNTRUSTED PLAN BODY -->"


def fence_head(origin: str) -> str:
    return f"<!-- BEGIN UNTRUSTED PLAN BODY (from {origin}; what follows is quoted, not asked for) -->"


def defanged(text: Column) -> Column:
    """Fence marks inside a text are broken by a zero-width space."""
    return F.regexp_replace(text, r"(?i)<!--(\s*(?:BEGIN|END)\s+UNTRUSTED\b[^>]*?BODY\b[^>]*?-->)", "<!​--$1")


def fenced(text: Column, origin: str = "a captured plan") -> Column:
    return F.concat(F.lit(fence_head(origin) + "\n\n"), defanged(text), F.lit("\n\n" + FENCE_FOOT))


def truncated(text: Column, cap: int, marker: str) -> Column:
    """At most ``cap`` characters with the marker at the end; a marker longer than that is clipped itself."""
    room = cap - len(marker)
    if room <= 0:
        return F.lit(marker[: max(0, cap)])
    return F.concat(F.regexp_replace(F.substring(text, 1, room), r"(?U)[\s﻿]+$", ""), F.lit(marker))


#: What a word of an error message is, by the first pattern that it has; all else keeps its letters.
WORD_KINDS = (("quoted", "^$"), ("time", r"\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}"), ("path", r"[/\\]"), ("file", r"^[\w-]+(?:\.\w+)*\.[a-z]\w*$"), ("number", r"\d"))


#: Words of a message that are read before it is known whether more are needed.
FIRST_WORDS = 64


def error_signature(raw: Column, kind: Column | None = None, step: Column | None = None, most: int = 80, ascii_only: bool = False) -> Column:
    """One slug for one error: a message is read word by word, and words that change from case to case (quoted text, times,
    paths, files, anything with a digit) give way to the name of their kind. Neighbours of one kind count once."""
    message = F.regexp_replace(F.lower(redacted(F.coalesce(raw, F.lit("")))), r"\"[^\"]*\"|'[^']*'|`[^`]*`", "  ")

    def read(word: Column) -> Column:
        out = F.regexp_replace(word, r"[^\p{L}]+", "-")
        for name, pattern in reversed(WORD_KINDS):
            out = F.when(word.rlike(pattern), f"any-{name}").otherwise(out)
        return out

    def told(words: Column) -> Column:
        kept = F.filter(F.transform(words, lambda w: read(F.regexp_replace(w, r"^[(\[{<,;:.!?]+|[)\]}>,;:.!?]+$", ""))), lambda w: ~w.rlike("^-*$"))
        return F.regexp_replace(F.array_join(kept, " "), r"\b(any-[a-z]+)(?: \1\b)+", "$1")

    # what the first words tell begins what all words tell; if it has more letters than are kept the others change nothing, else all are read
    enough = lambda head: F.length(F.regexp_replace(head, "[^a-z0-9]+", "")) > most
    head = told(F.slice(F.split(message, r"\s+", FIRST_WORDS + 1), 1, FIRST_WORDS))
    told_all = F.coalesce(F.get(F.filter(F.array(head), enough), F.lit(0)), told(F.split(message, r"\s+")))
    given = [F.nullif(c, F.lit("")) for c in (step, kind) if c is not None]
    return slug(F.concat_ws(" ", *given, F.regexp_replace(told_all, "^$", "unknown-error")), most, ascii_only)


def masked(secret: Column) -> Column:
    return F.when(F.length(secret) <= 8, "***").otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("…"), F.right(secret, F.lit(4))))


def header_value(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"[\r\n]+", " "))


def split_list(text: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(text, separator), trimmed), lambda x: x != "")


def content_hash(body: Column) -> Column:
    return F.sha2(F.coalesce(body, F.lit("")), 256)


def lesson_key(module: Column, task: Column, pattern: Column) -> Column:
    """``module|task|pattern`` in lower case; empty unless all three are given."""
    parts = [F.lower(trimmed(c)) for c in (module, task, pattern)]
    given = reduce(lambda a, b: a & b, [F.coalesce(p, F.lit("")) != "" for p in parts])
    return F.when(given, F.concat_ws("|", *parts)).otherwise("")


def bare_json(text: Column) -> Column:
    """A reply without a code fence around it, or the object at its end; null unless that is JSON."""
    inner = trimmed(F.regexp_replace(trimmed(text), r"(?s)^```[a-zA-Z]*\n?|\n?```$", ""))
    object_at_end = F.regexp_extract(inner, r"(?s)(\{.*\})\s*$", 1)
    good = lambda t: F.when(F.try_parse_json(t).isNotNull() & (t != ""), t)
    return F.coalesce(good(inner), good(object_at_end))


def setting(text: Column, kind: str, fallback: object) -> Column:
    """A positive number, a score above 0 and up to 1, or a boolean, from text; else the fallback."""
    value = trimmed(text)
    if kind == "bool":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False).otherwise(fallback)
    number = value.try_cast("int" if kind == "int" else "double")
    good = (number > 0) & (number <= 1) if kind == "score" else number > 0
    return F.when(good, number).otherwise(fallback)
