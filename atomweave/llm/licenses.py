"""License scans by conditional compression.

A text's paragraphs that hold a cue of licensing are candidate blocks. Each is compressed, in windows of words that overlap by half, with zstandard alone and
with every licence's template as a raw dictionary; a template has a licence's names, a notice, its SPDX tag and the passage by which its full
text is known. Licences are ranked by the bytes that they save. All that save any are confirmed by exact wording: one of the licence's names must
stand in the block, word for word but for FILLER; or its passage, with at most MISSING of the words missing, which are reported. Names of fewer than
SHORT letters can't save bytes for sure, and so are looked for in every block. No shuffle; templates have a fixed size.

Rules of names. Words are compared in lower case, "version 3", "v3" and "3.0" alike; at each place the longest name counts, so that the lesser or Affero licence isn't
taken for the general one. A name of one common word (MIT, ISC) counts after or before "license", or after "released under" and the like. A name that is denied ("not
licensed under …") doesn't count; nor does one without a version where versions differ. The two BSD texts begin alike: one that a further clause follows before
the next begins is the longer one, so a text that holds both licences names both.

Edge cases: null and empty texts have no licences; a licence that occurs twice is named once, with its best evidence; ties in savings go to the licence that comes
first by name; rows that repeat give rows that repeat; very long lines are read in windows, whole.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import column_type

#: Short notices of public licences, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "Released into the public domain under the Unlicense.",
    "all-rights-reserved": "All rights reserved.",
}
#: What only the full text of a licence says.
PASSAGES = {
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose",
}
#: Other names of licences.
NAMES = {
    "0BSD": ("0BSD", "Zero-Clause BSD", "BSD Zero Clause License"),
    "Apache-1.1": ("Apache License 1.1", "Apache Software License 1.1", "Apache 1.1"),
    "Apache-2.0": ("Apache License 2.0", "Apache Software License 2.0", "Apache 2.0", "ASL 2.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause", "2-Clause BSD", "Two-Clause BSD", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-Clause BSD", "Three-Clause BSD", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License", "BSL 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0", "Creative Commons Zero", "Creative Commons CC0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "CDDL 1.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "EPL 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "ISC": ("ISC License", "ISC"),
    "MIT": ("MIT License", "MIT", "Expat License", "X11 License"),
    "MIT-0": ("MIT No Attribution", "MIT 0"),
    "MPL-1.1": ("Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0"),
    "ODbL-1.0": ("Open Database License 1.0", "ODbL 1.0", "Open Database License"),
    "OFL-1.1": ("SIL Open Font License 1.1", "OFL 1.1", "SIL Open Font License"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "Zlib": ("zlib License", "zlib libpng License", "zlib"),
    "all-rights-reserved": ("All rights reserved",),
}
#: Families whose names follow a rule: versions, short and long name.
GNU = {"GPL": (("2.0", "3.0"), "", "GNU General Public License"), "LGPL": (("2.0", "2.1", "3.0"), "Lesser", "GNU Lesser General Public License"), "AGPL": (("3.0",), "Affero", "GNU Affero General Public License")}
COMMONS, COMMONS_VERSIONS = {"BY": ("Attribution",), "SA": ("ShareAlike", "Share Alike"), "NC": ("NonCommercial", "Non Commercial"), "ND": ("NoDerivatives", "No Derivatives", "NoDerivs")}, ("2.0", "2.5", "3.0", "4.0")
COMMONS_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
#: Names of one word that mean a licence wherever they stand.
STRONG = frozenset("0bsd cc0 unlicense wtfpl".split())
TAG = "SPDX-License-Identifier"
#: Parts of words that any block with a licence has, in lower case; finding them needs no expression, and so is quick in long texts.
CUES = (
    "licens", "licenc", "redistribution", "endorse or", "hereby granted", "permission to", "permission is", "permitted to copy", "unencumbered", "as-is", "public domain", "rights reserved", "creative commons", "spdx",
    "cc by", "cc-by", "cc0", "gpl", "apache", "bsd", "mpl-", "mpl 1", "mpl 2", "mpl v", "mpl1", "mpl2", "epl-", "epl 1", "epl 2", "epl v", "eupl", "cddl", "odbl", "ofl-", "ofl 1", "ofl v", "wtfpl", "artistic", "boost software", "bsl-", "bsl 1", "asl 2", "mit no", "mit-0",
)
WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
#: Words that say nothing in a name, and those that may stand between a denial and a name.
FILLER = frozenset("the of terms a an is are in to version ver v".split())
DENIALS, AFTER_DENIAL = frozenset("not never isn aren wasn nor neither no".split()), frozenset("licensed license released distributed available published provided covered offered under longer yet t".split())
GIVEN = frozenset("licensed released distributed available published provided offered dedicated subject".split())
JOINED = re.compile(r"(a?gpl|lgpl|mpl|epl|eupl|cddl|ofl|apache|bsd|cc0|odbl)-?v?(\d+(?:\.\d+)?)")
#: Words of a window, the share of a passage's words that may be missing, and letters of a name that saves bytes for sure.
WINDOW, MISSING, SHORT = 60, 0.2, 24
END = "."


def words(text: str) -> list[str]:
    """Words in the form in which they are compared, with a mark where a sentence ends."""
    out: list[str] = []
    end = 0
    last = ""
    for m in WORD.finditer(text):
        gap = text[end : m.start()]
        if out and last not in ("v", "ver") and re.search(r"[.;!?]\s", gap):
            out.append(END)
        last, end = m[0].lower(), m.end()
        if joined := JOINED.fullmatch(last):
            parts = [joined[1], joined[2]]
        else:
            parts = [last]
        for p in parts:
            p = re.sub(r"^v(?=\d)", "", p)
            p = re.sub(r"^(\d+)(?:\.0)+$", r"\1", p)
            p = {"licence": "license", "licenses": "license", "licences": "license", "licenced": "licensed"}.get(p, p)
            if p not in FILLER:
                out.append(p)
    return out


@lru_cache(1)
def every_name() -> dict[str, tuple[str, ...]]:
    """Licence: its names."""
    out = {licence: (*names, licence) for licence, names in NAMES.items() if licence != "all-rights-reserved"} | {"all-rights-reserved": NAMES["all-rights-reserved"]}
    for short, (versions, kind, long) in GNU.items():
        for v in versions:
            other = [f"GNU Library General Public License {v}"] if (short, v) == ("LGPL", "2.0") else []
            spelled = [f"{long} as published by the Free Software Foundation, either version {v} of the License", f"{long} as published by the Free Software Foundation, version {v} of the License"]
            out[f"{short}-{v}"] = (f"{long} {v}", f"{long.removeprefix('GNU ')} {v}", f"{short} {v}", f"GNU {short} {v}", *([f"{kind} GPL {v}"] if kind else []), *other, *spelled)
    for kind in COMMONS_KINDS:
        for v in COMMONS_VERSIONS:
            long = [" ".join(p) for p in product(*[COMMONS[k] for k in kind.split("-")])]
            out[f"CC-{kind}-{v}"] = (f"CC {kind} {v}", f"CC-{kind}-{v}", *[f"Creative Commons {x} {v}" for x in long], *[f"Creative Commons {x} License {v}" for x in long], f"Creative Commons {kind} {v}")
    return {licence: out[licence] for licence in sorted(out)}


@lru_cache(1)
def names_by_word() -> dict[str, list[tuple[tuple[str, ...], str, int]]]:
    """First word of a name: (words, licence, letters of the name), the longest first."""
    out: dict[str, dict[tuple[str, ...], tuple[str, int]]] = {}
    for licence, names in every_name().items():
        for name in names:
            key = tuple(w for w in words(name) if w != END)
            out.setdefault(key[0], {}).setdefault(key, (licence, len(name)))
    return {first: sorted(((k, *v) for k, v in of.items()), key=lambda x: (-len(x[0]), x[0])) for first, of in out.items()}


@lru_cache(1)
def passages() -> dict[str, list[str]]:
    return {licence: [w for w in words(text) if w != END] for licence, text in PASSAGES.items()}


@lru_cache(1)
def compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    parameters = lambda: zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_dict_id=False)

    def with_template(licence: str) -> zstandard.ZstdCompressor:
        text = "\n".join([PASSAGES.get(licence, ""), f"{TAG}: {licence}", *every_name()[licence], TEMPLATES.get(licence, f"Licensed under the {every_name()[licence][0]}.")]).lower()
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters())

    return zstandard.ZstdCompressor(compression_params=parameters()), {licence: with_template(licence) for licence in every_name()}


@lru_cache(20_000)
def window_savings(window: str) -> tuple[tuple[int, str], ...]:
    alone, given = compressors()
    data = window.encode("utf-8", "replace")
    base = len(alone.compress(data))
    return tuple(sorted(((base - len(c.compress(data)), licence) for licence, c in given.items()), key=lambda x: (-x[0], x[1])))


def savings(block: str) -> list[tuple[int, str]]:
    """Licences by the bytes that they save in some window of the block, the most first."""
    found = [w for w in block.lower().split() if WORD.search(w)]  # marks of comments don't count
    best: dict[str, int] = {}
    for k in range(0, max(1, len(found) - WINDOW // 2), WINDOW // 2):
        window = " ".join(found[k : k + WINDOW])
        if cued(window):
            for saved, licence in window_savings(window) if len(window) <= 1_000 else window_savings.__wrapped__(window):
                best[licence] = max(best.get(licence, saved), saved)
    return sorted(((saved, licence) for licence, saved in best.items()), key=lambda x: (-x[0], x[1]))


def denied(found: list[str], start: int) -> bool:
    """Whether a denial stands before this place, with nothing but what is denied between."""
    k = start - 1
    while k >= 0 and found[k] in AFTER_DENIAL:
        k -= 1
    return k >= 0 and found[k] in DENIALS


def in_context(found: list[str], start: int, end: int, last_end: int) -> bool:
    """Whether a name of one common word means a licence here."""
    if end < len(found) and found[end] == "license":
        return True
    before = found[start - 1] if start else ""
    if before in ("license", "licensed", "identifier") or (before == "under" and bool(GIVEN & set(found[max(0, start - 5) : start - 1]))):
        return True
    return before in ("or", "and") and start - 1 == last_end


def named(found: list[str], winners: set[str]) -> Iterator[tuple[int, str]]:
    """(place, licence) of the names in a block's words."""
    index, k, last_end = names_by_word(), 0, -1
    while k < len(found):
        match = next(((key, licence, letters) for key, licence, letters in index.get(found[k], ()) if tuple(found[k : k + len(key)]) == key and (licence in winners or letters < SHORT)), None)
        if match is None:
            k += 1
            continue
        key, licence, _ = match
        common = len(key) == 1 and key[0] not in STRONG
        if not denied(found, k) and (not common or in_context(found, k, k + len(key), last_end)):
            yield k, licence
        k += len(key)
        last_end = k


def passage_places(found: list[str], licence: str) -> Iterator[tuple[int, list[str]]]:
    """(place, words lacking) of each occurrence of a licence's passage, found by its first or last two words."""
    passage = passages()[licence]
    clean = [w for w in found if w != END]
    size, seen = len(passage), -1
    spare = int(size * MISSING) + 1
    for k in range(len(clean) - 1):
        if clean[k : k + 2] == passage[:2]:
            start = k
        elif clean[k : k + 2] == passage[-2:]:
            start = max(0, k + 2 - size - spare)
        else:
            continue
        part = clean[start : start + size + spare]
        matcher = difflib.SequenceMatcher(None, passage, part, autojunk=False)
        here = [m for m in matcher.get_matching_blocks() if m.size]
        kept = {m.a + x for m in here for x in range(m.size)}
        if here and len(kept) >= (1 - MISSING) * size and start + here[-1].b + here[-1].size > seen:
            yield start + here[0].b, [w for x, w in enumerate(passage) if x not in kept]
            seen = start + here[-1].b + here[-1].size + size // 2


def flat(text: str) -> str:
    """Lower case, words apart by one blank, without marks that stand alone, as comments have them."""
    lowered = text.lower()
    return " ".join(w for w in lowered.split() if w.isalnum() or WORD.search(w)) if "\n" in lowered else lowered


def cued(lowered: str) -> bool:
    return any(c in lowered for c in CUES)


def candidate_blocks(text: str) -> list[str]:
    """Paragraphs with a cue, in order; runs of white space count as one blank."""
    if not cued(flat(text)):
        return []
    return [block for block in re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)+", text) if cued(flat(block))]


def scan_text(text: str) -> list[tuple[str, int, str]]:
    """(licence, bytes saved, words lacking) of a text, by licence."""
    best: dict[str, tuple[int, int, str]] = {}

    def tell(licence: str, saved: int, lacks: list[str]) -> None:
        new = (len(lacks), -saved, " ".join(lacks))
        best[licence] = min(best.get(licence, new), new)

    two: tuple[int, list[str]] | None = None  # a text that both BSD licences begin with
    for block in candidate_blocks(text):
        found = words(block)
        ranked = savings(block)
        saved = {licence: n for n, licence in ranked}
        winners = {licence for licence, n in saved.items() if n > 0}
        for _, licence in named(found, winners):
            tell(licence, max(0, saved.get(licence, 0)), [])
        events = sorted((place, licence, lacks) for licence in PASSAGES if licence in winners for place, lacks in passage_places(found, licence))
        for _, licence, lacks in events:
            n = saved[licence]
            if licence == "BSD-2-Clause":
                if two is not None:
                    tell(licence, *two)
                two = (n, lacks)
            else:
                if licence == "BSD-3-Clause":
                    two = None
                tell(licence, n, lacks)
    if two is not None:
        tell("BSD-2-Clause", *two)
    return [(licence, -best[licence][1], best[licence][2]) for licence in sorted(best)]


KIND = pa.list_(pa.struct([("license", pa.string()), ("saved_bytes", pa.int64()), ("missing_words", pa.string())]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found array<struct<license, saved_bytes, missing_words>>) of each document, by name of the licence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"license": a, "saved_bytes": b, "missing_words": c} for a, b, c in scan_text(value.as_py() or "")] for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, KIND)], names=[key, "found"])

    return docs.select(key, text).mapInArrow(run, f"{key} {column_type(docs, key)}, found array<struct<license:string,saved_bytes:long,missing_words:string>>")
