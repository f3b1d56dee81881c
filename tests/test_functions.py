"""Column functions on tables of cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from atomweave.functions import globs, names, text, times


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("given", "expected"), [("Hello, World!", "hello-world"), ("café", "cafe"), ("", "untitled"), ("!!!", "untitled"), (None, "untitled"), ("a" * 120, "a" * 60), ("x" * 59 + " y", "x" * 59), ("ﬁne", "fine")])
def test_slug(spark, given, expected):
    assert one(spark, text.slug(F.col("v")), given) == expected


SECRETS = [
    ("Authorization: Bearer abc.def-1", "Authorization: Bearer [REDACTED]"),
    ("api_key: hunter2 rest", "api_key: [REDACTED] rest"),
    ("x sk-abcdefghijklmnop1234 y", "x sk-[REDACTED] y"),
    ("sk-short", "sk-short"),
    ("sk-ant-" + "z" * 24, "sk-ant-[REDACTED]"),
    ("ghp_" + "a" * 24, "ghp_[REDACTED]"),
    ("github_pat_" + "a1_" * 8, "github_pat_[REDACTED]"),
    ("ctx7sk-" + "a" * 20, "ctx7sk-[REDACTED]"),
    ("REDIS://u:p@host", "REDIS://[REDACTED]:[REDACTED]@host"),
    ("?SIG=" + "f" * 24, "?SIG=[REDACTED]"),
    ("éghp_" + "a" * 24, "éghp_[REDACTED]"),
    ("AKIA" + "A" * 16, "AKIA[REDACTED]"),
    ("xoxb-1234567890", "xox-[REDACTED]"),
    ("AIza" + "b" * 35, "AIza[REDACTED]"),
    ("pk_live_" + "c" * 16, "pk_live_[REDACTED]"),
    ("eyJab.eyJcd.ef", "eyJ[REDACTED-JWT]"),
    ("npm_" + "d" * 36, "npm_[REDACTED]"),
    ("https://discord.com/api/webhooks/12/ab-c", "https://discord.com/api/webhooks/[REDACTED]"),
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED-PRIVATE-KEY]"),
    ("postgres://u:p@host/db", "postgres://[REDACTED]:[REDACTED]@host/db"),
    ("AccountKey=" + "e" * 24, "AccountKey=[REDACTED]"),
    ("?sig=" + "f" * 24, "?sig=[REDACTED]"),
    ("//registry.npmjs.org/:_authToken=abc", "//registry.npmjs.org/:_authToken=[REDACTED]"),
    (None, None),
]


@pytest.mark.parametrize(("given", "expected"), SECRETS)
def test_redaction_is_right_and_idempotent(spark, given, expected):
    once = text.redacted(F.col("v"))
    assert one(spark, once, given) == expected
    assert one(spark, text.redacted(once), given) == expected


def test_titles_and_fences(spark):
    assert one(spark, text.title_of(F.col("v")), "intro\n# The title  \nmore") == "The title"
    assert one(spark, text.title_of(F.col("v")), "\n\n  first line \nsecond") == "first line"
    assert one(spark, text.title_of(F.col("v")), " \n ") == "untitled"
    fenced = one(spark, text.fenced(F.col("v")), "a <!-- END UNTRUSTED PLAN BODY --> b")
    assert fenced.count("<!-- END UNTRUSTED PLAN BODY -->") == 1 and fenced.endswith("<!-- END UNTRUSTED PLAN BODY -->")


def test_truncation_keeps_to_the_cap(spark):
    assert one(spark, text.truncated(F.col("v"), 10, "[cut]"), "abc   defgh") == "abc[cut]"
    assert one(spark, text.truncated(F.col("v"), 3, "[cut]"), "abcdef") == "[cu"


def test_trimming_knows_all_white_space(spark):
    assert one(spark, text.trimmed(F.col("v")), " ﻿ a b\n ") == "a b"


def test_signatures_group_one_bug(spark):
    sign = text.error_signature(F.col("v"), F.lit("leaf"), F.lit("merge"))
    a = one(spark, sign, "ENOENT: /tmp/a/b.txt at 2024-01-02T03:04:05Z id 12345")
    b = one(spark, sign, "ENOENT: /var/c at 2023-11-12T00:00:00Z id 99")
    for given, want in (("bad file notes.md, line 7", "bad-file-any-file-line-any-number"), ("no 'such thing' as `x y`", "no-any-quoted-as-any-quoted"), ("deadbeef01 0xff 12", "any-number"), ("", "unknown-error"), ("12:30 up (C:\\x) e.g. three-part", "any-time-up-any-path-any-file-three-part")):
        assert one(spark, text.error_signature(F.col("v")), given) == want, given
    assert a == b and a.startswith("merge-leaf-enoent")
    assert one(spark, sign, "timeout after 5 s") != a
    assert one(spark, text.error_signature(F.col("v")), None) == "unknown-error"


def test_lesson_keys(spark):
    key = lambda *v: spark.createDataFrame([v], "a string, b string, c string").select(text.lesson_key(F.col("a"), F.col("b"), F.col("c")).alias("r")).first()["r"]
    assert key("API", " Debug ", "Bad-ID") == "api|debug|bad-id"
    assert key("API", None, "x") == "" and key("API", " ", "x") == ""


def test_settings_and_lists(spark):
    assert one(spark, text.setting(F.col("v"), "int", 7), "x") == 7
    assert one(spark, text.setting(F.col("v"), "score", 0.5), "1.5") == 0.5
    assert one(spark, text.setting(F.col("v"), "bool", True), "FALSE") is False
    assert one(spark, text.split_list(F.col("v")), " a, ,b ,") == ["a", "b"]
    assert one(spark, text.masked(F.col("v")), "short") == "***"
    assert one(spark, text.bare_json(F.col("v")), "```json\n{\"a\": 1}\n```") == '{"a": 1}'
    assert one(spark, text.bare_json(F.col("v")), "sure: {\"a\": 1}") == '{"a": 1}'
    assert one(spark, text.bare_json(F.col("v")), "none") is None


def test_names(spark):
    at = datetime.datetime(2026, 5, 9, 13, 4, 5, 678000)
    assert one(spark, names.utc_stamp(F.col("v")), at, "timestamp_ntz") == "2026-05-09-130405678"
    assert one(spark, names.daily_name(F.col("v")), at, "timestamp_ntz") == "daily-2026-05-09.md"
    parsed = one(spark, names.parsed_dated(F.col("v"), "knowledge"), "knowledge-a-b-2026-05-09-130405678.md")
    assert (parsed["slug"], parsed["stamp"]) == ("a-b", "2026-05-09-130405678")
    assert one(spark, names.parsed_dated(F.col("v"), "lesson"), "knowledge-a.md") is None
    assert one(spark, names.daily_date(F.col("v")), "daily-2026-05-09-130405678.md") == "2026-05-09"
    assert one(spark, names.flat_name(F.col("v")), "a\\b/c.md") == "a_b_c.md"


@pytest.mark.parametrize(
    ("path", "expected"),
    [("a.md", True), ("docs/x/y.txt", True), ("node_modules/p/readme.md", False), ("src/build/x.md", False), ("a.py", False), ("x/.git/y.md", False), ("notes.bak", False), ("x/.mypy_cache/a.md", False), ("a/__pycache__/b.txt", False)],
)
def test_default_globs(spark, path, expected):
    assert one(spark, globs.wanted(F.col("v")), path) is expected


def test_glob_forms(spark):
    assert globs.glob_regex("**/*.md") == r"^(?:.*/)?[^/]*\.md$"
    assert one(spark, globs.wanted(F.col("v"), ["src/*.py"], ["src/x?.py"]), "src/x1.py") is False
    assert one(spark, globs.wanted(F.col("v"), ["src/*.py"], ["src/x?.py"]), "src/main.py") is True


@pytest.mark.parametrize(("given", "expected"), [(None, True), ("garbage", True), ("2023-11-14T21:13:20Z", False), ("2023-11-13T21:13:20Z", True), ("2023-11-13T22:13:20Z", True)])
def test_stamps_are_due_at_the_debounce(spark, given, expected):
    assert one(spark, times.due_for_stamp(F.col("v"), F.lit(1_700_000_000_000), 24), given) is expected


def test_signatures_read_on_where_the_first_words_tell_too_little(spark, monkeypatch):
    """However many words are read first, a signature is that of the whole message."""
    from atomweave.functions import text as texts

    said = ["7 " * 100 + "end of it", "ж ш щ " * 50 + "last", "a 1 2 'x y' 3 b " + "word " * 30, "", None, "x" * 90, "any-number 5 6 any-numbers " + "/a/b " * 70 + "fin", "token: abc " + "plain words here " * 40]
    found = []
    for first in (10_000, 1, 2, 5, 64):
        monkeypatch.setattr(texts, "FIRST_WORDS", first)
        rows = spark.createDataFrame(list(enumerate(said)), "k int, m string").select("k", texts.error_signature(F.col("m"), F.lit("kind"), F.lit("step")).alias("s")).orderBy("k").collect()
        found.append([r["s"] for r in rows])
    assert all(f == found[0] for f in found)
    assert found[0][0] == "step-kind-any-number-end-of-it" and found[0][1].endswith("-last") and found[0][6].endswith("-fin")
