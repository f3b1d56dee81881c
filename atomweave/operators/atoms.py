"""From transcripts to atoms and promoted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import ATOM_CHARS, ATOM_TYPES, EVIDENCE_CHARS, LESSON, LESSON_FIELDS, PLAN, QUALITY_CHARS, TASK_TYPES, TITLE_CHARS, TURN_CHARS, TURNS

ROLES = ("user", "assistant", "summary", "system")


def source_material(turns: DataFrame, least: int = 1, most: int = TURNS, chars: int = TURN_CHARS, summaries: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn_count, body, skip): the last turns of each conversation as text, secrets replaced, the last
    characters kept. Turns beyond ``most`` are dropped by rank before they are gathered, so a group is of bounded size. A
    summary in ``summaries`` (conv_id, summary), unless it is blank, stands for the turns, however few they are."""
    said = turns.where(F.col("role").isin(*ROLES) & ~X.blank(F.col("text")))
    label = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise(F.col("role"))
    said = said.withColumn("block", F.concat(F.lit("### "), label, F.lit("\n\n"), X.trimmed(F.col("text"))))
    recent = said.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= most)
    joined = recent.groupBy("conv_id").agg(F.count("*").alias("turn_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    if summaries is not None:
        told = summaries.where(~X.blank(F.col("summary"))).select("conv_id", "summary")
        joined = joined.join(told, "conv_id", "full").select("conv_id", F.coalesce("turn_count", F.lit(0)).alias("turn_count"), F.coalesce("summary", "body").alias("body"), F.col("summary").isNotNull().alias("summed"))
    else:
        joined = joined.withColumn("summed", F.lit(False))
    body = X.trimmed(X.redacted(F.col("body")))
    shown = F.when(F.length("clean") <= chars, F.col("clean")).otherwise(F.concat(F.right("clean", F.lit(chars)), F.lit(f"\n\n[Truncated to last {chars} chars.]")))
    skip = F.when(~F.col("summed") & (F.col("turn_count") < least), "too-few-turns").when(F.col("clean") == "", "no-content")
    return joined.withColumn("clean", body).select("conv_id", "turn_count", shown.alias("body"), skip.alias("skip"))


def validated(atoms: DataFrame) -> DataFrame:
    """Atoms (…, type, title, body, tags, metadata, evidence) that hold, in their stored form."""
    kind = F.lower(X.trimmed(F.col("type")))
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(X.trimmed(t))), lambda t: t != "")
    field = lambda name: F.coalesce(F.lower(X.trimmed(F.regexp_replace(F.element_at("metadata", name), r"[\r\n]+", " "))), F.lit(""))
    task = field("task_type")
    out = atoms.select(
        *[c for c in atoms.columns if c not in ("type", "title", "body", "tags", "metadata", "evidence")],
        kind.alias("type"), F.substring(X.trimmed(F.col("title")), 1, TITLE_CHARS).alias("title"), F.substring(X.trimmed(F.col("body")), 1, ATOM_CHARS).alias("body"), tags.alias("tags"),
        field("project_module").alias("project_module"), field("language").alias("language"), F.when((task == "") | task.isin(*TASK_TYPES), task).otherwise("unknown").alias("task_type"),
        field("error_pattern").alias("error_pattern"), F.substring("evidence", 1, EVIDENCE_CHARS).alias("evidence"),
    )
    lesson_ok = (F.col("type") != LESSON) | ((F.col("project_module") != "") & (F.col("task_type") != "") & (F.col("error_pattern") != ""))
    return out.where(F.col("type").isin(*[t for t in ATOM_TYPES if t != PLAN]) & ~X.blank(F.col("title")) & ~X.blank(F.col("body")) & (F.size("tags") > 0) & lesson_ok)


def quality(df: DataFrame) -> DataFrame:
    """(…, ok, reasons): bodies of some length, a tag, evidence or a stated reason, and a module where the type needs one."""
    because = F.col("body").rlike(r"(?is)(^|\n)\s*(why|how to apply)\s*:")
    reasons = F.array_compact(F.array(
        F.when(F.length("body") < QUALITY_CHARS, "body-too-short"), F.when(F.size("tags") < 1, "no-tags"),
        F.when(X.blank(F.col("evidence")) & ~because, "no-evidence"), F.when(F.col("type").isin(LESSON, "bug-root-cause") & X.blank(F.col("project_module")), "no-project-module"),
    ))
    return df.withColumn("reasons", F.array_join(reasons, ",")).withColumn("ok", F.col("reasons") == "")


def rendered(df: DataFrame, keys: list[str], order: str, head: Column) -> DataFrame:
    """(keys, text): each group's atoms as one markdown document under a head."""
    metadata = F.to_json(F.map_filter(F.create_map(*[x for f in ("project_module", "language", "task_type", "error_pattern") for x in (F.lit(f), F.coalesce(f, F.lit("")))]), lambda k, v: v != ""))
    block = F.concat_ws(
        "\n", F.concat(F.lit("### Atom · "), "type", F.lit(" · "), "title"), F.concat(F.lit("- type: "), "type"), F.concat(F.lit("- title: "), "title"),
        F.concat(F.lit("- tags: ["), F.array_join("tags", ", "), F.lit("]")), F.concat(F.lit("- metadata: "), metadata), F.lit("- body: |"), F.regexp_replace("body", "(?m)^", "    "),
        F.when(~X.blank(F.col("evidence")), F.concat(F.lit("- evidence: "), F.to_json(F.array("evidence")))),
    )
    blocks = df.select(*keys, order, block.alias("block")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda x: x["block"]).alias("blocks"))
    return blocks.select(*keys, F.concat(head, F.lit("\n\n"), F.array_join("blocks", "\n"), F.lit("\n")).alias("text"))


def parsed(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, type, title, tags, metadata, body, evidence) of the atoms in markdown documents (keys, text).

    A document is cut before each heading of an atom; fields are lines ``- key: value``; the body are the indented lines
    that follow its key, with up to four leading spaces taken off. All of it are SQL functions."""
    cut = df.select(*keys, F.posexplode(F.split("text", r"\n(?=(?:#{1,6} )?Atom · )")).alias("position", "block")).where(F.col("block").rlike(r"^(?:#{1,6} )?Atom · "))
    line = lambda name: F.nullif(F.trim(F.regexp_extract("block", rf"(?m)^- {name}: *(.*)$", 1)), F.lit(""))
    raw_body = F.regexp_extract("block", r"(?m)^- body: \|[ \t]*\n((?:(?: .*|[ \t]*)(?:\n|\z))*)", 1)
    body = X.trimmed(F.regexp_replace(raw_body, r"(?m)^ {1,4}", ""))
    metadata = F.from_json(F.when(F.try_parse_json(line("metadata")).isNotNull(), line("metadata")), "map<string,string>")
    evidence = F.coalesce(F.element_at(F.from_json(line("evidence"), "array<string>"), 1), F.get_json_object(F.concat(F.lit('{"v":'), line("evidence"), F.lit("}")), "$.v"), line("evidence"))
    tags = X.split_list(F.regexp_extract("block", r"(?m)^- tags: *\[(.*)\]", 1))
    found = cut.select(*keys, "position", line("type").alias("type"), line("title").alias("title"), tags.alias("tags"), F.coalesce(metadata, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("metadata"), body.alias("body"), evidence.alias("evidence"))
    return found.where(F.col("type").isin(*ATOM_TYPES) & F.col("title").isNotNull() & (F.col("body") != ""))


def promoted_text(updated_at: Column, merged: Column | None = None) -> Column:
    """The stored document of an atom; a merged text replaces the body and leaves evidence out."""
    given = F.lit(None).cast("string") if merged is None else F.nullif(X.trimmed(merged), F.lit(""))
    field = lambda name: F.concat(F.lit(f"- {name}: "), F.coalesce(name, F.lit("")))
    evidence = F.when(given.isNull() & ~X.blank(F.col("evidence")), F.concat(F.lit("\nevidence: "), "evidence"))
    return F.concat(
        F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), field("type"), F.concat(F.lit("- tags: ["), F.array_join("tags", ", "), F.lit("]")), field("project_module"), field("language"), field("task_type"),
                    field("error_pattern"), F.concat(F.lit("- updated_at_utc: "), updated_at), F.lit(""), F.coalesce(given, F.col("body")), evidence),
        F.lit("\n"),
    )


def stored_metadata() -> Column:
    """The metadata under which an atom is stored: its type, its tags joined, and fields that aren't blank."""
    tags = F.array_join(F.filter(F.transform("tags", X.trimmed), lambda t: t != ""), ",")
    fields = [("tags", tags)] + [(f, X.trimmed(F.col(f))) for f in ("project_module", "language", "task_type", "error_pattern")]
    every = F.create_map(F.lit("atom_type"), X.trimmed(F.col("type")), *[x for name, value in fields for x in (F.lit(name), value)])
    return F.map_filter(every, lambda k, v: (k == "atom_type") | (F.coalesce(v, F.lit("")) != ""))


def writes(decided: DataFrame, at: Column) -> DataFrame:
    """(atom_id, action, name, supersedes) of decisions (atom_id, type, title, action, target_id, target_name, merged_name): a
    creation is named by its title; an update by what it replaces, if that has a name of the same family, else by the name that was decided, else by its title, and
    disables what it replaces. Other actions write nothing."""
    slug_in = lambda family: F.regexp_extract("target_name", rf"^{family}-(.+)-\d{{4}}-\d{{2}}-\d{{2}}-\d{{9}}\.md$", 1)
    replaced = F.when(F.col("type") == LESSON, slug_in("lesson")).otherwise(slug_in("knowledge"))
    slugs = F.coalesce(F.nullif(replaced, F.lit("")), F.nullif(X.trimmed(F.col("merged_name")), F.lit("")), F.col("title"))
    source = F.when(F.col("action") == "update", slugs).otherwise(F.col("title"))
    family = F.when(F.col("type") == LESSON, "lesson").otherwise("knowledge")
    name = F.concat(family, F.lit("-"), X.slug(source), F.lit("-"), F.date_format(at, "yyyy-MM-dd-HHmmssSSS"), F.lit(".md"))
    return decided.where(F.col("action").isin("create", "update")).select("atom_id", "action", name.alias("name"), F.when(F.col("action") == "update", F.col("target_id")).alias("supersedes"))


def lesson_document() -> Column:
    """The document of a saved lesson: a heading, its fields, the text, and evidence if there is any; null unless the
    fields that a lesson needs are given."""
    field = lambda name: F.when(~X.blank(F.col(name)), F.concat(F.lit(f"- {name}: "), X.header_value(F.col(name))))
    lines = F.concat_ws("\n", F.concat(F.lit("# "), X.header_value(F.col("title"))), F.lit(""), *map(field, ("project_module", "task_type", "error_pattern", "language", "tags")), F.lit(""), F.col("body"), F.when(~X.blank(F.col("evidence")), F.concat(F.lit("\nevidence: "), F.col("evidence"))))
    return F.when(lesson_fields_given(), lines)


#: What a day's entry says where there are no atoms.
MARKERS = {"nothing-durable": "The session was read and holds nothing durable to keep.", "context-unreadable": "The session's context could not be read."}


def day_entry(outcome: Column, body: Column) -> Column:
    """The text under a day's entry without atoms: a marker, or the raw source, indented inside a fence."""
    raw = F.concat(F.lit("<!-- BEGIN UNTRUSTED SESSION BODY -->\n"), F.regexp_replace(X.defanged(body), "(?m)^", "    "), F.lit("\n<!-- END UNTRUSTED SESSION BODY -->"))
    out = F.when(outcome == "raw-fallback", raw)
    for name, text in MARKERS.items():
        out = out.when(outcome == name, F.lit(text))
    return out


def decisions(atoms: DataFrame, candidates: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(atom_id, action, target_id): what becomes of each atom, given its ranked candidates (atom_id, rank, doc_id).

    A lesson with an error pattern and a candidate replaces the first candidate; an atom without candidates is created;
    for the rest a decision in ``given`` (atom_id, action, target_id) counts if it names a candidate, else it waits."""
    first = candidates.groupBy("atom_id").agg(F.min_by("doc_id", "rank").alias("first_id"))
    out = atoms.select("atom_id", "type", "error_pattern").join(first, "atom_id", "left")
    forced = (F.col("type") == LESSON) & ~X.blank(F.col("error_pattern")) & F.col("first_id").isNotNull()
    if given is None:
        out = out.withColumn("given_action", F.lit(None).cast("string")).withColumn("given_id", F.lit(None).cast("string"))
    else:
        valid = given.where(F.col("action") == "create").unionByName(given.join(candidates.select("atom_id", F.col("doc_id").alias("target_id")), ["atom_id", "target_id"], "left_semi").select(*given.columns))
        out = out.join(valid.select("atom_id", F.col("action").alias("given_action"), F.col("target_id").alias("given_id")), "atom_id", "left")
    action = F.when(forced, "update").when(F.col("first_id").isNull(), "create").otherwise(F.coalesce("given_action", F.lit("unresolved")))
    return out.select("atom_id", action.alias("action"), F.when(forced, F.col("first_id")).when(F.col("first_id").isNotNull(), F.col("given_id")).alias("target_id"))


def merged_day(prior: Column, incoming: Column) -> Column:
    return F.when(X.blank(prior), incoming).otherwise(F.concat(F.regexp_replace(prior, r"\s+$", ""), F.lit("\n\n"), incoming))


def lesson_fields_given() -> Column:
    out = F.lit(True)
    for name in LESSON_FIELDS:
        out = out & ~X.blank(F.col(name))
    return out
