"""Changes to stored documents without updates in place: each gives the next state, and snapshots flip by a pointer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove
from ..sources.journal import Journal, LostRace


def saved(incoming: DataFrame, fields: DataFrame, most: int) -> DataFrame:
    """(slot, name, document_ok, metadata_ok, ok) of documents (slot, name, text, metadata) to be saved: a document needs a name
    and a text of at most ``most`` characters; its metadata need fields that the slot has in (slot, names)."""
    document_ok = (F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.length("text") <= most)
    # texts are judged where they stand; slots are few, and most documents may be of one
    told = incoming.withColumn("document_ok", F.coalesce(document_ok, F.lit(False))).drop("text")
    told = told.join(F.broadcast(fields), "slot", "left")
    asked = F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    unknown = F.array_except(asked, F.coalesce("names", F.array().cast("array<string>")))
    told = told.withColumn("metadata_ok", (F.size(asked) == 0) | (F.col("document_ok") & (F.size(unknown) == 0)))
    return told.select("slot", "name", "document_ok", "metadata_ok", (F.col("document_ok") & F.col("metadata_ok")).alias("ok"))


def document_id(slot: Column, name: Column, version: Column) -> Column:
    """A new id for each version of a document, the same wherever it is computed."""
    return F.sha2(F.concat_ws("|", slot, name, version.cast("string")), 256)


def created(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """The base with new documents (slot, name, version, …) appended under new ids; nothing is replaced."""
    rows = incoming.withColumn("doc_id", document_id(F.col("slot"), F.col("name"), F.col("version"))).withColumn("enabled", F.lit(True))
    return base.unionByName(rows.select(*[c if c in rows.columns else F.lit(None).alias(c) for c in base.columns]))


def superseded(base: DataFrame, incoming: DataFrame, action: str = "disable") -> tuple[DataFrame, DataFrame]:
    """(next state, failures) of documents that name the one they replace (supersedes): the new one is added, the old one
    disabled or deleted; a named document that isn't there is a failure and doesn't keep the new one out."""
    old = incoming.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("doc_id"))
    left = switched(base, old, False) if action == "disable" else deleted(base, old)
    return created(left, incoming.drop("supersedes")), old.join(base.select("doc_id"), "doc_id", "left_anti")


def superseded_or_refused(base: DataFrame, incoming: DataFrame, action: str = "disable") -> tuple[DataFrame, DataFrame]:
    """As ``superseded`` for updates, which must name what they replace: a new document whose old one isn't named or isn't there
    is refused, and told apart."""
    known = base.select(F.col("doc_id").alias("supersedes"))
    good = incoming.join(known, "supersedes", "left_semi").select(*incoming.columns)
    return superseded(base, good, action)[0], incoming.join(known, "supersedes", "left_anti").select(*incoming.columns)


def latest_by_name(versions: DataFrame) -> DataFrame:
    """Of (slot, name, version, …) the last version of each name: the row is chosen by an aggregate and not a sort."""
    others = [c for c in versions.columns if c not in ("slot", "name")]
    return versions.groupBy("slot", "name").agg(F.max_by(F.struct(*others), "version").alias("v")).select("slot", "name", *[F.col(f"v.{c}").alias(c) for c in others])


def upserted(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """The base with documents of (slot, name) replaced by the incoming ones, or added."""
    last = latest_by_name(incoming.withColumn("version", F.col("version"))) if "version" in incoming.columns else incoming
    return base.join(last.select("slot", "name"), ["slot", "name"], "left_anti").unionByName(last.select(*base.columns))


def replaced_copies(listing: DataFrame, name: str, new_id: str | None) -> DataFrame:
    """Other documents of exactly this name, to be deleted; none while the new id is unknown."""
    return listing.where(F.lit(new_id is not None) & (F.col("name") == name) & F.col("doc_id").isNotNull() & (F.col("doc_id") != F.lit(new_id)))


def merged_metadata(current: Column, patch: Column) -> Column:
    """Both maps; the patch wins; a null in the patch becomes empty text."""
    fixed = F.transform_values(patch, lambda k, v: F.coalesce(v, F.lit("")))
    return F.map_zip_with(current, fixed, lambda k, old, new: F.coalesce(new, old))


def patched(base: DataFrame, patches: DataFrame, known: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(next state, absent): metadata read and merged with patches (doc_id, patch); fields that aren't known are passed
    over; patches for absent documents are told apart."""
    allowed = patches.withColumn("patch", F.map_filter("patch", lambda k, v: k.isin(*known)))
    joined = base.join(allowed, "doc_id", "left")
    state = joined.withColumn("metadata", F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(merged_metadata(F.col("metadata"), F.col("patch")))).select(*base.columns)
    return state, patches.join(base.select("doc_id"), "doc_id", "left_anti")


def switched(base: DataFrame, ids: DataFrame, enabled: bool) -> DataFrame:
    """Documents of these ids disabled or enabled."""
    marked = ids.select("doc_id").distinct().withColumn("__hit", F.lit(True))
    return base.join(marked, "doc_id", "left").withColumn("enabled", F.when(F.col("__hit"), enabled).otherwise(F.col("enabled"))).select(*base.columns)


def deleted(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("doc_id"), "doc_id", "left_anti")


def archived(base: DataFrame, pairs: DataFrame, at: str) -> DataFrame:
    """Losers of (keeper_id, loser_id) disabled, with who replaced them and when."""
    losers = pairs.select(F.col("loser_id").alias("doc_id"), "keeper_id").dropDuplicates(["doc_id"])
    joined = base.join(losers, "doc_id", "left")
    hit = F.col("keeper_id").isNotNull()
    stamped = merged_metadata(F.col("metadata"), F.create_map(F.lit("superseded_by"), "keeper_id", F.lit("consolidated_at"), F.lit(at)))
    return joined.withColumn("metadata", F.when(hit, stamped).otherwise(F.col("metadata"))).withColumn("enabled", F.when(hit, False).otherwise(F.col("enabled"))).select(*base.columns)


class Snapshots:
    """Versions of a table under one folder. A version's rows are written first, under a name of their own; the version counts
    once its entry stands in the journal, so readers see whole versions, and a writer that dies leaves none behind.

    A writer says which version its rows were made from. If another version came in between, ``commit`` raises LostRace and
    removes what it wrote, so that no change is lost unseen. An entry keeps the number of the last batch of each stream; a batch
    that comes again commits nothing.

    ``buckets`` = (number, columns): rows are kept in so many files by hash of the columns, sorted by them, and read back as a bucketed
    table, so that joins on these columns don't shuffle what is stored."""

    def __init__(self, spark: SparkSession, path: str, buckets: tuple[int, tuple[str, ...]] | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.journal = Journal(spark, f"{self.path}/journal")

    def versions(self) -> list[int]:
        return self.journal.versions()

    def last(self) -> int:
        return self.journal.last()

    def read(self, version: int | None = None) -> DataFrame:
        known = self.last() if version is None else version
        if not known:
            raise ValueError(f"no version in {self.path}")
        entry = self.journal.entry(known)
        place = f"{self.path}/{entry['folder']}"
        if self.buckets is None:
            return self.spark.read.parquet(place)
        number, columns = self.buckets
        name, listed = f"v_{entry['folder'].removeprefix('data-')}", ", ".join(f"`{c}`" for c in columns)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({entry['schema']}) USING parquet CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {number} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def seen(self, stream: str, batch: int) -> int | None:
        """The last version, if this batch of the stream is in it already."""
        known = self.last()
        return known if known and self.journal.entry(known)["batches"].get(stream, -1) >= batch else None

    def commit(self, state: DataFrame, partition_by: str | None = None, base: int | None = None, batch: tuple[str, int] | None = None, told: dict[str, int] | Callable[[], dict[str, int]] | None = None) -> int:
        """Writes ``state`` as the next version and gives its number. ``base`` is the version it was made from, by default the last
        one now; ``batch`` names a stream and a number; ``told`` are counts to keep with the version, or a function that gives them once the
        rows are written."""
        base = self.last() if base is None else base
        if batch is not None and (done := self.seen(*batch)) is not None:
            return done
        before = self.journal.entry(base) if base else {"batches": {}}
        folder = f"data-{uuid.uuid4().hex}"
        place = f"{self.path}/{folder}"
        if self.buckets is not None:
            number, columns = self.buckets
            # a task of the write holds one bucket if the rows come from a join with the version before; else they are dealt out first
            dealt = state if base else state.repartition(number, *columns)
            name = f"v_{folder.removeprefix('data-')}"
            dealt.write.format("parquet").bucketBy(number, *columns).sortBy(*columns).option("path", place).saveAsTable(name)
        else:
            writer = state.write.partitionBy(partition_by) if partition_by else state.write
            writer.parquet(place)
        entry = {"folder": folder, "schema": state.schema.toDDL(), "batches": before["batches"] | ({batch[0]: batch[1]} if batch else {}), "told": (told() if callable(told) else told) or {}}
        try:
            return self.journal.append(entry, base)
        except LostRace:
            if self.buckets is not None:
                self.spark.sql(f"DROP TABLE IF EXISTS v_{folder.removeprefix('data-')}")
            remove(self.spark, place)
            raise

    def told(self, version: int | None = None) -> dict[str, int]:
        known = self.last() if version is None else version
        return self.journal.entry(known)["told"] if known else {}

    def put_back(self, version: int, told: dict[str, int] | None = None) -> int:
        """A next version with the rows of an older one, which stay where they are: nothing is written but the entry."""
        base = self.last()
        return self.journal.append(self.journal.entry(version) | {"batches": self.journal.entry(base)["batches"], "told": told or {}}, base)

    def keep_last(self, most: int) -> list[int]:
        """Removes the rows of all but the last ``most`` versions; their entries stay. Gives the versions whose rows went."""
        gone = []
        kept = {self.journal.entry(version)["folder"] for version in self.versions()[-most:]}
        for version in self.versions()[:-most]:
            entry = self.journal.entry(version)
            if entry["folder"] in kept:
                continue
            if self.buckets is not None:
                self.spark.sql(f"DROP TABLE IF EXISTS v_{entry['folder'].removeprefix('data-')}")
            remove(self.spark, f"{self.path}/{entry['folder']}")
            gone.append(version)
        return gone


def upserted_by_join(base: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("slot", "name")) -> DataFrame:
    """As ``upserted``, in one join on the keys: where the base is stored in buckets by them it isn't shuffled."""
    last = latest_by_name(incoming) if "version" in incoming.columns else incoming
    others = [c for c in base.columns if c not in keys]
    new = last.select(*keys, *[F.col(c).alias(f"new_{c}") for c in others], F.lit(True).alias("new_"))
    return base.join(new, list(keys), "full").select(*[F.col(c) if c in keys else F.when(F.col("new_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])


def patched_by_name(base: DataFrame, patches: DataFrame, known: tuple[str, ...], keys: tuple[str, ...] = ("slot", "name")) -> DataFrame:
    """The base with metadata merged with patches (slot, name, patch), the later of a name winning by ``version`` if there is one;
    fields that aren't known are passed over. The join is on the keys, and so doesn't shuffle a base in buckets."""
    last = latest_by_name(patches) if "version" in patches.columns else patches
    allowed = last.select(*keys, F.map_filter("patch", lambda k, v: k.isin(*known)).alias("patch"))
    return base.join(allowed, list(keys), "left").withColumn("metadata", F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(merged_metadata(F.col("metadata"), F.col("patch")))).select(*base.columns)
