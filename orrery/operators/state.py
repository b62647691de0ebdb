"""State changes as functions from old tables and a delta to new tables.

Plain files have no merge: every function returns a new version, to be written beside the old one and swapped in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns that new rows lack become null."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key isn't there yet."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def put_dates(old: DataFrame, found: DataFrame) -> DataFrame:
    """Dates by key, the latest batch winning (found has a column batch)."""
    order = Window.partitionBy("key").orderBy(F.desc("batch"))
    rows = old.withColumn("batch", F.lit(-1)).unionByName(found)
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "batch")


def purge_missing(stored: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key still exists.  If nothing exists at all, nothing is purged: an empty listing is a failure."""
    there = existing.select(key).distinct()
    some = there.agg((F.count(F.lit(1)) > 0).alias("some"))
    found = stored.join(there.withColumn("there", F.lit(True)), key, "left").crossJoin(F.broadcast(some))
    return found.where("there or not some").drop("there", "some")


def prune_people(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People who have a face left."""
    return people.join(faces, people["id"] == faces["person_id"], "left_semi")


def rename(people: DataFrame, person: int, name: str | None) -> DataFrame:
    """A trimmed name, blank for none; naming pins a person, taking the name away doesn't unpin."""
    own, clean = F.col("id") == person, (name or "").strip() or None
    return people.withColumn("pinned", F.when(own & F.lit(clean is not None), True).otherwise(F.col("pinned"))).withColumn("name", F.when(own, F.lit(clean)).otherwise(F.col("name")))


def set_hidden(people: DataFrame, person: int, hidden: bool) -> DataFrame:
    """Hiding pins, too."""
    own = F.col("id") == person
    return people.withColumn("pinned", F.when(own & F.lit(hidden), True).otherwise(F.col("pinned"))).withColumn("hidden", F.when(own, hidden).otherwise(F.col("hidden")))


def set_pinned(people: DataFrame, person: int, pinned: bool) -> DataFrame:
    return people.withColumn("pinned", F.when(F.col("id") == person, pinned).otherwise(F.col("pinned")))


def lock_face(faces: DataFrame, face: int, person: int | None, blocked: int | None = None) -> DataFrame:
    """One face is given to a person (None: nobody) for good; a person it was taken from stays blocked unless another is named."""
    own = F.col("id") == face
    faces = faces.withColumn("person_id", F.when(own, F.lit(person).cast("long")).otherwise(F.col("person_id")))
    faces = faces.withColumn("locked", F.when(own, True).otherwise(F.col("locked")))
    return faces.withColumn("blocked", F.when(own, F.coalesce(F.lit(blocked).cast("long"), "blocked")).otherwise(F.col("blocked")))


def merge_people(people: DataFrame, faces: DataFrame, seen: DataFrame, gone: int, into: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """people, faces and seen (uri, ts_ms, person_id) with one person's rows given to another."""
    give = lambda df: df.withColumn("person_id", F.when(F.col("person_id") == gone, F.lit(into).cast("long")).otherwise(F.col("person_id")))
    return people.where(F.col("id") != gone), give(faces), give(seen).dropDuplicates(["uri", "ts_ms", "person_id"])


def dissolve_unpinned(people: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unpinned people go, and their faces that aren't locked belong to nobody."""
    loose = people.where("not pinned").select(F.col("id").alias("loose"))
    freed = faces.join(loose, faces["person_id"] == loose["loose"], "left")
    return people.where("pinned"), freed.withColumn("person_id", F.when(F.col("loose").isNull() | F.col("locked"), F.col("person_id"))).drop("loose")


def assign(faces: DataFrame, moves: DataFrame) -> DataFrame:
    """faces with the persons of moves (id, new_person); a null new_person takes the person away."""
    found = faces.join(moves.withColumn("moved", F.lit(True)), "id", "left")
    return found.withColumn("person_id", F.when(F.col("moved"), F.col("new_person")).otherwise(F.col("person_id"))).drop("moved", "new_person")


def log_merge(history: DataFrame, entry: DataFrame, keep: int = 30) -> DataFrame:
    """The newest ``keep`` entries by id."""
    return history.unionByName(entry).orderBy(F.desc("id")).limit(keep)


def restore_faces(faces: DataFrame, entry: DataFrame, person: int) -> DataFrame:
    """Faces of a merge entry (face_ids) that somebody has and nobody locked, given to a restored person."""
    ids = entry.select(F.explode("face_ids").alias("id")).distinct().withColumn("back", F.lit(True))
    found = faces.join(ids, "id", "left")
    mine = F.coalesce(F.col("back"), F.lit(False)) & F.col("person_id").isNotNull() & ~F.col("locked")
    return found.withColumn("person_id", F.when(mine, F.lit(person).cast("long")).otherwise(F.col("person_id"))).drop("back")


def reject_pairs(rejected: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that aren't one person, each once, smaller id first."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return rejected.select("a", "b").unionByName(ordered).distinct()


def overlay(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Built-in collections (id, name, prompts, sensitivity) under the user's rows (the same, hidden).

    No row: as built in.  A row without prompts: only its state.  Else the row's name, prompts and sensitivity.
    """
    o = overrides.select("id", *(F.col(c).alias(f"own_{c}") for c in ("name", "prompts", "sensitivity")), "hidden")
    full = F.coalesce(F.size("own_prompts") > 0, F.lit(False))
    pick = lambda c: F.when(full, F.coalesce(f"own_{c}", c)).otherwise(F.col(c)).alias(c)
    return defaults.join(o, "id", "left").select("id", pick("name"), pick("prompts"), pick("sensitivity"), F.coalesce("hidden", F.lit(0)).alias("hidden"))


def reconcile(catalog: DataFrame, current: DataFrame) -> DataFrame:
    """catalog (key, uri, taken_ms, src) after a rebuilt index: gone keys go, known dates stay, new ones are pending (src -1)."""
    kept = catalog.join(current.select("key").distinct(), "key", "left_semi")
    fresh = current.dropDuplicates(["key"]).join(catalog.select("key"), "key", "left_anti")
    return kept.unionByName(fresh.select("key", "uri", F.lit(0).cast("long").alias("taken_ms"), F.lit(-1).alias("src")))
