"""People found in a stream of faces: the state of a block is kept person by person and photo by photo.

A block's looks (the vectors that faces are compared with) are read once a batch; of everything else only what the batch
touches is read and written: the people whose looks or counts change, the photos that come, and the last of a person's
lists of photos.  After every so many photos, or when a block has been still for a while, like people are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from orrery.operators.cluster import Groups, Thresholds, unit
from orrery.shared import written

#: Photos in one list of a person, and photos after which like people are merged.
PHOTOS_A_LIST, MERGE_EACH = 512, 500
FOUND = "block long, kind string, id long, person long"


class PhotoSet:
    """A person's photos: new ones at once, those in the state when they are asked for."""

    def __init__(self, stored: Callable[[], set]) -> None:
        self.stored, self.new = stored, set()

    def add(self, photo: int) -> None:
        self.new.add(photo)

    def __iter__(self) -> Iterator[int]:
        return iter(self.stored() | self.new)

    def __and__(self, other: PhotoSet) -> set:
        return set(self) & set(other)


class Loaded(dict):
    """A dictionary whose values come from the state when they are first asked for."""

    def __init__(self, load: Callable[[Any], Any]) -> None:
        super().__init__()
        self.load = load

    def __missing__(self, key: Any) -> Any:
        self[key] = self.load(key)
        return self[key]

    def get(self, key: Any, default: Any = None) -> Any:
        return self[key]

    def setdefault(self, key: Any, default: Any = None) -> Any:
        return self[key]


class People(StatefulProcessor):
    """Faces of a block (id, media_key, video, rank, good, blocked, embedding) placed as ``place_faces`` does, photo by photo.

    Gives rows of FOUND: placed (a face and its person, or none) and merged (a person and the one it is now part of).
    """

    def __init__(self, limits: Thresholds, each: int = MERGE_EACH, still_ms: int | None = None) -> None:
        self.limits, self.each, self.still_ms = limits, each, still_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.people = handle.getMapState("people", "person long", "rows binary, looks binary, n long, ranks binary, clear binary, lists long")
        self.photos = handle.getMapState("photos", "person long, list long", "photos array<long>")
        self.inside = handle.getMapState("inside", "photo long", "people array<long>")
        self.uses = handle.getMapState("uses", "person long, video long", "n long")
        self.seen = handle.getValueState("seen", "photos long, unmerged long, timer long")

    # ---- between the state and Groups

    def _list_of(self, person: int, number: int) -> list[int]:
        key = (person, number)
        return list(self.photos.getValue(key)[0]) if self.photos.containsKey(key) else []

    def _load(self, dim: int) -> tuple[Groups, dict[int, tuple]]:
        groups, known = Groups(dim, self.limits), {}
        for (person,), value in self.people.iterator():
            known[person] = (bytes(value[0]), bytes(value[1]), value[2], bytes(value[3]), bytes(value[4]), value[5])
        total = sum(len(v[0]) // 8 for v in known.values())
        groups.room(total)
        for person, (rows, looks, n, ranks, clear, _) in known.items():
            at = np.frombuffer(rows, np.int64)
            for i, look in zip(at.tolist(), np.frombuffer(looks).reshape(len(at), -1), strict=True):
                groups.put(i, person, look)
            if n:
                groups.changed.add(person)
                groups.count[person] = n
                groups.clear[person] = list(zip(np.frombuffer(ranks).tolist(), np.frombuffer(clear).reshape(-1, dim), strict=True))
        groups.looks = total
        lists = {p: v[5] for p, v in known.items()}
        groups.photos = Loaded(lambda p: PhotoSet(lambda: {x for k in range(lists.get(p, 0)) for x in self._list_of(p, k)}))
        groups.inside = Loaded(lambda photo: set(self.inside.getValue((photo,))[0]) if self.inside.containsKey((photo,)) else set())
        groups.in_video = Loaded(lambda key: self.uses.getValue(key)[0] if None not in key and self.uses.containsKey(key) else 0)
        return groups, known

    def _save(self, groups: Groups, known: dict[int, tuple], gone: set[int]) -> None:
        owner = groups.owner[: groups.looks]
        by: dict[int, list[int]] = {}
        for i, person in enumerate(owner.tolist()):
            by.setdefault(person, []).append(i)
        for person in {*by, *known, *groups.photos} - gone:
            lists = known[person][5] if person in known else 0
            new = sorted(groups.photos[person].new) if person in groups.photos else []
            if new:
                last = self._list_of(person, lists - 1) if lists else []
                if lists and len(last) < PHOTOS_A_LIST:
                    lists, new = lists - 1, last + new
                for at in range(0, len(new), PHOTOS_A_LIST):
                    self.photos.updateValue((person, lists), (new[at : at + PHOTOS_A_LIST],))
                    lists += 1
            rows, clear = by.get(person, []), groups.clear.get(person, [])
            value = (np.array(rows, np.int64).tobytes(), groups.sums[rows].tobytes(), groups.count.get(person, 0), np.array([r for r, _ in clear], float).tobytes(), b"".join(e.tobytes() for _, e in clear), lists)
            if known.get(person) != value:
                self.people.updateValue((person,), value)
        for person in gone:
            if person in known:
                for k in range(known[person][5]):
                    self.photos.removeKey((person, k))
                self.people.removeKey((person,))
        for photo, people in groups.inside.items():
            if people:
                self.inside.updateValue((photo,), (sorted(people),))
        for (person, video), n in groups.in_video.items():
            if n and video is not None:
                self.uses.updateValue((person, video), (n,))

    # ---- batches and timers

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf[pdf.embedding.map(lambda v: v is not None and len(v) > 0)].sort_values(["media_key", "rank", "id"], ascending=[True, False, True])
        out: list[tuple] = []
        if len(pdf):
            groups, known = self._load(len(pdf.embedding.iloc[0]))
            photos, unmerged, timer = self.seen.get() if self.seen.exists() else (0, 0, 0)
            gone: set[int] = set()
            number = lambda x: None if pd.isna(x) else int(x)
            vectors = unit(np.stack(pdf.embedding.to_numpy()).astype(np.float64))
            last = None
            for r, e in zip(pdf.itertuples(), vectors, strict=True):
                if last is not None and r.media_key != last:
                    photos, unmerged = photos + 1, unmerged + 1
                    if self.each and photos % self.each == 0:
                        unmerged = self._merge(key[0], groups, gone, out)
                last = r.media_key
                out.append((key[0], "placed", int(r.id), groups.place(int(r.id), int(r.media_key), e, bool(r.good), float(r.rank), number(r.blocked), number(r.video))))
            photos, unmerged = photos + 1, unmerged + 1
            if self.each and photos % self.each == 0:
                unmerged = self._merge(key[0], groups, gone, out)
            self._save(groups, known, gone)
            if self.still_ms is not None:
                if timer:
                    self.handle.deleteTimer(timer)
                timer = timerValues.getCurrentProcessingTimeInMs() + self.still_ms
                self.handle.registerTimer(timer)
            self.seen.update((photos, unmerged, timer))
        yield _found(out)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The block has been still: merge what came since the last time."""
        photos, unmerged, _ = self.seen.get()
        out: list[tuple] = []
        if unmerged:
            dim = next((len(np.frombuffer(bytes(v[1]))) * 8 // len(bytes(v[0])) for _, v in self.people.iterator() if len(bytes(v[0]))), 0)
            if dim:
                groups, known = self._load(dim)
                gone: set[int] = set()
                self._merge(key[0], groups, gone, out)
                self._save(groups, known, gone)
        self.seen.update((photos, 0, 0))
        yield _found(out)

    def _merge(self, block: int, groups: Groups, gone: set[int], out: list[tuple]) -> int:
        for a, b in groups.merged(set(), set(), set()).items():
            gone.add(a)
            out.append((block, "merged", a, b))
        return 0

    def close(self) -> None:
        pass


def _found(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pd.DataFrame({"block": pd.array(columns[0], "Int64"), "kind": pd.array(columns[1], "string"), "id": pd.array(columns[2], "Int64"), "person": pd.array(columns[3], "Int64")})


def stateful(spark: SparkSession) -> None:
    """State of this kind is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def people_stream(faces: DataFrame, limits: Thresholds, each: int = MERGE_EACH, still_ms: int | None = None) -> DataFrame:
    """block, kind, id, person (see ``People``) for a stream of faces (block, id, media_key, video, rank, good, blocked, embedding).

    A photo's faces have to come in one batch to be placed clearest first.  still_ms: merge blocks without faces for so long.
    """
    stateful(faces.sparkSession)
    rows = faces.select("block", "id", "media_key", "video", "rank", "good", "blocked", "embedding")
    return rows.groupBy("block").transformWithStateInPandas(People(limits, each, still_ms), FOUND, "Append", "ProcessingTime" if still_ms is not None else "None")


def final_people(found: DataFrame) -> DataFrame:
    """block, id, person of placed faces (rows of FOUND) once merges are followed to the person that is left.

    Every round follows twice as many merges as the one before.
    """
    into = found.where("kind = 'merged'").selectExpr("block", "id as gone", "person as kept")
    while True:
        further = into.selectExpr("block", "gone as kept", "kept as last")
        longer = written(into.join(further, ["block", "kept"], "left").selectExpr("block", "gone", "coalesce(last, kept) as kept", "last is not null as moved"))
        into = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    placed = found.where("kind = 'placed'").select("block", "id", "person")
    return placed.join(into.withColumnRenamed("gone", "person"), ["block", "person"], "left").selectExpr("block", "id", "coalesce(kept, person) as person")
