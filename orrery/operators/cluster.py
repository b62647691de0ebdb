"""Grouping faces: greedy steps run inside one photo, video or block of people, all others are joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalar import iou
from orrery.operators.vector import dot, knn_many


#: Similarities for join, weak, merge and link by how strict grouping is.
STRICTNESS = {"normal": (0.365, 0.40, 0.45, 0.425), "strict": (0.445, 0.48, 0.53, 0.505), "loose": (0.305, 0.34, 0.39, 0.365)}


#: Faces whose near looks are found in one product, looks or faces that meet others at a time, and what single precision may miss.
AHEAD, AT_ONCE, SLACK = 128, 1 << 14, 1e-4


#: Looks and clearest faces kept of a person, faces of a video that shape one, and what two looks need to be linked.
MOST_LOOKS, CLEAREST, PER_VIDEO, BEFORE_LINK = 6, 10, 2, 0.26


@dataclass(frozen=True)
class Thresholds:
    """Similarities at which faces join a person, weak faces do, people merge, and links count."""

    join: float = 0.365
    weak: float = 0.40
    merge: float = 0.45
    link: float = 0.425

    @classmethod
    def named(cls, strictness: str | None) -> Thresholds:
        return cls(*STRICTNESS.get(strictness or "", STRICTNESS["normal"]))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def met(x: np.ndarray, y: np.ndarray, least: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y (counted from ``first``) whose product may be ``least`` or above, in single precision."""
    near = (x.astype(np.float32) @ y.astype(np.float32, copy=False).T >= least - SLACK).ravel()
    # Few are, so eight are looked at as one number first.
    whole = len(near) // 8 * 8
    some = (np.flatnonzero(near[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    i, j = np.divmod(np.concatenate([some[near[some]], whole + np.flatnonzero(near[whole:])]), max(len(y), 1))
    return i, j + first


class Clear:
    """The clearest faces of all people as one matrix, while people merge."""

    def __init__(self, clear: dict[int, list[tuple[float, np.ndarray]]], people: list[int], dim: int) -> None:
        self.people = people
        self.number = {p: k for k, p in enumerate(self.people)}
        self.sizes = np.array([len(clear[p]) for p in self.people], np.int64)
        self.faces = np.array([e for p in self.people for _, e in clear[p]], np.float32).reshape(-1, dim)
        self.ranks = np.array([rank for p in self.people for rank, _ in clear[p]], np.float64)
        self.whose = np.repeat(np.arange(len(self.people)), self.sizes)
        self.rows = dict(zip(self.people, np.split(np.arange(len(self.whose)), np.cumsum(self.sizes)[:-1]), strict=True)) if self.people else {}

    def absorb(self, keep: int, gone: int) -> None:
        """As ``Groups`` keeps the clearest of both, in the order of rank."""
        both = np.concatenate([self.rows[keep], self.rows.pop(gone)])
        both = both[np.argsort(-self.ranks[both], kind="stable")]
        self.whose[both] = -1
        self.rows[keep] = both[:CLEAREST]
        self.whose[self.rows[keep]] = self.number[keep]
        self.sizes[self.number[keep]] = len(self.rows[keep])


class Groups:
    """People of one block as looks (running means of like faces), their clearest faces, and the photos they are in.

    Looks of all people are the rows of one matrix, so the nearest person is one product, and those of the faces that come
    next are another (``expect``): what changes meanwhile is compared again face by face.
    """

    def __init__(self, dim: int, limits: Thresholds) -> None:
        self.limits, self.looks = limits, 0
        self.sums, self.centres, self.owner = np.zeros((64, dim)), np.zeros((64, dim)), np.zeros(64, np.int64)
        self.rows: dict[int, set[int]] = {}  # of a person's looks
        self.moved: list[int] = []  # looks that are others than when faces were expected
        self.is_moved = np.zeros(64, bool)
        self.count: dict[int, int] = {}
        self.clear: dict[int, list[tuple[float, np.ndarray]]] = {}
        self.photos: dict[int, set] = {}
        self.inside: dict[int, set] = {}
        self.in_video: dict[tuple, int] = {}
        self.changed: set[int] = set()  # whose looks or clearest faces are others than when people were merged last

    def room(self, n: int) -> None:
        """Space for n looks at least."""
        while n > len(self.owner):
            self.sums, self.centres, self.owner, self.is_moved = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.centres, self.owner, self.is_moved))

    def put(self, i: int, person: int, total: np.ndarray) -> None:
        """Look i becomes one of a person, with this sum of vectors."""
        self.room(i + 1)
        self.rows.get(int(self.owner[i]), set()).discard(i)
        self.rows.setdefault(person, set()).add(i)
        if not self.is_moved[i]:
            self.is_moved[i] = True
            self.moved.append(i)
        self.sums[i], self.centres[i], self.owner[i] = total, unit(total), person

    def looks_of(self, person: int) -> np.ndarray:
        return np.array(sorted(self.rows.get(person, ())), np.int64)

    def join(self, person: int, photo: int) -> None:
        self.photos.setdefault(person, set()).add(photo)
        self.inside.setdefault(photo, set()).add(person)

    def learn(self, person: int, e: np.ndarray, rank: float) -> None:
        """One more clear face of a person: it moves the nearest of their looks, or is a new one."""
        own = self.looks_of(person)
        near = self.centres[own] @ e
        if len(own) and near.max() >= self.limits.join:
            self.put(int(own[near.argmax()]), person, self.sums[own[near.argmax()]] + e)
        else:
            self.put(self.looks, person, e)
            self.looks += 1
        self.changed.add(person)
        self.count[person] = self.count.get(person, 0) + 1
        self.clear[person] = sorted([*self.clear.get(person, []), (rank, e)], key=lambda x: -x[0])[:CLEAREST]
        self.bound(person)

    def bound(self, person: int) -> None:
        """Of more than MOST_LOOKS looks the two most alike become one."""
        while len(own := self.looks_of(person)) > MOST_LOOKS:
            alike = np.triu(self.centres[own] @ self.centres[own].T, 1) + np.tril(np.full((len(own),) * 2, -9.0))
            i, j = (int(own[k]) for k in np.unravel_index(alike.argmax(), alike.shape))
            self.put(i, person, self.sums[i] + self.sums[j])
            self.looks -= 1
            last = int(self.owner[self.looks])
            self.put(j, last, self.sums[self.looks])
            self.rows[last].discard(self.looks)
            self.owner[self.looks] = 0

    def expect(self, faces: np.ndarray) -> list[np.ndarray]:
        """For each of the faces that come next the looks that may be near enough, ``may`` of ``nearest`` until the next call."""
        self.is_moved[self.moved] = False
        self.moved.clear()
        found = [met(faces, self.centres[low : min(low + AT_ONCE, self.looks)], min(self.limits.join, self.limits.weak), low) for low in range(0, self.looks, AT_ONCE)]
        i, j = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *found, strict=True))
        by = np.argsort(i, kind="stable")
        return np.split(j[by], np.searchsorted(i[by], np.arange(1, len(faces))))

    def nearest(self, e: np.ndarray, least: float, out: set, may: np.ndarray | None = None) -> int | None:
        """The person with the look nearest to e, at ``least`` or above and not among ``out``; may: see ``expect``."""
        if may is None:
            some = np.arange(self.looks)
            near = self.centres[: self.looks] @ e
        else:
            some = np.concatenate([may[~self.is_moved[may]], np.array(self.moved, np.int64)])
            some = some[some < self.looks]
            near = np.einsum("ij,j->i", self.centres[some], e)
        enough = near >= least
        some, near = some[enough], near[enough]
        for i in some[np.lexsort((some, -near))] if len(some) > 1 else some:
            if int(self.owner[i]) not in out:
                return int(self.owner[i])
        return None

    def place(self, face: int, photo: int, e: np.ndarray, good: bool, rank: float, blocked: int | None, video: int | None, may: np.ndarray | None = None) -> int | None:
        """The person a face goes to (a new one is named by the negative of the face), or None.

        A face that joins or starts a person shapes them only if it is good, and of one video at most PER_VIDEO faces do.
        """
        out = self.inside.get(photo, set()) | ({blocked} if blocked is not None else set())
        person = self.nearest(e, self.limits.join if good else self.limits.weak, out, may)
        if person is None and not good:
            return None
        person = -face if person is None else person
        if good:
            used = self.in_video.get((person, video), 0)
            if video is None or used < PER_VIDEO:
                self.in_video[person, video] = used + 1
                self.learn(person, e, rank)
        self.join(person, photo)
        return person

    def merged(self, pinned: set, named: set, rejected: set) -> dict[int, int]:
        """Who goes into whom when like people are merged, larger ones first.

        People merge when looks of theirs are as near as ``merge``, or when three pairs of their clearest faces and more
        are, on average of the best three, as near as ``link``; not two that are both pinned or both named, nor those that
        share a photo or were rejected.  The named one stays, else the pinned one, else the larger.
        """
        into: dict[int, int] = {}
        order = sorted(self.count, key=lambda p: (-self.count[p], -p))
        place = {p: k for k, p in enumerate(order)}
        # A pair that did not merge last time and has not changed since does not merge now: photos only add up.
        changed = [p for p in order if p in self.changed]
        self.changed.clear()
        partners: dict[int, set] = {}
        clear = Clear(self.clear, order, len(self.sums[0]))

        def compare(people: list[int], every: bool = False) -> None:
            for a, b in self.alike(people, clear, every):
                partners.setdefault(a, set()).add(b)
                partners.setdefault(b, set()).add(a)

        # Of two that merge the larger has two faces and more.
        every = len(changed) == len(order)
        compare([p for p in changed if self.count[p] > 1] if every else changed, every)
        for k, a in enumerate(order):
            if a in into:
                continue
            if self.count[a] <= 1:
                break
            at, gone = k, None
            while gone != a and (left := [place[b] for b in partners.get(a, ()) if place[b] > at]):
                for at in sorted(left):
                    b = order[at]
                    if b in into or (a in pinned and b in pinned) or (a in named and b in named) or (min(a, b), max(a, b)) in rejected or self.photos[a] & self.photos[b]:
                        continue
                    keep, gone = (b, a) if b in named or (b in pinned and a not in named) else (a, b)
                    into[gone] = keep
                    clear.absorb(keep, gone)
                    self._absorb(keep, gone)
                    for p in (keep, gone):
                        for q in partners.pop(p, ()):
                            partners.get(q, set()).discard(p)
                    compare([keep])
                    break
                else:
                    break
        return into

    def alike(self, people: list[int], clear: Clear, first: bool = False, size: int = 256) -> Iterator[tuple[int, int]]:
        """Pairs of these people and any others whose looks are as near as ``merge``, or BEFORE_LINK and their clearest faces
        as near as ``link``; vectors of some of these people meet AT_ONCE others at a time.  first: these people are the
        first of ``clear`` in its order, so faces meet those that come after them only."""
        for start in range(0, len(people), size // 4):
            some = people[start : start + size // 4]
            like, may = set(), set()
            own = np.concatenate([self.looks_of(p) for p in some])
            for low in range(0, self.looks, AT_ONCE):
                i, j = met(self.centres[own], self.centres[low : min(low + AT_ONCE, self.looks)], self.limits.merge, low)
                enough = (self.centres[own[i]] * self.centres[j]).sum(axis=1) >= self.limits.merge
                like.update(zip(self.owner[own[i[enough]]].tolist(), self.owner[j[enough]].tolist(), strict=True))
            own = np.concatenate([clear.rows[p] for p in some])
            for low in range(int(own[0]) if first else 0, len(clear.whose), AT_ONCE):
                i, j = met(clear.faces[own], clear.faces[low : low + AT_ONCE], self.limits.link, low)
                i, j = clear.whose[own[i]], clear.whose[j]
                # Those with fewer than three pairs of faces are never linked; -1 is nobody's any more.
                enough = (j >= 0) & (clear.sizes[i] * clear.sizes[j] >= 3)
                may.update((clear.people[a], clear.people[b]) for a, b in set(zip(i[enough].tolist(), j[enough].tolist(), strict=True)))
            for a, b in like | may:
                if a != b and ((a, b) in like or (self._near(a, b) >= BEFORE_LINK and self._linked(a, b))):
                    yield a, b

    def _near(self, a: int, b: int) -> float:
        return float((self.centres[self.looks_of(a)] @ self.centres[self.looks_of(b)].T).max(initial=-1.0))

    def _linked(self, a: int, b: int) -> bool:
        pairs = np.sort((np.stack([e for _, e in self.clear[a]]) @ np.stack([e for _, e in self.clear[b]]).T).ravel())
        return len(pairs) >= 3 and pairs[-3:].mean() >= self.limits.link

    def _absorb(self, keep: int, gone: int) -> None:
        self.owner[self.looks_of(gone)] = keep
        self.rows.setdefault(keep, set()).update(self.rows.pop(gone, ()))
        self.changed.add(keep)
        self.count[keep] += self.count.pop(gone)
        self.clear[keep] = sorted(self.clear[keep] + self.clear.pop(gone), key=lambda x: -x[0])[:CLEAREST]
        for photo in self.photos.pop(gone):
            self.join(keep, photo)
            self.inside[photo].discard(gone)
        self.bound(keep)


_PLACED = "block long, id long, person long"


def _placed(limits: Thresholds, again: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.embedding.map(lambda v: v is not None and len(v) > 0)]
        if not len(pdf):
            return pd.DataFrame(columns=["block", "id", "person"])
        number = lambda x: None if pd.isna(x) else int(x)
        vectors = dict(zip(pdf.id.tolist(), unit(np.stack(pdf.embedding.to_numpy()).astype(np.float64)), strict=True))
        groups, found = Groups(len(pdf.embedding.iloc[0]), limits), {}
        for r in pdf[pdf.person_id.notna()].sort_values(["rank", "id"], ascending=[False, True]).itertuples():
            if r.good:
                groups.learn(int(r.person_id), vectors[r.id], r.rank)
            groups.join(int(r.person_id), int(r.media_key))
        new = pdf[pdf.person_id.isna()]
        new = new.sort_values(["good", "rank", "id"], ascending=[False, False, True]) if again else new.sort_values(["media_key", "rank", "id"], ascending=[True, False, True])
        for start in range(0, len(new), AHEAD):
            some = new.iloc[start : start + AHEAD]
            for r, may in zip(some.itertuples(), groups.expect(np.stack([vectors[i] for i in some.id.tolist()])), strict=True):
                found[r.id] = groups.place(int(r.id), int(r.media_key), vectors[r.id], bool(r.good), float(r.rank), number(r.blocked), None if again else number(r.video), may)
        if again:
            known = pdf[pdf.person_id.notna()]
            own = lambda flag: set(known[known[flag].astype(bool)].person_id.astype(int))
            into = groups.merged(own("pinned"), own("named"), {(int(a), int(b)) for a, b in pdf.rejected.iloc[0]})

            def last(p):
                while p in into:
                    p = into[p]
                return p

            found = {i: p if p is None else last(p) for i, p in found.items()}
        rows = [(int(pdf.block.iloc[0]), i, p) for i, p in found.items()]
        return pd.DataFrame({"block": [r[0] for r in rows], "id": [r[1] for r in rows], "person": pd.array([r[2] for r in rows], "Int64")})

    return run


_FACES = ("block", "id", "media_key", "video", "rank", "good", "person_id", "blocked", "pinned", "named", "embedding")


def place_faces(faces: DataFrame, limits: Thresholds) -> DataFrame:
    """block, id, person: where faces without a person go, photo by photo, the clearest of a photo first.

    faces: block, id, media_key, video (null: a photo), rank, good, person_id, blocked, embedding.  person is a known
    one, the negative id of the face that starts a new one, or null.  A block is what callers cut the library into.
    """
    rows = faces.withColumn("pinned", F.lit(False)).withColumn("named", F.lit(False))
    return rows.select(*_FACES).groupBy("block").applyInPandas(_placed(limits, False), _PLACED)


def regroup(faces: DataFrame, rejected: DataFrame, limits: Thresholds) -> DataFrame:
    """block, id, person: all faces without a person grouped anew, good ones first by rank, then weak ones, then like people
    are merged.

    faces as for ``place_faces``, with pinned and named of their person; those with a person stay.  rejected: block, a, b
    with a < b, pairs of known people of a block that aren't one.
    """
    pairs = rejected.groupBy("block").agg(F.collect_list(F.array("a", "b")).alias("rejected"))
    rows = faces.select(*_FACES).join(pairs, "block", "left").withColumn("rejected", F.coalesce("rejected", F.expr("cast(array() as array<array<bigint>>)")))
    return rows.groupBy("block").applyInPandas(_placed(limits, True), _PLACED)


def leader_clusters(faces: DataFrame, limits: Thresholds, block: str = "block") -> DataFrame:
    """block, id, leader: faces (block, id, media_key, rank, good, embedding) grouped from nothing; weak ones may stay alone (null)."""
    none = F.lit(None).cast("long")
    rows = faces.select(F.col(block).alias("block"), "id", "media_key", none.alias("video"), "rank", "good", none.alias("person_id"), none.alias("blocked"), F.lit(False).alias("pinned"), F.lit(False).alias("named"), "embedding", F.expr("cast(array() as array<array<bigint>>)").alias("rejected"))
    found = rows.groupBy("block").applyInPandas(_placed(limits, True), _PLACED)
    return found.select(F.col("block").alias(block), "id", (-F.col("person")).alias("leader"))


def identify(faces: DataFrame, people: DataFrame, least: float) -> DataFrame:
    """ord, person, score: for faces (ord, embedding) the nearest of people (person, embedding) at ``least`` or above."""
    index = people.select(F.col("person").alias("ord"), "embedding")
    found = knn_many(index, faces.select(F.col("ord").alias("query"), F.col("embedding").alias("q")), 1)
    return found.where(F.col("score") >= least).select(F.col("query").alias("ord"), F.col("ord").alias("person"), "score")


def mutual_match(a: DataFrame, b: DataFrame, size: int = 2048) -> DataFrame:
    """pair, score: for pairs of faces' groups (pair, id, embedding) the smaller of both sides' mean of their three best
    per-face bests; pairs with fewer than two faces on a side fall out.

    A pair's faces meet in blocks of about ``size`` of both sides, of which only the best of each face is kept.
    """
    parts = lambda x, n: x.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n))
    both = parts(a, "ni").join(parts(b, "nj"), "pair")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(both, "pair").select("pair", "id", "embedding", own("ni").alias("i"), each("nj").alias("j"), F.lit(True).alias("is_left"))
    right = b.join(both, "pair").select("pair", "id", "embedding", each("ni").alias("i"), own("nj").alias("j"), F.lit(False).alias("is_left"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = np.full(len(pdf), np.nan)
        side, length = pdf.is_left.to_numpy(bool), pdf.embedding.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for n in set(length[side]) & set(length[~side]) - {-1}:
            x, y = (np.flatnonzero(s & (length == n)) for s in (side, ~side))
            vectors = lambda at: np.stack(pdf.embedding.to_numpy()[at]).astype(np.float64)
            near = vectors(x) @ vectors(y).T
            best[x], best[y] = np.fmax.reduce(near, axis=1), np.fmax.reduce(near, axis=0)
        return pd.DataFrame({"pair": pdf.pair, "is_left": side, "id": pdf.id, "s": best})

    found = left.unionByName(right).groupBy("pair", "i", "j").applyInPandas(run, f"pair {a.schema['pair'].dataType.simpleString()}, is_left boolean, id {a.schema['id'].dataType.simpleString()}, s double")
    best = found.groupBy("pair", "is_left", "id").agg(F.max(F.nullif(F.col("s"), F.lit(float("nan")))).alias("s"))
    rank = F.row_number().over(Window.partitionBy("pair", "is_left").orderBy(F.desc("s")))
    top = best.withColumn("place", rank).groupBy("pair", "is_left").agg(F.avg(F.when(F.col("place") <= 3, F.col("s"))).alias("mean"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return top.groupBy("pair").agg(F.count(F.lit(1)).alias("sides"), F.min("mean").alias("score")).where("sides = 2").select("pair", "score")


def two_groups(faces: DataFrame, least_share: float = 0.1, rounds: int = 15) -> DataFrame:
    """person_id, id, second: people's faces (person_id, id, rank, good, embedding) in two groups, for those who may be two.

    Spherical two-means over the good faces (four at least), from three pairs of seeds; a split with a smaller group of
    least_share and more beats any other.  second is false for the larger group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], ascending=[False, True])
        every, good = np.stack(pdf.embedding.to_numpy()).astype(np.float64), pdf.good.to_numpy(bool)
        clear = every[good]
        best, ends = (-1.0, None), pdf.iloc[:0]
        if len(clear) >= 4:
            away = lambda e: clear[np.argmin(clear @ e)]
            one = away(clear[0])
            two = away(one)
            for pair in ((clear[0], one), (one, two), (two, away(two))):
                centres = np.stack(pair)
                for _ in range(rounds):
                    side = (clear @ centres[0] < clear @ centres[1]).astype(int)
                    if not 0 < side.sum() < len(side):
                        break
                    moved = unit(np.stack([clear[side == k].sum(axis=0) for k in (0, 1)]))
                    still = ((moved * centres).sum(axis=1) >= 0.9999).all()
                    centres = moved
                    if still:
                        break
                if 0 < side.sum() < len(side):
                    fit = (clear @ centres.T).max(axis=1).mean() + (min(side.mean(), 1 - side.mean()) >= least_share)
                    best = max(best, (fit, centres), key=lambda x: x[0])
            if best[1] is not None:
                side = every @ best[1][0] < every @ best[1][1]
                if 0 < side.sum() < len(side):
                    ends = pdf.assign(second=side if side.sum() <= len(side) - side.sum() else ~side)
        return ends.reindex(columns=["person_id", "id", "second"])

    return faces.select("person_id", "id", "rank", "good", "embedding").groupBy("person_id").applyInPandas(run, "person_id long, id long, second boolean")


def tracks(detections: DataFrame, reach: float = 1.0, low: float = 0.55, high: float = 1.8) -> DataFrame:
    """video, id, track of detections (video, id, frame, cx, cy, size, rank): each face, clearest first, continues the
    nearest unused one of the frame before within reach (in face sizes) and of like size, or starts a track.

    Faces come sorted to their task and are gone through as they come: what is kept are those of two frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, frame, before, now, used, count = (), None, [], [], set(), 0
        for batch in batches:
            found = []
            for v, f, x, y, size in zip(*(batch[c].to_pylist() for c in ("video", "frame", "cx", "cy", "size")), strict=True):
                if (v,) != video:
                    video, frame, before, now, used, count = (v,), f, [], [], set(), 0
                elif f != frame:
                    frame, before, now, used = f, now, [], set()
                best, at = reach, None
                for k, (px, py, other, _) in enumerate(before):
                    if k not in used:
                        apart = abs(complex(x - px, y - py)) / max(size, other)
                        if apart < best and low <= size / other <= high:
                            best, at = apart, k
                if at is None:
                    track, count = count, count + 1
                else:
                    track = before[at][3]
                    used.add(at)
                now.append((x, y, size, track))
                found.append(track)
            yield pa.RecordBatch.from_arrays([batch["video"], batch["id"], pa.array(found, pa.int32())], ["video", "id", "track"])

    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    rows = detections.where("frame is not null").select(F.col("video").cast("long").alias("video"), F.col("id").cast("long").alias("id"), "frame", *map(number, ("cx", "cy", "size", "rank")))
    rows = rows.repartition("video").sortWithinPartitions("video", "frame", F.desc(F.nullif(F.col("rank"), F.lit(float("nan")))), "id")
    return rows.mapInArrow(run, "video long, id long, track int")


def recognition_picks(tracked: DataFrame) -> DataFrame:
    """video, track, id, role: the best face of a track, a second two frames away (or the next), and up to two more."""

    track = Window.partitionBy("video", "track")
    order = track.orderBy(F.desc("rank"), "id")
    x = tracked.select("video", "track", "id", F.row_number().over(order).alias("place"), (F.abs(F.col("frame") - F.first("frame").over(order)) >= 2).alias("far"))
    x = x.withColumn("second", F.coalesce(F.min(F.when((F.col("place") > 1) & F.col("far"), F.col("place"))).over(track), F.lit(2)))
    role = F.when(F.col("place") == 1, "best").when(F.col("place") == F.col("second"), "second").otherwise("extra")
    same = Window.partitionBy("video", "track", "role")
    x = x.withColumn("role", role).withColumn("at", F.row_number().over(same.orderBy("place"))).withColumn("n", F.count(F.lit(1)).over(same))
    return x.where((F.col("role") != "extra") | (F.col("at") == 1) | (F.col("at") == F.col("n"))).select("video", "track", "id", "role")


def suppressed(boxes: DataFrame, limit: float = 0.4) -> DataFrame:
    """media_key, id of boxes (media_key, id, score, l, t, r, b) kept, best first, where none kept overlaps by more than limit.

    A fold over the sorted boxes of one picture, in the JVM.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg_score"), "id", "l", "t", "r", "b")))

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: iou(x, y) > limit), kept).otherwise(F.concat(kept, F.array(x)))

    chosen = boxes.groupBy("media_key").agg(F.aggregate(ranked, F.filter(ranked, lambda x: F.lit(False)), step).alias("kept"))
    return chosen.select("media_key", F.explode("kept").alias("k")).select("media_key", "k.id")


def merge_groups(groups: DataFrame, limits: Thresholds) -> DataFrame:
    """block, id, into: groups (block, id, n, pinned, named, media array, centroid) merged with larger ones of their block.

    In the order of size, each goes into the most similar group before it at the merge limit or above that shares no
    media with it; two pinned or two named groups stay apart.  A merged group has both media and the weighted centre.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        out = []
        for g in pdf.sort_values(["n", "id"], ascending=[False, True]).itertuples():
            e, media, best = unit(np.asarray(g.centroid, np.float64)), set(g.media), (limits.merge, None)
            for k in kept:
                near = float(unit(k["sum"]) @ e)
                if near >= best[0] and not (k["pinned"] and g.pinned) and not (k["named"] and g.named) and not media & k["media"]:
                    best = (near, k)
            if best[1] is None:
                kept.append({"id": g.id, "sum": e * g.n, "media": media, "pinned": g.pinned, "named": g.named})
                out.append((g.block, g.id, g.id))
            else:
                k = best[1]
                k.update(sum=k["sum"] + e * g.n, media=k["media"] | media, pinned=k["pinned"] or g.pinned, named=k["named"] or g.named)
                out.append((g.block, g.id, k["id"]))
        return pd.DataFrame(out, columns=["block", "id", "into"])

    return groups.select("block", "id", "n", "pinned", "named", "media", "centroid").groupBy("block").applyInPandas(run, "block long, id long, into long")
