"""Merging people over blocks and naming faces of frames, beside one pass in memory."""

import numpy as np
import pytest

from orrery.operators import cluster as C
from orrery.operators import merge as M

FACES = "person long, id long, media_key long, rank double, good boolean, embedding array<double>"
LIMITS = C.Thresholds()
PEOPLE, PAIRS = "person long, pinned boolean, named boolean", "a long, b long"


def split_people(seed, people=6, parts=2, each=8, spread=0.12, dim=16):
    """Faces of people that are split into parts, one photo each: person number is 10 times the true one plus the part."""
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(dim, people)))[0].T
    return [(10 * p + k, 1000 * p + 100 * k + i, 1000 * p + 100 * k + i, float(rng.random()), i > 0, (centres[p] / np.linalg.norm(centres[p]) + spread * rng.normal(size=dim)).tolist()) for p in range(people) for k in range(parts) for i in range(each)]


def in_memory(rows, pinned=frozenset(), named=frozenset(), rejected=frozenset()):
    groups = C.Groups(len(rows[0][5]), LIMITS)
    for person, i, media, rank, good, v in sorted(rows, key=lambda r: (r[0], -r[3], r[1])):
        if good:
            groups.learn(person, C.unit(np.array(v)), rank)
        groups.join(person, media)
    into = groups.merged(set(pinned), set(named), set(rejected))

    def last(p):
        while p in into:
            p = into[p]
        return p

    return {p: last(p) for p in {r[0] for r in rows}}


def merged(spark, rows, people=(), rejected=()):
    into = {r.person: r.into for r in M.merge_people(spark.createDataFrame(rows, FACES), spark.createDataFrame(list(people), PEOPLE), spark.createDataFrame(list(rejected), PAIRS), LIMITS).collect()}
    return {p: into.get(p, p) for p in {r[0] for r in rows}}


@pytest.mark.parametrize("parts", [2, 3])
def test_split_people_become_one(spark, parts):
    rows = split_people(4, people=4, parts=parts)
    found = merged(spark, rows)
    groups = lambda m: {frozenset(p for p in m if m[p] == q) for q in m.values()}
    assert groups(found) == groups(in_memory(rows)) == {frozenset(10 * p + k for k in range(parts)) for p in range(4)}


def test_flags_photos_and_rejections(spark):
    rows = split_people(9, people=5, parts=2)
    rows += [(1, 5001, 0, 0.5, True, rows[0][5])]  # person 1 is in a photo of person 0
    people = [(10, False, True), (11, True, False), (20, True, False), (21, True, False), (31, False, True)]
    found = merged(spark, rows, people, [(40, 41)])
    assert found == {0: 0, 1: 1, 10: 10, 11: 10, 20: 20, 21: 21, 30: 31, 31: 31, 40: 40, 41: 41}
    want = in_memory(rows, {11, 20, 21}, {10, 31}, {(40, 41)})
    assert found == want


def test_photos_of_those_taken_in_keep_apart(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=16)
    v /= np.linalg.norm(v)
    near = lambda s: (v + s * rng.normal(size=16)).tolist()
    rows = [(p, 100 * p + i, 100 * p + i, 1.0 - i / 10, True, near(0.02 * p)) for p in (1, 2, 3) for i in range(5)]
    rows.append((3, 390, 200, 0.1, True, near(0.02)))  # 3 and 2 share a photo, 1 is like both
    found = merged(spark, rows)
    assert found[1] == found[2] != found[3] or found[1] == found[3] != found[2]


def test_nobody_to_merge(spark):
    assert M.merge_people(spark.createDataFrame([], FACES), spark.createDataFrame([], PEOPLE), spark.createDataFrame([], PAIRS), LIMITS).count() == 0


@pytest.mark.parametrize("size", [1 << 23, 1 << 13])
def test_like_pairs_meet_in_blocks(spark, monkeypatch, size):
    """By looks, by three clear faces, and neither; only like pairs leave a task, so no pair is joined with its vectors."""
    monkeypatch.setattr(M, "BLOCK_BYTES", size)
    rng = np.random.default_rng(3)
    people = []
    for p in range(120):
        centre = C.unit(rng.normal(size=6))
        clear = [(float(-k), C.unit(centre + 0.6 * rng.normal(size=6)).tolist()) for k in range(int(rng.integers(1, 11)))]
        people.append((p, len(clear), (2 * C.unit(centre + rng.normal(size=(int(rng.integers(1, 7)), 6)))).tolist(), clear, False, False))
    limits = C.Thresholds(merge=0.93, link=0.94)
    of = lambda rows: spark.createDataFrame(rows, f"{M._PROFILE}, pinned boolean, named boolean")
    want, by_faces = {}, 0
    for a in people[:50]:
        for b in people:
            near = float((C.unit(np.array(a[2])) @ C.unit(np.array(b[2])).T).max())
            best = sorted((float(np.dot(x, y)) for _, x in a[3] for _, y in b[3]), reverse=True)[:3]
            linked = near >= C.BEFORE_LINK and len(best) == 3 and sum(best) / 3 >= limits.link
            by_faces += linked and near < limits.merge
            if a[0] != b[0] and (near >= limits.merge or linked):
                want[min(a[0], b[0]), max(a[0], b[0])] = round(near, 9)
    found = M.like_pairs(of(people[:50]), of(people), limits)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert {(r.a, r.b): round(r.near, 9) for r in found.collect()} == want and 0 < by_faces < len(want)


def test_faces_of_frames_are_named_once(spark):
    rng = np.random.default_rng(7)
    looks = [(p, (c / np.linalg.norm(c)).tolist()) for p in range(5) for c in rng.normal(size=(2, 6))]
    faces = []
    for i in range(90):
        v = np.array(looks[int(rng.integers(10))][1]) + 0.4 * rng.normal(size=6)
        faces.append((i // 5, i, float(rng.integers(3)), (v / np.linalg.norm(v)).tolist()))
    faces.append((0, 1000, 9.0, None))
    found = M.name_frames(spark.createDataFrame(faces, "frame long, id long, rank double, embedding array<double>"), spark.createDataFrame(looks, "person long, embedding array<double>"), 0.2).collect()
    want, contested = [], 0
    for frame in range(18):
        taken = set()
        for _, i, _, v in sorted((f for f in faces if f[0] == frame and f[3]), key=lambda f: (-f[2], f[1])):
            near = {}
            for p, look in looks:
                near[p] = max(near.get(p, -9), float(np.dot(v, look)))
            order = sorted((-s, p) for p, s in near.items() if s >= 0.2)
            free = [(p, -s) for s, p in order if p not in taken]
            contested += bool(order) and order[0][1] in taken
            if free:
                taken.add(free[0][0])
                want.append((frame, i, free[0][0], round(free[0][1], 9)))
    assert sorted((r.frame, r.id, r.person, round(r.score, 9)) for r in found) == sorted(want) and contested > 5
