"""Small functions on numbers, names and arrays of a media library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Numbers of photos worth telling, and pixels, score, yaw and sharpness of good faces in photos and in videos.
MILESTONES = (50, 100, 250, 500, 1000, 2000, 5000, 10000)
GOOD_PHOTO, GOOD_VIDEO = (48, 0.6, 0.55, 20), (44, 0.5, 0.65, 14)


def strength(count: Column, best: Column) -> Column:
    """How good a memory a day is, from its number of photos and its best score."""
    return F.least(best, F.lit(300.0)) / 300 + 0.5 * F.least(F.lit(1.0), F.log1p(count) / F.log(F.lit(21.0))) + F.when(best > 0, 0.3).otherwise(0.0)


def qualifies(count: Column, best: Column) -> Column:
    return (best > 0) | (count >= 4)


def milestone_reached(count: Column, steps: tuple[int, ...] = MILESTONES) -> Column:
    return F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= count)), F.lit(0))


def milestone_crossed(count: Column, announced: Column) -> Column:
    """The largest step reached if it is beyond what was announced, else null."""
    reached = milestone_reached(count)
    return F.when(reached > announced, reached)


def truly_first(dates: Column, window_days: int = 90, need: int = 3) -> Column:
    """Whether at least ``need`` of the dates (ms) lie within window_days of the first, both ends included."""
    first = F.array_min(dates)
    return F.size(F.filter(dates, lambda d: d <= first + window_days * 86_400_000)) >= need


def face_rank(size: Column, score: Column, yaw: Column) -> Column:
    return score * F.least(size, F.lit(200)) * (1 - 0.5 * F.least(yaw, F.lit(1.0)))


def face_yaw(landmarks: Column) -> Column:
    """Offset of the nose (point 3) from the middle of the eyes, along their line, over their distance; 1 if they meet."""
    at = lambda i: F.element_at(landmarks, i + 1).cast("double")
    dx, dy = at(2) - at(0), at(3) - at(1)
    square = dx * dx + dy * dy
    along = (at(4) - (at(0) + at(2)) / 2) * dx + (at(5) - (at(1) + at(3)) / 2) * dy
    return F.when(square > 0, F.abs(along) / square).otherwise(1.0)


def is_good_face(size: Column, score: Column, yaw: Column, sharpness: Column, video: bool = False) -> Column:
    a, b, c, d = GOOD_VIDEO if video else GOOD_PHOTO
    return (size >= a) & (score >= b) & (yaw <= c) & (sharpness >= d)


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area of boxes (l, t, r, b); 0 without area."""
    width = F.greatest(F.lit(0.0), F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]))
    height = F.greatest(F.lit(0.0), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]))
    area = lambda x: (x["r"] - x["l"]) * (x["b"] - x["t"])
    joint = area(a) + area(b) - width * height
    return F.when(joint > 0, width * height / joint).otherwise(0.0)


def frame_times(duration_ms: Column) -> Column:
    """Middles of 3, 5, 8 or 10 equal parts of a video of under 10, 30, 120 seconds or more."""
    n = F.when(duration_ms < 10_000, 3).when(duration_ms < 30_000, 5).when(duration_ms < 120_000, 8).otherwise(10)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(duration_ms * (2 * i + 1) / (2 * n)))


def sample_times(duration_ms: Column, step_ms: int = 2000, most: int = 30) -> Column:
    """Middles of duration / step parts, 3 to ``most`` of them."""
    n = F.least(F.lit(most), F.greatest(F.lit(3), F.floor(duration_ms / step_ms).cast("int")))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(duration_ms * (2 * i + 1) / (2 * n)))


#: The start of the identity hash, and the multipliers and mask of the frame hash.
HASH_START, FRAME_VIDEO, FRAME_TIME, FRAME_MASK = 1125899906842597, 1_000_003, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D


@F.pandas_udf(LongType())
def identity_hash(size: pd.Series, modified: pd.Series, name: pd.Series) -> pd.Series:
    """31 h + x over size, time and the UTF-16 units of the name, wrapping at 64 bits.

    A name of n units adds the sum of its units times 31 ** (n - 1 - place), which all names of a batch share as one sum.
    """
    text = name.tolist()
    units = np.frombuffer("".join(text).encode("utf-16-le"), "<u2").astype(np.uint64)
    n = np.array([len(x.encode("utf-16-le")) // 2 for x in text], np.int64)
    power = np.multiply.accumulate(np.concatenate([[1], np.full(int(n.max(initial=0)), 31)]).astype(np.uint64))
    ends = np.cumsum(n)
    place = np.arange(len(units)) - np.repeat(ends - n, n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(units * power[np.repeat(n, n) - 1 - place], dtype=np.uint64)])
    s, m = (x.to_numpy(np.int64).view(np.uint64) for x in (size, modified))
    head = (np.uint64(HASH_START) * np.uint64(31) + s) * np.uint64(31) + m
    return pd.Series((head * power[n] + total[ends] - total[ends - n]).view(np.int64))


@F.pandas_udf(LongType())
def frame_hash(video: pd.Series, ts_ms: pd.Series) -> pd.Series:
    """What names one frame of a video among all photos."""
    v, t = video.to_numpy(np.int64).view(np.uint64), ts_ms.to_numpy(np.int64).view(np.uint64)
    return pd.Series(((v * np.uint64(FRAME_VIDEO)) ^ (t * np.uint64(FRAME_TIME)) ^ np.uint64(FRAME_MASK)).view(np.int64))


def uri_hash(uri: Column) -> Column:
    """First eight bytes of SHA-256, as a signed big-endian integer."""
    return F.conv(F.substring(F.sha2(uri, 256), 1, 16), 16, -10).cast("long")


def safe_name(text: Column, fallback: str) -> Column:
    """A file name of at most 100 characters without signs that file systems refuse, or dots at its ends."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]', "_")), r"^\.+|\.+$", "")
    return F.coalesce(F.nullif(F.trim(F.left(clean, F.lit(100))), F.lit("")), F.lit(fallback))


def rotated(items: Column, day: Column) -> Column:
    """items from the place that day picks, round to the start; spread by a multiplicative hash."""
    n = F.size(items)
    at = F.pmod(day * 2654435761, n.cast("long")).cast("int")
    return F.when(n > 1, F.concat(F.slice(items, at + 1, n), F.slice(items, 1, at))).otherwise(items)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.lit("pair:"), F.least(a, b), F.lit("-"), F.greatest(a, b))


def joined_names(names: Column) -> Column:
    """A; A and B; A, B and C."""
    n = F.size(names)
    front = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).otherwise(F.concat(front, F.lit(" and "), F.try_element_at(names, F.lit(-1))))


def span_words(months: Column) -> Column:
    """y years m months; months are left out from five years on."""
    y, m = F.floor(months / 12), months % 12
    word = lambda n, w: F.when(n == 1, F.lit(f"1 {w}")).when(n > 1, F.concat(n, F.lit(f" {w}s")))
    return F.coalesce(F.nullif(F.concat_ws(" ", word(y, "year"), F.when(y < 5, word(m, "month"))), F.lit("")), F.lit("0 months"))


def zip_cost(size: Column, path: Column) -> Column:
    """Bytes of an entry in an archive of stored blocks: data, block heads, names and records."""
    return size + 5 * (F.floor(size / 65535) + 1) + 2 * F.octet_length(path) + 200


def zip_estimate(size: Column) -> Column:
    return size + F.floor(size / 13000) + 500
