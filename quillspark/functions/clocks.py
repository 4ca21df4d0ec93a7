"""Timecodes, frames, dates in names and zones, offsets, freshness, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TIMECODE = r"^\s*(\d{1,2}):(\d{2}):(\d{2})[:;](\d{2})\s*$"
NAME_DATE = r"(?<!\d)((?:19|20)\d{2}([-_.]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01]))(?:[-_ T.]?(?:[01]\d|2[0-3])[-_.:h]?[0-5]\d[-_.:m]?[0-5]\d)?(?!\d)"
OFFSET = r"^\s*([+-])(\d{2}):?(\d{2})\s*$"
AGREEMENT_S = 30
UTC_OFFSETS = (
    -720, -660, -600, -570, -540, -480, -420, -360, -300, -240, -210, -180, -150, -120, -60, 0,
    60, 120, 180, 210, 240, 270, 300, 330, 345, 360, 390, 420, 480, 525, 540, 570, 600, 630,
    660, 720, 765, 780, 825, 840,
)
PROVISIONAL_H, SETTLED_D = 48, 7
MONTHS = {
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
}


def nominal(fps: float) -> int:
    return round(fps)


def drops(fps: float) -> int:
    """Frame numbers left out each minute but every tenth at 29.97 and 59.94 frames a second; none at others."""
    return 2 * round(fps / 30) if any(abs(fps - r) < 0.01 for r in (30000 / 1001, 60000 / 1001)) else 0


def timecode_frames(code: Column, fps: float) -> Column:
    """Frames from 00:00:00:00; null where it is no timecode or the frame number is out of range. A semicolon marks drop-frame."""
    part = lambda i: F.regexp_extract(code, TIMECODE, i).cast("long")
    h, m, s, f = (part(i) for i in (1, 2, 3, 4))
    minutes = h * 60 + m
    count = (minutes * 60 + s) * nominal(fps) + f
    if drops(fps):
        count = count - F.when(F.contains(code, F.lit(";")), (minutes - F.floor(minutes / 10)) * drops(fps)).otherwise(F.lit(0))
    return F.when(code.rlike(TIMECODE) & (f < nominal(fps)), count)


def timecode_seconds(code: Column, fps: float) -> Column:
    """Seconds of a timecode at the nominal rate; null where it is none."""
    part = lambda i: F.regexp_extract(code, TIMECODE, i).cast("long")
    return F.when(code.rlike(TIMECODE) & (part(4) < nominal(fps)), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / F.lit(float(nominal(fps))))


def frames_timecode(frames: Column, fps: float, drop_frame: bool = False) -> Column:
    """HH:MM:SS:FF of a frame count, wrapped at 24 hours; with a semicolon where frame numbers are dropped."""
    n, skipped = nominal(fps), drops(fps) if drop_frame else 0
    if skipped:
        ten, minute = n * 600 - skipped * 9, n * 60 - skipped
        frames = F.pmod(frames, F.lit(ten * 144))
        rest = frames % ten
        frames = frames + F.floor(frames / ten) * (skipped * 9) + F.when(rest > skipped, F.floor((rest - skipped) / minute) * skipped).otherwise(F.lit(0))
    total = F.pmod(frames, F.lit(24 * 3600 * n))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(total / (3600 * n))), F.lit(":"), two(F.floor(total / (60 * n)) % 60), F.lit(":"), two(F.floor(total / n) % 60), F.lit(";" if skipped else ":"), two(total % n))


def frame_at(seconds: Column, fps: float) -> Column:
    """The frame shown at a time."""
    return F.greatest(F.lit(0), F.floor(seconds * fps + 1e-6)).cast("long")


def short_clock(seconds: Column) -> Column:
    """MM:SS, with hours where there are some; null below zero."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    base = F.concat(two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    return F.when(seconds >= 0, F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), base)).otherwise(base))


def spoken_date(day: Column, language: str) -> Column:
    """Day, month and year in words; the first of a month is '1er' in French."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS[language]]), F.month(day))
    number = F.dayofmonth(day)
    d = F.when((number == 1) & F.lit(language == "fr"), "1er").otherwise(number.cast("string"))
    return F.concat_ws(" ", d, month, F.year(day).cast("string"))


def name_date(name: Column) -> Column:
    """The first valid date in a file name."""
    found = F.regexp_extract_all(name, F.lit(NAME_DATE), 1)
    days = F.transform(found, lambda x: F.try_to_date(F.regexp_replace(x, "[^0-9]", ""), "yyyyMMdd"))
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def offset_minutes(value: Column) -> Column:
    """Minutes of '+0200' or '-03:30', for offsets that are in use only."""
    minutes = F.regexp_extract(value, OFFSET, 2).cast("int") * 60 + F.regexp_extract(value, OFFSET, 3).cast("int")
    signed = F.when(F.regexp_extract(value, OFFSET, 1) == "-", -minutes).otherwise(minutes)
    return F.when(value.rlike(OFFSET) & signed.isin(list(UTC_OFFSETS)), signed)


def inferred_offset(local_s: Column, utc_s: Column) -> Column:
    """The offset that a wall clock and an instant of the same moment imply: on a grid of 15 minutes, within AGREEMENT_S of it."""
    delta = local_s - utc_s
    quarters = F.bround(delta / 900.0).cast("long")
    minutes = quarters * 15
    return F.when((F.abs(delta - quarters * 900) <= AGREEMENT_S) & minutes.isin(list(UTC_OFFSETS)), minutes)


def capture_date(at: Column, zone: Column, offset: Column) -> Column:
    """The local date of an instant (a timestamp in a UTC session): by the zone, else by the offset in minutes, else in UTC."""
    return F.to_date(F.coalesce(F.from_utc_timestamp(at, zone), at + F.make_dt_interval(mins=offset), at))


def freshness(at_s: Column, now_s: Column, provisional_h: int = PROVISIONAL_H, settled_d: int = SETTLED_D) -> Column:
    """future, provisional, recent or settled."""
    age = now_s - at_s
    return F.when(age < -3600, "future").when(age < provisional_h * 3600, "provisional").when(age < settled_d * 86400, "recent").otherwise("settled")
