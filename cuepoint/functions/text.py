"""Scalar expressions on names, ids and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any kind; none comes after U+3000.
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(_WHITE))


def video_hash(name: Column, size_bytes: Column) -> Column:
    """Key of a video: eight hex digits over its file name and size. Content isn't read, so equal names and sizes collide."""
    return F.substring(F.md5(F.concat_ws("_", name, size_bytes.cast("string")).cast("binary")), 1, 8)


def frame_id(video: Column, frame_idx: Column) -> Column:
    return F.format_string("%s_frame_%06d", video, frame_idx)


def chunk_id(video: Column, number: Column) -> Column:
    return F.format_string("%s_chunk_%04d", video, number)


def frame_file(frame_idx: Column, timestamp: Column) -> Column:
    return F.format_string("frame_%06d_t%.2f.jpg", frame_idx, timestamp)


def minutes_clock(seconds: Column) -> Column:
    """``MM:SS``; minutes run on past 59."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)))


def hours_clock(seconds: Column) -> Column:
    """``H:MM:SS`` from one hour on, else ``MM:SS``."""
    whole = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600).cast("long"), F.pmod(F.floor(whole / 60), F.lit(60)).cast("long"), F.pmod(whole, F.lit(60))
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))


def clock_seconds(text: Column) -> Column:
    """Whole seconds of ``MM:SS`` or ``H:MM:SS``."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("int"))
    return F.aggregate(parts, F.lit(0), lambda total, p: total * 60 + p)


def parse_times(text: Column) -> Column:
    """Seconds, to one digit, of a comma list of ``SS``, ``MM:SS`` and ``H:MM:SS``.

    The last part may have a fraction. Blank, unreadable and longer entries are skipped, with and
    without colons alike.
    """

    def entry(item: Column) -> Column:
        parts = F.transform(F.split(item, ":"), lambda p: strip(p))
        whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
        units = F.transform(whole, lambda p: p.try_cast("int").cast("double"))
        last = F.element_at(parts, -1).try_cast("double")
        value = F.aggregate(units, F.lit(0.0), lambda total, p: total * 60 + p) * 60 + last
        return F.when(F.size(parts) <= 3, F.round(value, 1))

    items = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    return F.filter(F.transform(items, entry), lambda v: v.isNotNull() & ~F.isnan(v))


def display_name(custom: Column, name: Column) -> Column:
    """The custom name if it isn't empty, else the file's; an empty file name stays empty."""
    return F.coalesce(F.nullif(custom, F.lit("")), name, F.lit("Untitled"))


def clipped(text: Column, chars: int) -> Column:
    return F.concat(F.substring(text, 1, chars), F.when(F.length(text) > chars, "...").otherwise(""))


def context_line(seconds: Column, text: Column) -> Column:
    return F.concat(F.lit("["), minutes_clock(seconds), F.lit("] "), text)


def reduction_pct(dropped: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * dropped / total, 2)).otherwise(0.0)


def static_url(path: Column) -> Column:
    return F.concat(F.lit("app/static/videos/"), F.element_at(F.split(path, "/"), -1))


def shown_pct(pct: Column) -> Column:
    """Unknown (negative) as N/A."""
    return F.when(pct < 0, "N/A").otherwise(F.format_string("%.0f%%", pct))
