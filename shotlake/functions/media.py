"""Media time, labels, paths and keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a frame rate that is missing or not positive.
DEFAULT_FPS = 30.0
#: Formats that may be uploaded, largest upload, and formats that need no transcoding.
FORMATS = ("mp4", "mkv", "webm", "avi", "mov")
MAX_BYTES = 500 * 1024 * 1024
READY_FORMATS = ("mp4", "m4v")


def media_ms(frame: Column, fps: Column) -> Column:
    """Truncated milliseconds of a frame."""
    return (frame / fps * 1000).cast("long")


def frame_at(ms: Column, fps: Column) -> Column:
    """Truncated frame number of a time; not the inverse of media_ms."""
    return (ms / 1000 * fps).cast("long")


def interval(fps: Column, target: float, fallback: bool = True) -> Column:
    """Sampling stride: at least 1."""
    used = F.when(fps > 0, fps).otherwise(DEFAULT_FPS) if fallback else fps
    return F.greatest(F.lit(1), F.floor(used / target)).cast("long")


def label_ms(ms: Column) -> Column:
    """MM:SS.mmm, with HH: in front only from an hour on."""
    hours, minutes = F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000)
    seconds, rest = F.floor(ms % 60000 / 1000), ms % 1000
    short = F.format_string("%02d:%02d.%03d", minutes, seconds, rest)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), short)).otherwise(short)


def label_mmss(ms: Column) -> Column:
    """MM:SS; minutes go beyond 59."""
    return F.format_string("%02d:%02d", F.floor(ms / 60000), F.floor(ms % 60000 / 1000))


def extension(name: Column) -> Column:
    """Lower-case suffix of a path's last part, without the dot; empty if it has none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]*)$", 1))


def clean_path(path: Column) -> Column:
    """Without leading slashes and without any '..'."""
    return F.replace(F.regexp_replace(path, "^/+", ""), F.lit(".."), F.lit(""))


def url_part(url: Column, part: str) -> Column:
    """host, port (6379 if missing) or db (0 if missing) of scheme://[user@]host[:port][/db]."""
    rest = r"^[a-z]+://(?:[^@/]*@)?"
    if part == "host":
        return F.coalesce(F.nullif(F.regexp_extract(url, rest + r"([^:/?#]*)", 1), F.lit("")), F.lit("localhost"))
    if part == "port":
        return F.coalesce(F.nullif(F.regexp_extract(url, rest + r"[^:/?#]*:([0-9]+)", 1), F.lit("")).cast("int"), F.lit(6379))
    return F.coalesce(F.nullif(F.regexp_extract(url, rest + r"[^/?#]*/([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))


def codec_name(code: Column) -> Column:
    """Four characters packed into an integer, lowest byte first."""
    return F.concat(*[F.chr(F.shiftright(code, s).bitwiseAND(F.lit(255))) for s in (0, 8, 16, 24)])


def frame_path(index: Column, suffix: str = "jpg") -> Column:
    return F.format_string(f"frame_%06d.{suffix}", index)


def data_url(data: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(data), r"[\r\n]", ""))


def key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def key_part(name: Column, k: int) -> Column:
    """k-th part of a key, from 0."""
    return F.get(F.split(name, ":"), k)


def confidence(distance: Column, threshold: Column) -> Column:
    return F.least(F.lit(1.0), distance / (3 * threshold))


def clip_ms(window: Column, fps: Column) -> Column:
    """Truncated milliseconds of a clip of window frames."""
    return (window / fps * 1000).cast("long")


def clip_stride(window: Column, overlap: Column) -> Column:
    """Frames from one clip's start to the next's: at least 1."""
    return F.greatest(F.lit(1).cast("long"), (window * (1 - overlap)).cast("long"))


def iso(ts: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS of a timestamp without zone, with six digits of fraction if there is any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.extract(F.lit("SECOND"), ts) % 1 == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def from_iso(text: Column) -> Column:
    """A timestamp without zone; null where the text is none."""
    return F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" "))).cast("timestamp_ntz")


def accepted(name: Column, size: Column) -> Column:
    """The size of a file that passes validity(), else an error with the reason and what is allowed."""
    reason = validity(name, size)
    told = F.concat(F.lit("refused: "), reason, F.lit(f"; formats {', '.join(FORMATS)}; at most {MAX_BYTES} bytes, not "), size.cast("string"))
    return F.when(reason.isNull(), size).otherwise(F.raise_error(told).cast("long"))


def validity(name: Column, size: Column, exists: Column | None = None) -> Column:
    """The first failed check of (exists, extension, size), or null."""
    there = F.lit(True) if exists is None else exists
    return (
        F.when(~there, F.lit("missing"))
        .when(~extension(name).isin(*FORMATS), F.lit("format"))
        .when(size > MAX_BYTES, F.lit("size"))
    )


def needs_preprocessing(name: Column, width: Column, height: Column, readable: Column | None = None) -> Column:
    unreadable = F.lit(False) if readable is None else ~readable
    return ~extension(name).isin(*READY_FORMATS) | unreadable | (width > 1920) | (height > 1080)
