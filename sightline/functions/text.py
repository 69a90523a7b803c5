"""Identifiers, plates, names and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sightline.policy import PERSON_CLASSES, VEHICLE_CLASSES

DOMAIN_PREFIX = {"person": "P", "vehicle": "V"}
DISPLAY_DASH = "—"
# Column captions and words of the exported event list.
LOG_DOMAIN_WORDS = {"person": "人员", "vehicle": "车辆"}
LOG_EVENT_WORDS = {"recognition": "识别", "recovery": "恢复"}
LOG_CAPTIONS = ["时间", "类别", "目标ID", "事件", "车牌号", "相似度", "来源"]
LOG_TITLE = "目标出现记录"
# Fixed value: name pattern of a recording this system manages.
RECORDING_PATTERN = r"^(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})(?:_(\d+))?\.mp4$"
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]


def choose(key: Column, words: dict[str, str], otherwise: Column | None = None) -> Column:
    expr = None
    for value, word in words.items():
        expr = F.when(key == value, word) if expr is None else expr.when(key == value, word)
    return expr.otherwise(otherwise) if otherwise is not None else expr


def domain_of_class(class_id: Column) -> Column:
    return F.when(class_id.isin(*PERSON_CLASSES), "person").when(
        class_id.isin(*VEHICLE_CLASSES), "vehicle"
    )


def display_id(domain: Column, identity_id: Column) -> Column:
    """``P007`` / ``V012``; at least three digits, more when needed, null below one."""
    digits = identity_id.cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), "0")
    return F.when(identity_id >= 1, F.concat(choose(domain, DOMAIN_PREFIX), padded))


def parse_display_id(text: Column, prefix: str) -> Column:
    """Numeric id of ``P007``, ``p7`` or ``7``; null when malformed or not positive."""
    digits = F.regexp_extract(F.upper(F.trim(text)), rf"^{prefix}?([0-9]+)$", 1)
    number = F.when(digits != "", digits).try_cast("bigint")
    return F.when(number >= 1, number)


def normalize_plate(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(text, r"\s+", "")), F.lit(""))


def recording_time(name: Column) -> Column:
    """Start time of a managed recording; null for any other file or impossible date."""
    stamp = F.regexp_extract(name, RECORDING_PATTERN, 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyy-MM-dd_HH-mm-ss"))


def recording_suffix(name: Column) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(name, RECORDING_PATTERN, 2), F.lit("")).try_cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def usable_fps(fps: Column, fallback: float) -> Column:
    ok = ~F.isnan(fps) & (fps > 0.0) & (fps <= 240.0)
    return F.when(F.coalesce(ok, F.lit(False)), fps).otherwise(F.lit(fallback))


def batch_plan(count: Column, sizes: tuple[int, ...] = (1, 2, 4, 8)) -> Column:
    """Sizes of the model batches for ``count`` crops, largest first."""
    parts, rest = [], count
    for size in sorted(sizes, reverse=True):
        times = F.floor(rest / size).cast("int")
        parts.append(F.array_repeat(F.lit(size), times))
        rest = rest - times * size
    return F.concat(*parts)


def event_time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def track_label(
    selected: Column,
    identity: Column,
    track_id: Column,
    class_name: Column,
    conf: Column,
    show_unselected: bool = True,
    show_conf: bool = False,
) -> Column:
    """Caption drawn next to a track; null when the track is not shown at all."""
    own = F.when(
        identity.isNotNull(), F.format_string("TARGET %s | ID %d", identity, track_id)
    ).otherwise(F.format_string("TARGET | ID %d", track_id))
    other = F.concat_ws(" ", class_name, F.format_string("ID %d", track_id))
    text = F.when(selected, own)
    if show_unselected:
        text = text.otherwise(other)
    if show_conf:
        text = F.when(text.isNotNull(), F.concat(text, F.format_string(" conf=%.2f", conf)))
    return text


def safe_relative_path(name: Column) -> Column:
    """Neither absolute nor climbing out of its folder."""
    climbing = name.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    absolute = name.rlike(r"^([/\\]|[A-Za-z]:)")
    return F.coalesce((name != "") & ~climbing & ~absolute, F.lit(False))


def image_suffix_ok(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1)).isin(*IMAGE_SUFFIXES)
