"""Shape rules for label texts: predicates, ids, paths, display forms and small decision rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual forms of the fields.
PRODUCT = r"^[A-Za-z0-9]{3,9}$"
SIZE = r"^[A-Z0-9/-]{1,7}$"
COLOR = r"^[A-Za-z /]{3,}$"
POSITION_QUANTITY = r"^(\d+)\s*/\s*(\d+)$"
# Characters as which the slash between position and quantity is misread.
MISREAD_SLASH = "1|lI!tij7"


def is_product(text: Column) -> Column:
    return text.rlike(PRODUCT)


def is_size(text: Column) -> Column:
    return text.rlike(SIZE)


def is_color(text: Column) -> Column:
    return text.rlike(COLOR)


def is_position_quantity(text: Column) -> Column:
    return text.rlike(POSITION_QUANTITY)


def frame_id(ts: Column, prefix: str = "frame_") -> Column:
    """``frame_YYYYMMDD_HHMMSS_mmm`` of a capture time, milliseconds cut."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd_HHmmss_SSS"))


def path_id(path: Column) -> Column:
    """Id of a file below its root: suffix dropped, separators to ``_``. Different paths can share an id."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./\\]+$", ""), r"[/\\]", "_")


def landscape_shape(width: Column, height: Column) -> Column:
    """Shape after turning an upright image on its side (only if strictly higher than wide)."""
    turn = height > width
    return F.struct(F.when(turn, height).otherwise(width).alias("width"), F.when(turn, width).otherwise(height).alias("height"), turn.alias("turned"))


def needs_half_turn(label: Column, score: Column, threshold: float = 0.6) -> Column:
    """Whether an orientation label calls for a turn by 180 degrees: it names 180 and its score is above the threshold."""
    return F.coalesce(F.contains(label, F.lit("180")) & (score > threshold), F.lit(False))


def step_message(*steps: Column) -> Column:
    """The messages of the steps that had one, joined by `` | ``."""
    return F.concat_ws(" | ", *steps)


def scale_factor(width: Column, target: int) -> Column:
    """Factor that brings ``width`` to ``target``; exactly 1 where it would change less than a hundredth. Null for width 0."""
    f = F.lit(target) / F.nullif(width, F.lit(0))
    return F.when(F.abs(f - 1) < 0.01, F.lit(1.0)).otherwise(f)


def detection_label(class_name: Column, confidence: Column) -> Column:
    return F.format_string("%s: %.2f", class_name, confidence)


def palette_index(i: Column, n: int) -> Column:
    return F.pmod(i, F.lit(n))


def or_dashes(value: Column) -> Column:
    """The value as text, ``--`` where it is null, empty or zero."""
    text = value.cast("string")
    return F.coalesce(F.nullif(F.nullif(text, F.lit("")), F.lit("0")), F.lit("--"))


def order_display(order_type: Column, number: Column) -> Column:
    """``type-number`` if both are there, else ``--``."""
    there = (F.coalesce(order_type, F.lit("")) != "") & (F.coalesce(number, F.lit("")) != "")
    return F.when(there, F.concat_ws("-", order_type, number)).otherwise("--")


def validity_display(valid: Column) -> Column:
    return F.when(F.coalesce(valid, F.lit(False)), "VALID").otherwise("INVALID")


def stage_key(name: Column) -> Column:
    """Short key of a stage: capitals up to the first underscore."""
    return F.upper(F.split_part(name, F.lit("_"), F.lit(1)))


def fit_scale(width: Column, height: Column, view_width: int, view_height: int) -> Column:
    """``scale, width, height`` of an image fitted into a view without enlarging it; whole sizes cut."""
    s = F.least(F.lit(view_width) / width, F.lit(view_height) / height, F.lit(1.0))
    return F.struct(s.alias("scale"), (width * s).cast("int").alias("width"), (height * s).cast("int").alias("height"))


def frames_a_second(ms: Column) -> Column:
    """``1000 / ms`` to two places, 0 for none or no time."""
    return F.when(ms > 0, F.round(1000 / ms, 2)).otherwise(F.lit(0.0))


def capture_name(ts: Column) -> Column:
    """File name of a capture on demand: ``capture_YYYYMMDD_HHMMSS_ffffff.png``."""
    return F.concat(F.lit("capture_"), F.date_format(ts, "yyyyMMdd_HHmmss_SSSSSS"), F.lit(".png"))


def input_image_name(frame: Column, mode: Column) -> Column:
    """File name of a code reader's input: frame and mode, ``raw`` without a preprocessor (a null mode)."""
    return F.concat(frame, F.lit("_"), F.coalesce(mode, F.lit("raw")), F.lit(".png"))
