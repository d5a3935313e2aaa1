"""The noise-tolerant form of printed order codes ``MMDDYY-FF-T-N...-P[/R]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.runtime import BLANK, let

# Characters that recognition confuses, by what must stand at a place.
_TO_DIGIT = ("OQDIL|ZSBG", "0001112586")
_TO_LETTER = ("012568|", "OIZSGBI")
# What scanners put before the payload: a name with a colon, or a symbology identifier such as "]C1".
_PREFIX = r"^\W*(?:[A-Za-z .]{1,12}[:=#]|\][A-Za-z]\d)\s*"


def canonical_code(code: Column, order_digits: int = 8) -> Column:
    """The printed code that a noisy reading stands for: ``STRUCT<value STRING, complete BOOLEAN>``.

    Case, blanks, separators, stray marks, scanner prefixes and confused characters are undone by place: six digits, three
    letters, ``order_digits`` digits, the position, and after ``/`` the revision (left out if 0, as in print). ``complete`` is
    false for a reading that lost its end; its value is then the printed prefix that is left. Null for null and blank
    readings. ASCII only: a letter of another alphabet counts as a stray mark.
    """
    digit = lambda c: F.translate(c, *_TO_DIGIT)
    letter = lambda c: F.translate(c, *_TO_LETTER)
    unpadded = lambda c: F.regexp_replace(digit(c), r"^0+(?=\d)", "")

    def parts(up: Column) -> Column:
        body = F.substring_index(up, "/", 1)
        pieces = [
            digit(F.substring(body, 1, 6)),
            letter(F.substring(body, 7, 2)),
            letter(F.substring(body, 9, 1)),
            digit(F.substring(body, 10, order_digits)),
            unpadded(F.substr(body, F.lit(10 + order_digits))),
        ]
        head = F.array_join(F.filter(F.array(*pieces), lambda x: x != ""), "-")
        return F.concat(head, F.when(F.instr(up, "/") > 0, F.concat(F.lit("/"), unpadded(F.substring_index(up, "/", -1)))).otherwise(""))

    whole = rf"^\d{{6}}-[A-Z]{{2}}-[A-Z]-\d{{{order_digits}}}-\d+(/\d+)?$"
    up = F.regexp_replace(F.upper(F.regexp_replace(code, _PREFIX, "")), r"[^A-Z0-9|/]", "")
    result = let(let(up, parts), lambda v: F.struct(F.regexp_replace(v, "/0?$", "").alias("value"), v.rlike(whole).alias("complete")))
    return F.when(~(code.isNull() | code.rlike(BLANK)), result)
