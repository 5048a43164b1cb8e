"""Validators of written forms, as Spark expressions and as the same rules for use inside an Arrow function."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of valid forms. Only ASCII digits are digits.
SHAPES = {
    "HEADING": r"([0-2][0-9]{2}|3[0-5][0-9])°", "BEARING": r"([0-2][0-9]{2}|3[0-5][0-9])°", "MMSI_ID": r"[0-9]{9}", "IMO_ID": r"([^0-9]*[0-9]){7}[^0-9]*",
    "TELEPHONE": r"0[0-9]{9,10}|\+[0-9]{2}( [0-9]{1,3}){2,4}|1[89]00 [0-9]{4,6}", "PORT_CODE": r"[A-Z]{5}",
    "VEHICLE_PLATE": r"[0-9]{2}[A-Z]{1,2}-([0-9]{3}\.[0-9]{2}|[0-9]{4,5})",
    **{k: r"-?[0-9.]+(,[0-9]+)? ?°?[A-Za-zµ°²³/%]+" for k in ("MEASURE", "SPEED", "DISTANCE", "DEPTH", "DRAFT", "FREQUENCY")},
}
ANGLE = r"([0-9]+)°(?:([0-9]{2})(\.[0-9]{1,3})?[′'])?(?:([0-9]{2})[″\"])?([NSEW])"
VALIDATED = {"COORD", *SHAPES}


def _angle_ok(part: str) -> bool:
    m = re.fullmatch(ANGLE, part.strip())
    return bool(m) and int(m[1]) <= (90 if m[5] in "NS" else 180) and int(m[2] or 0) < 60 and int(m[4] or 0) < 60


def valid(kind: str, text: str | None) -> bool:
    """A type without a validator accepts everything."""
    if kind not in VALIDATED:
        return True
    if not text:
        return False
    return all(map(_angle_ok, text.split(","))) if kind == "COORD" else re.fullmatch(SHAPES[kind], text) is not None


def valid_column(kind: Column, text: Column) -> Column:
    """The same on columns."""
    text = F.coalesce(text, F.lit(""))

    def angle(p: Column) -> Column:
        p = F.trim(p)
        part = lambda i: F.coalesce(F.regexp_extract(p, f"^{ANGLE}$", i).try_cast("int"), F.lit(0))
        most = F.when(F.regexp_extract(p, f"^{ANGLE}$", 5).isin("N", "S"), 90).otherwise(180)
        return p.rlike(f"^{ANGLE}$") & (part(1) <= most) & (part(2) < 60) & (part(4) < 60)

    out = F.when(kind == "COORD", F.forall(F.split(text, ","), angle))
    for k, shape in SHAPES.items():
        out = out.when(kind == k, text.rlike(f"^(?:{shape})$"))
    return out.otherwise(F.lit(True))
