"""Map fills: a continuous Lab ramp for contests and a step scale for district overlays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import as_col, named

# Ramp stops per party or primary rank, from a near tie to a landslide.
RAMPS = {
    "REP": ["#fff5f0", "#fee0d2", "#fcbba1", "#fc9272", "#fb6a4a", "#ef3b2c", "#cb181d", "#99000d"],
    "DEM": ["#f7fbff", "#deebf7", "#c6dbef", "#9ecae1", "#6baed6", "#4292c6", "#2171b5", "#084594"],
    "IND1": ["#fcfbfd", "#dadaeb", "#bcbddc", "#9e9ac8", "#807dba", "#6a51a3", "#54278f"],
    "IND2": ["#fff5eb", "#fdd0a2", "#fdae6b", "#fd8d3c", "#f16913", "#d94801", "#8c2d04"],
    "IND3": ["#f7fcf5", "#c7e9c0", "#a1d99b", "#74c476", "#41ab5d", "#238b45", "#005a32"],
    "IND4": ["#f7f4f9", "#d4b9da", "#c994c7", "#df65b0", "#e7298a", "#ce1256", "#91003f"],
}
NO_PARTY_FILL = "#f0f0f0"
RAMP_LOW, RAMP_HIGH = 0.5, 0.85

# Step scale as (party, comparison, share, fill), first hit wins. The second
# primary rank starts with "<" where every other scale starts with ">".
STEPS = [
    ("REP", ">", 0.8, "#99000d"),
    ("REP", ">", 0.75, "#cb181d"),
    ("REP", ">", 0.7, "#ef3b2c"),
    ("REP", ">", 0.65, "#fb6a4a"),
    ("REP", ">", 0.6, "#fc9272"),
    ("REP", ">", 0.55, "#fcbba1"),
    ("REP", ">", 0.5, "#fee0d2"),
    ("REP", "", None, "#fff5f0"),
    ("DEM", ">", 0.8, "#084594"),
    ("DEM", ">", 0.75, "#2171b5"),
    ("DEM", ">", 0.7, "#4292c6"),
    ("DEM", ">", 0.65, "#6baed6"),
    ("DEM", ">", 0.6, "#9ecae1"),
    ("DEM", ">", 0.55, "#c6dbef"),
    ("DEM", ">", 0.5, "#deebf7"),
    ("DEM", "", None, "#f7fbff"),
    ("IND1", ">", 0.8, "#6a51a3"),
    ("IND1", ">", 0.65, "#9e9ac8"),
    ("IND1", ">", 0.5, "#cbc9e2"),
    ("IND1", "<", 0.5, "#f2f0f7"),
    ("IND2", "<", 0.8, "#d94701"),
    ("IND2", ">", 0.65, "#fd8d3c"),
    ("IND2", ">", 0.5, "#fdbe85"),
    ("IND2", "<", 0.5, "#feedde"),
    ("IND3", ">", 0.8, "#238b45"),
    ("IND3", ">", 0.65, "#74c476"),
    ("IND3", ">", 0.5, "#bae4b3"),
    ("IND3", "<", 0.5, "#edf8e9"),
    ("IND4", ">", 0.8, "#ce1256"),
    ("IND4", ">", 0.65, "#df65b0"),
    ("IND4", ">", 0.5, "#d7b5d8"),
    ("IND4", "<", 0.5, "#f1eef6"),
]
STEP_DEFAULT = "white"

# Sequential yellow-green-blue scale by number of classes, and the fill of a place without a value.
BIN_FILLS = {
    3: ["#edf8b1", "#7fcdbb", "#2c7fb8"],
    4: ["#ffffcc", "#a1dab4", "#41b6c4", "#225ea8"],
    5: ["#ffffcc", "#a1dab4", "#41b6c4", "#2c7fb8", "#253494"],
}
NO_VALUE_FILL = "#808080"

# sRGB (D65) to XYZ and back, and the D65 white point.
RGB_TO_XYZ = [
    [0.4124564, 0.3575761, 0.1804375],
    [0.2126729, 0.7151522, 0.0721750],
    [0.0193339, 0.1191920, 0.9503041],
]
XYZ_TO_RGB = [
    [3.2404542, -1.5371385, -0.4985314],
    [-0.9692660, 1.8760108, 0.0415560],
    [0.0556434, -0.2040259, 1.0572252],
]
WHITE = [0.95047, 1.0, 1.08883]
LAB_EPSILON, LAB_KAPPA = 216 / 24389, 24389 / 27


def lab_of(hex_color: str) -> list[float]:
    """CIE Lab coordinates of one fixed ramp stop (runs once per stop while the plan is built)."""
    channels = [int(hex_color[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    linear = [c / 12.92 if c < 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in channels]
    scaled = [sum(m * c for m, c in zip(row, linear)) / w for row, w in zip(RGB_TO_XYZ, WHITE)]
    fx, fy, fz = (s ** (1 / 3) if s > LAB_EPSILON else (LAB_KAPPA * s + 16) / 116 for s in scaled)
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]


def ramp_position(share: Column | str) -> Column:
    """Where a winning share sits on the ramp: 0 at a half or less, 1 at 85 % or more."""
    t = (as_col(share) - RAMP_LOW) / (RAMP_HIGH - RAMP_LOW)
    return F.greatest(F.least(F.coalesce(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def _stops(winner: Column) -> Column:
    """Lab stops of the winner's ramp, from a constant map."""
    pairs = []
    for party, ramp in RAMPS.items():
        stops = [F.struct(*[F.lit(v).alias(n) for n, v in zip("lab", lab_of(stop))]) for stop in ramp]
        pairs += [F.lit(party), F.array(*stops)]
    return F.try_element_at(F.create_map(*pairs), winner)


def _from_lab_axis(f: Column) -> Column:
    cube = f * f * f
    return F.when(cube > LAB_EPSILON, cube).otherwise((f * 116 - 16) / LAB_KAPPA)


def _channel_hex(linear: Column) -> Column:
    gamma = F.when(linear <= 0.0031308, linear * 12.92).otherwise(
        F.pow(F.greatest(linear, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055
    )
    level = F.floor(F.greatest(F.least(gamma, F.lit(1.0)), F.lit(0.0)) * 255 + 0.5)
    return F.lpad(F.lower(F.hex(level)), 2, "0")


def ramp_fill(winner: Column | str, share: Column | str) -> Column:
    """Hex fill for a winner and its share, blended between ramp stops in Lab space."""
    winner = as_col(winner)

    def place(r: Column) -> Column:
        at = r["t"] * (F.size(r["stops"]) - 1)
        low = F.least(F.floor(at), F.size(r["stops"]).cast("bigint") - 2).cast("int")
        left, right = F.get(r["stops"], low), F.get(r["stops"], low + 1)
        return F.struct(left.alias("left"), right.alias("right"), (at - low).alias("part"))

    def blend(r: Column) -> Column:
        mixed = [(r["left"][n] + (r["right"][n] - r["left"][n]) * r["part"]).alias(n) for n in "lab"]
        return F.struct(*mixed)

    def to_xyz(r: Column) -> Column:
        fy = (r["l"] + 16) / 116
        axes = [fy + r["a"] / 500, fy, fy - r["b"] / 200]
        return F.struct(*[(_from_lab_axis(f) * w).alias(n) for n, f, w in zip("xyz", axes, WHITE)])

    def to_rgb(r: Column) -> Column:
        mixed = [r["x"] * row[0] + r["y"] * row[1] + r["z"] * row[2] for row in XYZ_TO_RGB]
        return F.struct(*[m.alias(n) for n, m in zip("rgb", mixed)])

    value = F.struct(_stops(winner).alias("stops"), ramp_position(share).alias("t"))
    for step in (place, blend, to_xyz, to_rgb):
        value = named(value, step)
    fill = named(value, lambda r: F.concat(F.lit("#"), *[_channel_hex(r[n]) for n in "rgb"]))
    return F.when(winner.isin(*RAMPS), fill).otherwise(NO_PARTY_FILL)


def step_fill(winner: Column | str, share: Column | str) -> Column:
    winner, share = as_col(winner), as_col(share)
    fill = None
    for party, sign, limit, color in STEPS:
        hit = winner == party
        if sign:
            hit = hit & (share > limit if sign == ">" else share < limit)
        fill = F.when(hit, color) if fill is None else fill.when(hit, color)
    return fill.otherwise(STEP_DEFAULT)


def bin_fill(bin_: Column, bins: Column) -> Column:
    """Fill of a 1-based bin among ``bins`` classes (3 to 5; fewer take the three-class scale); grey for no bin."""
    scale = None
    for n, fills in sorted(BIN_FILLS.items(), reverse=True):
        stops = F.array(*[F.lit(f) for f in fills])
        scale = stops if scale is None else F.when(bins <= n, stops).otherwise(scale)
    return F.coalesce(F.get(scale, (bin_ - 1).cast("int")), F.lit(NO_VALUE_FILL))
