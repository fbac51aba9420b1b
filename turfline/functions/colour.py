"""Colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_bgr(code: Column) -> Column:
    """'#rrggbb' or 'rrggbb' as a struct of b, g, r."""
    digits = F.regexp_replace(code, "^#", "")
    part = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
    return F.struct(part(5).alias("b"), part(3).alias("g"), part(1).alias("r"))


def lab_to_bgr(lightness: Column, a: Column, b: Column) -> Column:
    """8-bit scaled CIELAB (D65) as a struct of b, g, r of 0 to 255."""
    clip = lambda c: F.least(F.greatest(F.bround(c), F.lit(0.0)), F.lit(255.0))
    fy = (clip(lightness) * 100 / 255 + 16) / 116
    fx, fz = fy + (clip(a) - 128) / 500, fy - (clip(b) - 128) / 200
    cube = lambda t: F.when(t > 6 / 29, t * t * t).otherwise((t - 4 / 29) * 3 * (6 / 29) ** 2)
    x, y, z = cube(fx) * 0.950456, cube(fy), cube(fz) * 1.088754
    linear = {
        "b": x * 0.055648 - y * 0.204043 + z * 1.057311,
        "g": x * -0.969256 + y * 1.875991 + z * 0.041556,
        "r": x * 3.240479 - y * 1.537150 - z * 0.498535,
    }
    gamma = lambda c: F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
    level = lambda c: F.least(F.greatest(F.bround(gamma(c) * 255), F.lit(0.0)), F.lit(255.0)).cast("int")
    return F.struct(*[level(c).alias(k) for k, c in linear.items()])


def ink_on(b: Column, g: Column, r: Column) -> Column:
    """Black text on light grounds, white on others."""
    return F.when(b * 0.114 + g * 0.587 + r * 0.299 > 150, F.lit("black")).otherwise(F.lit("white"))
