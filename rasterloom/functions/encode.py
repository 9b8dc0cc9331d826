"""Column functions of pixel values: 24-bit codes, colour channels, and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_M, STEP_M = -10_000.0, 0.1
MAX_CODE = 256**3 - 1


def pack24(value: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue bytes of a number, rounded half to even and held within 24 bits."""
    v = F.least(F.greatest(F.rint(value), F.lit(0.0)), F.lit(float(MAX_CODE))).cast("long")
    byte = lambda n: F.shiftright(v, n).bitwiseAND(F.lit(255)).cast("int")
    return byte(16), byte(8), byte(0)


def unpack24(r: Column, g: Column, b: Column) -> Column:
    return r.cast("long") * 65_536 + g.cast("long") * 256 + b.cast("long")


def finite(v: Column) -> Column:
    """The value, or null where it is not a finite number."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def encode_terrain_rgb(height: Column) -> tuple[Column, Column, Column]:
    """Elevation in steps of 0.1 m from -10000 m; null and non-finite values sit at the base."""
    return pack24((F.coalesce(finite(height), F.lit(BASE_M)) - BASE_M) / STEP_M)


def decode_terrain_rgb(r: Column, g: Column, b: Column) -> Column:
    return BASE_M + unpack24(r, g, b) * STEP_M


def widened(vmin: Column, vmax: Column) -> Column:
    """The upper end of a range, 1 above the lower one where the range is empty."""
    return F.when(vmax - vmin < 1e-12, vmin + 1.0).otherwise(vmax)


def encode_linear(v: Column, vmin: Column, vmax: Column) -> tuple[Column, Column, Column]:
    top = widened(vmin, vmax)
    return pack24((F.coalesce(finite(v), vmin) - vmin) / (top - vmin) * MAX_CODE)


def decode_linear(r: Column, g: Column, b: Column, vmin: Column, vmax: Column) -> Column:
    return vmin + unpack24(r, g, b) / F.lit(float(MAX_CODE)) * (vmax - vmin)


def encode_linear_bits(v: Column, vmin: Column, vmax: Column, bits: int = 24) -> tuple[Column, Column, Column]:
    """A linear code of which only the top ``bits`` (1 to 24) are used."""
    bits = max(1, min(24, int(bits)))
    span = F.greatest(vmax - vmin, F.lit(1e-12))
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(finite(v), vmin) - vmin) / span))
    return pack24(F.rint(norm * ((1 << bits) - 1)) * (1 << (24 - bits)))


def linear_step(vmin: Column, vmax: Column, bits: int = 24) -> Column:
    return (vmax - vmin) / ((1 << max(1, min(24, int(bits)))) - 1)


def linear_range_for_bits(vmin: Column, vmax: Column, bits: int = 24) -> tuple[Column, Column]:
    """The range to record so that the plain decoder reads a ``bits`` code exactly."""
    bits = max(1, min(24, int(bits)))
    top = ((1 << bits) - 1) << (24 - bits)
    return vmin, vmin + (vmax - vmin) * (MAX_CODE / top)


def spectral_channels(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Luminance, saturation, excess green and excess blue of 0..255 bands."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    total = F.greatest(r + g + b, F.lit(1e-6))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    return {
        "lum": 0.299 * r + 0.587 * g + 0.114 * b,
        "sat": (most - least) / F.greatest(most, F.lit(1e-6)),
        "exg": (2 * g - r - b) / total,
        "exb": (2 * b - r - g) / total,
    }


def huber_weight(residual: Column, delta: float) -> Column:
    return F.least(F.lit(1.0), delta / F.greatest(F.abs(residual), F.lit(1e-9)))


def blend_weight(row: Column, col: Column, chip: int, ramp: int) -> Column:
    """Flat-top raised cosine of a chip's pixel, at least 0.001; the ramp is at most half the chip."""
    ramp = max(1, min(ramp, chip // 2))

    def side(at: Column) -> Column:
        edge = F.least(at, chip - 1 - at)
        return F.when(edge < ramp, 0.5 - 0.5 * F.cos(F.pi() * (edge + 0.5) / ramp)).otherwise(F.lit(1.0))

    return F.greatest(side(row) * side(col), F.lit(1e-3))


def combine_sigma(*sigmas: Column) -> Column:
    """Quadrature sum of independent one-sigma values; nulls are left out."""
    total = F.lit(0.0)
    for s in sigmas:
        total = total + F.coalesce(s * s, F.lit(0.0))
    return F.sqrt(total)


def choose_stride(h: Column, w: Column, most: int = 350_000) -> Column:
    """The smallest stride of 1 to 16 whose two triangles a cell stay within ``most``, else 16."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(16)), lambda s: 2 * F.floor((h - 1) / s) * F.floor((w - 1) / s) <= most)
    return F.coalesce(F.get(fits, 0), F.lit(16))
