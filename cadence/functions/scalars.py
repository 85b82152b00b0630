"""Scalar column functions. Nulls give nulls unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper bounds (exclusive) of star ratings and their labels.
DIFFICULTY_LABELS = [(2.5, "Easy"), (3.5, "Normal"), (4.5, "Hard"), (5.5, "Insane")]


_GAP = r"[\s\x1c-\x1f]"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def slug(text: Column, longest: int = 180) -> Column:
    """Trimmed, in compatibility-composed form (NFKC, which only Python has), without characters that file systems
    forbid, white space squeezed, cut to `longest` characters."""
    kept = F.regexp_replace(_composed(F.regexp_replace(text, f"(?U)^{_GAP}+|{_GAP}+$", "")), r'[<>:"/\\|?*\x00-\x19]', "")
    return F.substring(F.regexp_replace(kept, f"(?U){_GAP}{{2,}}", " "), 1, longest)


def file_name(artist: Column, title: Column, creator: Column, label: Column, extension: str) -> Column:
    return slug(F.concat(F.format_string("%s - %s (%s) [%s]", artist, title, creator, label), F.lit(extension)))


def first_given(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def padded(number: Column, width: int = 5) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def difficulty_label(stars: Column) -> Column:
    found = F.when(stars.isNull(), F.lit(None))
    for bound, label in DIFFICULTY_LABELS:
        found = found.when(stars < bound, F.lit(label))
    return found.otherwise(F.lit("Expert"))


def hue(value: Column, low: Column, high: Column, lower_is_better: bool = False) -> Column:
    """0 (worst) to 120 (best); 120 if all values are the same."""
    place = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce((F.lit(1.0) - place if lower_is_better else place) * 120, F.when(value.isNotNull(), F.lit(120.0)))


def hsl(hue_: Column) -> Column:
    return F.format_string("hsl(%d, 70%%, 60%%)", F.bround(hue_, 0).cast("int"))


def interpolated(x: Column, first: float, step: float, values: Column) -> Column:
    """Piecewise linear through values at first, first + step, ...; constant beyond both ends."""
    last = F.size(values) - 1
    at = F.least(F.greatest((x - first) / step, F.lit(0.0)), last.cast("double"))
    i = F.least(F.floor(at).cast("int"), last - 1)
    a, b = F.get(values, i), F.get(values, i + 1)
    return a + (b - a) * (at - i)


def sped(time: Column, speed: Column | float) -> Column:
    """Times divided by a speed, cut to whole milliseconds."""
    return (time / speed).cast("long")


def ratio_step(ratio: Column, resolution: int) -> Column:
    """-1 up to 0, resolution + 1 from 1 on, between them the nearest step, halves to even."""
    step = F.bround(ratio * resolution, 0).cast("int")
    return F.when(ratio <= 0, F.lit(-1)).when(ratio >= 1, F.lit(resolution + 1)).otherwise(step)


def bucket(value: Column, classes: int, highest: float) -> Column:
    """Whole part of value * classes / highest, within 0 and classes - 1."""
    return F.least(F.greatest((value * classes / highest).cast("int"), F.lit(0)), F.lit(classes - 1))


def bucket_with_unknown(value: Column, classes: int, highest: float) -> Column:
    """As bucket() over classes - 2 steps, where classes - 1 is kept for unknown (null) values."""
    step = F.least(F.greatest((value * (classes - 2) / highest).cast("int"), F.lit(0)), F.lit(classes - 2))
    return F.coalesce(step, F.lit(classes - 1))


def length_bucket(ms: Column) -> Column:
    """Ten-second steps, at most 60."""
    return F.least(F.greatest(F.floor(ms / 10_000).cast("int"), F.lit(0)), F.lit(60))


def speed_bucket(speed: Column) -> Column:
    """Hundredths within 0.4 and 3.6, halves to even."""
    return F.bround(F.least(F.greatest(speed, F.lit(0.4)), F.lit(3.6)) * 100, 0).cast("int")


def pack_hitsound(sound: Column, sample_set: Column, addition_set: Column) -> Column:
    """Bits 1 to 3 of the sound, then the sets (1 to 3; 1 if out of range) as digits of base 3 over 8."""
    valid = lambda s: F.when(s.between(1, 3), s).otherwise(F.lit(1))
    return F.shiftright(sound.bitwiseAND(14), 1) + 8 * (valid(sample_set) - 1) + 24 * (valid(addition_set) - 1)


def unpack_hitsound(code: Column) -> Column:
    """struct(sound, sample_set, addition_set)."""
    div = lambda k: F.floor(code / F.lit(k)).cast("int")
    return F.struct(
        (F.pmod(code, F.lit(8)) * 2).alias("sound"), (F.pmod(div(8), F.lit(3)) + 1).alias("sample_set"), (F.pmod(div(24), F.lit(3)) + 1).alias("addition_set")
    )


def sample_field(field: Column, default_set: Column, default_volume: Column) -> Column:
    """struct(sample_set, addition_set, volume) of `a:b:c:d`, where 0 or a missing part inherits."""
    part = lambda i: F.nullif(F.get(F.split(field, ":"), F.lit(i)).cast("int"), F.lit(0))
    own = F.coalesce(part(0), F.coalesce(F.nullif(default_set, F.lit(0)), F.lit(2)))
    volume = F.least(F.greatest(F.coalesce(part(3), default_volume), F.lit(0)), F.lit(100))
    return F.struct(own.alias("sample_set"), F.coalesce(part(1), own).alias("addition_set"), volume.alias("volume"))


def pack_position(x: Column, y: Column, precision: int, low: tuple[int, int], high: tuple[int, int]) -> Column:
    """Row-major cell number of a clipped point on a grid of `precision`."""
    cell = lambda v, a, b: F.least(F.greatest(v / precision, F.lit(a / precision)), F.lit(b / precision)).cast("int")
    columns = (high[0] - low[0]) // precision + 1
    return (cell(x, low[0], high[0]) - low[0] // precision) + (cell(y, low[1], high[1]) - low[1] // precision) * columns


def unpack_position(code: Column, precision: int, low: tuple[int, int], high: tuple[int, int]) -> Column:
    """struct(x, y): the middle of the cell."""
    columns = (high[0] - low[0]) // precision + 1
    half = precision // 2 if precision > 1 else 0
    x = (F.pmod(code, F.lit(columns)) + low[0] // precision) * precision + half
    y = (F.floor(code / F.lit(columns)).cast("int") + low[1] // precision) * precision + half
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def column_of(x: Column, columns: Column | int, width: int = 512) -> Column:
    return F.least(F.greatest((x / width * columns).cast("int"), F.lit(0)), F.lit(columns) - 1 if isinstance(columns, int) else columns - 1)


def column_middle(column: Column, columns: Column | int, width: int = 512) -> Column:
    return ((column + 0.5) * width / columns).cast("int")


def snap_divisor(beats: Column, ms_per_beat: Column, within_ms: float = 2.0, most: int = 16) -> Column:
    """The smallest i up to `most` for which beats lies within `within_ms` of a multiple of 1 / i; 0 if none does."""
    fits = F.filter(
        F.sequence(F.lit(1), F.lit(most)), lambda i: F.abs(beats - F.bround(beats * i, 0) / i) * ms_per_beat < within_ms
    )
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))


def coarser_divisors(divisor: int) -> list[int]:
    """The divisor over each of its prime factors: the next coarser grids that it contains."""
    return sorted({divisor // p for p in range(2, divisor + 1) if divisor % p == 0 and all(p % q for q in range(2, p))})


def resnapped(time: Column, before: Column, ms_per_beat: Column, after: Column, divisor: Column, most: int = 16) -> Column:
    """`time` moved to the nearest tick of `divisor`, leaving out ticks of coarser grids; the earliest of equally near.

    `before` is the time of the red point in force, `after` that of the next one (null: none): a time within 10 ms of
    the next point, and not so near after the last, moves there. Divisors below 1 and empty tick sets leave the time.
    """

    def ticks(d: Column) -> Column:
        step = ms_per_beat / d
        start = time - F.pmod(time - before, step)
        return F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda k: (start + step * k).cast("long"))

    coarse = F.when(F.lit(False), F.array().cast("array<int>"))
    for d in range(1, most + 1):
        coarse = coarse.when(divisor == d, F.array(*map(F.lit, coarser_divisors(d))).cast("array<int>"))
    coarse = coarse.otherwise(F.array(F.lit(1)))
    removed = F.flatten(F.transform(coarse, lambda d: ticks(d)))
    left = F.array_except(ticks(divisor), removed)
    near = F.array_min(F.transform(left, lambda t: F.struct(F.abs(t - time).alias("d"), t.alias("t"))))["t"]
    to_next = after.isNotNull() & (time > before + 10) & (time >= after - 10)
    return F.when(divisor < 1, time.cast("long")).when(to_next, after.cast("long")).otherwise(F.coalesce(near, time.cast("long")))


def human_period(period: Column, holds) -> Column:
    """The roundest tempo for which `holds(period)`: beats a minute in whole, half, tenth, hundredth, thousandth steps.

    `holds` maps a period in milliseconds to a condition; if none holds the period stays. Periods of 0 or over a minute
    stay.
    """
    tempo = F.lit(60_000.0) / F.nullif(period, F.lit(0.0))
    steps = [F.lit(60_000.0) / F.nullif(F.bround(tempo * k, 0) / k, F.lit(0.0)) for k in (1, 2, 10, 100, 1000)]
    found = F.coalesce(*(F.when(holds(s), s) for s in steps), period)
    return F.when((period == 0) | (period > 60_000), period).otherwise(found)


def slider_length(speed: Column, duration: Column, ms_per_beat: Column, multiplier: Column) -> Column:
    return speed * duration * 100 / ms_per_beat * multiplier


def human_speed(needed: Column, duration: Column, ms_per_beat: Column, multiplier: Column, last: Column, new_combo: Column) -> Column:
    """The last speed if the needed one is within 5 % (new combo) or 15 %, else in twentieths, or hundredths if low."""
    speed = needed / 100 / duration * ms_per_beat / multiplier
    coarse = F.bround(speed * 20, 0) / 20
    rounded = F.when(coarse < 0.1, F.bround(speed * 100, 0) / 100).otherwise(coarse)
    near = F.abs(speed - last) / last <= F.when(new_combo, F.lit(0.05)).otherwise(F.lit(0.15))
    return F.when(near, last).when(rounded > 1e-5, rounded).otherwise(speed)


def sinusoids(t: Column, dims: int, longest: float = 10_000.0) -> Column:
    """Cosines then sines of t at dims // 2 geometric frequencies, and a zero if dims is odd."""
    half = dims // 2
    angle = lambda i: t * F.exp(-F.log(F.lit(longest)) * i / half)
    grid = F.sequence(F.lit(0), F.lit(half - 1))
    parts = [F.transform(grid, lambda i: F.cos(angle(i))), F.transform(grid, lambda i: F.sin(angle(i)))]
    return F.concat(*parts, *([F.array(F.lit(0.0))] if dims % 2 else []))


def repeat_class(repeats: Column) -> Column:
    """0, 1, 2 for 1 to 3 repeats, then 3 for even and 4 for odd numbers."""
    return F.when(repeats < 4, repeats - 1).when(repeats % 2 == 0, F.lit(3)).otherwise(F.lit(4))


def one_hot(k: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == k).cast("int"))


def multi_hot(codes: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(codes, i).cast("int"))


def section_steps(steps: Column, counts: list[int]) -> Column:
    """Array of evenly spaced steps of nearly equal sections of `steps` steps: counts[i] of them from section i, the
    first ones being longer by one where they can't be equal. Null where a section has fewer steps than it should give."""
    n = len(counts)
    size, extra = F.floor(steps / F.lit(n)), steps % n
    parts, enough = [], F.lit(True)
    for i, count in enumerate(counts):
        own = (size + (extra > i).cast("int")).cast("int")
        enough = enough & (own >= count)
        start = size * i + F.least(extra, F.lit(i))
        if count:
            stride = (own - 1) / F.lit(count - 1) if count > 1 else F.lit(1.0)
            parts.append(_strided(start, count, stride))
    return F.when(enough, F.concat(*parts))


def _strided(start: Column, n: int, stride: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (start + F.bround(k * stride, 0)).cast("int"))


def strided_steps(steps: Column, count: int) -> Column:
    """Array of `count` steps of 0, ..., steps - 1 at one whole stride from 0 on, the smallest that gives so many; null if
    none does."""
    stride = F.ceil(steps / F.lit(count))
    return F.when((steps >= count) & (F.ceil(F.try_divide(steps, stride)) == count) & (stride < steps), F.sequence(F.lit(0).cast("long"), steps.cast("long") - 1, stride))



def circle_candidates(x: Column, y: Column, far: Column, samples: int, width: float = 512, height: float = 384, or_corner: bool = True) -> Column:
    """Points at a distance from (x, y), at `samples` even angles, that lie inside the field; if none does, with `or_corner`
    its farther corner."""
    angle = lambda i: F.lit(2.0) * F.pi() * i / (samples - 1)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        lambda i: F.struct((x + far * F.cos(angle(i))).alias("x"), (y + far * F.sin(angle(i))).alias("y")),
    )
    inside = F.filter(points, lambda p: p["x"].between(0, width) & p["y"].between(0, height))
    if not or_corner:
        return inside
    corner = F.when(x + y > (width + height) / 2, F.struct(F.lit(float(width)).alias("x"), F.lit(float(height)).alias("y"))).otherwise(
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    )
    return F.when(F.size(inside) > 0, inside).otherwise(F.array(corner))


def hashed(seed: int, *keys) -> Column:
    """Hexadecimal md5 of a seed and keys: a pseudo-random order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)).cast("binary"))


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) by hash of keys, 52 bits of it: the same for the same keys, whatever the partitions."""
    return F.conv(F.substring(hashed(seed, *keys), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def padded_tokens(tokens: Column, length: int, fill: int) -> Column:
    """The first `length` tokens, filled up at the end."""
    cut = F.slice(tokens, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(fill).cast("int"), F.lit(length) - F.size(cut)))


def shifted_labels(tokens: Column, length: int, ignore: int = -100) -> Column:
    """Labels for predicting the next token: tokens one place earlier, the rest ignored."""
    return padded_tokens(F.slice(tokens, 2, length), length, ignore)


def frames(samples: Column, hop: int) -> Column:
    """Samples zero-padded to whole frames of `hop` (a full frame of zeros if they divide) and cut into them."""
    n = F.floor(F.size(samples) / F.lit(hop)).cast("int") + 1
    full = F.concat(samples, F.array_repeat(F.lit(0).cast("double"), n * hop - F.size(samples)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(full, i * hop + 1, F.lit(hop)))


def relative_step(time: Column, start: Column, low: int, high: int, step_ms: int = 10) -> Column:
    """struct(step, clipped): time from a window's start in whole steps, within [low, high]."""
    raw = ((time - start) / step_ms).cast("int")
    inside = F.least(F.greatest(raw, F.lit(low)), F.lit(high))
    return F.struct(inside.alias("step"), (raw != inside).alias("clipped"))


def quoted(text: Column) -> Column:
    """In double quotes, with quotes and backslashes inside escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def safe_path(text: Column) -> Column:
    """Back slashes to slashes; quotes and line ends dropped."""
    return F.translate(text, "\\\"'\n\r", "/")
