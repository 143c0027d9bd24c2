"""Arithmetic of frames, shapes and buckets as columns. Divisors are non-zero by contract; nulls give nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom.functions import dims


def span(pair: Column, low: int = 0, high: int = 1) -> Column:
    """Difference of two entries of an array, null where one is missing."""
    return F.get(pair, F.lit(high)) - F.get(pair, F.lit(low))


def uttid(path: Column, cut: Column) -> Column:
    """File stem and cut, as stem_start-end."""
    return F.concat_ws("_", stem(path), F.concat_ws("-", F.get(cut, F.lit(0)), F.get(cut, F.lit(1))))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def without(text: Column, *parts: str) -> Column:
    """Removes each literal part wherever it occurs, in the given order."""
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(""))
    return text


def fps_stride(fps: Column, base: float) -> Column:
    """Frames to skip to come from ``fps`` down to ``base``, at least one; null for an unknown rate."""
    return F.when(fps.isNotNull(), F.greatest(F.floor(fps / F.lit(base)), F.lit(1)).cast("int"))


def ceil_div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.floor((a + b - 1) / b).cast("bigint")


def nearest_resolution(height: Column, width: Column) -> Column:
    """struct(height, width) of the bucket of nearest aspect; the last of equal ones wins."""
    options = [F.struct(F.abs(height * w - width * h).alias("d"), F.lit(-i).alias("o"), F.lit(h).alias("height"), F.lit(w).alias("width")) for i, (h, w) in enumerate(dims.RESOLUTIONS)]
    best = F.array_min(F.array(*options))
    return F.when(height.isNotNull() & width.isNotNull(), F.struct(best["height"].alias("height"), best["width"].alias("width")))


def nearest_length(frames: Column, lengths: list[int]) -> Column:
    """The largest bucket that the frames fill; fewer frames than the smallest bucket stay as they are."""
    fitting = F.array_max(F.filter(F.array(*map(F.lit, lengths)), lambda b: b <= frames))
    return F.when(frames.isNotNull(), F.coalesce(fitting, frames))


def middle_frames(wanted: int, length: Column) -> Column:
    """The middle frame of each of ``wanted`` equal intervals, the last one repeated where there are fewer frames; null for
    no frames."""
    n = F.least(F.lit(wanted), length)
    edge = lambda i: F.when(i == n, length).otherwise(F.floor(i.cast("double") * (length / n)).cast("int"))
    picked = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.floor((edge(i) + edge(i + 1) - 1) / 2).cast("int"))
    return F.when(length > 0, padded(picked, wanted))


def random_frames(wanted: int, length: Column, ident: Column, seed: str | int = 0) -> Column:
    """A frame of each of ``wanted`` equal intervals by hash, never an interval's last; where an interval has no other frame,
    as many frames of all as are wanted. The last one is repeated where there are fewer frames; null for no frames."""
    from cliploom.operators.sampling import pick, shuffle_key

    n = F.least(F.lit(wanted), length)
    edge = lambda i: F.when(i == n, length).otherwise(F.floor(i.cast("double") * (length / n)).cast("int"))
    intervals = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(i.alias("i"), edge(i).alias("a"), (edge(i + 1) - 1 - edge(i)).alias("n")))
    each = F.transform(intervals, lambda x: (x["a"] + pick(F.concat_ws("/", ident.cast("string"), x["i"].cast("string")), seed, x["n"])).cast("int"))
    keyed = F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), lambda f: F.struct(shuffle_key(F.concat_ws("/", ident.cast("string"), f.cast("string")), seed).alias("h"), f.alias("f")))
    some = F.array_sort(F.transform(F.slice(F.array_sort(keyed), F.lit(1), n), lambda k: k["f"].cast("int")))
    return F.when(length > 0, padded(F.when(F.exists(intervals, lambda x: x["n"] <= 0), some).otherwise(each), wanted))


def fps_frames(fps_out: float, length: Column, fps_in: Column) -> Column:
    """Frames at ``fps_out`` from the middle of the first interval on, half-way cases to even."""
    gap = 1.0 / fps_out
    steps = F.greatest(F.ceil(length / fps_in / F.lit(gap)).cast("int"), F.lit(1))
    frames = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.bround((F.lit(gap / 2) + i * F.lit(gap)) * fps_in).cast("int"))
    return F.when((length > 0) & (fps_in > 0), F.filter(frames, lambda f: f < length))


def padded(values: Column, n: int) -> Column:
    """The first n entries, the last one repeated; an empty or null array gives null."""
    last = F.element_at(values, -1)
    return F.when(F.size(values) > 0, F.slice(F.concat(values, F.array_repeat(last, n)), 1, n))


def portion(total: Column, start: float, end: float, wanted: int) -> Column:
    """struct(start, end): a part of the frames, widened evenly to hold ``wanted`` where it is too short."""
    a, b = F.floor(total * F.lit(start)).cast("int"), F.floor(total * F.lit(end)).cast("int")
    lack = (F.lit(wanted) - (b - a)) / 2
    wide_a = F.greatest(F.lit(0), a - F.ceil(lack).cast("int"))
    wide_b = F.least(total, b + F.floor(lack).cast("int"))
    short = (wide_b - wide_a) < wanted
    last_b = F.when(short & (wide_a == 0), F.least(total, wide_a + wanted)).otherwise(wide_b)
    last_a = F.when(short & (wide_a != 0) & (wide_b == total), F.greatest(F.lit(0), wide_b - wanted)).otherwise(wide_a)
    enough = (b - a) >= wanted
    return F.struct(F.when(enough, a).otherwise(last_a).alias("start"), F.when(enough, b).otherwise(last_b).alias("end"))


def aligned(value: Column, step: int = 2) -> Column:
    """The nearest multiple, half-way cases to the even multiple."""
    return (F.bround(value / step) * step).cast("int")


def resized(height: Column, width: Column, factor: int, least: int, most: int, ratio: int = 200) -> Column:
    """struct(height, width) in multiples of ``factor`` with a pixel count in [least, most]; null beyond the aspect ratio."""
    h, w = F.greatest(F.lit(factor), aligned(height, factor)), F.greatest(F.lit(factor), aligned(width, factor))
    area = height.cast("double") * width
    down, up = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)
    low = lambda x: (F.floor(x / factor) * factor).cast("int")
    high = lambda x: (F.ceil(x / factor) * factor).cast("int")
    pick = lambda x, near: F.when(h * w > most, low(x / down)).when(h * w < least, high(x * up)).otherwise(near)
    fine = F.greatest(height, width) / F.least(height, width) <= ratio
    return F.when(fine, F.struct(pick(height, h).alias("height"), pick(width, w).alias("width")))


def sampled_frames(total: Column, fps: Column, wanted_fps: float = 2.0, factor: int = 2, least: int = 4, most: int = 768) -> Column:
    """How many frames a model is fed: by rate, within bounds, a multiple of ``factor``; null where that cannot be."""
    upper = F.floor(F.least(F.lit(most), total) / factor) * factor
    n = F.least(F.greatest(total / fps * F.lit(wanted_fps), F.lit(float(-(-least // factor) * factor))), upper)
    n = F.least(F.bround(n / factor) * factor, total).cast("int")
    return F.when((n >= factor) & (n <= total), n)


def uniform_frames(total: Column, n: int) -> Column:
    """n frames from the first to the last, half-way cases to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * ((total - 1) / F.lit(n - 1))).cast("int"))


def spaced(first: Column, last: Column, n: Column) -> Column:
    """n whole numbers from first to last, half-way cases to even."""
    gap = F.when(n > 1, (last - first) / (n - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.bround(first + i * gap).cast("int"))


def point_frames(total: Column, fps: Column, points: int = 4, each: int = 6, wanted_fps: int = 8) -> Column:
    """``each`` neighbouring frames around ``points`` places of a clip seen at ``wanted_fps``; null where the clip is too short
    for one place."""
    n = F.floor(total * wanted_fps / fps).cast("int")
    frames, half = spaced(F.lit(0), total - 1, n), each // 2
    places = spaced(F.lit(half), n - half - 1, F.lit(points))
    picked = F.flatten(F.transform(places, lambda p: F.slice(frames, p - half + 1, F.lit(each))))
    return F.when(n > each, picked)


def centre_crop(height: Column, width: Column, to_height: Column, to_width: Column) -> Column:
    """struct(top, left, height, width) of the largest centred rectangle of the target's aspect."""
    wide = width * to_height > height * to_width
    h = F.when(wide, height).otherwise(F.floor(width * to_height / to_width)).cast("int")
    w = F.when(wide, F.floor(height * to_width / to_height)).otherwise(width).cast("int")
    return F.struct(F.floor((height - h) / 2).cast("int").alias("top"), F.floor((width - w) / 2).cast("int").alias("left"), h.alias("height"), w.alias("width"))


def clip_fps(frames: Column, fps: Column, compat: bool = False) -> Column:
    """16 for clips of at most 93 frames and 8 for at most 49. compat: the first test hides the second."""
    if compat:
        return F.when(frames <= 93, 16.0).otherwise(fps)
    return F.when(frames <= 49, 8.0).when(frames <= 93, 16.0).otherwise(fps)


def shift_of(length: Column, base_length: float = 256.0, most_length: float = 4096.0, base: float = 0.5, most: float = 1.15) -> Column:
    """The linear shift of a sequence length."""
    slope = (most - base) / (most_length - base_length)
    return length * F.lit(slope) + F.lit(base - slope * base_length)


def shifted(sigma: Column, mu: Column) -> Column:
    return sigma * mu / (1 + (mu - 1) * sigma)
