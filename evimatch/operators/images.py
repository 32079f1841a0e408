"""Measurements on grey arrays: Spark expressions on flat arrays, pictures as their rows laid end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimatch.functions.text import let
from evimatch.functions.vocabulary import REGIONS, STRIP_HEIGHT, STRIP_MARGIN


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def fnv_hash(a: Column) -> Column:
    """FNV-1a, 32 bits, over every 16th value; hexadecimal without leading zeroes."""
    each = F.filter(a, lambda x, i: i % 16 == 0)
    h = F.aggregate(each, F.lit(2166136261).cast("bigint"), lambda acc, x: F.pmod(acc.bitwiseXOR(x.cast("bigint")) * F.lit(16777619).cast("bigint"), F.lit(4294967296).cast("bigint")))
    return F.lower(F.hex(h))


def nth(a: Column, q: float) -> Column:
    """The value at floor(q * n) of the sorted array, the last at most."""
    n = F.size(a)
    return F.element_at(F.sort_array(a), F.least(n, F.floor(n * q).cast("int") + 1))


def upper_median(a: Column) -> Column:
    return F.element_at(F.sort_array(a), F.floor(F.size(a) / 2).cast("int") + 1)


def lower_median(a: Column) -> Column:
    return F.element_at(F.sort_array(a), F.floor((F.size(a) - 1) / 2).cast("int") + 1)


def histogram(grays: DataFrame, key: str, col: str) -> DataFrame:
    """key, value, n of arrays of 0..255."""
    each = grays.select(key, F.explode(col).alias("x"))
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("x") + 0.5))).cast("int")
    return each.groupBy(key, value.alias("value")).agg(F.count("*").alias("n"))


def otsu(grays: DataFrame, key: str, col: str) -> DataFrame:
    """key, threshold: the value that best separates dark from light, the first on a tie; 0 where all is one value.

    One fold over the sorted values, row by row: what lies at or below a value only changes where a value ends, so a value is judged when
    the next larger one comes.
    """
    rounded = F.sort_array(F.transform(col, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x + 0.5).cast("double")))))
    out = grays.select(key, rounded.alias("a")).withColumns({"n": F.size("a").cast("double"), "s": F.aggregate("a", F.lit(0.0), lambda t, x: t + x)})
    fields = ("w", "s", "last", "best", "most")
    state = lambda *values: F.struct(*[x.alias(f) for f, x in zip(fields, values, strict=True)])

    def judged(t: Column) -> Column:
        gap = t["s"] / t["w"] - (F.col("s") - t["s"]) / (F.col("n") - t["w"])
        return t["w"] * (F.col("n") - t["w"]) * gap * gap

    def step(t: Column, x: Column) -> Column:
        between = F.when((t["w"] > 0) & (x != t["last"]), judged(t))
        better = F.coalesce(between > t["most"], F.lit(False))
        return state(t["w"] + 1.0, t["s"] + x, x, F.when(better, t["last"]).otherwise(t["best"]), F.when(better, between).otherwise(t["most"]))

    found = F.aggregate("a", state(*map(F.lit, (0.0, 0.0, -1.0, 0.0, -1.0))), step)
    return out.select(key, found["best"].cast("int").alias("threshold"))


def binarize(a: Column, threshold: Column) -> Column:
    """255 above the threshold, 0 at or below it."""
    return F.transform(a, lambda x: F.when(x > threshold, 255).otherwise(0))


def stretch(grays: DataFrame, key: str, col: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """key, lo, hi, and the array stretched so that the two percentiles become 0 and 255."""
    rounded = F.sort_array(F.transform(col, lambda x: F.floor(x + 0.5).cast("int")))
    at = lambda q: F.element_at(rounded, F.greatest(F.lit(1), F.ceil(F.size(col) * q).cast("int")))
    lo = at(low)
    spread = grays.withColumn("lo", lo).withColumn("hi", F.greatest(F.col("lo") + 1, at(high)))
    out = F.transform(col, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)))
    return spread.select(key, "lo", "hi", out.alias("stretched"))


def issues(edge: Column, mean: Column, blown: Column, sharpness: Column) -> Column:
    found = F.array(F.when(edge < 400, "small"), F.when(mean < 60, "dark"), F.when((blown > 0.04) & (blown < 0.5), "glare"), F.when(sharpness < 60, "blurry"))
    return F.filter(found, lambda x: x.isNotNull())


def region_rect(region: Column, width: Column, height: Column) -> Column:
    """A named region in whole pixels (sx, sy, sw, sh), inside a card of that size; null for a name that is none."""
    box = F.create_map(*[x for name, parts in REGIONS.items() for x in (F.lit(name), F.array(*map(F.lit, parts)))])[region]
    pixels = lambda i, size: F.floor(box[i] * size + 0.5).cast("int")
    left, top = F.greatest(F.lit(0), pixels(0, width)), F.greatest(F.lit(0), pixels(1, height))
    rect = F.struct(left.alias("sx"), top.alias("sy"), F.least(width - left, pixels(2, width)).alias("sw"), F.least(height - top, pixels(3, height)).alias("sh"))
    return F.when(box.isNotNull(), rect)


def to_card(rect: Column, x: Column, y: Column) -> Column:
    """Where on the card a point of its enlarged strip lies."""
    scale = F.lit(float(STRIP_HEIGHT)) / rect["sh"]
    return F.struct((rect["sx"] + (x - STRIP_MARGIN) / scale).alias("x"), (rect["sy"] + (y - STRIP_MARGIN) / scale).alias("y"))


def flatten_line(a: Column, radius: int) -> Column:
    """Each value as a part of the mean around it (cut off at the ends), 255 at most: uneven light goes."""

    def around(i: Column) -> Column:
        first = F.greatest(F.lit(1), i + 1 - radius)
        near = F.slice(a, first, i + 1 + radius - first + 1)
        return F.aggregate(near, F.lit(0.0), lambda t, x: t + x) / F.size(near)

    return F.transform(a, lambda x, i: F.least(F.lit(255.0), F.lit(255.0) * x / F.greatest(F.lit(1.0), around(i))))


def _summed(a: Column, width: Column) -> Column:
    """The summed-area table of a square of rows laid end to end: one row and one column more, so that no edge is a case of its own."""
    plus = lambda x, y: x + y
    running = lambda row: F.aggregate(row, F.array(F.lit(0.0)), lambda t, x: F.array_append(t, F.element_at(t, -1) + x))
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1), lambda y: F.slice(a, y * width + 1, width))
    return F.aggregate(rows, F.array(F.array_repeat(F.lit(0.0), width + 1)), lambda t, row: F.array_append(t, F.zip_with(F.element_at(t, -1), running(row), plus)))


def box_blur(a: Column, width: Column, radius: int) -> Column:
    """Each value of a picture (rows laid end to end) as the mean of the square around it, cut off at the edges."""
    height = F.floor(F.size(a) / width).cast("int")

    def means(t: Column) -> Column:
        def mean(i: Column) -> Column:
            y, x = F.floor(i / width).cast("int"), i % width
            top, left = F.greatest(F.lit(0), y - radius), F.greatest(F.lit(0), x - radius)
            bottom, right = F.least(height, y + radius + 1), F.least(width, x + radius + 1)
            return (t[bottom][right] - t[top][right] - t[bottom][left] + t[top][left]) / ((bottom - top) * (right - left))

        return F.transform(F.sequence(F.lit(0), F.size(a) - 1), mean)

    return let(_summed(a, width), means)


def flatten_illumination(a: Column, width: Column, radius: int) -> Column:
    """A picture as parts of the mean around each value, 255 at most: uneven light goes."""
    return F.zip_with(a, box_blur(a, width, radius), lambda x, m: F.least(F.lit(255.0), F.lit(255.0) * x / F.greatest(F.lit(1.0), m)))


def laplacian_variance(a: Column, width: Column) -> Column:
    """How much the picture's second differences vary (0 if it has less than three rows or columns): low where it is blurred."""
    height = F.floor(F.size(a) / width).cast("int")
    inner = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i % width > 0) & (i % width < width - 1) & (i >= width) & (i < width * (height - 1)))
    edges = F.transform(inner, lambda i: a[i - width] + a[i + width] + a[i - 1] + a[i + 1] - a[i] * 4)
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda t, y: t + f(y))

    def variance(x: Column) -> Column:
        n = F.size(x)
        return F.when(n == 0, 0.0).otherwise((total(x, lambda y: y * y) * n - total(x, lambda y: y) * total(x, lambda y: y)) / (n * n))

    return let(edges, variance)
