"""Chip indices, stretches and masks on packed rasters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.functions.parse import finite

#: Scene classes counted as water, and those that are cloud, shadow or no data: fixed values.
WATER, CLOUDY = 6, (0, 1, 3, 8, 9, 10)


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of value, where value is worked out once a row however often fn uses it, also inside other lambdas."""
    return F.transform(F.array(value), fn)[0]


def robust(values: Column, mask: Column | None = None) -> Column:
    """Struct of mean, population std and count of the finite values of an array where the mask is positive; NaN, NaN, 0 for none."""
    pairs = F.arrays_zip(values.alias("v"), (mask if mask is not None else F.transform(values, lambda _: F.lit(1))).alias("m"))
    good = F.transform(F.filter(pairs, lambda p: (p["m"] > 0) & finite(p["v"])), lambda p: p["v"].cast("double"))
    nan = F.lit(float("nan"))

    def stats(good: Column) -> Column:
        n = F.size(good)
        mean = F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / n

        def around(m: Column) -> Column:
            spread = F.aggregate(good, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n
            return F.struct(F.when(n > 0, m).otherwise(nan).alias("mean"), F.when(n > 0, F.sqrt(spread)).otherwise(nan).alias("std"), n.alias("n"))

        return bound(F.when(n > 0, mean), around)

    return bound(good, stats)


def usable_pixels(classes: Column | None, data: Column, values: Column) -> Column:
    """Mask by the first of these that has any pixel: water, not cloudy, data, finite."""
    ints = lambda xs, ok: F.transform(xs, lambda x: ok(x).cast("int"))
    some = lambda m: F.coalesce(F.exists(m, lambda x: x > 0), F.lit(False))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0)))
    finite_ = ints(values, finite)
    has = ints(data, lambda x: x > 0)
    if classes is None:
        return F.when(some(has), has).otherwise(finite_)
    water = both(ints(classes, lambda x: x == WATER), has)
    clear = both(ints(classes, lambda x: ~x.isin(*CLOUDY)), has)
    return F.when(classes.isNotNull() & some(water), water).when(classes.isNotNull() & some(clear), clear).when(some(has), has).otherwise(finite_)


def chip_indices(chips: DataFrame, *, green: str = "b03", red: str = "b04", nir: str = "b08", mask: str = "mask", classes: str | None = "scl", scale: float = 10000.0) -> DataFrame:
    """The chips' columns but their bands, with mean and std of the three indices and valid_px. Chips that lack a band are left out."""
    bands = {"_g": green, "_r": red, "_n": nir}
    rows = chips.where(" and ".join(f"{c} is not null" for c in bands.values()))
    rows = rows.withColumns({k: F.transform(F.col(c), lambda x: numeric.reflectance(x, scale)) for k, c in bands.items()})
    has_classes = classes is not None and classes in chips.columns
    data = F.col(mask) if mask in chips.columns else F.transform("_g", lambda _: F.lit(1))
    rows = rows.withColumn("_m", usable_pixels(F.col(classes) if has_classes else None, data, F.col("_g")))
    px = F.arrays_zip("_g", "_r", "_n")
    rows = rows.withColumns({
        "_ndwi": F.transform(px, lambda p: numeric.ndwi(p["_g"], p["_n"])),
        "_fai": F.transform(px, lambda p: numeric.fai(p["_g"], p["_r"], p["_n"])),
        "_rednir": F.transform(px, lambda p: numeric.red_nir(p["_r"], p["_n"])),
    })
    rows = rows.withColumns({f"_s{k}": robust(F.col(f"_{k}"), F.col("_m")) for k in ("ndwi", "fai", "rednir")})
    stats = [F.col(f"_s{k}.{s}").alias(f"{k}_{s}") for k in ("ndwi", "fai", "rednir") for s in ("mean", "std")]
    drop = {*bands.values(), mask, classes or ""}
    return rows.select(*[c for c in chips.columns if c not in drop], *stats, F.col("_sndwi.n").alias("valid_px"))


def pixel_indices(pixels: DataFrame, *keys: str, green: Column, red: Column, nir: Column, usable: Column | None = None, scale: float = 10000.0) -> DataFrame:
    """The same statistics from one row a pixel: plain aggregates with partial sums, so a raster of any size is no row and no task of its own."""
    g, r, n = (numeric.reflectance(c, scale) for c in (green, red, nir))
    indices = {"ndwi": numeric.ndwi(g, n), "fai": numeric.fai(g, r, n), "rednir": numeric.red_nir(r, n)}
    ok = usable if usable is not None else F.lit(True)
    good = {k: F.when(ok & finite(v), v) for k, v in indices.items()}
    stats = [f(v).alias(f"{k}_{name}") for k, v in good.items() for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return pixels.groupBy(*keys).agg(*stats, F.count(good["ndwi"]).cast("int").alias("valid_px"))


def stretched(values: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """Bytes of an array stretched between two of its quantiles (linear between ranks), over its finite values."""

    def quantile(good: Column, q: float) -> Column:
        at = (F.size(good) - 1) * q
        lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
        a, b = F.try_element_at(good, lo + 1), F.try_element_at(good, hi + 1)
        return a + (b - a) * (at - lo)

    def limits(good: Column) -> Column:
        return F.struct(quantile(good, low).alias("a"), quantile(good, high).alias("b"))

    good = F.array_sort(F.transform(F.filter(values, finite), lambda v: v.cast("double")))
    return bound(bound(good, limits), lambda q: F.transform(values, lambda v: numeric.to_byte(v.cast("double"), q["a"], F.greatest(q["b"], q["a"] + 1e-6))))


def _weights(n: int, out: int) -> list[tuple[int, list[float]]]:
    """For each of out places the first of n source places and the weights of those from it on: a triangle of one pixel, wider where the image shrinks."""
    scale, rows = n / out, []
    support = max(1.0, scale)
    for k in range(out):
        centre = (k + 0.5) * scale
        first, last = max(0, int(centre - support + 0.5)), min(n, int(centre + support + 0.5))
        w = [max(0.0, 1 - abs((x + 0.5 - centre) / support)) for x in range(first, last)]
        rows.append((first, [v / sum(w) for v in w]))
    return rows


def resized_bilinear(band: Column, height: int, width: int, out_h: int, out_w: int) -> Column:
    """A flat band of height x width bytes resampled to out_h x out_w bytes, columns first and then rows.

    Weights are whole numbers of 2**-22, and either pass rounds to whole bytes, as image libraries resample gray images. Weights are constants of the plan.
    """
    bits = 22

    def mixed(first: Column, w: Column, at: Callable[[Column], Column]) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 1)
        total = F.aggregate(places, F.lit(1 << (bits - 1)).cast("long"), lambda a, x: a + F.element_at(w, x + 1) * at(first + x).cast("long"))
        return F.least(F.greatest(F.shiftright(total, bits), F.lit(0).cast("long")), F.lit(255).cast("long")).cast("int")

    def table(n: int, out: int) -> Column:
        return F.array(*[F.struct(F.lit(f).alias("f"), F.array(*[F.lit(int(0.5 + v * (1 << bits))).cast("long") for v in w]).alias("w")) for f, w in _weights(n, out)])

    def rows(b: Column, across: Column, down: Column) -> Column:
        lines = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.transform(across, lambda c: mixed(c["f"], c["w"], lambda j: F.element_at(b, (i * width + j + 1).cast("int")))))
        pick = lambda g, k: F.transform(down, lambda r: mixed(r["f"], r["w"], lambda i: F.element_at(F.element_at(g, (i + 1).cast("int")), (k + 1).cast("int"))))
        by_column = lambda g: F.transform(F.sequence(F.lit(0), F.lit(out_w - 1)), lambda k: pick(g, k))
        turned = lambda cols: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(out_h - 1)), lambda i: F.transform(cols, lambda c: F.element_at(c, (i + 1).cast("int")))))
        return bound(lines, lambda g: bound(by_column(g), turned))

    return bound(band, lambda b: bound(table(width, out_w), lambda across: bound(table(height, out_h), lambda down: rows(b, across, down))))


def model_input(gray: Column, channels: int = 3) -> Column:
    """A gray band of 0 to 255 as -1 to 1, repeated for each channel."""
    return F.flatten(F.array_repeat(F.transform(gray, lambda x: (x / 255.0 - 0.5) / 0.5), channels))


def dilated(pixels: DataFrame, *keys: str) -> DataFrame:
    """Distinct pixels (keys, i, j) with their eight neighbours."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = pixels.select(*keys, F.col("i"), F.col("j"), F.explode(around).alias("di")).select("*", F.explode(around).alias("dj"))
    return spread.select(*keys, (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).distinct()
