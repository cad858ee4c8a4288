"""Colour as column expressions: hex, sRGB, CIE Lab (D65), CIEDE2000 after Sharma, Wu and Dalal (2005). No UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_digits(code: Column) -> Column:
    """Six hex digits of `#abc`, `abc`, `#aabbcc` or `aabbcc`, ends trimmed; null for anything else."""
    bare = F.regexp_replace(F.trim(code), "^#", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), bare).when(bare.rlike("^[0-9A-Fa-f]{3}$"), F.regexp_replace(bare, "(.)", "$1$1"))


def hex_to_rgb(code: Column) -> Column:
    """struct(r, g, b) of ints, or null."""
    digits = hex_digits(code)
    channel = lambda at, name: F.conv(F.substring(digits, at, 2), 16, 10).cast("int").alias(name)
    return F.when(digits.isNotNull(), F.struct(channel(1, "r"), channel(3, "g"), channel(5, "b")))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def linear(channel: Column) -> Column:
    x = channel / F.lit(255.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


# sRGB to XYZ over the D65 white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of doubles."""
    channels = [linear(x) for x in (r, g, b)]
    edge = (6 / 29) ** 3

    def response(weights: tuple[float, ...], white: float) -> Column:
        t = sum((c * w for c, w in zip(channels[1:], weights[1:], strict=True)), channels[0] * weights[0]) / white
        return F.when(t > edge, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)

    x, y, z = (response(w, n) for w, n in zip(TO_XYZ, WHITE, strict=True))
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def hex_to_lab(code: Column) -> Column:
    """Lab of a hex code, or null. Meant for palettes; the channels are bound once by transform() over one element."""
    return F.transform(F.array(hex_to_rgb(code)), lambda c: F.when(c.isNotNull(), rgb_to_lab(c["r"], c["g"], c["b"])))[0]


def lab_chroma(lab: Column) -> Column:
    return F.sqrt(lab["a"] * lab["a"] + lab["b"] * lab["b"])


def hue_of(b: Column, a: Column) -> Column:
    """Degrees in [0, 360); 0 where both are 0."""
    angle = F.degrees(F.atan2(b, a))
    return F.when((a == 0) & (b == 0), F.lit(0.0)).when(angle < 0, angle + 360).otherwise(angle)


def lab_hue(lab: Column) -> Column:
    return hue_of(lab["b"], lab["a"])


def hue_delta(h1: Column, h2: Column) -> Column:
    """Angle between two hues, 0 to 180."""
    d = F.abs(h1 - h2)
    return F.when(d > 180, 360 - d).otherwise(d)


def lab_dist_sq(p: Column, q: Column) -> Column:
    square = lambda k: (p[k] - q[k]) * (p[k] - q[k])
    return square("l") + square("a") + square("b")


def _cos(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def with_ciede2000(df: DataFrame, p: str, q: str, name: str = "de") -> DataFrame:
    """df with the colour difference of its Lab struct columns p and q, kL = kC = kH = 1.

    Each intermediate value is a column of its own projection, so it is worked out once, in generated code. inline() at
    the end keeps later filters on the difference from being pushed below and taking it all apart again.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    seventh = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))
    t = lambda c: F.col(f"__de_{c}")

    def stage(rows: DataFrame, carried: tuple[str, ...], **new: Column) -> DataFrame:
        return rows.select(*keep, *map(t, carried), *[v.alias(f"__de_{k}") for k, v in new.items()])

    lab = {f"{k}{i}": F.col(f"{c}.{k}") for i, c in ((1, p), (2, q)) for k in "lab"}
    rows = stage(df, (), **lab)
    rows = stage(rows, tuple(lab), s=1 + 0.5 * (1 - seventh((F.sqrt(t("a1") * t("a1") + t("b1") * t("b1")) + F.sqrt(t("a2") * t("a2") + t("b2") * t("b2"))) / 2)))
    rows = stage(rows, ("l1", "l2", "b1", "b2"), p1=t("a1") * t("s"), p2=t("a2") * t("s"))
    rows = stage(rows, ("l1", "l2"), c1=F.sqrt(t("p1") * t("p1") + t("b1") * t("b1")), c2=F.sqrt(t("p2") * t("p2") + t("b2") * t("b2")), h1=hue_of(t("b1"), t("p1")), h2=hue_of(t("b2"), t("p2")))
    rows = stage(rows, ("l1", "l2", "c1", "c2"), grey=t("c1") * t("c2") == 0, turn=t("h2") - t("h1"), both=t("h1") + t("h2"))
    turn = F.when(t("grey"), 0.0).when(t("turn") > 180, t("turn") - 360).when(t("turn") < -180, t("turn") + 360).otherwise(t("turn"))
    mean_h = F.when(t("grey"), t("both")).when(F.abs(t("turn")) <= 180, t("both") / 2).when(t("both") < 360, t("both") / 2 + 180).otherwise(t("both") / 2 - 180)
    rows = stage(rows, ("c1", "c2"), turn=turn, mh=mean_h, mc=(t("c1") + t("c2")) / 2, off=(t("l1") + t("l2")) / 2 - 50, dl=t("l2") - t("l1"))
    weight = 1 - 0.17 * _cos(t("mh") - 30) + 0.24 * _cos(2 * t("mh")) + 0.32 * _cos(3 * t("mh") + 6) - 0.2 * _cos(4 * t("mh") - 63)
    bend = (t("mh") - 275) / 25
    rows = stage(
        rows,
        (),
        dl=t("dl") / (1 + 0.015 * t("off") * t("off") / F.sqrt(20 + t("off") * t("off"))),
        dc=(t("c2") - t("c1")) / (1 + 0.045 * t("mc")),
        dh=2 * F.sqrt(t("c1") * t("c2")) * F.sin(F.radians(t("turn") / 2)) / (1 + 0.015 * t("mc") * weight),
        rt=-F.sin(F.radians(60 * F.exp(-bend * bend))) * 2 * seventh(t("mc")),
    )
    total = F.sqrt(t("dl") * t("dl") + t("dc") * t("dc") + t("dh") * t("dh") + t("rt") * t("dc") * t("dh"))
    return rows.select(*keep, F.inline(F.array(F.struct(total.alias(name)))))


def weighted_lab_distance(source: Column, thread: Column) -> Column:
    """Squared cylindrical Lab distance of a source colour and a thread.

    Chroma differences count 0.7 times, hue chords 1 time up to a source chroma of 2, rising to 2.8 times at 8.
    """
    c1, c2 = lab_chroma(source), lab_chroma(thread)
    weight = 1 + 1.8 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c1 - 2) / 6))
    dl, dc = source["l"] - thread["l"], c1 - c2
    da, db = source["a"] - thread["a"], source["b"] - thread["b"]
    chord_sq = F.greatest(F.lit(0.0), da * da + db * db - dc * dc)
    return dl * dl + 0.49 * dc * dc + weight * weight * chord_sq


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Approximate lightness, 0 to 100, straight from gamma-coded channels."""
    y = (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0
    return 116 * F.cbrt(F.greatest(y, F.lit(0.0001))) - 16


def is_plain_white(r: Column, g: Column, b: Column, floor: int) -> Column:
    return (F.least(r, g, b) >= floor) & (F.greatest(r, g, b) - F.least(r, g, b) <= 8)


def palette_class(r: Column, g: Column, b: Column, background: Column | None = None, white: int = 230) -> Column:
    """'background' (as given, or all channels at least `white`), 'light' (luminance at least 78), else 'dark'."""
    behind = background if background is not None else F.least(r, g, b) >= white
    return F.when(behind, "background").when(luminance(r, g, b) >= 78, "light").otherwise("dark")
