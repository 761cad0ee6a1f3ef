"""Colours as column expressions: hexadecimal and functional notations, and conversions.

Colours are structs of ints red, green, blue and alpha.  Conversions run in single precision and cut
fractions off when they return to bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import f32 as q

EPSILON = 2.0**-23
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def rgba(r, g, b, a=255) -> Column:
    i = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(i(r).alias("red"), i(g).alias("green"), i(b).alias("blue"), i(a).alias("alpha"))


def hex_color(text: Column) -> Column:
    """Of 3, 4, 6 or 8 hexadecimal digits after an optional # or 0x, underscores ignored; else null."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(#|0x)", ""), "_", "")
    long = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    byte = lambda k: F.conv(F.substr(long, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int")
    alpha = F.when(F.length(long) == 8, byte(3)).otherwise(255)
    return F.when(digits.rlike("^([0-9A-Fa-f]{3}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), rgba(byte(0), byte(1), byte(2), alpha))


def _number(text: Column) -> Column:
    return F.when(text.rlike(f"^{_NUMBER}$"), text.try_cast("float"))


def _channel(text: Column) -> Column:
    v = _number(text)
    return F.when((v >= 0) & (v <= 255), q.round_away(v).cast("int"))


def _alpha(text: Column) -> Column:
    """A percentage, a share up to 1, or a byte value."""
    percent = F.endswith(text, F.lit("%"))
    v = _number(F.when(percent, F.trim(F.regexp_replace(text, "%$", ""))).otherwise(text))
    share = F.when(percent, q.mul(v, 0.01)).when(v > 1, q.div(v, 255.0)).otherwise(v)
    return F.when(v.isNotNull(), q.round_away(q.mul(q.clamp(share, 0.0, 1.0), 255.0)).cast("int"))


def _share(text: Column) -> Column:
    """A percentage or a number; what is above 1 without a sign counts as a percentage."""
    percent = F.endswith(text, F.lit("%"))
    v = _number(F.when(percent, F.trim(F.regexp_replace(text, "%$", ""))).otherwise(text))
    return q.clamp(F.when(percent | (v > 1), q.mul(v, 0.01)).otherwise(v), 0.0, 1.0)


def _hue(text: Column) -> Column:
    v = _number(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)\s*deg$", ""), r"\s*°$", ""))
    return q.f32(F.pmod(v, q.f32(360.0)))


def color_spec(text: Column) -> Column:
    """A fill colour: hexadecimal, then rgb(r,g,b[,a]), hsv(h,s,v), or three numbers with commas; else null."""
    parts = lambda x: F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")

    def three(p: Column) -> Column:
        """Struct of three channels, null unless all are fine."""
        c = F.struct(*[_channel(F.get(p, k)).alias(n) for k, n in enumerate("rgb")])
        return q.let(c, lambda v: F.when(v["r"].isNotNull() & v["g"].isNotNull() & v["b"].isNotNull(), v))

    def called(t: Column) -> Column:
        name = F.lower(F.trim(F.regexp_extract(t, r"(?s)^([^(]*)\(.*\)", 1)))

        def read(args: Column) -> Column:
            alpha = F.when(F.size(args) > 3, _alpha(F.get(args, 3))).otherwise(255)
            from_rgb = q.let(three(args), lambda v: q.let(alpha, lambda a: F.when(v.isNotNull() & a.isNotNull(), rgba(v["r"], v["g"], v["b"], a))))
            hsv = F.struct(_hue(F.get(args, 0)).alias("h"), _share(F.get(args, 1)).alias("s"), _share(F.get(args, 2)).alias("v"))
            from_hsv = q.let(hsv, lambda v: F.when(v["h"].isNotNull() & v["s"].isNotNull() & v["v"].isNotNull(), hsv_to_rgb(v["h"], v["s"], v["v"])))
            return F.when(name == "rgb", from_rgb).when(name == "hsv", from_hsv)

        # a call without any argument is none
        return q.let(parts(F.regexp_extract(t, r"(?s)\((.*)\)", 1)), lambda args: F.when(F.size(args) > 0, read(args)))

    def plain(t: Column) -> Column:
        return q.let(parts(t), lambda p: q.let(three(p), lambda v: F.when(F.size(p) >= 3, F.when(v.isNotNull(), rgba(v["r"], v["g"], v["b"])))))

    def spec(t: Column) -> Column:
        is_call = t.rlike(r"(?s)^[^(]*\(.*\)") & F.lower(F.trim(F.substring_index(t, "(", 1))).isin("rgb", "hsv")
        return F.coalesce(hex_color(t), F.when(is_call, called(t)).when(F.contains(t, F.lit(",")), plain(t)))

    return q.let(F.trim(text), spec)


def _with_unit(r, g, b, body) -> Column:
    """``body`` of the channels as shares of 255 and their high, low and delta, each worked out once."""
    shares = F.struct(q.div(r, 255.0).alias("r"), q.div(g, 255.0).alias("g"), q.div(b, 255.0).alias("b"))
    ends = lambda u: F.struct(u["r"].alias("r"), u["g"].alias("g"), u["b"].alias("b"), F.greatest(u["r"], u["g"], u["b"]).alias("high"), F.least(u["r"], u["g"], u["b"]).alias("low"))
    return q.let(shares, lambda u: q.let(ends(u), lambda e: q.let(q.sub(e["high"], e["low"]), lambda d: body(e, d))))


def _hue_of(e: Column, delta: Column) -> Column:
    near = lambda c: F.abs(q.sub(e["high"], e[c])) < EPSILON
    turn = lambda a, b: q.div(q.sub(e[a], e[b]), delta)
    hue = (
        F.when(F.abs(delta) < EPSILON, q.f32(0.0))
        .when(near("r"), q.mul(60.0, (turn("g", "b") % q.f32(6.0)).cast("float")))
        .when(near("g"), q.mul(60.0, q.add(turn("b", "r"), 2.0)))
        .otherwise(q.mul(60.0, q.add(turn("r", "g"), 4.0)))
    )
    return q.let(hue, lambda h: F.when(h < 0, q.add(h, 360.0)).otherwise(h))


def rgb_to_hsv(r, g, b) -> Column:
    def made(e: Column, delta: Column) -> Column:
        s = F.when(F.abs(e["high"]) < EPSILON, q.f32(0.0)).otherwise(q.div(delta, e["high"]))
        return F.struct(_hue_of(e, delta).alias("hue"), s.alias("saturation"), e["high"].alias("value"))

    return _with_unit(r, g, b, made)


def rgb_to_hsl(r, g, b) -> Column:
    def made(e: Column, delta: Column) -> Column:
        def lit(light: Column) -> Column:
            s = F.when(F.abs(delta) < EPSILON, q.f32(0.0)).otherwise(q.div(delta, q.sub(1.0, F.abs(q.fma(light, 2.0, -1.0)))))
            return F.struct(_hue_of(e, delta).alias("hue"), s.alias("saturation"), light.alias("lightness"))

        return q.let(q.mul(q.add(e["high"], e["low"]), 0.5), lit)

    return _with_unit(r, g, b, made)


def _byte(v: Column) -> Column:
    """Cut to a whole number from 0 to 255."""
    return q.to_int(v, 0, 255).cast("int")


def _wheel(hue: Column, chroma: Column, lift: Column) -> Column:
    """The colour of a hue with a chroma, lifted."""
    h0 = F.when(F.isnan(hue), q.f32(0.0)).otherwise(q.f32(F.pmod(hue, q.f32(360.0))))

    def picked(v: Column) -> Column:
        side = q.mul(v["c"], q.sub(1.0, F.abs(q.sub((q.div(v["h"], 60.0) % q.f32(2.0)).cast("float"), 1.0))))

        def channels(x: Column) -> Column:
            c, none = v["c"], q.f32(0.0)

            def pick(*by_sixth: Column) -> Column:
                out = by_sixth[5]
                for k in range(4, -1, -1):
                    out = F.when(v["h"] < 60.0 * (k + 1), by_sixth[k]).otherwise(out)
                return _byte(q.mul(q.add(out, v["m"]), 255.0))

            return rgba(pick(c, x, none, none, x, c), pick(x, c, c, x, none, none), pick(none, none, x, c, c, x))

        return q.let(side, channels)

    return q.let(F.struct(h0.alias("h"), q.f32(chroma).alias("c"), q.f32(lift).alias("m")), picked)


def hsv_to_rgb(h, s, v) -> Column:
    def made(u: Column) -> Column:
        gray = _byte(q.mul(u["v"], 255.0))
        c = q.mul(u["v"], u["s"])
        return F.when(u["s"] <= 0, rgba(gray, gray, gray)).otherwise(_wheel(u["h"], c, q.sub(u["v"], c)))

    return q.let(F.struct(q.f32(h).alias("h"), q.f32(s).alias("s"), q.f32(v).alias("v")), made)


def hsl_to_rgb(h, s, light) -> Column:
    def made(u: Column) -> Column:
        c = q.mul(q.sub(1.0, F.abs(q.fma(u["l"], 2.0, -1.0))), u["s"])
        return _wheel(u["h"], c, q.sub(u["l"], q.mul(c, 0.5)))

    return q.let(F.struct(q.f32(h).alias("h"), q.f32(s).alias("s"), q.f32(light).alias("l")), made)


def rgb_to_cmyk(r, g, b) -> Column:
    def made(e: Column, _: Column) -> Column:
        k = q.sub(1.0, e["high"])
        black = F.abs(q.sub(1.0, k)) < EPSILON
        ink = lambda v: F.when(black, q.f32(0.0)).otherwise(q.div(q.sub(q.sub(1.0, v), k), q.sub(1.0, k)))
        return F.struct(ink(e["r"]).alias("cyan"), ink(e["g"]).alias("magenta"), ink(e["b"]).alias("yellow"), F.when(black, q.f32(1.0)).otherwise(k).alias("key"))

    return _with_unit(r, g, b, made)


def cmyk_to_rgb(c, m, y, k) -> Column:
    channel = lambda v: _byte(q.mul(q.mul(255.0, q.sub(1.0, v)), q.sub(1.0, k)))
    return rgba(channel(c), channel(m), channel(y))
