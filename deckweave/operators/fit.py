"""How a text is laid out in the box of the one it replaces.

A width is measured as half the font size a character unless another measure is
given.  The first step of the plan (one line, closed form) is a SQL expression;
what is left goes through an Arrow-batched function.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SIZE, STEP, SLACK = 6.0, 0.5, 1.0
LINE_RATIO, ASCENT, COVER, MARGIN, FLOOR_GAP, TOUCH = 1.15, 0.8, 0.5, 18.0, 2.0, 0.5
UNIT = 0.5
DECISIONS = ("fit-original", "wrap-fit", "fit-shrunk", "truncated", "no-room")


def room(df: DataFrame, floor: str = "next_top") -> DataFrame:
    """Adds room_left, room_top, room_width and room_height of boxes left, right, bottom, top: down to the next line's top or the margin, within the container where the box is."""
    low = F.greatest(F.lit(MARGIN), F.coalesce(F.col(floor) + FLOOR_GAP, F.lit(MARGIN)))
    left, right, top = F.col("left"), F.col("right"), F.col("top")
    if "c_left" in df.columns:
        left = F.when((left >= F.col("c_left") - TOUCH) & (left < F.col("c_left")), F.col("c_left")).otherwise(left)
        right = F.when((right <= F.col("c_right") + TOUCH) & (right > F.col("c_right")), F.col("c_right")).otherwise(right)
        top = F.when((top <= F.col("c_top") + TOUCH) & (top > F.col("c_top")), F.col("c_top")).otherwise(top)
        low = F.when((F.col("bottom") >= F.col("c_bottom") - TOUCH) & (low < F.col("c_bottom")), F.col("c_bottom")).otherwise(low)
    return df.withColumns({"room_left": left, "room_top": top, "room_width": F.greatest(F.lit(1.0), right - left), "room_height": F.greatest(F.lit(0.0), top - low)})


def one_line_size(text: Column, size: Column, width: Column, height: Column) -> Column:
    """The font size at which a text fits on one line, in steps, null if none from the least size up does."""
    unit = F.length(text) * UNIT
    fit = F.floor(F.least(size, F.try_divide(width + SLACK, unit)) / STEP) * STEP
    return F.when((unit > 0) & (fit >= LEAST_SIZE) & (fit * LINE_RATIO <= height + SLACK), fit)


def single_line(df: DataFrame) -> DataFrame:
    """Adds fit_size and decision: fit-original, fit-shrunk, or wrap for what doesn't go on one line."""
    own = df.withColumn("fit_size", one_line_size(F.col("text"), F.col("font_size"), F.col("room_width"), F.col("room_height")))
    whole = F.col("fit_size") >= F.col("font_size") - 1e-6
    return own.withColumn("decision", F.when(F.col("fit_size").isNull(), "wrap").when(whole, "fit-original").otherwise("fit-shrunk"))


def packed(text: Column, fits: Callable[[Column], Column]) -> Column:
    """A text's words packed into lines as long as the joined line fits; a longer word has a line of its own."""
    words = F.filter(F.split(text, "[\\s\\x{0B}\\x{A0}]+"), lambda w: w != "")

    def pack(lines: Column, word: Column) -> Column:
        joined = F.concat(F.element_at(lines, -1), F.lit(" "), word)
        return F.when((F.size(lines) > 0) & fits(joined), F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(joined))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, F.array().cast("array<string>"), pack)


def wrapped(text: Column, most: Column) -> Column:
    """A text's words packed into lines of at most ``most`` characters."""
    return packed(text, lambda line: F.length(line) <= most)


def measure(text: str, size: float) -> float:
    return len(text) * size * UNIT


def wrap(text: str, size: float, width: float, of: Callable[[str, float], float] = measure) -> list[str]:
    lines: list[str] = []
    for word in text.split():
        if lines and of(f"{lines[-1]} {word}", size) <= width + SLACK:
            lines[-1] = f"{lines[-1]} {word}"
        else:
            lines.append(word)
    return lines


def plan(text: str | None, size: float, width: float, height: float, of: Callable[[str, float], float] = measure) -> tuple[str, float, list[str]]:
    """(decision, font size, lines): one line, else wrapped lines at ever smaller sizes, else cut at the least size, else no room."""
    text = text or ""
    unit = of(text, 1.0)
    if unit > 0:
        fit = math.floor(min(size, (width + SLACK) / unit) / STEP) * STEP
        if fit >= LEAST_SIZE and fit * LINE_RATIO <= height + SLACK and of(text, fit) <= width + SLACK:
            return ("fit-original" if fit >= size - 1e-6 else "fit-shrunk"), fit, [text]
    now = size
    while now >= LEAST_SIZE:
        lines = wrap(text, now, width, of)
        if not lines:
            break
        if len(lines) * now * LINE_RATIO <= height + SLACK:
            whole = "fit-original" if len(lines) == 1 else "wrap-fit"
            return (whole if now == size else "fit-shrunk"), now, lines
        now -= STEP
    lines = wrap(text, LEAST_SIZE, width, of)
    most = math.floor(height / (LEAST_SIZE * LINE_RATIO))
    if most < 1 or not lines:
        return "no-room", LEAST_SIZE, []
    lines = lines[:most]
    while lines[-1] and of(lines[-1] + "...", LEAST_SIZE) > width + SLACK:
        lines[-1] = lines[-1][:-1]
    return "truncated", LEAST_SIZE, [*lines[:-1], lines[-1] + "..."]


def plan_fit(df: DataFrame, keys: list[str], of: Callable[[str, float], float] | None = None) -> DataFrame:
    """(keys..., decision, size, lines) for rows with text, font_size, room_width, room_height.

    With the plain measure the plan is one expression on the JVM: the one-line
    step, then the first of the sizes from the font's down to the least at which
    the wrapped lines fit, then a cut.  Another measure goes through ``plan`` in
    Arrow batches.
    """
    own = df.select(*keys, "text", "font_size", "room_width", "room_height")
    if of is not None:
        return _planned(own, keys, of)
    width, height, text = F.col("room_width"), F.col("room_height"), F.coalesce("text", F.lit(""))
    at = lambda size: packed(text, lambda line: F.length(line) * size * UNIT <= width + SLACK)
    one = one_line_size(text, F.col("font_size"), width, height)
    steps = F.floor((F.col("font_size") - LEAST_SIZE) / STEP).cast("int")
    sizes = F.when(steps >= 1, F.transform(F.sequence(F.lit(1), steps), lambda k: F.col("font_size") - k * STEP)).otherwise(F.array().cast("array<double>"))
    fits = lambda t: F.size(t["lines"]) * t["size"] * LINE_RATIO <= height + SLACK
    whole = F.when(one.isNull() & (F.trim(text) != "") & (F.col("font_size") >= LEAST_SIZE), F.struct(F.col("font_size").alias("size"), at(F.col("font_size")).alias("lines")))
    own = own.withColumns({"one": one, "whole": whole}).withColumn("whole", F.when(fits(F.col("whole")), F.col("whole")))
    tried = F.when(F.col("one").isNull() & F.col("whole").isNull() & (F.trim(text) != ""), F.transform(sizes, lambda s: F.struct(s.alias("size"), at(s).alias("lines"))))
    own = own.withColumn("tried", F.filter(tried, fits))
    own = own.withColumns({"best": F.coalesce("whole", F.try_element_at("tried", F.lit(1))), "least": F.when(F.col("one").isNull() & F.col("whole").isNull() & (F.size(F.coalesce("tried", F.array())) == 0), at(F.lit(LEAST_SIZE)))})
    most = F.floor(height / (LEAST_SIZE * LINE_RATIO)).cast("int")
    room_left = F.greatest(F.lit(0), F.floor((width + SLACK) / (LEAST_SIZE * UNIT)).cast("int") - 3)
    kept = F.slice("least", 1, F.greatest(most, F.lit(1)))
    cut = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.concat(F.left(F.element_at(kept, -1), room_left), F.lit("..."))))
    none = (most < 1) | (F.size("least") == 0)
    kind = F.when(F.size("best.lines") == 1, "fit-original").otherwise("wrap-fit")
    return own.select(
        *keys,
        F.when(F.col("one").isNotNull(), F.when(F.col("one") >= F.col("font_size") - 1e-6, "fit-original").otherwise("fit-shrunk"))
        .when(F.col("best").isNotNull(), F.when(F.col("best.size") == F.col("font_size"), kind).otherwise("fit-shrunk")).when(none, "no-room").otherwise("truncated").alias("decision"),
        F.coalesce("one", "best.size", F.lit(LEAST_SIZE)).alias("size"),
        F.when(F.col("one").isNotNull(), F.array(text)).when(F.col("best").isNotNull(), F.col("best.lines")).when(none, F.array().cast("array<string>")).otherwise(cut).alias("lines"),
    )


def _planned(own: DataFrame, keys: list[str], of: Callable[[str, float], float]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    shape = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", decision string, size double, lines array<string>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plans = [plan(*row, of) for row in pdf[["text", "font_size", "room_width", "room_height"]].itertuples(index=False)]
            yield pdf[keys].assign(decision=[p[0] for p in plans], size=[p[1] for p in plans], lines=[p[2] for p in plans])

    return own.mapInPandas(work, shape)


def drawn(plans: DataFrame) -> DataFrame:
    """Adds the rectangle that covers the replaced text and where the first line is drawn, for plans with left, right, room_left and room_top.

    The cover is as wide as the replaced box or the longest planned line, as deep
    as the planned lines, with ``COVER`` round it; the first line's base lies
    ``ASCENT`` of its size under the top.
    """
    longest = F.coalesce(F.array_max(F.transform("lines", F.length)), F.lit(0)) * F.col("size") * UNIT
    deep = F.size("lines") * F.col("size") * LINE_RATIO
    return plans.withColumns({
        "cover_x": F.col("room_left") - COVER, "cover_y": F.col("room_top") - deep - COVER, "cover_width": F.greatest(F.col("right") - F.col("left"), longest) + 2 * COVER, "cover_height": deep + 2 * COVER,
        "draw_x": F.col("room_left"), "draw_y": F.col("room_top") - F.col("size") * ASCENT,
    })


def tally(plans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Plans counted by decision, in one row or one for each of some keys."""
    counts = [F.count_if(F.col("decision") == d).alias(d.replace("-", "_")) for d in DECISIONS]
    shown = F.col("decision").isin("fit-original", "wrap-fit", "fit-shrunk", "truncated")
    return plans.groupBy(*keys).agg(*counts, F.count_if(shown).alias("overlays"), F.count_if(~shown).alias("skipped"))
