"""From positioned text items to lines, headings and paragraphs.

Tables: items (doc, page, seq, text, x, y, font_size, font_name, width) with seq
the arrival order within a page; boxes (doc, page, seq, x, y, width, height).
Every join and window has the page as its key, so nothing is a bare range join
and no group is larger than a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckweave.functions import text as T

Y_TOLERANCE = 3.0
CONTAIN_SLACK = 1.0
LEAST_SIDE, MOST_PAGE = 5.0, 0.85
HEADING, BOLD_HEADING = 1.25, 1.05
SPACE_GAP = 0.45
PAGE = ["doc", "page"]


def usable_items(items: DataFrame) -> DataFrame:
    """Items with a text; blank ones only if they are a single space."""
    return items.where((F.col("text") == " ") | (T.strip(F.col("text")) != ""))


def item_box(df: DataFrame) -> DataFrame:
    """Adds left, bottom, right, top of each item; an unknown width is taken as half the font size a character."""
    wide = F.coalesce(F.col("width"), F.length("text") * F.col("font_size") * 0.5)
    low = F.col("y") - F.col("font_size") * 0.25
    return df.withColumns({"left": F.col("x"), "right": F.col("x") + wide, "bottom": low, "top": low + F.col("font_size") * 1.1})


def containers(boxes: DataFrame, page_area: float | None = None) -> DataFrame:
    """Adds area and container_id (by area from the largest, then seq) to the boxes that can hold text."""
    own = boxes.withColumn("area", F.col("width") * F.col("height"))
    own = own.where(f"NOT isnan(width) AND NOT isnan(height) AND width >= {LEAST_SIDE} AND height >= {LEAST_SIDE}")
    if page_area is not None:
        own = own.where(F.col("area") <= page_area * MOST_PAGE)
    return own.withColumn("container_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("area"), "seq")))


def container_depth(held: DataFrame) -> DataFrame:
    """Adds depth: how many strictly larger boxes of the page hold the box."""
    o = held.select(*PAGE, *(F.col(c).alias(f"o_{c}") for c in ("container_id", "area", "x", "y", "width", "height")))
    e = CONTAIN_SLACK
    inside = f"o_area > area AND x >= o_x - {e} AND y >= o_y - {e} AND x + width <= o_x + o_width + {e} AND y + height <= o_y + o_height + {e}"
    hits = held.join(o, PAGE).where(inside).groupBy(*PAGE, "container_id").agg(F.count("*").alias("depth"))
    return held.join(hits, [*PAGE, "container_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("bigint"))


def assign_containers(items: DataFrame, held: DataFrame) -> DataFrame:
    """Adds container_id: the smallest box that holds the item, the lowest id on a tie, null if none does."""
    e = CONTAIN_SLACK
    box = held.select(*PAGE, "container_id", F.col("area").alias("b_area"), *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "width", "height")))
    own = item_box(items)
    inside = f"left >= b_x - {e} AND bottom >= b_y - {e} AND right <= b_x + b_width + {e} AND top <= b_y + b_height + {e}"
    best = own.join(box, PAGE).where(inside).groupBy(*PAGE, "seq").agg(F.min_by("container_id", F.struct("b_area", "container_id")).alias("container_id"))
    return items.join(best, [*PAGE, "seq"], "left")


def y_buckets(items: DataFrame) -> DataFrame:
    """(doc, page, seq, bucket, bucket_y): each item joins the first bucket within the tolerance, whose height moves halfway to it, else opens one.

    The fold follows arrival order and can't be split, so it runs as an ``aggregate`` over one page's items on the JVM.
    """
    own = items.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("seq", "y"))).alias("all"))
    fold = f"""aggregate(all, named_struct('b', array() :: array<double>, 'at', array() :: array<int>),
      (s, i) -> named_struct(
        'b', if(exists(s.b, y -> abs(y - i.y) <= {Y_TOLERANCE}),
                transform(s.b, (y, k) -> if(k = array_position(transform(s.b, v -> abs(v - i.y) <= {Y_TOLERANCE}), true) - 1, (y + i.y) / 2, y)),
                concat(s.b, array(i.y))),
        'at', concat(s.at, array(if(exists(s.b, y -> abs(y - i.y) <= {Y_TOLERANCE}),
                cast(array_position(transform(s.b, v -> abs(v - i.y) <= {Y_TOLERANCE}), true) AS INT), size(s.b) + 1)))))"""
    own = own.withColumn("state", F.expr(fold))
    own = own.select(*PAGE, "state.b", F.explode(F.arrays_zip(F.expr("transform(all, i -> i.seq)").alias("seq"), F.col("state.at").alias("bucket"))).alias("z"))
    return own.select(*PAGE, F.col("z.seq").alias("seq"), F.col("z.bucket").alias("bucket"), F.expr("b[z.bucket - 1]").alias("bucket_y"))


def _spaced(items: DataFrame, line: list[str]) -> DataFrame:
    """Adds piece: the item's text, after a space where a gap is wider than ``SPACE_GAP`` of the font and none is there."""
    w = Window.partitionBy(*line).orderBy("x", "seq")
    before = {c: F.lag(c).over(w) for c in ("text", "x", "width", "font_size")}
    own = items.withColumns({f"p_{c}": v for c, v in before.items()})
    reach = F.col("p_x") + F.coalesce(F.col("p_width"), F.length("p_text") * F.col("p_font_size") * 0.5)
    spaced = F.col("p_text").rlike(f"{T.SPACE}\\z") | F.col("text").rlike(f"^{T.SPACE}")
    gap = ~spaced & (F.col("x") - reach > F.col("p_font_size") * SPACE_GAP)
    return own.withColumn("piece", F.when(F.coalesce(gap, F.lit(False)), F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))


def _line_text() -> Column:
    return T.collapse(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "seq", "piece"))), lambda p: p["piece"]), ""))


def _line_size() -> list[Column]:
    return [F.greatest(F.max("font_size"), F.lit(0.0)).alias("font_size"), F.bool_or(F.coalesce(F.col("font_name").rlike(T.BOLD), F.lit(False))).alias("bold")]


def joined_text(items: DataFrame, line: list[str]) -> DataFrame:
    """(line..., text): a line's items from left to right, spaces put where gaps ask for them."""
    return _spaced(items, line).groupBy(*line).agg(_line_text().alias("text"))


def line_boxes(items: DataFrame, line: list[str]) -> DataFrame:
    """(line..., left, right, bottom, top, baseline, font_size) of each line; the baseline is its first item's."""
    return items.groupBy(*line).agg(*_line_box(), F.max("font_size").alias("font_size"))


def line_sizes(items: DataFrame, line: list[str]) -> DataFrame:
    """(line..., font_size, bold): the largest size, not under 0, and whether any item is bold."""
    return items.groupBy(*line).agg(*_line_size())


def lines_of(items: DataFrame, line: list[str], boxes: bool = False) -> DataFrame:
    """(line..., text, font_size, bold) in one pass over the items: one exchange by the line serves the gaps and the sums; with ``boxes`` also left, right, bottom, top, baseline."""
    return _spaced(items, line).groupBy(*line).agg(_line_text().alias("text"), *_line_size(), *(_line_box() if boxes else ()))


def _line_box() -> list[Column]:
    wide = F.coalesce(F.col("width"), F.length("text") * F.col("font_size") * 0.5)
    return [
        F.min("x").alias("left"), F.max(F.col("x") + wide).alias("right"), F.min(F.col("y") - F.col("font_size") * 0.25).alias("bottom"),
        F.max(F.col("y") + F.col("font_size") * 0.85).alias("top"), F.min_by("y", F.struct("x", "seq")).alias("baseline"),
    ]


def baselines(lines: DataFrame) -> DataFrame:
    """(doc, baseline): the exact median of the positive sizes of a document's lines; 0 if it has none."""
    return lines.groupBy("doc").agg(F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(0.0)).alias("baseline"))


def heading_rule(size: Column, bold: Column, text: Column, baseline: Column) -> Column:
    """Large text, slightly larger bold text that isn't long, and short bold capitals are headings, as far as there is a baseline."""
    large = size >= baseline * HEADING
    emphasised = bold & (size >= baseline * BOLD_HEADING) & (F.length(text) < 120)
    capitals = bold & (F.length(text) < 80) & text.rlike(T.CAPS_HEADING)
    return F.when((baseline > 0) & (large | emphasised | capitals), "heading").otherwise("paragraph")


def reflow(elements: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """Paragraphs that were wrapped over several lines as one: (page..., part, type, text, container_id), and boxes where the elements have a list of them: all boxes of the merged lines in their order.

    A line goes on with the one before it iff both are paragraphs of one
    container, the one before doesn't end a sentence, and it starts no list item.
    Whether it does depends on its neighbour alone, so a lag and a running sum
    find the paragraphs.  ``elements`` has type, text, container_id; noise must be gone.
    """
    w = Window.partitionBy(*page).orderBy(*order)
    p = {c: F.lag(c).over(w) for c in ("type", "text", "container_id")}
    goes_on = (F.col("type") == "paragraph") & (p["type"] == "paragraph") & F.col("container_id").eqNullSafe(p["container_id"])
    goes_on = goes_on & ~p["text"].rlike(T.SENTENCE_FINAL) & ~F.col("text").rlike(T.LIST_START)
    own = elements.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    own = own.withColumns({"part": F.sum("new").over(w), "at": F.row_number().over(w)})
    boxes = ["boxes"] if "boxes" in elements.columns else []
    item = F.struct("at", "text", *boxes)
    own = own.groupBy(*page, "part").agg(F.min_by("type", "at").alias("type"), F.sort_array(F.collect_list(item)).alias("all"), F.min_by("container_id", "at").alias("container_id"))
    merged = F.regexp_replace(F.array_join(F.expr("transform(all, (x, i) -> if(i = 0, x.text, trim(x.text)))"), " "), f"{T.SPACE}+", " ")
    return own.select(*page, "part", "type", F.when(F.size("all") > 1, merged).otherwise(F.expr("all[0].text")).alias("text"), "container_id", *(F.flatten(F.expr(f"transform(all, x -> x.{b})")).alias(b) for b in boxes))


def next_top(boxes: DataFrame, page: list[str], order: list[Column | str]) -> DataFrame:
    """Adds next_top: the top of the line under each one, null under the last."""
    return boxes.withColumn("next_top", F.lead("top").over(Window.partitionBy(*page).orderBy(*order)))


def union_box(boxes: str = "boxes") -> Column:
    """The box (left, right, bottom, top) round a list of them."""
    side = lambda f, name: f(F.transform(boxes, lambda b: b[name])).alias(name)
    return F.struct(side(F.array_min, "left"), side(F.array_max, "right"), side(F.array_min, "bottom"), side(F.array_max, "top"))


def candidate_boxes(*kinds: DataFrame) -> DataFrame:
    """Boxes of several kinds (drawn paths, bare rectangles) as one table (doc, page, seq, x, y, width, height): those of the first kind come first in seq, and negative sides are turned round."""
    out = None
    for n, kind in enumerate(kinds):
        own = kind.select(*PAGE, F.lit(n).alias("kind"), F.col("seq").alias("own_seq"), F.least("x", F.col("x") + F.col("width")).alias("x"), F.least("y", F.col("y") + F.col("height")).alias("y"), F.abs("width").alias("width"), F.abs("height").alias("height"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("seq", F.row_number().over(Window.partitionBy(*PAGE).orderBy("kind", "own_seq"))).drop("kind", "own_seq")


def without_noise(elements: DataFrame) -> DataFrame:
    return elements.where(~T.noise(F.col("text")))


def compact(elements: DataFrame, page: list[str], order: str) -> DataFrame:
    """(page..., lines): elements as {h} or {p} with their container, in order."""
    line = F.struct(F.col(order).alias("at"), F.when(F.col("type") == "heading", F.col("text")).alias("h"), F.when(F.col("type") != "heading", F.col("text")).alias("p"), F.col("container_id").alias("c"))
    return elements.groupBy(*page).agg(F.sort_array(F.collect_list(line)).alias("all")).select(*page, F.expr("transform(all, x -> struct(x.h AS h, x.p AS p, x.c AS c))").alias("lines"))


def splits_prevented(items: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, splits): by how much each page has more lines than crude heights, added up."""
    heights = items.where(T.strip(F.col("text")) != "").groupBy(*PAGE).agg(F.countDistinct(F.floor(F.col("y") / Y_TOLERANCE + 0.5)).alias("heights"))
    counts = lines.groupBy(*PAGE).agg(F.count("*").alias("lines"))
    both = counts.join(heights, PAGE, "left").withColumn("more", F.greatest(F.lit(0), F.col("lines") - F.coalesce("heights", F.lit(0))))
    return both.groupBy("doc").agg(F.sum("more").cast("bigint").alias("splits"))


def extract(items: DataFrame, held: DataFrame) -> DataFrame:
    """The whole way: (doc, page, line_no, type, text, container_id) before noise and reflow."""
    own = usable_items(items).withColumn("font_size", F.abs("font_size"))
    own = assign_containers(own, held).join(y_buckets(own), [*PAGE, "seq"])
    own = own.withColumn("container", F.coalesce("container_id", F.lit(-1)))
    lines = lines_of(own, [*PAGE, "bucket", "bucket_y", "container"])
    positive = F.when(F.col("font_size") > 0, F.col("font_size"))
    lines = lines.withColumn("baseline", F.coalesce(F.median(positive).over(Window.partitionBy("doc")), F.lit(0.0))).where("text <> ''")
    lines = lines.withColumn("type", heading_rule(F.col("font_size"), F.col("bold"), F.col("text"), F.col("baseline")))
    order = Window.partitionBy(*PAGE).orderBy(F.desc(F.round("bucket_y", 3)), "container", "bucket")
    return lines.select(*PAGE, F.row_number().over(order).alias("line_no"), "type", "text", F.nullif("container", F.lit(-1)).alias("container_id"))
