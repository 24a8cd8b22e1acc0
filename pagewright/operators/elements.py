"""Elements of pages: whole texts, lines, words, images and annotations, as flat rows.

Ids are unique within a path.  Words of a line number from line * 1000, so a line of more
than a thousand words shares ids with the next one; (line_idx, word_idx) stays unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ExtractConfig, Layout
from ..functions.formats import image_format
from ..functions.text import fields, is_blank, lines
from ..schema import ELEMENTS

_KINDS = {
    "path": "string", "element_id": "string", "parent_id": "string", "level": "int", "type": "string", "page_number": "int",
    "line_idx": "int", "word_idx": "int", "text": "string", "detail": "string",
}


def element_id(prefix: str, page: Column, index: Column) -> Column:
    return F.format_string(f"{prefix}_%d_%d", page, index)


def _as_elements(df: DataFrame, **columns: Column) -> DataFrame:
    given = {"parent_id": F.lit(None), "level": F.lit(0), "line_idx": F.lit(None), "word_idx": F.lit(None), "font_size": F.lit(None), "detail": F.lit(None)} | columns
    return df.select(*[given.get(c, F.col(c)).cast(_KINDS.get(c, "double")).alias(c) for c in ELEMENTS])


def _line_box(layout: Layout, line: Column) -> dict[str, Column]:
    down = line * layout.pitch
    return {
        "llx": F.lit(layout.left), "lly": layout.first_baseline - down, "urx": F.lit(layout.right), "ury": layout.first_top - down,
        "width": F.lit(layout.width), "height": F.lit(layout.pitch),
    }


def _split_lines(pages: DataFrame) -> DataFrame:
    split = pages.select("path", "page_number", F.posexplode(lines(F.col("text"))).alias("line_idx", "text"))
    return split.where(~is_blank(F.col("text")))


def line_elements(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """A row for each line that is not blank; blank ones keep their place in the count."""
    return _as_elements(
        _split_lines(pages), type=F.lit("text"), element_id=element_id("line", F.col("page_number"), F.col("line_idx")),
        line_idx=F.col("line_idx"), font_size=F.lit(layout.font_size), confidence=F.lit(layout.line_confidence), **_line_box(layout, F.col("line_idx")),
    )


def word_elements(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """A row for each word, below its line; words share the line's width evenly."""
    counted = _split_lines(pages).withColumn("__words", fields(F.col("text"))).withColumn("__n", F.size("__words"))
    words = counted.select("path", "page_number", "line_idx", "__n", F.posexplode("__words").alias("word_idx", "text"))
    step = F.lit(layout.width) / F.col("__n")
    box = _line_box(layout, F.col("line_idx")) | {
        "llx": layout.left + F.col("word_idx") * step, "urx": layout.left + (F.col("word_idx") + 1) * step, "width": step,
    }
    return _as_elements(
        words, type=F.lit("text"), level=F.lit(1), element_id=element_id("word", F.col("page_number"), F.col("line_idx") * 1000 + F.col("word_idx")),
        parent_id=element_id("line", F.col("page_number"), F.col("line_idx")), line_idx=F.col("line_idx"), word_idx=F.col("word_idx"),
        font_size=F.lit(layout.font_size), confidence=F.lit(layout.word_confidence), **box,
    )



def page_elements(pages: DataFrame) -> DataFrame:
    """A row for each page with text, without a place on it."""
    zero = {k: F.lit(0.0) for k in ("llx", "lly", "urx", "ury", "width", "height")}
    return _as_elements(pages.where(F.col("text").isNotNull() & ~is_blank(F.col("text"))), type=F.lit("text"), element_id=element_id("text", F.col("page_number"), F.lit(0)), confidence=F.lit(1.0), **zero)


def page_images(parsed: DataFrame) -> DataFrame:
    """Every image object of every page: index, pixels, filter, colour space, bits, data and its hash."""
    rows = parsed.where("page_number is not null").select("path", "page_number", F.posexplode("images").alias("image_idx", "image"))
    bits = F.col("image.bits")
    return rows.select(
        "path", "page_number", "image_idx", F.col("image.name").alias("name"), F.coalesce("image.width", F.lit(0)).alias("width"), F.coalesce("image.height", F.lit(0)).alias("height"),
        F.col("image.filter").alias("filter"), F.col("image.color_space").alias("color_space"), bits.alias("bits"),
        F.octet_length("image.data").cast("long").alias("data_bytes"), F.sha2(F.coalesce("image.data", F.lit(b"")), 256).alias("sha256"),
    )


def image_elements(parsed: DataFrame) -> DataFrame:
    i = page_images(parsed)
    detail = F.to_json(F.struct(
        image_format(F.col("filter"), F.col("color_space")).alias("format"), F.coalesce("color_space", F.lit("Unknown")).alias("color_space"),
        F.coalesce(F.nullif("bits", F.lit(0)), F.lit(8)).alias("bits_per_component"), F.col("sha256").alias("hash"), F.col("data_bytes").alias("size"),
    ))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return _as_elements(i, type=F.lit("image"), element_id=element_id("image", F.col("page_number"), F.col("image_idx")), llx=F.lit(0.0), lly=F.lit(0.0), urx=w, ury=h, width=w, height=h, text=F.lit(None), detail=detail, confidence=F.lit(1.0))


def annotation_elements(parsed: DataFrame) -> DataFrame:
    """Annotations with a subtype, numbered among themselves; without a rectangle the box is zero."""
    typed = F.filter("annotations", lambda a: a["subtype"].isNotNull())
    rows = parsed.where("page_number is not null").select("path", "page_number", F.posexplode(typed).alias("idx", "a"))
    ok = F.size("a.rect") >= 4
    at = lambda k: F.when(ok, F.element_at("a.rect", k)).otherwise(0.0)
    llx, lly, urx, ury = (at(k) for k in range(1, 5))
    return _as_elements(rows, type=F.lit("annotation"), element_id=element_id("annotation", F.col("page_number"), F.col("idx")), llx=llx, lly=lly, urx=urx, ury=ury, width=urx - llx, height=ury - lly, text=F.coalesce("a.contents", F.lit("")), detail=F.col("a.subtype"), confidence=F.lit(1.0))


def no_elements(pages: DataFrame, kind: str) -> DataFrame:
    """Vector drawings and form fields are typed but not produced: no rows, the same columns."""
    zero = {k: F.lit(0.0) for k in ("llx", "lly", "urx", "ury", "width", "height")}
    return _as_elements(pages.where(F.lit(False)), type=F.lit(kind), element_id=F.lit(""), text=F.lit(None), confidence=F.lit(0.0), **zero)


def union_elements(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def select_pages(pages: DataFrame, requested: tuple[int, ...] | list[int]) -> DataFrame:
    """The requested pages in order, as often as requested; none requested means all.

    ``request_idx`` is the place in the request.
    """
    if not requested:
        place = F.row_number().over(W.partitionBy("path").orderBy("page_number")) - 1
        return pages.withColumn("request_idx", place.cast("int"))
    array = F.array(*[F.lit(int(p)) for p in requested])
    asked = pages.sparkSession.range(1).select(F.posexplode(array).alias("request_idx", "asked"))
    # as long as the request, which is part of the plan
    return pages.join(F.broadcast(asked), F.col("page_number") == F.col("asked")).drop("asked")


def extract(pages: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """All elements that the configuration switches on.  pages has at least path, page_number and
    text; images and annotations are read where it has those columns."""
    chosen = select_pages(pages, config.pages).drop("request_idx") if config.pages else pages
    parts = []
    if config.text:
        if config.by_line:
            parts.append(line_elements(chosen, config.layout))
            if config.coordinates:
                parts.append(word_elements(chosen, config.layout))
        else:
            parts.append(page_elements(chosen))
    if config.images and "images" in pages.columns:
        parts.append(image_elements(chosen))
    if config.vectors:
        parts.append(no_elements(chosen, "vector"))
    if config.forms:
        parts.append(no_elements(chosen, "form"))
    if config.annotations and "annotations" in pages.columns:
        parts.append(annotation_elements(chosen))
    return union_elements(parts) if parts else no_elements(chosen, "text")


def with_parents(elements: DataFrame) -> DataFrame:
    """Each element with its parent's text and box; roots have none."""
    p = elements.where("level = 0").select(F.col("path").alias("p_path"), F.col("element_id").alias("p_id"), F.col("text").alias("parent_text"), F.col("llx").alias("parent_llx"), F.col("urx").alias("parent_urx"))
    return elements.join(p, (F.col("path") == F.col("p_path")) & (F.col("parent_id") == F.col("p_id")), "left").drop("p_path", "p_id")


def element_order() -> list[Column]:
    return [F.col("path"), F.col("page_number"), F.col("type"), F.col("line_idx").asc_nulls_first(), F.col("word_idx").asc_nulls_first(), F.col("element_id")]


def first_elements(elements: DataFrame, n: int = 5) -> DataFrame:
    """The first n top-level elements in page order."""
    return elements.where("level = 0").orderBy(*element_order()).limit(n)
