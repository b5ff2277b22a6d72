"""OCR words to text: lines by block, paragraph and line, a page only if its words are trusted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import images
from tallyframe.functions.scalars import trimmed

#: Least mean confidence of a page; the most characters of a hint; least confidence of the other engine's lines.
LEAST_CONFIDENCE, HINT_CHARS, LEAST_LINE = 35.0, 6000, 0.5


def kept_words(words: DataFrame) -> DataFrame:
    """Words (page, idx, text, conf, block, par, line) that aren't blank and have a confidence of 0 or more."""
    conf = F.col("conf").cast("string").try_cast("double")
    return words.where((trimmed("text") != "") & conf.isNotNull() & ~F.isnan(conf) & (conf >= 0)).withColumn("conf", conf)


def lines(words: DataFrame) -> DataFrame:
    """(page, block, par, line, text, n, conf): words of each line in input order; ``conf`` is their sum."""
    row = F.sort_array(F.collect_list(F.struct("idx", "text")))
    # dealt by page once, which serves the lines and whatever is made of a page's lines
    return kept_words(words).repartition("page").groupBy("page", "block", "par", "line").agg(F.concat_ws(" ", F.transform(row, lambda x: x["text"])).alias("text"), F.count("*").alias("n"), F.sum("conf").alias("conf"))


def confidence(words: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(page, mean_conf, trusted): the mean over a page's words."""
    pages = kept_words(words).groupBy("page").agg(F.avg("conf").alias("mean_conf"))
    return pages.select("page", "mean_conf", (F.col("mean_conf") >= least).alias("trusted"))


def page_text(words: DataFrame, least: float = LEAST_CONFIDENCE, most: int = HINT_CHARS) -> DataFrame:
    """(page, mean_conf, text): lines in order; empty where the mean confidence is too low."""
    pages = lines(words).groupBy("page").agg((F.sum("conf") / F.sum("n")).alias("mean_conf"), F.sort_array(F.collect_list(F.struct("block", "par", "line", "text"))).alias("rows"))
    text = F.substring(trimmed(F.concat_ws("\n", F.transform("rows", lambda x: x["text"]))), 1, most)
    return pages.select("page", "mean_conf", F.when(F.col("mean_conf") >= least, text).otherwise("").alias("text"))


def trusted_lines(found: DataFrame, least: float = LEAST_LINE) -> DataFrame:
    """Lines of an engine that rates whole lines."""
    return found.where((trimmed("text") != "") & (F.col("confidence") >= least))


def skew_action(dark_pixels: Column, angle: Column, least_pixels: int = 100, least: float = 0.3, most: float = 15.0) -> Column:
    """Whether a page is turned: not with too little ink, nor for tiny or implausible angles."""
    return F.when(dark_pixels < least_pixels, "blank").when(F.abs(angle) < least, "straight").when(F.abs(angle) > most, "implausible").otherwise("turn")


def fallback_lines(text: DataFrame, rows: int = 80, width: int = 120, top: int = 20, step: int = 18, bottom: int = 1550) -> DataFrame:
    """(doc_id, line_no, y, line): what a page drawn from plain text shows of it."""
    out = text.select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, rows)).alias("line_no", "line"))
    return out.withColumn("y", top + step * F.col("line_no")).where(F.col("y") <= bottom).select("doc_id", "line_no", "y", F.substring("line", 1, width).alias("line"))


def prepared(pages: DataFrame, quarter_turns: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(path, page_pos, height, width, pixels, turned, degrees): pages of raw pixels (one byte each, or three) made grey, righted, clear.

    ``quarter_turns`` is the caller's detector of orientation, in degrees clockwise; a page on
    which it fails isn't turned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, pos, h, w, data in zip(rows["path"], rows["page_pos"], rows["height"], rows["width"], rows["pixels"]):
                x = np.frombuffer(data, np.uint8)
                x = images.grey(x.reshape(h, w) if len(x) == h * w else x.reshape(h, w, 3))
                try:
                    degrees = int(quarter_turns(x)) % 360 if quarter_turns else 0
                except Exception:  # noqa: BLE001  the detector is the caller's
                    degrees = 0
                x, tilt = images.deskewed(images.turned(x, degrees))
                x = images.enhanced(x)
                out.append((path, pos, x.shape[0], x.shape[1], x.tobytes(), degrees, tilt))
            yield pd.DataFrame(out, columns=["path", "page_pos", "height", "width", "pixels", "turned", "degrees"])

    return pages.select("path", "page_pos", "height", "width", "pixels").mapInPandas(run, "path string, page_pos int, height int, width int, pixels binary, turned int, degrees double")


def first_reading(pages: DataFrame, engines: list[Callable[[np.ndarray], str]]) -> DataFrame:
    """(path, page_pos, text): what the first engine that reads anything on a page reads; one that fails is passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, pos, h, w, data in zip(rows["path"], rows["page_pos"], rows["height"], rows["width"], rows["pixels"]):
                text = ""
                for read in engines:
                    try:
                        text = (read(np.frombuffer(data, np.uint8).reshape(h, w)) or "").strip()
                    except Exception:  # noqa: BLE001  the engines are the caller's
                        text = ""
                    if text:
                        break
                out.append((path, pos, text[:HINT_CHARS]))
            yield pd.DataFrame(out, columns=["path", "page_pos", "text"])

    return pages.select("path", "page_pos", "height", "width", "pixels").mapInPandas(run, "path string, page_pos int, text string")
