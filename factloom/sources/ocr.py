"""Layout of recognised words: lines, ruled cells, borderless columns. Recognition itself is a plug-in.

A recogniser gives words (page_id, word, left, top, width, height, line_no);
what follows from their boxes is relational.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Recogniser = Callable[[DataFrame], DataFrame]


def available() -> bool:
    """Whether a recogniser is installed on this machine."""
    import shutil

    return shutil.which("tesseract") is not None


def recognise(images: DataFrame, recogniser: Recogniser | None) -> DataFrame:
    """Words of page images, by the given recogniser."""
    if recogniser is None:
        raise RuntimeError("no recogniser is installed")
    return recogniser(images)


def islands(cells: DataFrame, by: list[str], at: str, flag: str) -> DataFrame:
    """Runs of consecutive positions with a set flag: (by, start, end), as ruled lines show in a profile of ink."""
    window = Window.partitionBy(*by).orderBy(at)
    kept = cells.where(F.col(flag)).withColumn("run", F.col(at) - F.row_number().over(window))
    return kept.groupBy(*by, "run").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("run")


def words_in_cells(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words by the grid cell that holds their centre.

    The range join runs within a page: boxes are spread over bands of 64 units of
    height, so a word meets the boxes of its band only. Words at one place are
    ordered as their column is, numbers as numbers.
    """
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    w = words.withColumn("cx", x).withColumn("cy", y).withColumn("band", F.floor(F.col("cy") / 64))
    b = boxes.withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / 64), F.floor(F.col("y1") / 64))))
    inside = w.join(b, ["page_id", "band"]).where((F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") < F.col("y1")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.negative("left").alias("right_first"), "word")))
    return inside.groupBy("page_id", "row_no", "col_no").agg(F.array_join(F.transform(ordered, lambda s: s["word"].cast("string")), " ").alias("text"))


def lines(words: DataFrame) -> DataFrame:
    """Words of each line from right to left, with the line's top."""
    ordered = F.array_sort(F.collect_list(F.struct(F.negative("left").alias("right_first"), "word")))
    return words.groupBy("page_id", "line_no").agg(F.array_join(F.transform(ordered, lambda s: s["word"]), " ").alias("text"), F.min("top").alias("top"))


def borderless_columns(words: DataFrame, least_gap: float) -> DataFrame:
    """Words with a column number: a gap wider than least_gap between what is covered so far and a word opens a new column."""
    order = Window.partitionBy("page_id", "line_no").orderBy("left")
    covered = F.max(F.col("left") + F.col("width")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("left") - covered > least_gap, F.lit(False)).cast("int")
    return words.withColumn("opens", opens).withColumn("col_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def ink(gray: np.ndarray, dark: int = 128) -> np.ndarray:
    """Dark pixels of a grey image."""
    return gray < dark


def skew(mask: np.ndarray, most: float = 3.0, step: float = 0.25) -> float:
    """The angle in degrees whose shear makes the rows' ink profile sharpest; 0 for a page without ink."""
    y, x = np.nonzero(mask)
    if not len(y):
        return 0.0
    best, angle = -1.0, 0.0
    for a in sorted(np.arange(-most, most + step / 2, step), key=abs):
        rows = np.rint(y - np.tan(np.radians(a)) * x).astype(int)
        profile = np.bincount(rows - rows.min())
        sharp = float((np.diff(profile.astype(float)) ** 2).sum())
        if sharp > best * (1 + 1e-9):
            best, angle = sharp, float(a)
    return angle


def straighten(mask: np.ndarray, angle: float) -> np.ndarray:
    """The image sheared back by its skew."""
    out = np.zeros_like(mask)
    y, x = np.nonzero(mask)
    rows = np.rint(y - np.tan(np.radians(angle)) * x).astype(int)
    keep = (rows >= 0) & (rows < mask.shape[0])
    out[rows[keep], x[keep]] = True
    return out


def longest_runs(mask: np.ndarray) -> np.ndarray:
    """The longest run of set pixels in each row."""
    count, best = np.zeros(mask.shape[0], int), np.zeros(mask.shape[0], int)
    for column in mask.T:
        count = np.where(column, count + 1, 0)
        np.maximum(best, count, out=best)
    return best


def rules(mask: np.ndarray, share: float = 0.5) -> list[tuple[int, int]]:
    """(first, after last) rows of ruled lines: rows next to one another with a run over the given share of the width."""
    at = np.flatnonzero(longest_runs(mask) >= share * mask.shape[1])
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return [(int(a), int(b) + 1) for a, b in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)], strict=True)]


def grid_boxes(mask: np.ndarray, share: float = 0.5) -> list[tuple[int, int, int, int, int, int]]:
    """(row, column, x0, y0, x1, y1) of the cells between ruled lines."""
    ys, xs = rules(mask, share), rules(mask.T, share)
    return [(r, c, xs[c][1], ys[r][1], xs[c + 1][0], ys[r + 1][0]) for r in range(len(ys) - 1) for c in range(len(xs) - 1)]


def find_grids(images: DataFrame) -> DataFrame:
    """Cells of ruled tables on page images (page_id, width, height, grey pixels row by row), after straightening."""

    def run(batches):
        for batch in batches:
            out = []
            for page, width, height, pixels in zip(batch.page_id, batch.width, batch.height, batch.pixels, strict=True):
                mask = ink(np.frombuffer(pixels, np.uint8).reshape(height, width))
                angle = skew(mask)
                out += [(page, angle, *box) for box in grid_boxes(straighten(mask, angle) if angle else mask)]
            yield pd.DataFrame(out, columns=["page_id", "angle", "row_no", "col_no", "x0", "y0", "x1", "y1"])

    return images.select("page_id", "width", "height", "pixels").mapInPandas(run, "page_id long, angle double, row_no long, col_no long, x0 long, y0 long, x1 long, y1 long")


def better_reading(readings: DataFrame) -> DataFrame:
    """Of several readings of a cell (page_id, row_no, col_no, text, score) the best scored, the longest of equals."""
    return readings.groupBy("page_id", "row_no", "col_no").agg(F.max_by("text", F.struct("score", F.length("text"), "text")).alias("text"))
