"""Where characters and signs stand: sizes, gaps on a line, signs and their pieces, pages and their templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# From which bottom a mark is above its letter, from which advance it stands beside it, within what it
# stands on the baseline; how far a measured size may leave the font's; the shares that name a page's template.
ABOVE, BESIDE, BASELINE = 0.9, 0.1, 0.05
LEAST_SIZE, MOST_SIZE = 0.5, 2.0
LACKS, TIMES = 0.05, 2.0


def above_sign(kind: Column, bottom: Column) -> Column:
    return (kind == "mark") & (bottom >= ABOVE)


def on_line(kind: Column, bottom: Column, advance: Column, beside: Column | bool = False) -> Column:
    """Whether a character stands on the line: a base, a sign beside its letter, or one above where such are written beside."""
    beside = beside if isinstance(beside, Column) else F.lit(beside)
    return (kind == "base") | (advance > BESIDE) | (beside & above_sign(kind, bottom))


def sized(priors: DataFrame, measured: DataFrame, key: str = "ch") -> DataFrame:
    """Priors (key, kind, w, bottom, top) with measured sizes (key, w, h) where there are any, within bounds of the font's.

    A sign below the line keeps its top, everything else its bottom.
    """
    m = measured.select(key, F.col("w").alias("w_"), F.col("h").alias("h_"))
    height = F.col("top") - F.col("bottom")

    def within(x: str, own: Column) -> Column:
        return F.when(F.coalesce(F.col(x), F.lit(0.0)) != 0, F.greatest(F.least(F.col(x), MOST_SIZE * own), LEAST_SIZE * own)).otherwise(own)

    joined = priors.join(m, key, "left").withColumn("new_h", within("h_", height)).withColumn("new_w", within("w_", F.col("w")))
    hangs = (F.col("kind") == "mark") & (F.col("bottom") < ABOVE) & (F.abs("bottom") >= BASELINE)
    told = F.coalesce(F.col("h_"), F.lit(0.0)) != 0
    bottom = F.when(told & hangs, F.col("top") - F.col("new_h")).otherwise(F.col("bottom"))
    top = F.when(told & ~hangs, F.col("bottom") + F.col("new_h")).otherwise(F.col("top"))
    return joined.select(key, "kind", F.col("new_w").alias("w"), bottom.alias("bottom"), top.alias("top"))


def candidates(images: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Images that can draw a character, for characters (ch, classes) that several classes write."""
    return classes.select("ch", F.explode("classes").alias(label)).join(images, label)


def line_gaps(boxes: DataFrame) -> DataFrame:
    """Gaps of neighbours on the line, for boxes (word, x0, x1, kind, syllable): what they lie between, and whether inside a syllable."""
    w = Window.partitionBy("word").orderBy("x0", "x1")
    two = boxes.select("word", "kind", "syllable", "x1", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("kind", "syllable", "x0")]).where("next_kind is not null")
    between = F.when((F.col("kind") == "base") & (F.col("next_kind") == "base"), "letter to letter").when(F.col("next_kind") == "mark", "letter to sign beside it").otherwise("sign to next letter")
    return two.select("word", between.alias("between"), (F.col("syllable") == F.col("next_syllable")).alias("inside"), (F.col("next_x0") - F.col("x1")).alias("gap"))


def identified(lacks: DataFrame, page: str, template: str, lack: str) -> DataFrame:
    """Each page's template, for rows of the share of a template's ink that a page lacks: the least lacking, if little and clearly less than the next."""
    first = lacks.groupBy(page).agg(F.min(F.struct(lack, template)).alias("a"))
    rest = lacks.join(first, page).where(F.struct(lack, template) != F.col("a")).groupBy(page).agg(F.min(lack).alias("b"))
    told = first.join(rest, page, "left")
    best = F.col(f"a.{lack}")
    sure = (best < LACKS) & (F.col("b").isNull() | (F.col("b") > TIMES * best + LACKS))
    return told.select(page, F.when(sure, F.col(f"a.{template}")).alias(template), best.alias("lacks"), F.col("b").alias("runner_up"))


def matched(signs: DataFrame, pieces: DataFrame, by: str, sign_order: str, piece_order: str) -> DataFrame:
    """Signs and pieces of a word paired from left to right, if there are as many of each."""
    def placed(df: DataFrame, order: str) -> DataFrame:
        n = df.groupBy(by).agg(F.count("*").alias("count_"))
        return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).join(n, by)

    return placed(signs, sign_order).join(placed(pieces, piece_order), [by, "count_", "place"]).drop("count_")


def placement(rows: DataFrame, by: str) -> DataFrame:
    """Summary by sign of rows (to_letter, to_next, centre_to_letter, centre_to_next, crossing): shares and medians."""
    def share(c: Column, name: str) -> Column:
        return F.avg(c.cast("int")).alias(name)

    medians = [F.median(c).alias(f"median_{c}") for c in ("to_letter", "to_next", "centre_to_letter", "centre_to_next")]
    return rows.groupBy(by).agg(
        F.count("*").alias("cases"), share(F.col("to_next") <= F.col("to_letter"), "body_nearer_next"), share(F.col("centre_to_next") <= F.col("centre_to_letter"), "centre_nearer_next"),
        share(F.col("to_letter") <= 0, "touching"), share(F.col("to_letter") < 0.03, "almost_stuck"), share(F.col("crossing"), "crossing"), share(F.col("to_next") <= 0, "next_touching"), *medians)
