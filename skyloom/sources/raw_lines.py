"""Loading undecoded catalog lines: valid rows on one side, failing lines with their reason on the other.

A line is cut into cells with its quotes minded, the cells are exploded into (row, column, value), joined with a small
rule table and tested; the failures are aggregated per line to the first broken rule, and the clean rows are what an
anti-join leaves. Everything is built from column expressions; the explode and the aggregate meet in one stage, so only one
row a line reaches the shuffle.

Defined cases: blank lines and comments are neither valid nor failing; NULL lines count as blank; a line of any length is
handled without recursion; repeated lines are judged each on its own ``line_id``; lines without an id are dropped; an
empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a line in order.
FIELDS = ["name", "m", "t", "x", "y", "xe", "ye", "snr", "corr", "n_frames", "flux"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
COUNT = r"^\+?[0-9]+$"
BLANKS = " \t\r"
#: (order, reason, column or NULL for the whole line, pattern the value must match, pattern it must not match, least, least is excluded, most).
RULES = [
    (1, "quotes", None, None, None, None, False, None),
    (2, "columns", None, None, None, None, False, None),
    (3, "name", 0, r"(?s)[^ \t\r]", "�", None, False, None),
    (4, "corr", 8, NUMBER, None, 0.0, False, 1.0),
    (5, "n_frames", 9, COUNT, None, 1.0, False, None),
    (6, "flux", 10, NUMBER, None, 0.0, True, None),
]
#: Stands for a separator outside quotes; in the line itself it is replaced beforehand.
CUT, CUT_OUT = "\u0001", "\u0002"


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules, as many rows as reasons."""
    return spark.createDataFrame(RULES, "rule int, reason string, col int, must string, mustnt string, least double, open boolean, most double")


def cells(lines: DataFrame, line: str = "raw_line", layout: str = "layout") -> DataFrame:
    """The lines that are neither blank nor comments, with ``_cells`` (array) and ``_bad_quotes``.

    Between its quotes a line falls into pieces, outside and inside by turns. A piece outside must border on the quoted
    fields with separators; an empty one between two quoted pieces is a doubled quote.
    """
    text = F.trim(F.col(line), F.lit(BLANKS))
    comma = F.coalesce(F.col(layout) == "comma", F.lit(False))
    base = lines.withColumn("_text", F.translate(text, CUT, CUT_OUT)).where((F.length("_text") > 0) & ~F.startswith("_text", F.lit("#")))
    # bound once per line by a one-element transform: a lambda would compute them anew for each piece
    whole = F.struct(F.split("_text", '"', -1).alias("pieces"), comma.alias("comma"))
    blank = lambda s: F.length(F.trim(s, F.lit(BLANKS))) == 0

    with_count = lambda q: F.struct(q["pieces"].alias("pieces"), q["comma"].alias("comma"), F.size(q["pieces"]).alias("n"))

    def line_cells(q: Column) -> Column:
        last = q["n"] - 1
        ends = F.when(q["comma"], F.lit(r",[ \t\r]*$")).otherwise(F.lit(r"[ \t]$"))
        starts = F.when(q["comma"], F.lit(r"^[ \t\r]*,")).otherwise(F.lit(r"^[ \t]"))

        def piece(s: Column, i: Column) -> Column:
            outside, edge = i % 2 == 0, (i == 0) | (i == last)
            doubled = outside & ~edge & (s == "")
            fits = F.when(~outside | doubled | (last == 0), True).otherwise(
                ((i == 0) | F.regexp(s, starts)) & ((i == last) | F.regexp(s, ends)) | edge & blank(s)
            )
            cut = F.when(q["comma"], F.replace(s, F.lit(","), F.lit(CUT))).otherwise(F.regexp_replace(s, r"[ \t]+", CUT))
            return F.struct(F.when(doubled, F.lit('"')).when(outside, cut).otherwise(s).alias("v"), fits.alias("ok"))

        return F.struct(F.transform(q["pieces"], piece).alias("p"), (last % 2 == 1).alias("odd"))

    def joined(q: Column) -> Column:
        text = F.array_join(F.transform(q["p"], lambda p: p["v"]), "")
        return F.struct(
            F.transform(F.split(text, CUT, -1), lambda c: F.trim(c, F.lit(BLANKS))).alias("cells"),
            (q["odd"] | F.exists(q["p"], lambda p: ~p["ok"])).alias("bad")
        )

    done = F.element_at(F.transform(F.transform(F.transform(F.array(whole), with_count), line_cells), joined), 1)
    return base.withColumn("_done", done).withColumn("_cells", F.col("_done.cells")).withColumn("_bad_quotes", F.col("_done.bad")).drop("_text", "_done")


def failures(lines: DataFrame, key: str = "line_id", line: str = "raw_line", layout: str = "layout") -> DataFrame:
    """(line_id, reason): each failing line once, with the first reason that holds."""
    spark = lines.sparkSession
    cut = cells(
        lines.select(F.col(key).alias("_key"), F.col(line).alias("_line"), F.col(layout).alias("_layout")).where(F.col("_key").isNotNull()), "_line",
        "_layout"
    )
    rows = cut.select("_key", "_bad_quotes", F.size("_cells").alias("_count"), F.posexplode("_cells").alias("_pos", "_value"))
    # the first cell also carries the rules of the whole line
    at = F.explode(F.when(F.col("_pos") == 0, F.array(F.lit(-1), F.lit(0))).otherwise(F.array(F.col("_pos")))).alias("_at")
    rules = F.broadcast(rule_table(spark).withColumn("_at", F.coalesce("col", F.lit(-1))).drop("col"))
    v = F.col("_value").try_cast("double")
    holds = (
        F.when(F.col("reason") == "quotes", ~F.col("_bad_quotes"))
        .when(F.col("reason") == "columns", F.col("_count") == len(FIELDS))
        .otherwise(
            F.coalesce(F.regexp("_value", F.col("must")), F.lit(True))
            & ~F.coalesce(F.contains("_value", F.col("mustnt")), F.lit(False))
            & F.when(F.col("least").isNull(), True).otherwise(
                F.coalesce(F.when(F.col("open"), v > F.col("least")).otherwise(v >= F.col("least")) & (v < float("inf")), F.lit(False))
            )
            & F.when(F.col("most").isNull(), True).otherwise(F.coalesce(v <= F.col("most"), F.lit(False)))
        )
    )
    broken = rows.select("_key", "_bad_quotes", "_count", "_value", at).join(rules, "_at").where(~holds)
    first = broken.groupBy("_key").agg(F.min("rule").alias("rule"))
    return first.join(F.broadcast(rule_table(spark).select("rule", "reason")), "rule").select(F.col("_key").alias("line_id"), "reason")


def load(lines: DataFrame, key: str = "line_id", line: str = "raw_line", layout: str = "layout", failing: DataFrame | None = None) -> DataFrame:
    """The valid lines as typed catalog rows (key and ``list_id`` where there is one); a number that can't be read is NULL."""
    cut = cells(lines.where(F.col(key).isNotNull()), line, layout)
    bad = failing if failing is not None else failures(lines, key, line, layout)
    clean = cut.join(bad.select(F.col("line_id").alias(key)), key, "left_anti")
    kinds = {"name": "string", "n_frames": "bigint"}
    extra = [c for c in ("list_id",) if c in lines.columns]
    value = lambda i, f: F.get("_cells", F.lit(i)).try_cast(kinds.get(f, "double"))
    return clean.select(key, *extra, *((F.nullif(F.get("_cells", F.lit(0)), F.lit("")) if f == "name" else value(i, f)).alias(f) for i, f in enumerate(FIELDS)))
