"""Line dedup by winnowing over line hashes.

A *run* is a stretch of consecutive non-blank lines.  Every run of at least
``min_words`` words that already occurs earlier (in an earlier document in id
order, or earlier in the same document without overlap) is deleted from the
later place, with the blank lines inside it.

Method.  Lines are hashed.  Around each line two windows are laid: the
shortest stretch that starts there and the shortest that ends there with
``min_words`` words; no window is longer than ``min_words`` lines.  The
smallest line hash of a window is its fingerprint, so any two places that
share a run of ``min_words`` words select the same fingerprint.  Positions are
joined on the fingerprint and the hash of the window around it.  The windows
reach left and right of the fingerprint, and every line of a maximal shared
run lies in the window that starts there or in the one that ends with the run,
so uniting the matched windows extends each match both ways to its full run.

On Spark: only line hashes are shuffled, by document, until the cuts are known;
first occurrences are one aggregate (map-side combine, so a line that a third
of all documents hold is one row per task), matching is an equi join that AQE
splits on hot keys, no pairs of a group are made.  Then the texts meet their
cuts in one join on the document.  All steps are DataFrame functions.

Defined results: a null text stays null (no lines); an empty text stays empty;
rows that agree in id and text are one document and are cut alike; rows that
share an id but differ in text are told apart by the hash of their text; a
null id sorts before all others; an empty table stays empty; other columns
pass through, also those named like this module's own (they start with
``__ld_``, which the input may not use).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftsmith.session import checkpoint_dir

MIN_WORDS = 50
_WS = " \t\n\x0b\f\r"
_WS_CLASS = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _doc_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document and non-blank line:
    ``__ld_id, __ld_key, pos, h, g, w`` (two hashes of the trimmed line, words)."""

    def line(raw: Column) -> Column:
        return _let(
            F.btrim(raw, F.lit(_WS)),
            lambda x: F.struct(
                F.xxhash64(x).alias("h"),
                F.xxhash64(F.lit(1), x).alias("g"),
                F.when(x == "", 0).otherwise(F.size(F.split(x, _WS_CLASS))).alias("w"),
            ),
        )

    per_doc = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("__ld_id"),
        _doc_key(id_col, text_col).alias("__ld_key"),
        F.transform(F.split(F.col(text_col), "\n", -1), line).alias("ls"),
    )
    once = per_doc.dropDuplicates(["__ld_id", "__ld_key"])  # the one exchange up to the windows
    return once.select("__ld_id", "__ld_key", F.posexplode("ls").alias("pos", "l")).select("__ld_id", "__ld_key", "pos", "l.*").where("w > 0")


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Windows of ``min_words`` words with fingerprint: ``__ld_id, __ld_key, s, e, fp, wh``."""
    doc = Window.partitionBy("__ld_id", "__ld_key")
    upto = F.sum("w").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    x = lines.withColumn("after", upto).withColumn("before", F.col("after") - F.col("w"))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy("after").rangeBetween(-(min_words - 1), 0)
    x = (
        x.withColumn("aw", F.sum("w").over(ahead))
        .withColumn("ae", F.max("pos").over(ahead))
        .withColumn("af", F.min("h").over(ahead))
        .withColumn("ah", F.xxhash64(F.collect_list("g").over(ahead)))
        .withColumn("bw", F.sum("w").over(back))
        .withColumn("bs", F.min("pos").over(back))
        .withColumn("bf", F.min("h").over(back))
        .withColumn("bh", F.xxhash64(F.collect_list("g").over(back)))
    )
    one = lambda s, e, f, h: F.struct(F.col(s).alias("s"), F.col(e).alias("e"), F.col(f).alias("fp"), F.col(h).alias("wh"))
    both = F.array(
        F.when(F.col("aw") >= min_words, one("pos", "ae", "af", "ah")),
        # a window that ends here and would also end here without its last line's words is no start window
        F.when((F.col("bw") >= min_words) & (F.col("bw") - F.col("w") >= min_words), one("bs", "pos", "bf", "bh")),
    )
    return x.select("__ld_id", "__ld_key", F.explode(F.array_compact(both)).alias("v")).select("__ld_id", "__ld_key", "v.*")


def later_windows(win: DataFrame) -> DataFrame:
    """The windows whose content occurs earlier (non-overlapping): ``__ld_id, __ld_key, s, e``."""
    place = F.struct("__ld_id", "__ld_key", "s", "e")
    first = (
        win.groupBy("fp", "wh")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("fp", "wh", "first")
        .checkpoint()  # small: repeated windows only; both join sides then are plain exchanges that AQE can split
    )
    other = ~F.col("__ld_id").eqNullSafe(F.col("first.__ld_id")) | (F.col("__ld_key") != F.col("first.__ld_key"))
    return win.join(first, ["fp", "wh"]).where(other | (F.col("s") > F.col("first.e"))).select("__ld_id", "__ld_key", "s", "e")


def cuts(later: DataFrame) -> DataFrame:
    """Per document the maximal line ranges to delete: ``__ld_id, __ld_key, __ld_cuts array<struct<s, e>>``."""
    doc = Window.partitionBy("__ld_id", "__ld_key").orderBy("s", "e")
    x = later.withColumn("reach", F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("run", F.sum(F.when(F.col("s") <= F.col("reach") + 1, 0).otherwise(1)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy("__ld_id", "__ld_key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("__ld_id", "__ld_key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("__ld_cuts"))


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the lines of the sorted, disjoint ``spans``."""

    def kept(lines: Column) -> Column:
        def part(i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["e"] + 1)
            end = F.coalesce(F.get(spans, i)["s"], F.size(lines))
            return F.slice(lines, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), part)), "\n")

    return _let(F.split(text, "\n", -1), kept)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text_col``, and a column
    ``cut_lines`` (lines deleted; zero where nothing repeats)."""
    if min_words < 1:
        raise ValueError("min_words must be positive")
    checkpoint_dir(docs.sparkSession)
    win = windows(line_hashes(docs, id_col, text_col), min_words).checkpoint()  # hashes and positions; read for first places and for matches
    found = cuts(later_windows(win))
    # ids of found are null-safe through the key, which covers the id
    keyed = docs.withColumn("__ld_k", _doc_key(id_col, text_col))
    both = keyed.join(found, (F.col("__ld_k") == F.col("__ld_key")) & F.col(id_col).eqNullSafe(F.col("__ld_id")), "left")
    n = F.aggregate("__ld_cuts", F.lit(0), lambda a, c: a + c["e"] - c["s"] + 1)
    text = F.when(F.col("__ld_cuts").isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col("__ld_cuts")))
    names = [c for c in docs.columns if c != "cut_lines"]
    return both.select(
        *[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in names],
        F.coalesce(n, F.lit(0)).cast("long").alias("cut_lines"),
    )
