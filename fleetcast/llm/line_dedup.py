"""Line dedup by a suffix array over line ids, built by distributed prefix doubling (DataFrame functions only).

Every line with words is a symbol, every position the suffix that starts there. Round 0 groups positions by their line;
round r groups those that share 2^r lines, by the pair (group of the position, group of the position 2^(r-1) lines on). A
group is an interval of the suffix array whose longest common prefix is at least 2^r lines. It is named by its first
position, so names are exact. Positions that share nothing leave the table after each round.

A run of lines counts once it has ``min_words`` words. Each position has two shortest such runs, the one that starts there
and the one that ends there; a longer run is a union of these. Two suffixes share a run of m lines if the intervals of
depth 2^K <= m at its start and at 2^K lines before its end are the same. So doubling stops when 2^(K+1) lines exceed every
shortest run: deeper intervals would add nothing. Of each run all copies but the first are deleted, and overlapping copies
join to the maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.plans.staging import materialize

#: A position holds the line number in so many bits.
LINE_BITS = 28
#: What tells documents apart: the id, then two hashes of the text (97 bits) for rows that share an id or have none.
DOC = ["doc", "tie", "more"]
BLANKS = " \t\r"


def _numbered(text: Column) -> Column:
    """The lines with words of a text, as array of (line, t): number in the text and content without blanks around it."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("t")))
    return F.filter(lines, lambda x: x["t"] != "")


def _doc(ids: Column, kind: T.DataType) -> Column:
    """Ids that are never null: whole numbers as they are, others as text; the least value where there is none."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(ids.cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(ids.cast("string"), F.lit(""))


def _tie(ids: Column, text: Column) -> Column:
    """Tells apart rows with the same id and other texts, and null ids (first) from the ids that stand for them."""
    return F.pmod(F.xxhash64(text), F.lit(1 << (61 - LINE_BITS))) + F.when(ids.isNull(), 0).otherwise(1 << (61 - LINE_BITS))


def _more(text: Column) -> Column:
    """64 more bits of the text, so that the rows of a table without ids are never taken for one another."""
    return F.xxhash64(F.lit("more"), text)


def _positions(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each line with words: (doc, tie, more, idx) with its digest and its two shortest runs, null where too few words."""
    item = lambda x: F.struct(F.xxhash64(x["t"]).alias("h1"), F.xxhash64(F.lit("second"), x["t"]).alias("h2"), F.size(F.split(x["t"], f"[{BLANKS}]+", -1)).cast("long").alias("words"))
    # Rows that repeat a document are reduced to one in each task before anything moves.
    lines = docs.select(*DOC, F.transform(_numbered(F.col("text")), item).alias("items")).groupBy(*DOC).agg(F.first("items").alias("items"))
    lines = lines.select(*DOC, F.posexplode("items").alias("idx", "item")).select(*DOC, "idx", "item.*")
    by_doc = W.partitionBy(*DOC)
    lines = lines.withColumn("after", F.sum("words").over(by_doc.orderBy("idx").rowsBetween(W.unboundedPreceding, 0)))
    lines = lines.withColumn("before", F.col("after") - F.col("words")).withColumn("total", F.sum("words").over(by_doc))
    count = F.count(F.lit(1))
    from_here = count.over(by_doc.orderBy("before").rangeBetween(0, min_words - 1)).cast("int")
    to_here = count.over(by_doc.orderBy("after").rangeBetween(1 - min_words, 0)).cast("int")
    return lines.select(
        *DOC,
        "idx",
        "h1",
        "h2",
        F.struct("doc", F.shiftleft("tie", LINE_BITS).bitwiseOR(F.col("idx").cast("long")).alias("place"), "more").alias("pos"),
        F.when(F.col("total") - F.col("before") >= min_words, from_here).alias("ahead"),
        F.when(F.col("after") >= min_words, to_here).alias("back"),
    )


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (a written table) whose ``keys`` occur at two positions at least, with ``name``: the first of these.

    The groups are written before the join: then both its sides are plain shuffles, and the rows of a very common line are
    split over tasks instead of following the aggregation's partitioning.
    """
    groups = rows.groupBy(*keys).agg(F.min("pos").alias("name"), F.max("pos").alias("last")).where("name <> last").drop("last")
    return rows.join(materialize(groups), keys)


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc, tie, more, start, lines): shortest runs of ``min_words`` words that also occur at an earlier position.

    ``docs``: doc, tie, more (no nulls), text. Positions order by doc, then by tie, then by line.
    """
    positions = materialize(_positions(docs, min_words))
    level = materialize(_grouped(positions, ["h1", "h2"]).select(*DOC, "idx", "pos", "name", "ahead", "back"))
    base, levels, depth = level, [level], 1
    deepest = base.agg(F.greatest(F.max("ahead"), F.max("back"))).first()[0] or 0
    while 2 * depth <= deepest:
        there = W.partitionBy(*DOC).orderBy("idx").rangeBetween(depth, depth)
        pairs = level.select(*DOC, "idx", "pos", F.col("name").alias("here"), F.max("name").over(there).alias("next")).where("next is not null")
        level = materialize(_grouped(materialize(pairs), ["here", "next"]).select(*DOC, "idx", "pos", "name"))
        if level.isEmpty():
            break
        levels.append(level)
        depth *= 2

    runs = base.where("ahead is not null").select(*DOC, F.col("idx").alias("start"), F.col("ahead").alias("lines"))
    runs = runs.union(base.where("back is not null").select(*DOC, F.col("idx") - F.col("back") + 1, "back")).where("start >= 0").distinct()
    runs = runs.withColumn("k", F.floor(F.log2("lines")).cast("int"))
    names = None
    for k, table in enumerate(levels):
        rows = table.select(*DOC, "idx", "pos", "name", F.lit(k).alias("k"))
        names = rows if names is None else names.union(rows)
    started = runs.join(names.withColumnRenamed("idx", "start").withColumnRenamed("name", "here"), [*DOC, "k", "start"])
    whole = F.col("lines") == F.expr("shiftleft(1, k)")
    plain = started.where(whole & (F.col("here") != F.col("pos")))
    ends = names.select(*DOC, "k", F.col("idx").alias("tail"), F.col("name").alias("there"))
    tailed = started.where(~whole).withColumn("tail", F.col("start") + F.col("lines") - F.expr("shiftleft(1, k)")).join(ends, [*DOC, "k", "tail"])
    tailed = _grouped(materialize(tailed), ["lines", "here", "there"]).where("name <> pos")
    return plain.select(*DOC, "start", "lines").union(tailed.select(*DOC, "start", "lines"))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` less the later copies of repeated runs, and ``deleted_lines`` (sorted, from 0).

    A line is deleted if it lies in a run of consecutive lines with ``min_words`` words at least that also occurs earlier,
    in the order of (id, line), in the same document or another. Lines are compared without blanks around them; lines
    without words are no part of runs and always stay, and words are what blanks (space, tab, CR) separate.

    Null texts stay null, empty ones empty; a text of which every line goes becomes empty. Rows that repeat an id and a
    text are one document and get the same result; other rows with the same id are ordered by a hash of the text, and so are
    those with null ids, which come first; 97 bits of hashes tell them apart. Ids that are no whole numbers order as text. An empty table gives an empty result. All other columns stay (a
    column ``deleted_lines`` is replaced). Lines are compared by 128-bit digests; a document may have 2^28 lines.
    """
    names = [c for c in docs.columns if c != "deleted_lines"]
    doc, tie, more = _doc(F.col(id_col), docs.schema[id_col].dataType), _tie(F.col(id_col), F.col(text_col)), _more(F.col(text_col))
    runs = repeated_runs(docs.select(doc.alias("doc"), tie.alias("tie"), more.alias("more"), F.col(text_col).alias("text")).where("text is not null"), min_words)
    gone = runs.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)).alias("idx"))
    # Written before the join, so that rows of a document that is repeated very often are split over tasks; a merge join at every size.
    gone = materialize(gone.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), F.col("more").alias("_more")).agg(F.collect_set("idx").alias("_gone"))).hint("merge")
    # The input's columns travel in one struct, so that none can clash.
    rows = docs.select(F.struct(*names).alias("_row"), doc.alias("_own_doc"), tie.alias("_own_tie"), more.alias("_own_more"))
    joined = rows.join(gone, (F.col("_own_doc") == F.col("_doc")) & (F.col("_own_tie") == F.col("_tie")) & (F.col("_own_more") == F.col("_more")), "left")
    old = F.col("_row").getField(text_col)
    lines, counted = F.split(old, "\n", -1), F.transform(_numbered(old), lambda x: x["line"])
    joined = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines)).withColumn("_numbers", F.when(F.col("_gone").isNotNull(), counted))
    joined = joined.withColumn("_deleted", F.coalesce(F.array_sort(F.transform("_gone", lambda i: F.get("_numbers", i))), F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_deleted"))
    text = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    return joined.select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in names], F.col("_deleted").alias("deleted_lines"))
