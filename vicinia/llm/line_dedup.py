"""Line dedup by content-defined line chunks or by all pairs of lines; DataFrame functions only.

Lines are hashed, and a rolling hash over two neighbouring line hashes chooses where a
chunk of lines begins: one place in ``every``, but never two in a row. Boundaries depend
on the lines around them alone, so lines added elsewhere don't shift them, and a copied
passage of lines falls into the same chunks wherever it stands. A chunk with at least two
lines that aren't blank and that occurs more than once in the corpus is kept at its
earliest place (id, then place) and removed everywhere else.

Such chunks leave the head and tail of a copied passage, and often all of a short one.
With ``pairs`` every line that isn't blank begins a chunk: it and the next such line. The
pairs overlap, and the removed lines are those of all repeated pairs, so of a passage that
occurs before nothing stays from two lines on, wherever it is cut. A line goes only where
an earlier pair holds it, so each line's earliest place stays. The registered query uses this.

With ``both`` (``dedup``) chunks and pairs do it: content-defined chunks of the lines
that aren't blank are sought first, and what an earlier document's chunk holds goes. All
pairs within such a chunk lie in that document too, so they leave the search; pairs are
sought among the rest, and the lines removed are those of all repeated pairs. The pipeline
uses this.

Chunks are found by hash (64 and 128 bits) with partial aggregation, so a chunk that a
third of all documents hold is summed up before the shuffle. Then the texts of the
repeated ones are compared byte by byte; a group whose bytes differ is left alone.

Defined cases: a null text has no chunks and stays null; an empty text has one blank
line; single lines stay; a very long text takes steps in proportion to its lines; rows that repeat an id rank alike, so equal chunks at one place
of one id are one occurrence and stay; null ids rank first; an empty table gives an empty
result. Other columns are carried along unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import Workspace


def _shifted(values: Column, first: Column) -> Column:
    """The array moved one place on."""
    return F.slice(F.concat(F.array(first), values), F.lit(1), F.size(values))


def chunked(df: DataFrame, text_col: str = "text", every: int = 3, out: str = "_chunks") -> DataFrame:
    """Add the array of a text's chunks.

    A chunk holds its lines joined by line feeds, the first one marked with ``|`` and the
    others with a blank, so no text can forge a boundary; ``plain`` takes the marks off.
    Each step is linear in the text: arrays are passed on, never looked up by index.
    """
    df = df.withColumn("_lines", F.split(F.col(text_col), "\n", -1))
    df = df.withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(x)))
    pair = F.zip_with(_shifted(F.col("_hashes"), F.lit(0).cast("long")), F.col("_hashes"), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(every)) == 0)
    df = df.withColumn("_marks", F.transform(pair, lambda x, i: x | (i == 0)))
    begins = F.zip_with(_shifted(F.col("_marks"), F.lit(False)), F.col("_marks"), lambda a, b: b & ~a)
    marked = F.zip_with(F.col("_lines"), begins, lambda x, b: F.concat(F.when(b, "|").otherwise(" "), x))
    return df.withColumn(out, F.split(F.array_join(marked, "\n"), r"\n(?=\|)", -1)).drop("_lines", "_hashes", "_marks")


def plain(chunk: Column) -> Column:
    return F.substring(F.replace(chunk, F.lit("\n "), F.lit("\n")), F.lit(2), F.length(chunk))


def filled(rows: DataFrame) -> DataFrame:
    """id and ``_filled``: the number (from 0) and text of each line that isn't blank."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return rows.select("id", F.filter(lines, lambda x: F.btrim(x["line"], F.lit(" \t\r\n\f\v")) != "").alias("_filled"))


def paired(rows: DataFrame) -> DataFrame:
    """A row for each line that isn't blank and the next such one: id, chunk (the line's number, from 0), n_lines, n_chars, part."""
    lines = filled(rows)
    n = F.greatest(F.size("_filled"), F.lit(1))
    pair = F.zip_with(F.slice("_filled", F.lit(1), n - 1), F.slice("_filled", F.lit(2), n), lambda a, b: F.struct(a["at"].alias("chunk"), (b["at"] - a["at"] + 1).alias("n_lines"), F.concat(a["line"], F.lit("\n"), b["line"]).alias("part")))
    return lines.select("id", F.inline(pair)).select("id", "chunk", "n_lines", F.length("part").alias("n_chars"), "part")


def filled_chunks(rows: DataFrame, every: int = 3) -> DataFrame:
    """A row for each content-defined chunk of two or more lines that aren't blank: columns as of ``paired``."""
    lines = filled(rows).where(F.size("_filled") > 1)
    lines = chunked(lines.withColumn("text", F.array_join(F.transform("_filled", lambda x: x["line"]), "\n")), "text", every, "_parts")
    sizes = F.transform("_parts", lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1)
    lines = lines.withColumn("_firsts", F.flatten(F.transform(sizes, lambda n: F.concat(F.array(n), F.array_repeat(F.lit(0), n - 1)))))
    of = lambda marks: F.filter(F.zip_with("_filled", marks, lambda x, n: F.when(n > 0, x["at"])), lambda x: x.isNotNull())
    lasts = F.concat(F.slice("_firsts", F.lit(2), F.size("_firsts")), F.array(F.lit(1)))
    each = lines.select("id", F.inline(F.arrays_zip(F.col("_parts"), of(F.col("_firsts")).alias("_first"), of(lasts).alias("_last")))).toDF("id", "part", "chunk", "last")
    each = each.select("id", "chunk", (F.col("last") - F.col("chunk") + 1).alias("n_lines"), plain(F.col("part")).alias("part")).where("n_lines > 1")
    return each.select("id", "chunk", "n_lines", F.length("part").alias("n_chars"), "part")


def repeated_chunks(ws: Workspace, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = 3, pairs: bool = False) -> DataFrame:
    """A row for each chunk (with ``pairs``: each pair of lines) to remove: id, chunk (its place, from 0), n_lines, n_chars, kept_id, kept_chunk."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if pairs:
        return _repeats(ws, paired(rows))
    each = chunked(rows, "text", every).select("id", F.posexplode("_chunks").alias("chunk", "part"))
    each = each.where(F.contains(F.btrim(plain(F.col("part")), F.lit(" \t\r\n\f\v")), F.lit("\n")))  # two lines that aren't blank
    return _repeats(ws, each.select("id", "chunk", (F.length("part") - F.length(F.replace("part", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("n_lines"), F.length(plain(F.col("part"))).alias("n_chars"), "part"))


def repeated_lines(ws: Workspace, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = 3) -> tuple[DataFrame, DataFrame]:
    """What content-defined chunks remove, and then what pairs of lines do of the rest: id, chunk (its first line), n_lines.

    A chunk goes where another, earlier id holds it; repeats within one id are left to the pairs.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = _repeats(ws, filled_chunks(rows, every), "chunks-")
    chunks = ws.save(met.where(~F.col("id").eqNullSafe(F.col("kept_id"))).select("id", "chunk", "n_lines"), "chunks")
    inside = chunks.select("id", F.explode(F.sequence("chunk", F.col("chunk") + F.col("n_lines") - 2)).alias("chunk"))
    return chunks, _repeats(ws, paired(rows), "pairs-", inside).select("id", "chunk", "n_lines")


def _repeats(ws: Workspace, each: DataFrame, name: str = "", without: DataFrame | None = None) -> DataFrame:
    """The rows of ``each``, less those of an id and place in ``without``, whose part stands at an earlier place, and the earliest."""
    digests = (F.xxhash64("part").alias("h"), F.unhex(F.md5(F.col("part").cast("binary"))).alias("d"))
    rows = each.select("id", "chunk", *digests, "n_lines", "n_chars")
    if without is not None:
        known = without.distinct().select(F.col("id").alias("own_id"), F.col("chunk").alias("own_chunk"))
        rows = rows.join(known.hint("merge"), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("chunk") == F.col("own_chunk")), "left_anti")
    found = ws.save(rows, f"{name}found")
    twice = ws.save(found.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("id", "chunk")).alias("first")).where("n > 1"), f"{name}twice")
    # a merge join at every size: the texts cross one shuffle, and need grows in step with the input
    texts = each.select(*digests, "part").join(twice.select("h", "d").hint("merge"), ["h", "d"], "left_semi")
    alike = texts.groupBy("h", "d").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a = b").select("h", "d")
    keep = ws.save(twice.join(alike, ["h", "d"]).select("h", "d", F.col("first.id").alias("kept_id"), F.col("first.chunk").alias("kept_chunk")), f"{name}keep")
    return found.join(keep, ["h", "d"]).where(~(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("chunk") == F.col("kept_chunk")))).select("id", "chunk", "n_lines", "n_chars", "kept_id", "kept_chunk")


def removed(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = 3, pairs: bool = False) -> DataFrame:
    """The chunks to remove, by document."""
    return repeated_chunks(Workspace(df.sparkSession, "lines"), df, text_col, id_col, every, pairs)


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = 3, flag: str | None = "_emptied", pairs: bool = False, both: bool = False) -> DataFrame:
    """The table with the repeated chunks cut out of its texts, and ``flag``: true where nothing but blanks is left of a text that lost some.

    A column of the table that is called like the flag is replaced; without a flag
    (None) such rows go. ``both``: content-defined chunks first, then pairs of the rest.
    """
    ws = Workspace(df.sparkSession, "lines")
    pairs = pairs or both
    if both:
        chunks, rest = repeated_lines(ws, df, text_col, id_col, every)
        gone = chunks.unionByName(ws.save(rest, "gone"))
    else:
        gone = ws.save(repeated_chunks(ws, df, text_col, id_col, every, pairs), "gone")
    if pairs:
        gone = gone.select("id", F.explode(F.sequence("chunk", F.col("chunk") + F.col("n_lines") - 1)).alias("chunk"))  # the lines themselves
    gone = gone.groupBy("id").agg(F.collect_set("chunk").alias("gone"))  # bounded by the document
    own = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("own_id"))
    met = own.join(gone.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")), "left").select("row", "text", "gone")
    split = met.withColumn("_chunks", F.split("text", "\n", -1)) if pairs else chunked(met, "text", every)
    # two uses of the chunks keep them a column of their own, so a look-up by place takes one step
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_chunks") - 1), "gone"), lambda i: F.get("_chunks", i))
    whole = kept if pairs else F.transform(kept, plain)
    cut = split.select("row", F.col("gone").isNotNull().alias("changed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(whole, "\n")).alias("text"))
    emptied = F.coalesce(F.col("changed") & ~F.col("text").rlike(r"\S"), F.lit(False))
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns if c != flag]
    return cut.where(~emptied).select(*columns) if flag is None else cut.select(*columns, emptied.alias(flag))
