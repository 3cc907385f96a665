"""Line deduplication with levelled sorted runs of line hashes; DataFrame operations only.

Documents come in batches. A batch's line hashes (128 bits, each with the number of documents that hold it) are
merge-anti-joined with the runs of hashes that are already known as frequent, and what is new is added as a sorted run
of level 0. When a level has `fanout` runs they are compacted into one run of the next level: counts add up, and hashes
that have reached the threshold are sealed, so that later batches skip them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, SPACES, plain, row_keys, small, text_of, written

HASH = ["h1", "h2"]
ROW = ["_row", "_row2"]
#: The bytes that go on a letter of UTF-8, read as letters.
CONTINUATION = "".join(chr(b) for b in range(0x80, 0xC0))


def trimmed(line: Column) -> Column:
    """A line without ASCII white space at its ends."""
    return F.trim(line, F.lit(SPACES))


def folded(key: Column) -> Column:
    """A string that two keys have in common if and only if they differ in the case of A-Z alone.

    The bytes of the key, read one by one as letters, are lower-cased: A-Z fold, and where the bytes of other letters change, what follows
    them still tells them apart (the first byte of a letter of two bytes becomes that of a longer one, which has more bytes after it).
    This is many times as fast as replacing letters.
    """
    return F.lower(F.decode(key.cast("binary"), "ISO-8859-1"))


def folded_lines(text: Column) -> Column:
    """The folded lines of a text, with their white space: the text is folded as a whole, since no byte of a letter is a line feed."""
    return F.split(folded(text), "\n")


def long_enough(key: Column, min_chars: int) -> Column:
    """Whether a folded key has at least min_chars code points: bytes but those that go on a letter."""
    if min_chars <= 1:
        return key != "" if min_chars == 1 else F.lit(True)
    return F.length(F.translate(key, CONTINUATION, "")) >= min_chars


def key_hash(key: Column) -> list[Column]:
    """128 bits: two 64-bit hashes with different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


class LineRuns:
    """Levels of sorted runs (h1, h2, n) below the threshold, and sealed runs of the hashes that have reached it."""

    def __init__(self, threshold: int, fanout: int = 2):
        self.threshold, self.fanout = threshold, fanout
        self.levels: list[list[DataFrame]] = []
        self.sealed: list[DataFrame] = []

    def _frequent(self) -> DataFrame | None:
        out = None
        for run in self.sealed:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-joins a batch (h1, h2, n) with the sealed runs and adds the rest as a run."""
        known = self._frequent()
        fresh = batch if known is None else batch.join(known.select(*HASH).hint("merge"), HASH, "left_anti")
        self._append(0, fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._compact(level + 1, runs)
            level += 1

    def _append(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run if level else written(run.repartition(*HASH).sortWithinPartitions(*HASH), "lines0"))

    def _compact(self, level: int, runs: list[DataFrame]) -> None:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        merged = union.groupBy(*HASH).agg(F.sum("n").alias("n")).sortWithinPartitions(*HASH)
        merged = written(merged, f"lines{level}")
        self.sealed.append(merged.filter(F.col("n") >= self.threshold))
        self._append(level, merged.filter(F.col("n") < self.threshold))

    def frequent(self) -> DataFrame:
        """All hashes that have reached the threshold: (h1, h2, n); n counts up to when a hash was sealed."""
        runs = [run for level in self.levels for run in level]
        self.levels = []
        self._compact(0, runs)
        return self._frequent()


def frequent_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, text_column: str = "text", batches: int = 4, fanout: int = 2) -> DataFrame:
    """The hashes (h1, h2, n) of line keys of at least min_chars code points in at least min_documents rows of docs.

    A row counts once for a line that it repeats; each row is a document of its own.
    """
    keys = F.array_distinct(F.filter(F.transform(folded_lines(text_of(text_column)), trimmed), lambda key: long_enough(key, min_chars)))
    # Batch and keys come before the explosion, so that its rows carry no text; the outer form keeps Spark from working the keys out
    # twice, once to see whether there are any.
    batched = docs.select(F.pmod(_spread(text_column), F.lit(batches)).cast("int").alias("batch"), keys.alias("keys"))
    lines = batched.select("batch", F.explode_outer("keys").alias("key")).filter("key IS NOT NULL")
    counts = lines.select("batch", *key_hash(F.col("key"))).groupBy("batch", *HASH).agg(F.count(F.lit(1)).alias("n"))
    tables = written(counts, "line-counts", ("batch",))
    runs = LineRuns(min_documents, fanout)
    for b in range(batches):
        runs.add(tables.filter(F.col("batch") == b).select(*HASH, "n"))
    return runs.frequent()


def _spread(text_column: str) -> Column:
    return F.xxhash64(F.substring(text_of(text_column), 1, 64), F.length(text_of(text_column)))


def _marked(lines: DataFrame, frequent: DataFrame, broadcast_rows: int) -> DataFrame:
    """The lines whose hash is frequent.

    Few hashes are broadcast. Otherwise those in so many documents that at most broadcast_rows hashes can be as frequent
    are broadcast, and the others, none of which can fill a task, are merge-joined.
    """
    if small(frequent, broadcast_rows):
        return lines.join(F.broadcast(frequent.select(*HASH)), HASH, "left_semi")
    total = frequent.agg(F.sum("n")).first()[0]
    least = max(2, total // broadcast_rows)
    heavy, light = frequent.filter(F.col("n") >= least).select(*HASH), frequent.filter(F.col("n") < least).select(*HASH)
    rest = lines.join(F.broadcast(heavy), HASH, "left_anti")
    return lines.join(F.broadcast(heavy), HASH, "left_semi").unionByName(rest.join(light, HASH, "left_semi"))


def line_dedup(
    docs: DataFrame,
    min_documents: int = 10,
    min_chars: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    batches: int = 4,
    fanout: int = 2,
    broadcast_rows: int = BROADCAST_ROWS,
    keep_emptied: bool = False,
    keep_copy: bool = False,
) -> DataFrame:
    """docs with text replaced by what remains, and n_lines and n_dropped (long) added (columns of these names are replaced).

    A text is split at line feeds; null or empty is one empty line. Lines whose key (ASCII white space stripped at both
    ends, A-Z lower-cased, at least min_chars code points) is in at least min_documents rows go from every document; the
    others stay, joined by line feeds. A text that loses no line is unchanged, but null becomes empty. Rows that repeat
    an id count as documents of their own. An empty table gives no rows. With keep_emptied a document that would lose
    every line loses none, copy or not. With keep_copy only the row with the smallest id among exact copies of a text that
    would be left without a line other than blank ones loses none; a text without an exact copy keeps no frequent line.
    """
    columns = docs.columns
    docs, called = plain(docs)
    id_column, text_column = called[id_column], called[text_column]
    frequent = frequent_lines(docs, min_documents, min_chars, text_column, batches, fanout)
    # Rows without text lose no line: their keys are scattered, so that they don't meet in one task.
    blank = F.length(text_of(text_column)) == 0
    row, row2 = row_keys(id_column, text_column)
    keyed = docs.select("*", F.when(blank, F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(row).alias("_row"), F.when(blank, F.lit(0)).otherwise(row2).alias("_row2"))
    lines = keyed.select(*ROW, folded_lines(text_of(text_column)).alias("_lines")).select(*ROW, F.posexplode_outer("_lines").alias("_at", "_line"))
    lines = lines.withColumn("_key", trimmed(F.col("_line"))).filter(long_enough(F.col("_key"), min_chars)).select(*ROW, "_at", *key_hash(F.col("_key")))
    places = _marked(lines, frequent, broadcast_rows).groupBy(*ROW).agg(F.array_sort(F.collect_set("_at")).alias("_at"))
    if keep_copy:
        places = written(places, "line-places")
        text = text_of(text_column)
        worded = F.size(F.filter(F.split(text, "\n"), lambda line: F.length(trimmed(line)) > 0))
        sizes = keyed.select(*ROW, F.col(id_column).alias("_id"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(13), text).alias("_t2"), worded.alias("_worded"))
        emptied = written(sizes.join(places.select(*ROW, F.size("_at").alias("_n")), ROW).filter("_n = _worded"), "line-emptied")
        groups = emptied.groupBy("_t1", "_t2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
        firsts = emptied.join(groups, ["_t1", "_t2"]).filter(F.col("_id").eqNullSafe(F.col("_first"))).select(*ROW).distinct()
        places = places.join(firsts, ROW, "left_anti")
    # _gone[i]: whether line i goes; built from the gaps between the sorted places, so that each look-up is one step.
    gap = lambda at, i: at - F.coalesce(F.when(i > 0, F.get("_at", i - 1)), F.lit(-1)) - 1
    gone = F.flatten(F.transform("_at", lambda at, i: F.concat(F.array_repeat(F.lit(False), gap(at, i)), F.array(F.lit(True)))))
    drops = places.select(*ROW, gone.alias("_gone"), F.size("_at").cast("long").alias("_n"))
    all_lines = F.split(text_of(text_column), "\n")
    stay = F.array_join(F.filter(all_lines, lambda line, i: ~F.coalesce(F.get("_gone", i), F.lit(False))), "\n")
    joined = keyed.join(drops, ROW, "left")
    if keep_emptied:
        emptied = F.col("_n") == F.size(all_lines)
        joined = joined.withColumns({c: F.when(~emptied, F.col(c)) for c in ("_gone", "_n")})
    out = joined.withColumns({
        "_kept": F.when(F.col("_gone").isNull(), text_of(text_column)).otherwise(stay),
        "_lines": F.size(all_lines).cast("long"),
        "_dropped": F.coalesce("_n", F.lit(0).cast("long")),
    })
    kept = [F.col("_kept" if called[c] == text_column else called[c]).alias(c) for c in columns if c not in ("n_lines", "n_dropped")]
    return out.select(*kept, F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
