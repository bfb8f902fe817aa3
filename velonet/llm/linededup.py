"""Line dedup by winnowing: later repeats of runs of lines go.

DataFrame functions only. The window of a line is the shortest run of lines from it on that has ``words`` words or
``run`` lines (a document's last lines may have none). Each line is hashed; of each window's line hashes
the least (rightmost on ties) is selected, so two equal windows always select the same
lines. Selected lines whose hash is selected once in the corpus are dropped; the others are
joined on their positions' surroundings: the match is extended to every window
around the fingerprint (in both directions), and windows of equal content are put in order of
(doc_id, line). All but the first are deleted, which joins into maximal runs.

So a line goes exactly if a window that covers it occurs earlier, in this
document or one of a smaller doc_id: every repeated run of ``run`` lines, and every repeated run of lines with ``words``
words, even if it is a single line. Windows are judged on the input.

Counts are aggregated map-side; a hot line's fingerprints meet only by the content of their
windows, and the first of each content is found by a partial minimum, so no group is collected. Keys that repeat are written
before they are joined, so that adaptive execution can split a hot one.

Edge cases: null text stays null (0 lines); an empty text is one empty line; texts
without a window are kept. Text is split at ``\\n`` only; words are runs outside ASCII white space. An empty table gives
an empty table. Clashing names: this adds ``n_lines`` and ``n_removed`` and replaces columns of
those names; every other column is kept. Rows with a null ``doc_id`` are kept uncut and count for nothing. Of repeated ids,
rows of equal text are one document (cut alike), rows of different texts are two, in order of their texts' hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velonet.llm.store import materialise

RUN, WORDS = 3, 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _window(at: Column, run: int, words: int) -> Column:
    """How many lines the window from line ``at`` has (columns hashes, counts); null if the document ends before."""
    sums = [reduce(lambda a, b: a + b, [F.get("counts", at + i) for i in range(n)]) for n in range(1, run)]
    full = F.when(at + run <= F.size("hashes"), run)
    return reduce(lambda rest, n: F.when((at + n <= F.size("hashes")) & (sums[n - 1] >= words), n).otherwise(rest), range(run - 1, 0, -1), full)


def fingerprints(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, version, hashes, windows, picks): line hashes, the lines of each line's window, and the places of the winnowed lines; ``version`` is the text's hash."""
    lines = docs.filter("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), _lines(F.col("text")).alias("lines"))
    counts = F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
    h = lines.select("doc_id", "version", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), counts.alias("counts"))
    h = h.select("*", F.transform(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: _window(i, run, words)).alias("windows"))

    def place(i: Column) -> Column:  # of the rightmost minimum of the window
        own = F.slice("hashes", i + 1, F.get("windows", i))
        return (i + F.get("windows", i) - F.array_position(F.reverse(own), F.array_min(own))).cast("int")

    begins = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.get("windows", i).isNotNull())
    return h.withColumn("picks", F.array_distinct(F.transform(begins, place))).drop("counts")


def repeated_windows(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, version, at, n): the first line, and the number of lines, of each window whose content occurs earlier."""
    found = materialise(fingerprints(docs, run, words), "winnow")
    picked = found.select("doc_id", "version", "hashes", "windows", F.explode("picks").alias("p")).select("*", F.element_at("hashes", F.col("p") + 1).alias("h"))
    shared = materialise(picked.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "winnow-shared")
    reach = F.sequence(F.greatest(F.lit(0), F.col("p") - run + 1), F.col("p"))
    around = picked.select("*", F.explode(reach).alias("at")).withColumn("n", F.get("windows", F.col("at"))).filter("at + n > p")
    around = around.withColumn("w", F.slice("hashes", F.col("at") + 1, F.col("n")))
    around = around.select("doc_id", "version", "h", "at", "n", F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(1), "w").alias("w2"))
    around = materialise(around.join(shared, "h").select("doc_id", "version", "at", "n", "w1", "w2").distinct(), "winnow-windows")
    first = around.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "version", "at")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    first = materialise(first, "winnow-first")
    return around.join(first, ["w1", "w2"]).filter(F.struct("doc_id", "version", "at") != F.col("first")).select("doc_id", "version", "at", "n")


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``docs`` with repeated runs cut from ``text``, and n_lines and n_removed (long)."""
    docs = docs.drop("n_lines", "n_removed")
    gone = repeated_windows(docs.select("doc_id", "text"), run, words).groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("_at"))
    rows = docs.join(gone, (docs["doc_id"] == gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_version"]), "left").withColumn("_lines", _lines(F.col("text")))
    drop = F.array_distinct(F.flatten(F.transform("_at", lambda a: F.sequence(a["at"], a["at"] + a["n"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    keep = F.transform(left, lambda i: F.get("_lines", i))
    rows = rows.withColumn("_drop", drop)
    out = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return rows.withColumns({"text": out, "n_lines": n, "n_removed": F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long")}).select(*docs.columns, "n_lines", "n_removed")
