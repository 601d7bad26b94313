"""Removal of passages that repeat: three lines in a row that stood before, anywhere in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, skew_join, stored

#: Lines in a window.
LINES = 3


def _windows(lines: Column) -> Column:
    """(h1, h2) for each run of three lines, by its first line; null for runs of blank lines."""

    def run(i: Column) -> Column:
        three = [F.element_at(lines, i + F.lit(j + 1)) for j in range(LINES)]
        blank = F.concat(*(F.trim(x) for x in three)) == ""
        return F.when(~blank, F.struct(F.xxhash64(*three).alias("h1"), F.hash(*three).alias("h2")))

    return F.transform(F.sequence(F.lit(0), F.size(lines) - LINES), run)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines_out: str = "n_lines", removed_out: str = "n_removed") -> DataFrame:
    """The table with repeated passages taken out of its texts, and counts of lines before and removed.

    Lines end at line feeds.  Every run of three lines that are not all blank is hashed (96
    bits).  Of runs with equal hashes the first in order of (id, text hash, position) stays
    and the lines of all others go; the runs overlap, so a longer passage goes as a whole.

    Firsts are aggregated before they are shuffled, runs that very many places share are
    looked up by broadcast (``skew_join``), and only the positions of removed runs travel
    back to their documents.

    Texts of fewer than three lines have no runs and stay.  In a passage that repeats itself
    at once (a, a, a, a) the later runs overlap the first, of which line a is left.  Null text
    stays null, with 0 lines.  Rows that agree in id and text are one document: they get the
    same text.  Null ids come first.  Columns named as the new ones are replaced; an
    empty table gives no rows.
    """
    spare = docs.drop(*(c for c in docs.columns if c.lower() in (lines_out.lower(), removed_out.lower())))
    mark, covered = fresh(spare, "text_mark", "covered")
    split = F.split(F.col(text_col), "\n", -1)
    marked = spare.withColumn(mark, F.xxhash64(text_col))
    key = marked.select(F.col(id_col).alias("id"), F.col(mark).alias("mark"), split.alias("lines")).where(F.size("lines") >= LINES)
    runs = key.select("id", "mark", F.posexplode(_windows(F.col("lines"))).alias("at", "run")).where("run IS NOT NULL").select("id", "mark", "at", "run.h1", "run.h2")
    place = F.struct("id", "mark", "at")
    first = stored(runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated_runs")
    later = skew_join(runs, first, ["h1", "h2"], "n").where(place > F.col("first"))
    gone = later.groupBy("id", "mark").agg(F.flatten(F.collect_set(F.array(*(F.col("at") + j for j in range(LINES))))).alias(covered))
    # merged whatever its size: its file's size says little of the positions' size in memory, and the plan is one for all sizes
    gone = stored(gone, "removed_lines").hint("merge").withColumnsRenamed({"id": f"{covered}_id", "mark": f"{covered}_mark"})
    same = F.col(id_col).eqNullSafe(F.col(f"{covered}_id")) & (F.col(mark) == F.col(f"{covered}_mark"))
    # a text travels as its lines, cut once below the join: an expression inside the lambda would cut it again for each line
    joined = marked.withColumn(text_col, split).join(gone, same, "left").drop(f"{covered}_id", f"{covered}_mark", mark)
    whole = F.col(text_col)
    left = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col(covered))
    kept = F.when(F.col(covered).isNull(), F.array_join(whole, "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(whole, i + 1)), "\n"))
    n = F.when(whole.isNull(), 0).otherwise(F.size(whole))
    removed = F.when(F.col(covered).isNull(), 0).otherwise(F.size(F.array_distinct(F.col(covered))))
    return joined.withColumns({lines_out: n.cast("long"), removed_out: removed.cast("long"), text_col: kept}).drop(covered)


#: The same for tables without repeated ids, in DuckDB's SQL.
ORACLE_SQL = """
WITH lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM lined),
runs AS (SELECT doc_id, pos, list_slice(lines, pos + 1, pos + 3) AS run FROM placed
         WHERE pos + 3 <= len(lines) AND trim(array_to_string(list_slice(lines, pos + 1, pos + 3), ' '), ' ') <> ''),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE k > 1),
left_over AS (SELECT p.doc_id, string_agg(p.lines[p.pos + 1], chr(10) ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n_removed
              FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       CAST(coalesce(len(l.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(o.n_removed, 0) AS BIGINT) AS n_removed
FROM lined l LEFT JOIN left_over o ON l.doc_id = o.doc_id
"""
