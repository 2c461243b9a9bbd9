"""Line deduplication by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold.

A line is the text between line feeds, compared without outer blanks and in lower case; one of nothing but white space
is blank and stays (so do lines of fewer than ``min_chars`` characters, where a caller asks for that). A line, however
short, that at least ``min_sites`` different sites hold is boilerplate: it
stays at its first place (least document id, text hash, position) and goes everywhere else. Spark's functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm.tables import materialize, unused

MIN_SITES = 5
BLANK = r"[^\x09-\x0D\x1C-\x20\p{Z}]"     # what a line that isn't blank holds
LG_K = 11            # registers of a sketch: 2048, a standard error of 1.8 %
NEAR = 0.15          # estimates within this share of the threshold (one site at least) are counted exactly


def _keyed_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """(site, doc, code, pos, line): a row for each line that counts; line is a hash of the normalised line."""
    split = docs.select(F.col(site_col).alias("site"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("code"),
                        F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    plain = F.lower(F.trim("raw"))
    counted = F.col("raw").rlike(BLANK) & (F.char_length(F.trim("raw")) >= min_chars)
    return split.where(counted).select("site", "doc", "code", "pos", F.xxhash64(plain).alias("line"))


def site_spread(lines: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(line, sites): estimated number of distinct sites of each line. Sketches are partial in every map task and
    merge by aggregation, so a line that a third of all rows hold sends one sketch a task. Null sites don't count."""
    return lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K,
                near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(line, sites, exact, home) of the lines on ``min_sites`` sites or more; home is the place that keeps the line.
    With them the rows of ``lines`` that were near or above the threshold.

    Estimates clearly above the threshold stand; those near it are settled by an exact distinct count.
    """
    band = max(1.0, near * min_sites)
    spread = site_spread(lines, lg_k).where(F.col("sites") >= min_sites - band)
    spread = materialize(spread.withColumn("near", F.col("sites") <= min_sites + band), "line-spread")
    place = F.struct("doc", "code", "pos")
    # written before it is aggregated: a join alone, so that Spark can split the rows of a very common line
    found = materialize(lines.join(spread, "line"), "line-candidates")
    # two steps of one distinct count: a line's rows first meet by site, so no site list is gathered anywhere
    by_site = found.groupBy("line", "site").agg(F.first("sites").alias("sites"), F.first("near").alias("near"),
                                                F.min(place).alias("home"))
    settled = by_site.groupBy("line").agg(F.first("sites").alias("estimate"), F.first("near").alias("exact"),
                                          F.count("site").alias("counted"), F.min("home").alias("home"))
    settled = settled.where(~F.col("exact") | (F.col("counted") >= min_sites))
    sites = F.when(F.col("exact"), F.col("counted")).otherwise(F.col("estimate"))
    settled = materialize(settled.select("line", sites.alias("sites"), "exact", "home"), "line-boilerplate")
    return settled, found


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions in ``gone``; the array of lines is bound once."""
    def cut(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.transform(F.array(F.split(text, "\n")), cut)[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = MIN_SITES, min_chars: int = 1, removed_col: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines removed from its texts; ``removed_col`` adds the number of removed lines.

    Every row stays, texts may become empty; null texts stay null. Rows with the same id and the same text are treated
    alike (a line at home in one is at home in its repetitions); the same id with another text is another document. A
    null id is an id of its own. Columns of any name pass through.
    """
    lines = materialize(_keyed_lines(docs, id_col, text_col, site_col, min_chars), "line-keys")
    known, found = boilerplate(lines, min_sites)
    gone = found.join(known.select("line", "home"), "line").where(F.struct("doc", "code", "pos") != F.col("home"))
    gone = gone.groupBy("doc", "code").agg(F.collect_set("pos").alias("gone"))   # at most the lines of one text
    gone = materialize(gone, "line-positions")
    doc, code, cut, key = (unused(docs, x) for x in ("doc", "code", "gone", "key"))
    gone = gone.select(F.col("doc").alias(doc), F.col("code").alias(code), F.col("gone").alias(cut))
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    joined = keyed.join(gone, keyed[id_col].eqNullSafe(gone[doc]) & (keyed[key] == gone[code]), "left")
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(cut)))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    removed = [F.coalesce(F.size(F.col(cut)), F.lit(0)).alias(removed_col)] if removed_col else []
    return joined.select(*out, *removed)


def op9_sql(min_sites: int = MIN_SITES, min_chars: int = 1) -> str:
    """DuckDB SQL for ``queries.op9_line_dedup``: exact site counts, which the sketches agree with."""
    return f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(range(len(string_split(text, chr(10))))) AS pos,
         unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, lower(trim(raw)) AS line, regexp_matches(raw, '{BLANK}') AND length(trim(raw)) >= {min_chars} AS counts FROM lines),
spread AS (
  SELECT line, min(doc_id) AS home FROM keyed WHERE counts
  GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
first_place AS (
  SELECT s.line, s.home, min(k.pos) AS pos FROM spread s JOIN keyed k ON k.line = s.line AND k.doc_id = s.home AND k.counts
  GROUP BY ALL),
marked AS (
  SELECT k.doc_id, k.pos, k.raw, f.line IS NOT NULL AND (k.doc_id <> f.home OR k.pos <> f.pos) AS gone
  FROM keyed k LEFT JOIN first_place f ON k.line = f.line AND k.counts),
cut AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(removed, 0) AS INTEGER) AS removed_lines,
       CAST(length(kept) AS INTEGER) AS kept_chars, md5(kept) AS kept_md5
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""
