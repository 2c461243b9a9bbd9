"""Quality rules with adaptive limits: quantile sketches of each language and source instead of fixed cutoffs. Native.

Every text is measured once (words, their characters, symbols, repeated lines, repeated three-word windows). Four traits,
whole numbers so that every engine computes them alike, are then sketched for each (language, source):

* ``repeat``: words in repeated windows, of 1000;  ``symbol``: symbols per 1000 words;
* ``line``: repeated lines, of 1000;               ``length``: characters per 100 words.

A sketch counts values in buckets whose width is at most 1/32 of the value (below 64 every value has a bucket of its own),
so two sketches merge by adding counts, a quantile is off by at most a bucket, and the size is bounded however many rows
went in. The limits of a trait are its far fences: ``FENCE`` spreads beyond the quartiles, where the spread is the
distance of the quartiles, or the trait's least spread where nearly all texts agree. Sketches of groups with fewer than
``LEAST_ROWS`` texts say little: their language's merged sketch takes over, or that of all texts. The limits are joined
back to the texts by (language, source).

The base rules come first and don't adapt: too few words, or most words in repeated windows. Texts that fail them are
neither sketched nor kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm.tables import materialize, unused

LEAST_WORDS = 50              # base rule: fewer words fail
MOST_REPEATED = 50            # base rule: more than this percentage of words in repeated windows fails
LEAST_ROWS = 100              # rows of a sketch that sets limits of its own
FENCE = 6                     # spreads between a quartile and the limit
#: trait -> (least spread, whether low values fail as well)
TRAITS = {"repeat": (50, False), "symbol": (25, False), "line": (60, False), "length": (40, True)}
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_FINE = 32                    # buckets for each power of two


def words_of(text: Column) -> Column:
    """Words of a text: everything between blanks, tabs and line ends of ASCII; none if it is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words (long) that lie in a window of three words which the text holds twice or more, its first place included.

    Windows are compared as strings: no word holds a blank, so a joined window tells its words. Only a text with repeats
    sorts its windows; neighbours in that order that are equal give the places, whose union is added up."""
    def covered(grams: Column) -> Column:
        numbered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, b: F.get(s, a)["g"] == F.get(s, b)["g"]
            repeated = F.filter(F.sequence(F.lit(0), last),
                                lambda j: ((j > 0) & same(j - 1, j)) | ((j < last) & same(j, j + 1)))
            return F.sort_array(F.transform(repeated, lambda j: F.get(s, j)["i"]))

        def union(p: Column) -> Column:
            first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(p, first, lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

        return union(bound(numbered, places))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        repeats = bound(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g))
                        .otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) > 3, repeats).otherwise(F.lit(0).cast("long"))

    return bound(words, of)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row.

    ``n_lines`` are lines with a word; a null text has none of anything."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, _BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    counted = bound(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat")))
    lined = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                    counted.alias("w"), lined.alias("l"), F.char_length(bare).cast("long").alias("word_chars"),
                    (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    return d.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
                    F.col("l.n").alias("n_lines"), F.col("l.again").alias("n_dup_lines"),
                    F.col("w.repeat").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def traits() -> dict[str, Column]:
    """Whole-number traits of a measured text with at least one word."""
    share = lambda part, whole, scale: F.expr(f"({scale} * {part}) div greatest({whole}, 1)")
    return {"repeat": share("n_repeat_words", "n_words", 1000), "symbol": share("n_symbols", "n_words", 1000),
            "line": share("n_dup_lines", "n_lines", 1000), "length": share("word_chars", "n_words", 100)}


def bucket(value: str) -> Column:
    """Sketch bucket of a whole number of 0 or more: its power of two and the five bits after the leading one."""
    power = f"length(bin({value})) - 1"
    return F.expr(f"CASE WHEN {value} < {2 * _FINE} THEN {value} ELSE "
                  f"{_FINE} * ({power} - 5) + shiftright({value}, {power} - 5) END").cast("long")


def bucket_ends(number: str) -> tuple[Column, Column]:
    """Least and largest value of a bucket."""
    low = f"shiftleft({number} % {_FINE} + {_FINE}, CAST({number} DIV {_FINE} - 1 AS INT))"
    wide = f"shiftleft(1L, CAST({number} DIV {_FINE} - 1 AS INT))"
    return (F.expr(f"CASE WHEN {number} < {2 * _FINE} THEN {number} ELSE {low} END"),
            F.expr(f"CASE WHEN {number} < {2 * _FINE} THEN {number} ELSE {low} + {wide} - 1 END"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, trait, bucket, n): one sketch for each language, source and trait, as rows."""
    values = F.array(*[F.struct(F.lit(t).alias("trait"), v.alias("value")) for t, v in traits().items()])
    long = measured.where(~base_failed()).select("lang", "source", F.explode(values).alias("t"))
    return (long.select("lang", "source", "t.trait", F.col("t.value").alias("value"))
            .groupBy("lang", "source", "trait", bucket("value").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: counts of the same bucket are added."""
    return sketch.groupBy(*by, "trait", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, *by: str) -> DataFrame:
    """(*by, trait, rows, low, high): a sketch's far fences.

    A group's buckets, a few hundred for each power of two at most, are gathered into one sorted array; the quartile of
    rank r is the first bucket at which more than r values are behind or in it."""
    def at(share: int) -> Column:
        rank = F.expr(f"(({share} * (rows - 1)) div 4)")
        step = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("at")),
                           lambda a, x: F.when(a["at"] >= 0, a).otherwise(F.struct(
                               (a["n"] + x["n"]).alias("n"),
                               F.when(a["n"] + x["n"] > rank, x["bucket"]).otherwise(F.lit(-1).cast("long")).alias("at"))))
        return step["at"]

    whole = sketch.groupBy(*by, "trait").agg(F.sum("n").alias("rows"),
                                             F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    q = whole.select(*by, "trait", "rows", at(1).alias("b1"), at(3).alias("b3"))
    q = q.select(*by, "trait", "rows", bucket_ends("b1")[0].alias("q1"), bucket_ends("b3")[1].alias("q3"))
    least = reduce(lambda c, t: c.when(F.col("trait") == t[0], t[1][0]), TRAITS.items(), F.when(F.lit(False), 0))
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    both = F.col("trait").isin([t for t, (_, low) in TRAITS.items() if low])
    return q.select(*by, "trait", "rows", F.when(both, F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def wide(lim: DataFrame, *by: str, name: str) -> DataFrame:
    """One row a group: a struct ``name`` of its rows and its limits by trait."""
    out = [F.max("rows").alias("rows")]
    for t in TRAITS:
        out += [F.max(F.when(F.col("trait") == t, F.col(c))).alias(f"{t}_{c}") for c in ("low", "high")]
    cols = ["rows", *[f"{t}_{c}" for t in TRAITS for c in ("low", "high")]]
    return lim.groupBy(*by).agg(*out).select(*[F.col(b).alias(f"_{name}_{b}") for b in by], F.struct(*cols).alias(name))


def limit_table(sketch: DataFrame) -> DataFrame:
    """(_own_lang, _own_source, cut): limits for every language and source that has a sketch. A sketch of fewer than
    ``LEAST_ROWS`` rows gives way to its language's, that one to that of all texts."""
    own = wide(limits(sketch, "lang", "source"), "lang", "source", name="own")
    by_lang = merged(sketch, "lang")
    lang = wide(limits(by_lang, "lang"), "lang", name="of_lang")
    everything = limits(merged(by_lang).withColumn("_", F.lit(0)), "_")
    all_ = wide(everything, "_", name="of_all")
    joined = own.join(lang, own["_own_lang"].eqNullSafe(lang["_of_lang_lang"]), "left")
    joined = joined.withColumn("_", F.lit(0)).join(all_.withColumnRenamed("_of_all__", "_"), "_", "left")
    pick = (F.when(F.col("own.rows") >= LEAST_ROWS, F.col("own"))
            .when(F.col("of_lang.rows") >= LEAST_ROWS, F.col("of_lang")).otherwise(F.col("of_all")))
    return joined.select("_own_lang", "_own_source", pick.alias("cut"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    Null texts and texts without a word fail the base rules. Rows without a language or source form groups of their own.
    Repeated rows are judged, and counted in the sketches, each by itself. Other columns are not read. An empty table
    gives no rows."""
    measured = materialize(measure(docs, id_col, text_col, lang_col, source_col), "quality")
    cuts = materialize(limit_table(sketches(measured)), "quality-limits")
    own = traits()
    good = F.lit(True)
    for t, (_, low) in TRAITS.items():
        good = good & (own[t] <= F.col(f"cut.{t}_high"))
        if low:
            good = good & (own[t] >= F.col(f"cut.{t}_low"))
    d = measured.join(cuts, measured["lang"].eqNullSafe(cuts["_own_lang"])
                      & measured["source"].eqNullSafe(cuts["_own_source"]), "left")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base_failed().alias("base_failed"),
                    F.when(base_failed(), F.lit(False)).otherwise(good).alias("kept"))


def keep_good(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    row = unused(docs, "_row")
    kept = judge(docs.withColumn(row, F.struct(*docs.columns)), id_col=row, **columns).where("kept")
    return kept.select("doc_id.*")


def op13_sql() -> str:
    """The same rules in DuckDB SQL over ``documents``."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    power = "(length(bin(v)) - 1)"
    number = f"CASE WHEN v < {2 * _FINE} THEN v ELSE {_FINE} * ({power} - 5) + (v >> ({power} - 5)) END"
    least = " ".join(f"WHEN trait = '{t}' THEN {s}" for t, (s, _) in TRAITS.items())
    own = {"repeat": "1000 * n_repeat_words // greatest(n_words, 1)", "symbol": "1000 * n_symbols // greatest(n_words, 1)",
           "line": "1000 * n_dup_lines // greatest(n_lines, 1)", "length": "100 * word_chars // greatest(n_words, 1)"}
    values = " UNION ALL ".join(f"SELECT lang, source, '{t}' AS trait, {e} AS v FROM good" for t, e in own.items())
    low = lambda b: f"CASE WHEN {b} < {2 * _FINE} THEN {b} ELSE ({b} % {_FINE} + {_FINE}) << CAST({b} // {_FINE} - 1 AS INT) END"
    top = lambda b: f"CASE WHEN {b} < {2 * _FINE} THEN {b} ELSE {low(b)} + (1 << CAST({b} // {_FINE} - 1 AS INT)) - 1 END"
    sides = [f"(t.trait <> '{t}' OR ({own[t]} <= high{f' AND {own[t]} >= low' if both else ''}))" for t, (_, both) in TRAITS.items()]
    return f"""
WITH d AS (SELECT doc_id, lang, source, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: translate(x, {blanks}, '') <> '') AS ls FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
found AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(translate(text, {blanks}, '')) AS word_chars,
        length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words
      FROM w LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
good AS (SELECT * FROM judged WHERE NOT base_failed),
v AS ({values}),
own AS (SELECT 0 AS lvl, lang, source, trait, {number} AS b, count(*) AS n FROM v GROUP BY ALL),
sk AS (FROM own UNION ALL SELECT 1, lang, NULL, trait, b, sum(n) FROM own GROUP BY ALL
       UNION ALL SELECT 2, NULL, NULL, trait, b, sum(n) FROM own GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, trait ORDER BY b) AS upto,
               sum(n) OVER (PARTITION BY lvl, lang, source, trait) AS rows FROM sk),
q AS (SELECT lvl, lang, source, trait, max(rows) AS rows, min(CASE WHEN upto > (rows - 1) // 4 THEN b END) AS b1,
             min(CASE WHEN upto > 3 * (rows - 1) // 4 THEN b END) AS b3 FROM cum GROUP BY ALL),
e AS (SELECT *, {low('b1')} AS q1, {top('b3')} AS q3 FROM q),
lim AS (SELECT lvl, lang, source, trait, rows, q1 - {FENCE} * greatest(q3 - q1, CASE {least} END) AS low,
               q3 + {FENCE} * greatest(q3 - q1, CASE {least} END) AS high FROM e),
t AS (SELECT j.doc_id, o.trait,
             CASE WHEN o.rows >= {LEAST_ROWS} THEN o.low WHEN l.rows >= {LEAST_ROWS} THEN l.low ELSE a.low END AS low,
             CASE WHEN o.rows >= {LEAST_ROWS} THEN o.high WHEN l.rows >= {LEAST_ROWS} THEN l.high ELSE a.high END AS high
      FROM good j JOIN lim o ON o.lvl = 0 AND o.lang IS NOT DISTINCT FROM j.lang AND o.source IS NOT DISTINCT FROM j.source
      JOIN lim l ON l.lvl = 1 AND l.lang IS NOT DISTINCT FROM j.lang AND l.trait = o.trait
      JOIN lim a ON a.lvl = 2 AND a.trait = o.trait),
verdict AS (SELECT doc_id, bool_and({' AND '.join(sides)}) AS kept FROM t JOIN good USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       COALESCE(kept, false) AS kept
FROM judged LEFT JOIN verdict USING (doc_id)"""
