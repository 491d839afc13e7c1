"""Quality rules with adaptive thresholds, in DataFrame functions only.

Signals of each text are compared with fences that come from mergeable quantile sketches per
language and source instead of fixed cutoffs. A sketch is a histogram of integer buckets with a
bounded relative width (1/32), as in high-dynamic-range histograms: counts add up, so sketches of
sources merge into those of a language and of the corpus, partial aggregation builds them before any
shuffle, and the result does not depend on the order of rows. Every source has quantiles of its own at
any size: they are drawn towards its language's, and those towards the corpus', as if the wider group
had ``PRIOR`` documents more in the narrower one. So a verdict does not jump when a source grows, and
one document alone sets no fence. Fences are joined back to the signals, never to the texts.

A fence lies REACH times the distance of the outer decile from the median beyond that decile. Signals that
most documents do not have at all (symbols, duplicate lines, repeated words) are judged behind a hurdle: their
sketches hold the documents that have them, so the fence says how much of it is usual where there is some, in
that language and source, and documents without any always pass. No fence is a constant.

Defined cases: a null text has no words and fails the base rule; null language or source is a group
of its own (with the empty string); repeated rows count and appear once each; an empty table gives
an empty result; other columns are ignored. Equal values share a bucket, so ties need no rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import load, staged

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents that a group's quantiles borrow from the group one level up.
PRIOR = 200
#: Distance of a fence from the outer decile, in distances of that decile from the median.
REACH = 3
#: signal: whether it has a lower fence; a signal without one is judged behind the hurdle of having it at all. Word length counts hundredths of a character, symbols and repeated words thousandths of the words, duplicate lines thousandths of the lines.
SIGNALS: dict[str, bool] = {"word_length": True, "symbol_rate": False, "dup_line_rate": False, "repeat_rate": False}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, even where ``use`` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words that lie in an eight-word window which the text has twice or more, the first one included."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda o: F.filter(o, lambda x, j: (x["h"] == F.get(o, j - 1)["h"]) | (x["h"] == F.get(o, j + 1)["h"]))
        starts = F.sort_array(F.transform(let(ordered, lambda o: F.transform(twice(o), lambda x: x["i"])), lambda i: i))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct((i + WINDOW_WORDS).alias("end"), (acc["total"] + i + WINDOW_WORDS - F.greatest(acc["end"], i)).alias("total"))
        return F.aggregate(starts, zero, step, lambda acc: acc["total"])

    def windows(single: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(single) - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(single, i, WINDOW_WORDS)))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda single: let(windows(single), count))
    return F.when(F.size(words) < WINDOW_WORDS, F.lit(0)).otherwise(hashed)


def text_metrics(docs: DataFrame) -> DataFrame:
    """The exact counts that the base rule and the signals are made of."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).cast("long").alias("n_repeat_words"))

    worded = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    lines = let(worded, lambda own: F.struct(F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col("doc_id"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        let(words_of(text), of).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    ).select("doc_id", "lang", "source", "words.n_words", "words.word_chars", "n_symbols", "lines.n_lines", "lines.n_dup_lines", "words.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def signal(name: str) -> Column:
    """Integer signals, so that sketches are exact sums."""
    rate = lambda column, times, of="n_words": F.expr(f"({times} * {column}) div greatest({of}, 1)")
    return {"word_length": rate("word_chars", 100), "symbol_rate": rate("n_symbols", 1000), "dup_line_rate": rate("n_dup_lines", 1000, "n_lines"), "repeat_rate": rate("n_repeat_words", 1000)}[name]


def bucket(value: Column) -> Column:
    """Values under 64 stay; above, five bits after the leading one decide."""
    return let(F.greatest(F.length(F.bin(value)) - 6, F.lit(0)), lambda shift: shift * 32 + F.call_function("shiftright", value, shift)).cast("int")


def bucket_edge(number: Column, upper: bool) -> Column:
    """Smallest or largest value of a bucket."""
    shift = F.greatest(F.floor(number / 32) - 1, F.lit(0)).cast("int")
    start = (number - shift * 32).cast("long")
    return F.call_function("shiftleft", start + 1, shift) - 1 if upper else F.call_function("shiftleft", start, shift)


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Deciles and median of each group's sketch; ``n`` is the group's number of documents."""
    by = Window.partitionBy(*keys, "signal")
    running = sketch.withColumn("below", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    at = lambda share: F.min(F.when(F.col("below") * 10 >= F.col("total") * share, F.col("bucket")))
    return running.groupBy(*keys, "signal").agg(at(1).alias("q10"), at(5).alias("q50"), at(9).alias("q90"), F.max("total").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, <signal>_lo, <signal>_hi) from quantiles per source, drawn towards those of the language and of the corpus."""
    by_lang = sketch.groupBy("lang", "signal", "bucket").agg(F.sum("n").alias("n"))
    corpus = by_lang.groupBy("signal", "bucket").agg(F.sum("n").alias("n"))

    def edges(rows: DataFrame, prefix: str) -> DataFrame:
        values = {"q10": bucket_edge(F.col("q10"), False), "q50": bucket_edge(F.col("q50"), False), "q90": bucket_edge(F.col("q90"), True), "n": F.col("n")}
        return rows.withColumns({f"{prefix}{q}": value for q, value in values.items()}).drop(*([*values] if prefix else []))

    narrow = edges(quantiles(sketch, ["lang", "source"]), "")
    middle, wide = edges(quantiles(by_lang, ["lang"]), "lang_"), edges(quantiles(corpus, []), "all_")
    joined = narrow.join(middle, ["lang", "signal"]).join(wide, "signal")
    drawn = lambda q: f"(n * {q} + {PRIOR} * ((lang_n * lang_{q} + {PRIOR} * all_{q}) div (lang_n + {PRIOR}))) div (n + {PRIOR})"
    chosen = joined.select("lang", "source", "signal", *[F.expr(drawn(q)).alias(q) for q in ("q10", "q50", "q90")])
    out = []
    for name, lower in SIGNALS.items():
        mine = F.col("signal") == name
        if lower:
            out.append(F.max(F.when(mine, F.col("q10") - REACH * (F.col("q50") - F.col("q10")))).alias(f"{name}_lo"))
        out.append(F.max(F.when(mine, F.col("q90") + REACH * (F.col("q90") - F.col("q50")))).alias(f"{name}_hi"))
    return chosen.groupBy("lang", "source").agg(*out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base rule and verdict of each document. A document that meets the base rule stays unless a signal is beyond its group's fence."""
    measured = staged(text_metrics(docs), "quality").withColumn("base_failed", base_failed()).withColumns({name: signal(name) for name in SIGNALS})
    held = [F.when(F.lit(lower) | (F.col(name) > 0), F.struct(F.lit(name).alias("signal"), bucket(F.col(name)).alias("bucket"))) for name, lower in SIGNALS.items()]
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array_compact(F.array(*held))).alias("s"))
    sketch = rows.groupBy("lang", "source", "s.signal", "s.bucket").agg(F.count(F.lit(1)).alias("n"))
    inside = F.lit(True)
    for name, lower in SIGNALS.items():
        inside = inside & F.coalesce(F.col(name) <= F.col(f"{name}_hi"), F.lit(True))
        if lower:
            inside = inside & F.coalesce(F.col(name) >= F.col(f"{name}_lo"), F.lit(True))
    # Written, so that its size is known: a small table is broadcast, a large one joined with skew handling.
    judged = measured.join(staged(fences(sketch), "fences"), ["lang", "source"], "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "n_lines", *SIGNALS)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))


def _quantiles_sql(keys: str, table: str) -> str:
    by = f"{keys}, signal" if keys else "signal"
    return f"""
SELECT {by}, min(CASE WHEN below * 10 >= total * 1 THEN bucket END) AS q10, min(CASE WHEN below * 10 >= total * 5 THEN bucket END) AS q50,
       min(CASE WHEN below * 10 >= total * 9 THEN bucket END) AS q90, max(total) AS n
FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}) AS total FROM {table}) GROUP BY {by}"""


def _edge_sql(column: str, upper: bool) -> str:
    shift = f"greatest({column} // 32 - 1, 0)"
    start = f"({column} - {shift} * 32)"
    return f"((({start} + 1) << {shift}) - 1)" if upper else f"({start} << {shift})"


def _sql() -> str:
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    edge = lambda t, q: _edge_sql(f"{t}.{q}", q == "q90")
    drawn = lambda q: f"((a.n * {edge('a', q)} + {PRIOR} * ((b.n * {edge('b', q)} + {PRIOR} * {edge('c', q)}) // (b.n + {PRIOR}))) // (a.n + {PRIOR}))::BIGINT"
    picks = f"{drawn('q10')} AS lo10, {drawn('q50')} AS lo50, {drawn('q90')} AS hi90"
    bounds, inside = [], []
    for name, lower in SIGNALS.items():
        if lower:
            bounds.append(f"max(CASE WHEN signal = '{name}' THEN lo10 - {REACH} * (lo50 - lo10) END) AS {name}_lo")
            inside.append(f"coalesce({name} >= {name}_lo, true)")
        bounds.append(f"max(CASE WHEN signal = '{name}' THEN hi90 + {REACH} * (hi90 - lo50) END) AS {name}_hi")
        inside.append(f"coalesce({name} <= {name}_hi, true)")
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \\t-\\r]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: length(trim(l, {blank})) > 0) AS ls FROM t),
win AS (SELECT doc_id, p, list_aggregate(ws[p:p+7], 'string_agg', chr(32)) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w)),
twice AS (SELECT doc_id, win FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT win.doc_id, unnest(range(p, p + 8)) AS pos FROM win JOIN twice USING (doc_id, win)) GROUP BY 1),
m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
             len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT * EXCLUDE (wc), coalesce(wc, 0)::BIGINT AS word_chars, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
d AS (SELECT *, (100 * word_chars) // greatest(n_words, 1) AS word_length, (1000 * n_symbols) // greatest(n_words, 1) AS symbol_rate,
             (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_line_rate, (1000 * n_repeat_words) // greatest(n_words, 1) AS repeat_rate FROM b),
v AS (UNPIVOT (SELECT lang, source, word_length, symbol_rate, dup_line_rate, repeat_rate FROM d WHERE NOT base_failed) ON {', '.join(SIGNALS)} INTO NAME signal VALUE value),
h AS (SELECT * FROM v WHERE value > 0 OR signal IN ({', '.join(f"'{name}'" for name, lower in SIGNALS.items() if lower)})),
k AS (SELECT lang, source, signal, greatest(length(bin(value)) - 6, 0) * 32 + (value >> greatest(length(bin(value)) - 6, 0)) AS bucket FROM h),
sk AS (SELECT lang, source, signal, bucket, count(*) AS n FROM k GROUP BY ALL),
skl AS (SELECT lang, signal, bucket, sum(n) AS n FROM sk GROUP BY ALL),
ska AS (SELECT signal, bucket, sum(n) AS n FROM skl GROUP BY ALL),
qs AS ({_quantiles_sql('lang, source', 'sk')}), ql AS ({_quantiles_sql('lang', 'skl')}), qa AS ({_quantiles_sql('', 'ska')}),
edge AS (SELECT a.lang, a.source, a.signal, {picks} FROM qs a JOIN ql b ON a.lang = b.lang AND a.signal = b.signal JOIN qa c ON a.signal = c.signal),
f AS (SELECT lang, source, {', '.join(bounds)} FROM edge GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(inside)} AS kept, n_lines, {', '.join(SIGNALS)}
FROM d LEFT JOIN f USING (lang, source)
"""


SQL = _sql()
