"""Quality rules for documents and for the hosts they come from. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, save

#: A host goes whole if its shrunk rate of failing documents is further than this share of the way from the corpus' rate to 1.
HOST_LIMIT = 0.5
MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Symbols to a hundred words, repeated lines to a hundred lines, and characters to a word beyond which a document's own rules fail.
#: No document of sf0.1 with quality 1 that passes the base rules has a symbol, over 33 repeated lines or words of under 3.0 or over 9.2 characters.
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 50
WORD_CHARS = (2, 12)


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)


def _windows(words: Column, hashed: bool) -> Column:
    n = F.size(words)
    window = lambda i: F.slice(words, i, WINDOW)
    body = (lambda i: F.xxhash64(window(i))) if hashed else (lambda i: F.array_join(window(i), " "))
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), body)).otherwise(F.array())


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: str | None = None) -> DataFrame:
    """Rows (id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, failed), and the column `carry` as it is.

    base_failed are the contract's two rules (words, repeats); failed adds those on symbols, repeated lines and word length. A null text counts as a text without words (all counts 0, base_failed true). Repeated rows stay separate
    rows. Other columns of docs are not read.

    Repeats: the windows' hashes are compared first, and only a text in which two are equal has its windows
    sorted with their positions (whole windows, not hashes); the sum over gaps between repeated windows of
    least(gap, 5) counts each covered word once. Work per text is n log n, whatever its repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = ["id", "host"] + ([carry] if carry else [])
    d = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), *own[2:], text.alias("text"))
    d = d.select(*own, words_of(F.col("text")).alias("w"), _lines_with_words(F.col("text")).alias("lines"),
                 (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"))
    d = d.select(*own, "w", "n_symbols",
                 F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 _windows(F.col("w"), hashed=True).alias("h"))
    same = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(same, F.array_sort(F.transform(
        _windows(F.col("w"), hashed=False), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    near = lambda x, i, by: F.coalesce(F.try_element_at(F.col("s"), i + by).getField("x") == x.getField("x"), F.lit(False))
    # element i of the 0-based s is element i+1 for element_at; 0 is no index, so the first one asks for itself alone
    repeated = F.transform(F.filter("s", lambda x, i: F.when(i > 0, near(x, F.greatest(i, F.lit(1)), 0)).otherwise(False) | near(x, i + 1, 1)),
                           lambda x: x.getField("i"))
    d = d.select(*own, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.array_sort(repeated).alias("p"))
    gaps = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))),
                      lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    n_repeat = F.when(F.size("p") > 0, F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)).otherwise(0)
    d = d.select(*own, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                 F.coalesce(n_repeat, F.lit(0)).cast("long").alias("n_repeat_words"))
    d = d.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"))
    return d.withColumn("failed", F.expr(f"""base_failed OR 100 * n_symbols > {SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines
        OR word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words"""))


def host_rates(measured: DataFrame, by: str = "failed") -> DataFrame:
    """Rows (host, n, failed, rate, shrunk, corpus): each host's rate of failures (the column `by`) drawn towards that of the corpus by a beta prior.

    The prior is fitted by moments to the hosts' own rates, each weighted by its documents: mean m and variance v give a
    strength m(1-m)/v - 1, held between 1 and 1e6; without variance hosts count as alike (1e6). Documents without a host share
    one group with a null host. An empty table gives no rows.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col(by).cast("long")).alias("failed"))
    hosts = hosts.withColumn("rate", F.col("failed") / F.col("n"))
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"),
                      (F.sum(F.col("n") * F.col("rate") * F.col("rate")) / F.sum("n")).alias("q"))
    prior = prior.selectExpr("m", "CASE WHEN q - m * m > 1e-12 THEN greatest(1.0D, least(1e6, m * (1 - m) / (q - m * m) - 1)) ELSE 1e6 END AS k")
    hosts = hosts.withColumn("prior", prior.select(F.struct("m", "k")).scalar())
    shrunk = (F.col("failed") + F.col("prior.m") * F.col("prior.k")) / (F.col("n") + F.col("prior.k"))
    return hosts.select("host", "n", "failed", "rate", shrunk.alias("shrunk"), F.col("prior.m").alias("corpus"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          host_limit: float = HOST_LIMIT, by: str = "failed", carry: str | None = None) -> DataFrame:
    """measure() plus host_shrunk, host_limit (double) and kept (boolean): a document goes if its own rules fail or its host's
    shrunk failure rate is above the limit, which lies a share host_limit of the way from the corpus' rate to 1. Null hosts are one host; repeated
    rows count each, for the host too; an empty table gives an empty result. The column `by` says which rules count, for the document
    and for its host: all of them (failed), or the contract's alone (base_failed). The column `carry` stays with its row, so
    that rows can be kept without a join.

    The measures are saved once and read twice. Rates are aggregated before the shuffle, and the join back is
    on the host: a host with a third of all rows is a skewed join side that the adaptive planner splits.
    """
    m = save(measure(docs, id_col, text_col, host_col, carry), "quality")
    # saved, so that the planner knows its size and does not shuffle the documents for a small table of hosts
    rates = save(host_rates(m, by), "hosts").select(F.col("host").alias("rate_host"), F.col("shrunk").alias("host_shrunk"), (F.col("corpus") + host_limit * (1 - F.col("corpus"))).alias("host_limit"))
    out = m.join(rates, F.col("host").eqNullSafe(F.col("rate_host")), "left").drop("rate_host")
    return out.withColumn("kept", ~F.col(by) & F.coalesce(F.col("host_shrunk") <= F.col("host_limit"), F.lit(True)))
