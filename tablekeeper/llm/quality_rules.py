"""Quality rules: line frequency across the documents of a host.

Each document is cut into lines; a line is normalised (blanks joined, lower case) and hashed. For every host
and line the distinct documents are counted. Lines found in more documents than the limit, which follows the number
of the host's documents, are removed, and a document is rejected if too little of it is left, or if the rules on the document itself fail.

Everything is DataFrame functions. Lines are explored once per document and line, pre-aggregated before the
shuffle, and joined back to the few lines above the limit, so that a hot line or host is many narrow rows.

Defined results: NULL text has no words, fails the rules and is not kept; a NULL host is a host of its own;
a NULL id is one document for the count; repeated rows each get a row, and count as one document if they
share their id; texts without lines that hold a word have nothing to remove; an empty table gives no rows;
other columns are ignored.
"""

from pyspark.sql import functions as F

from tablekeeper.llm.tables import SPACE, let, load, staged, words

#: A line of a host is removed if more documents than this, and more than this share of the host's, have it.
LEAST_DOCUMENTS = 5
MOST_PERCENT = 5
#: A document is kept if at least this many words, and this share of its words in percent, are left.
LEAST_WORDS = 20
LEAST_PERCENT = 30
WINDOW = 8


def repeated_words(tokens, width=WINDOW):
    """Number of words inside windows of ``width`` words that occur at least twice in the array."""

    def positions(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"])
                     | x["h"].eqNullSafe(F.get(s, j + 1)["h"])),
            lambda x: x["i"],
        )))

    def covered(found):
        return let(found, lambda p: F.aggregate(
            F.transform(p, lambda at, j: F.least(
                F.lit(width), F.coalesce(F.get(p, j + 1) - at, F.lit(width)))),
            F.lit(0), lambda total, x: total + x,
        ))

    windows = let(tokens, lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
    ))
    count = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        covered(positions(h))))
    return F.when(F.size(tokens) <= width, F.lit(0)).otherwise(count).cast("long")


def base_measures(text):
    """Columns of the rules on one document, by name."""
    whole = F.coalesce(text, F.lit(""))
    tokens = words(text)
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(tokens),
    }


def normal_lines(text):
    """Array of (``line``, ``check``, ``n``): hashes and words of each normalised line that has a word.

    Two hashes of 64 and 32 bits stand for the line.
    """
    joined = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.trim(F.regexp_replace(line, SPACE + "+", " ")),
    )
    return F.transform(
        F.filter(F.transform(joined, F.lower), lambda line: line != ""),
        lambda line: F.struct(
            F.xxhash64(line).alias("line"), F.hash(line).alias("check"),
            (F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).cast("long").alias("n"),
        ),
    )


def host_key(host):
    """The host as a column that is never NULL."""
    return F.concat(F.when(host.isNull(), "0").otherwise("1"), F.coalesce(host.cast("string"), F.lit("")))


def hashed_lines(docs, host="source"):
    """(``host``, ``doc_id``, ``lines``) of every row."""
    return docs.select(host_key(F.col(host)).alias("host"), "doc_id", normal_lines(F.col("text")).alias("lines"))


def frequent_lines(lines, least=LEAST_DOCUMENTS, percent=MOST_PERCENT):
    """(``host``, ``line``, ``check``) of the lines that too many distinct documents of their host have.

    ``lines`` is what ``hashed_lines`` gives. A document counts each line once: rows of one id are merged per line
    before they are counted.
    """
    over = lambda n: (F.col(n) > least) & (100 * F.col(n) > percent * F.col("documents"))
    # Read back, so that a host of very many lines can be split by the join.
    sizes = staged(lines.select("host", "doc_id").distinct().groupBy("host").agg(
        F.count("*").alias("documents")), "hosts")
    each = lines.select("host", "doc_id", F.explode(F.array_distinct(F.transform(
        "lines", lambda x: F.struct(x["line"], x["check"])))).alias("x")).select("host", "x.line", "x.check", "doc_id")
    key = ["host", "line", "check"]
    # Rows are no fewer than documents, so this keeps all lines above the limit.
    many = each.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > least).join(
        sizes, "host").where(over("rows")).select(*key, "documents")
    distinct = each.join(many.select(*key), key, "left_semi").groupBy(*key, "doc_id").agg(F.lit(1).alias("one"))
    return distinct.groupBy(*key).agg(F.count("*").alias("n")).join(many, key).where(over("n")).select(*key)


def judged(docs, least=LEAST_DOCUMENTS, percent=MOST_PERCENT, least_words=LEAST_WORDS, least_percent=LEAST_PERCENT,
           host="source"):
    """``doc_id``, the measures, ``base_failed``, ``removed_words`` and ``kept`` of every row.

    Texts are read once: measures and hashes of the lines are staged, and all further work is on these.
    """
    measures = base_measures(F.col("text"))
    rows = staged(docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), host_key(F.col(host)).alias("host"),
        *[column.alias(name) for name, column in measures.items()],
        normal_lines(F.col("text")).alias("lines"),
    ), "quality-lines")
    # One row per line; the measures travel on the first one only.
    each = rows.select(
        "row", "host", F.struct("doc_id", *measures).alias("own"), F.posexplode_outer("lines").alias("i", "x"),
    ).select(
        "row", "host", "x.line", "x.check", "x.n",
        F.when(F.coalesce(F.col("i"), F.lit(0)) == 0, F.col("own")).alias("own"),
    )
    found = frequent_lines(rows.select("host", "doc_id", "lines"), least, percent).withColumn("frequent", F.lit(True))
    together = each.join(found, ["host", "line", "check"], "left").groupBy("row").agg(
        *[F.max(F.col("own")[name]).alias(name) for name in ("doc_id", *measures)],
        F.coalesce(F.sum(F.when(F.col("frequent"), F.col("n"))), F.lit(0)).alias("removed_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return together.select(
        "doc_id", *measures, failed.alias("base_failed"), "removed_words",
        (~failed & (left >= least_words) & (100 * left >= least_percent * F.col("n_words"))).alias("kept"),
    )


def cleaned(docs, least=LEAST_DOCUMENTS, percent=MOST_PERCENT, host="source"):
    """``docs`` with the frequent lines taken out of ``text``; all columns stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = staged(docs.select(F.monotonically_increasing_id().alias("number"), whole.alias("row")), "uncleaned")
    each = rows.select(
        "number", host_key(F.col(f"row.{host}")).alias("host"),
        F.posexplode(F.split("row.text", "\n")).alias("i", "line_text"),
    ).withColumn("x", F.get(normal_lines(F.col("line_text")), F.lit(0))).select(
        "number", "host", "i", "line_text", F.col("x.line").alias("line"), F.col("x.check").alias("check"),
    )
    found = frequent_lines(hashed_lines(rows.select("row.*"), host), least, percent)
    kept = each.join(found, ["host", "line", "check"], "left_anti").groupBy("number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line_text"))), lambda x: x["line_text"]),
                     "\n").alias("new"))
    text = F.when(F.col("row.text").isNotNull(), F.coalesce(F.col("new"), F.lit("")))
    return rows.join(kept, "number", "left").select(
        *[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_quality_rules(spark, folder):
    """The contract's columns for all of ``documents``."""
    return judged(load(spark, folder, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT rid, i, array_to_string(w[i + 1 : i + 8], ' ') AS g
  FROM w, generate_series(0, len(w.w) - 8) AS s(i) WHERE len(w) > 8),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cover AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
dl AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n FROM raw
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
ln AS (
  SELECT rid, trim(lower(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS l FROM raw),
freq AS (
  SELECT source, l, count(DISTINCT coalesce(doc_id, -1)) AS n FROM ln JOIN d USING (rid) WHERE l <> ''
  GROUP BY source, l HAVING count(DISTINCT coalesce(doc_id, -1)) > 5),
hosts AS (SELECT source, count(DISTINCT coalesce(doc_id, -1)) AS documents FROM d GROUP BY source),
many AS (
  SELECT freq.source, l FROM freq JOIN hosts ON hosts.source IS NOT DISTINCT FROM freq.source
  WHERE 100 * n > 5 * documents),
rem AS (
  SELECT rid, sum(len(string_split(ln.l, ' '))) AS n
  FROM ln JOIN d USING (rid) JOIN many ON many.l = ln.l AND many.source IS NOT DISTINCT FROM d.source
  GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(rem.n, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN rem USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 20
    AND 100 * (n_words - removed_words) >= 30 * n_words AS kept
FROM m
"""
