"""Quality rules: per-document counts, and cross-document line frequency per host.

Only DataFrame functions. Lines are normalised (stripped, lower case, white
space runs as one space) and hashed together with their host. Lines held by
more than ``limit`` documents of a host go from all of them but the one with
the smallest doc_id; a document left with too little is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import _common as C

_WS = "[ \t-\r]"  # the characters themselves: SQL literals read backslashes too


#: Texts of this many words or more have their repeated windows confirmed by a second hash.
LONG = 1 << 14


def _repeat_words(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``w`` (words) and ``n_words``.

    Window hashes are shifted to make room for the window's position, so that
    one primitive sort brings equal windows together and tells where they are.
    In a long text so few bits are left that windows meet by chance: there the
    windows found are sorted once more by another hash.
    """

    def equal_neighbours(name: str) -> str:
        return f"sort_array(transform(filter({name}, (x, i) -> (i > 0 AND shiftrightunsigned(x ^ {name}[greatest(i - 1, 0)], pb) = 0) OR (i < size({name}) - 1 AND shiftrightunsigned(x ^ {name}[least(i + 1, size({name}) - 1)], pb) = 0)), x -> x & (shiftleft(1L, pb) - 1)))"

    d = d.withColumn("pb", F.ceil(F.log2(F.col("n_words") + F.lit(1))).cast("int"))
    d = C.settled(d, "every", F.expr("CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, cast(n_words AS int) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), pb) | cast(i AS bigint))) ELSE array() END"))
    d = C.settled(d, "once", F.expr(equal_neighbours("every"))).drop("every")
    d = C.settled(d, "again", F.expr(f"CASE WHEN n_words >= {LONG} THEN sort_array(transform(once, i -> shiftleft(xxhash64(1, w[cast(i AS int)], w[cast(i AS int) + 1], w[cast(i AS int) + 2]), pb) | i)) ELSE array() END")).drop("w")
    d = C.settled(d, "s", F.expr(f"CASE WHEN n_words >= {LONG} THEN {equal_neighbours('again')} ELSE once END")).drop("once", "again")
    return d.withColumn("n_repeat_words", F.expr("CASE WHEN size(s) = 0 THEN 0L ELSE aggregate(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> least(3L, b - a)), 3L, (t, x) -> t + x) END")).drop("s", "pb")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    d = C.texts(docs, "source").select(
        "doc_id",
        F.xxhash64("text", "source").alias("text_hash"),
        F.expr(f"split(btrim(text, '{C.WS}'), '{_WS}+')").alias("w"),
        F.length(F.regexp_replace("text", f"{_WS}++", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.expr("filter(split(text, '\n'), l -> l RLIKE '[^ \t-\r]')").alias("lines"),
    )
    d = d.select("doc_id", "text_hash", "w", "word_chars", "n_symbols", F.when(F.col("word_chars") == 0, 0).otherwise(F.size("w")).cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    d = _repeat_words(d)
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_hash and ``lines``, those with a word: i (place in the text) and l (normalised)."""
    return C.texts(docs, F.col("source").alias("host")).select("doc_id", "host", F.xxhash64("text", "host").alias("text_hash"), F.expr(f"filter(transform(split(lower(text), '\n'), (l, i) -> struct(i AS i, btrim(regexp_replace(l, '{_WS}++', ' ')) AS l)), x -> x.l <> '')").alias("lines"))


def frequent_lines(docs: DataFrame, limit: int) -> DataFrame:
    """h (hash of host and line), first (smallest doc_id) of the lines in more than ``limit`` documents of a host. Rows of one doc_id are one document; a null doc_id is none."""
    held = _lines(docs).select("doc_id", F.explode(F.expr("array_distinct(transform(lines, x -> xxhash64(host, x.l)))")).alias("h"))
    return held.groupBy("h").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") > limit).select("h", "first")


def quality_rules(docs: DataFrame, limit: int = 64, min_share: float = 0.3, min_words: int = 20, broadcast_rows: int = 500_000) -> DataFrame:
    """The base rules' columns, removed_words, removed_lines, removed_at (the removed lines' places), depleted, kept; one row per row of ``docs``.

    Null text counts as empty and fails; a null host is a host; a null doc_id
    is never a line's first holder. A table without rows gives none. Other
    columns aren't read. Equal lines tie by the smallest doc_id.

    The frequent lines are broadcast up to ``broadcast_rows`` (16 bytes each);
    beyond, lines and frequent lines are joined by hash and one of 16 salts.
    """
    frequent = C.Workspace(docs.sparkSession, "quality").table(frequent_lines(docs, limit), "frequent")
    every = _lines(docs).select("doc_id", "text_hash", F.explode(F.expr("transform(lines, x -> struct(x.i AS pos, xxhash64(host, x.l) AS h, size(split(x.l, ' ')) AS n))")).alias("line")).select("doc_id", "text_hash", "line.pos", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    if frequent.count() <= broadcast_rows:
        met = every.join(F.broadcast(frequent), "h")
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        met = every.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(16))).join(salted, ["h", "salt"])
    gone = met.filter(~F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False)))
    gone = gone.select("doc_id", "text_hash", "pos", "n").distinct().groupBy("doc_id", "text_hash").agg(F.sum("n").alias("removed_words"), F.count("*").alias("removed_lines"), F.collect_list("pos").alias("removed_at"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "removed_words", "removed_lines", "removed_at")
    base = base_rules(docs)
    out = base.join(gone, base["doc_id"].eqNullSafe(gone["d"]) & (base["text_hash"] == gone["t"]), "left").drop("d", "t")
    left = F.col("n_words") - F.col("removed_words")
    return (
        out.fillna(0, ["removed_words", "removed_lines"])
        .withColumn("depleted", (F.col("removed_words") > 0) & ((left < min_words) | (left < min_share * F.col("n_words"))))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def keep_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, without their frequent lines (n_chars follows); other columns as they are, whatever their names. Null texts and empty ones fail, so they go; rows that repeat a document are kept alike."""
    names = docs.columns
    good = quality_rules(docs, **limits).filter("kept").select("doc_id", "text_hash", F.col("removed_at").alias("gone")).dropDuplicates(["doc_id", "text_hash"])
    # all columns travel as one, so none of theirs can clash with the verdicts'
    packed = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit("")), docs["source"]).alias("hash"))
    out = packed.join(good, packed["id"].eqNullSafe(good["doc_id"]) & (packed["hash"] == good["text_hash"]))
    text = F.expr("CASE WHEN gone IS NULL THEN row.text ELSE array_join(filter(split(row.text, '\n'), (l, i) -> NOT array_contains(gone, i)), '\n') END")
    new = {"text": text}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in names))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "removed_lines", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM d),
w AS (SELECT doc_id, source, text, CASE WHEN trimmed = '' THEN []::VARCHAR[] ELSE string_split_regex(trimmed, '[\x20\x09-\x0D]+') END AS words FROM t),
tri AS (SELECT doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n >= 2),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT * FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
norm AS (SELECT doc_id, source, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM worded),
freq AS (SELECT source, line, min(doc_id) AS first FROM norm GROUP BY source, line HAVING count(DISTINCT doc_id) > 64),
gone AS (SELECT n.doc_id, sum(len(string_split(n.line, ' '))) AS removed_words, count(*) AS removed_lines FROM norm n JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line WHERE n.doc_id <> f.first GROUP BY n.doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words, coalesce(removed_lines, 0)::BIGINT AS removed_lines
  FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words)) AS kept
FROM m
"""
