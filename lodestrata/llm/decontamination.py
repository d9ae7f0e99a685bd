"""Benchmark decontamination by template windows. Only DataFrame functions.

A text is tokenised once: numbers, words, and the marks that end sentences or
stand for units. Each token is its own word of the template, or a typed
placeholder (number, unit behind a number, name), and keeps its value, so
values can't shift. There are two templates: ``a`` keeps all words in lower
case, ``p`` has a placeholder for each run of capitalised words. Windows of
five template words of the documents are hash-joined with those of the
benchmark, and a document holds an item if, in either template, it has at
least 0.8 of the item's windows and the slots agree along some alignment:
each value of the item's placeholders stands for one value in the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import _common as C

#: Unit names that become a placeholder behind a number. Fixed values.
UNITS = "mm cm dm m km ft in mi yd mg g kg lb oz ml cl l s sec min h hr hrs hours minutes seconds days weeks months years percent usd eur dollars euros cents k c f w kw v a hz mb gb tb kb mph kmh".split()
#: Marks that are a unit behind a number, and marks that part sentences.
SIGNS, STOPS = "%€£$", ".!?"
NUMBER = "[0-9](?:[0-9.,:/]*[0-9])?"
LETTERS = r"\\p{L}+"  # as an SQL literal reads it
TOKEN = rf"[0-9](?:[0-9.,:/]*[0-9])?|\p{{L}}+|[{SIGNS}]|[{STOPS}]"
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)


def _templates(df: DataFrame, *keys: str) -> DataFrame:
    """keys, a and p: the templates' words (w) with their values (v), of rows with keys and text. ``C.settled``: nothing is computed twice."""
    d = C.settled(df.select(*keys, "text"), "t", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).drop("text")
    digit = "({0} >= '0' AND {0} < ':')"
    unit = f"(i > 0 AND {digit.format('t[greatest(i - 1, 0)]')} AND lower(w) IN ({_LIST([*UNITS, *SIGNS])}))"
    word = f"CASE WHEN {digit.format('w')} THEN '_n' WHEN {unit} THEN '_u' WHEN w IN ({_LIST(SIGNS + STOPS)}) THEN '' ELSE lower(w) END"
    d = C.settled(d, "x", F.expr(f"transform(t, (w, i) -> named_struct('w', {word}, 'v', lower(w), 'p', NOT {unit} AND w RLIKE '^\\\\p{{Lu}}'))")).drop("t")
    run = "aggregate(slice(x, i + 1, 8), named_struct('v', '', 'on', true), (r, e) -> CASE WHEN r.on AND e.p THEN named_struct('v', concat(r.v, ' ', e.v), 'on', true) ELSE named_struct('v', r.v, 'on', false) END, r -> r.v)"
    name = f"CASE WHEN NOT e.p THEN named_struct('w', e.w, 'v', e.v) WHEN i > 0 AND x[greatest(i - 1, 0)].p THEN named_struct('w', '', 'v', '') ELSE named_struct('w', '_p', 'v', {run}) END"
    return d.select(*keys, F.expr("transform(filter(x, e -> e.w <> ''), e -> named_struct('w', e.w, 'v', e.v))").alias("a"), F.expr(f"filter(transform(x, (e, i) -> {name}), e -> e.w <> '')").alias("p"))


def _hashed(df: DataFrame, *keys: str) -> DataFrame:
    """keys, a and p: a hash of each template word, at the places of ``_templates``.

    Cheaper than that, as values are lost: 0 stands for a number (no other
    digit is left), 1 for a unit, 2 for a run of names, put in by patterns.
    """
    stop = rf"\p{{L}}01{STOPS}{SIGNS}"
    plain = F.regexp_replace(F.regexp_replace("text", NUMBER, " 0 "), rf" 0 [^{stop}]*(?:(?i:{'|'.join(UNITS)})(?!\p{{L}})|[{SIGNS}])", " 0 1 ")
    d = C.settled(df.select(*keys, plain.alias("plain")), "a", F.expr(f"transform(regexp_extract_all(plain, '[01]|{LETTERS}', 0), w -> xxhash64(lower(w)))"))
    named = F.regexp_replace(F.regexp_replace("plain", r"(?<!\p{L})\p{Lu}\p{L}*", "2"), f"2[^2{stop}]+(?=2)", "")
    d = C.settled(d.select(*keys, "a", named.alias("named")), "p", F.expr(f"transform(regexp_extract_all(named, '[012]|{LETTERS}', 0), w -> xxhash64(lower(w)))"))
    return d.drop("named")


def _windows_of(kind: str, n: int) -> str:
    """SQL: the hashes of all windows of n words of template ``kind``."""
    return f"CASE WHEN size({kind}) >= {n} THEN transform(sequence(1, size({kind}) - {n - 1}), i -> xxhash64('{kind}', slice({kind}, i, {n}))) ELSE array() END"


def item_windows(benchmark: DataFrame, window: int = 5) -> tuple[DataFrame, list[tuple[str, int]]]:
    """item, kind, h, ipos (of the window's first place), of (the item's windows) and the kinds and lengths in use.

    An item that begins with a word that may be a unit has its first window in
    two readings, as a document's number before it makes that word a unit.

    An item of fewer words is one window of its length; null and empty items,
    and such as have no word of their own besides placeholders, have none.
    Template ``p`` is used for items with a name and at least ``window`` other
    words. Of repeated item_ids every row counts.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").filter("text is not null and item_id is not null")
    own = {k: f"size(filter({k}, e -> NOT startswith(e.w, '_')))" for k in "ap"}
    t = _templates(items.withColumn("raw", F.col("text")), "item", "raw").filter(F.expr(f"{own['a']} > 0"))
    t = t.select("item", F.col("raw").alias("text"), F.expr("size(a)").alias("na"), F.expr(f"CASE WHEN exists(p, e -> e.w = '_p') AND {own['p']} >= {window} THEN size(p) ELSE 0 END").alias("np"), F.expr(f"a[0].v IN ({_LIST(UNITS)})").alias("u"))
    lengths = sorted(r["n"] for r in t.select(F.least("na", F.lit(window)).alias("n")).distinct().collect())
    used = [("a", n) for n in lengths] + ([] if t.filter("np > 0").isEmpty() else [("p", window)])
    hashed = _hashed(t, "item", "na", "np", "u")
    sizes = [("a", n, F.least("na", F.lit(window)) == n) for n in lengths] + [("p", window, F.col("np") > 0)]
    parts = [hashed.filter(held).select("item", F.lit(k).alias("kind"), F.posexplode(F.expr(_windows_of(k, n))).alias("ipos", "h")) for k, n, held in sizes]
    as_unit = [hashed.filter(held & F.col("u")).select("item", F.lit(k).alias("kind"), F.lit(0).alias("ipos"), F.expr(f"xxhash64('{k}', concat(array(xxhash64('1')), slice({k}, 2, {n - 1})))").alias("h")) for k, n, held in sizes]
    found = reduce(DataFrame.unionByName, parts).groupBy("item", "kind", "h").agg(F.min("ipos").alias("ipos"))
    of = found.groupBy("item", "kind").agg(F.count("*").alias("of"))
    other = reduce(DataFrame.unionByName, as_unit).distinct().join(found, ["item", "kind", "h"], "left_anti")
    return found.unionByName(other).join(of, ["item", "kind"]), used


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, item: the items each document holds.

    The benchmark's windows are broadcast up to ``broadcast_rows`` rows (40
    bytes each); beyond, both sides are shuffled by hash. A document's
    distinct windows decide which items it may hold; places are looked at for
    these documents only, and texts are read again for them. An alignment
    counts if it has half of the windows that an item must have.
    """
    space = C.Workspace(docs.sparkSession, "decontamination")
    items, used = item_windows(benchmark, window)
    items = space.table(items, "items")
    few = (lambda n, df: F.broadcast(df) if n <= broadcast_rows else df)
    pair = ["doc_id", "th", "item", "kind"]
    known = C.texts(docs).filter("doc_id is not null").withColumn("th", F.xxhash64("text"))
    if not used:
        return docs.sparkSession.createDataFrame([], "doc_id long, item long")
    n_items = items.count()
    every = ", ".join(_windows_of(k, n) for k, n in used)
    held = _hashed(known, "doc_id", "th").select("doc_id", "th", F.explode(F.expr(f"array_distinct(concat({every}))")).alias("h"))
    had = held.join(few(n_items, items.select("item", "kind", "h", "ipos", "of")), "h").groupBy(*pair).agg(F.max("of").alias("of"), F.count_distinct("ipos").alias("had"))
    pairs = space.table(had.filter(F.col("had") >= share * F.col("of")).select(*pair, "of"), "pairs")
    n_pairs = pairs.count()
    again = known.join(few(n_pairs, pairs.select("doc_id", "th").distinct()), ["doc_id", "th"], "left_semi")

    # alignments
    hashed = _hashed(again, "doc_id", "th")
    placed = ", ".join(f"transform({_windows_of(k, n)}, (h, i) -> named_struct('pos', i, 'h', h))" for k, n in used)
    where = hashed.select("doc_id", "th", F.explode(F.expr(f"concat({placed})")).alias("w")).select("doc_id", "th", "w.pos", "w.h")
    at = where.join(few(n_items, items.select("item", "kind", "h", "ipos")), "h").join(few(n_pairs, pairs), pair)
    lines = space.table(at.groupBy(*pair, (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.max("of").alias("of"), F.count("*").alias("n")), "alignments")
    best = lines.groupBy(*pair).agg(F.max("n").alias("most"))
    lines = lines.join(best, pair).filter(F.col("n") >= F.least("most", share * F.col("of") / 2)).select(*pair, "shift")

    # slots
    slots = lambda d, *keys: d.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(f"filter(transform({k}, (e, i) -> named_struct('pos', i, 'w', e.w, 'v', e.v)), e -> e.w IN ('_n', '_p'))").alias("s")) for k in "ap"))).alias("k")).select(*keys, "k.kind", F.explode("k.s").alias("s")).select(*keys, "kind", F.col("s.pos").alias("pos"), F.concat("s.w", "s.v").alias("v"))
    named = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").filter("text is not null and item_id is not null")
    slots_i = slots(_templates(named, "item"), "item").select("item", "kind", F.col("pos").alias("ipos"), F.col("v").alias("ivalue"))
    slots_d = slots(_templates(again, "doc_id", "th"), "doc_id", "th").select("doc_id", "th", "kind", "pos", F.col("v").alias("dvalue"))
    slots_i, slots_d = space.table(slots_i, "slots_i"), space.table(slots_d, "slots_d")
    lines = space.table(lines, "lines")
    met = lines.join(slots_i, ["item", "kind"]).withColumn("pos", F.col("ipos") + F.col("shift")).join(slots_d.distinct(), ["doc_id", "th", "kind", "pos"])
    bad = met.groupBy(*pair, "shift", "ivalue").agg(F.min("dvalue").alias("x"), F.max("dvalue").alias("y")).filter("x <> y").select(*pair, "shift").distinct()
    return lines.join(bad, [*pair, "shift"], "left_anti").select("doc_id", "item").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_items, items (sorted item ids), contaminated; one row per row of ``docs``.

    Null and empty texts and rows with a null doc_id hold nothing. Rows that
    share a doc_id share the items found in any of them. An empty benchmark
    leaves every document clean; other columns aren't read.
    """
    pairs = contaminated_pairs(docs, benchmark, **options)
    found = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(found, "doc_id", "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.size(items) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as they are."""
    bad = contaminated_pairs(docs, benchmark, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_bad"], "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
