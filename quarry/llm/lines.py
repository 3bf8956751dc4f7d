"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

The edit bound is one word for lines of at least MIN_NEAR words, and none for other lines that aren't blank. A line
emits the hash of itself and of itself without one of its words, for each such word; lines that share a variant at one
place are within the bound, the earliest stays and the pair is verified word by word.

Emitting all variants of all lines would be many times the input, so lossless filters come first. One edit leaves the first h
or the last h words of a line alone (h at most half its words), so only lines that share such a half with another line
go on; and of those it leaves alone all but one of BLOCKS blocks, so only variants within blocks whose surroundings two
lines share are emitted. A block of more than BLOCK words is cut into blocks again first, as each variant costs the whole
line. All steps are grouped minima and equality joins: no group is listed or paired within itself. Joins are by shuffle
at every size, and only the last one and that for the words of candidate lines move whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize

MIN_NEAR = 8
#: Parts into which a line or block is cut, and words up to which a block is cut no more.
BLOCKS, BLOCK = 8, 16


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"\s+"), "")


def _half(n: Column) -> Column:
    """The largest power of two that is at most n / 2."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n / 2))).cast("int")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, lid, half keys of each line that isn't blank; a line's id is the MD5 of its words, set off by one blank each."""
    odd = F.lit(False)
    for space in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.col("text").contains(space)
    squeezed = F.when(odd, F.regexp_replace("text", "[ \t\x0b\f\r]+", " ")).otherwise(F.col("text"))
    each = docs.select("doc_id", F.posexplode(F.split(squeezed, "\n")).alias("pos", "line")).select("doc_id", "pos", F.trim("line").alias("line")).where("line <> ''")
    n = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n")
    each = each.select("doc_id", "pos", "line", n)
    one, two = _half(F.col("n")), _half(F.col("n") - 1)
    upto = lambda h: F.call_function("substring_index", "line", F.lit(" "), h)
    ends = lambda h: [F.xxhash64(F.lit("first"), h, upto(h)), F.xxhash64(F.lit("last"), h, upto(-h))]
    keys = F.when(F.col("n") >= MIN_NEAR, F.when(one == two, F.array(*ends(one))).otherwise(F.array(*ends(one), *ends(two))))
    return each.select("doc_id", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("lid"), keys.alias("keys"))


def _without(words: Column, at: Column) -> Column:
    """words without the one at `at` (from 0; -1: all of them)."""
    return F.when(at < 0, words).otherwise(F.concat(F.slice(words, 1, at), F.slice(words, at + 2, F.size(words))))


def _shared(keyed: DataFrame) -> DataFrame:
    """The keys that two lines have."""
    return keyed.groupBy("key").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a <> b").select("key").hint("merge")


def _able(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """lid, first, words of the lines that share a half key with a different one."""
    keyed = distinct.where("keys IS NOT NULL").select("lid", "first", F.explode("keys").alias("key"))
    found = keyed.join(_shared(keyed), "key", "left_semi").select("lid", "first").distinct()
    owners = found.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.pos", "lid")).alias("found")).withColumnRenamed("doc_id", "owner")
    texts = docs.join(owners.hint("merge"), docs["doc_id"].eqNullSafe(owners["owner"]))
    said = let(F.split("text", "\n"), lambda lines: F.transform("found", lambda x: F.struct(x["pos"].alias("pos"), x["lid"].alias("lid"), F.get(lines, x["pos"]).alias("line"))))
    each = texts.select("doc_id", F.explode(said).alias("x")).select("x.lid", F.struct("doc_id", "x.pos").alias("first"), _words(F.col("x.line")).alias("words"))
    # Rows that repeat a doc_id with another text have other lines there: only the line itself counts.
    return each.where(F.unhex(F.md5(F.concat_ws(" ", "words").cast("binary"))) == F.col("lid")).dropDuplicates(["lid"])


def _roles(able: DataFrame) -> DataFrame:
    """lid, role, m: each line as the one of m words (role 0) and as one with a word more (role 1)."""
    n = F.size("words")
    roles = F.explode(F.array(F.struct(F.lit(0).alias("role"), n.alias("m")), F.struct(F.lit(1).alias("role"), (n - 1).alias("m")))).alias("x")
    return able.select("lid", roles).select("lid", "x.role", "x.m")


def _around(begin: Column, end: Column) -> Column:
    """Hash of the words of a line around a block, and of the place of the block in m words."""
    n, m = F.size("words"), F.col("m")
    return F.xxhash64(m, begin, end, F.slice("words", F.lit(1), begin), F.slice("words", n - (m - end) + 1, m - end))


def _blocks(able: DataFrame) -> DataFrame:
    """lid, role, begin, end of the blocks of at most BLOCK words whose surroundings another line shares, by blocks of blocks."""
    spark = able.sparkSession
    words = able.select("lid", "words")
    todo, done = _roles(able).select("lid", "role", "m", F.lit(0).alias("begin"), F.col("m").alias("end")), []
    while True:
        at = lambda j: (F.col("begin") + F.floor(j * (F.col("end") - F.col("begin")) / BLOCKS)).cast("int")
        parts = todo.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).select("lid", "role", "m", at(F.col("j")).alias("begin"), at(F.col("j") + 1).alias("end")).where("begin < end")
        keyed = materialize(spark, parts.join(words, "lid").select("lid", "role", "m", "begin", "end", _around(F.col("begin"), F.col("end")).alias("key")), "block-keys")
        met = materialize(spark, keyed.join(_shared(keyed), "key", "left_semi").drop("key"), "blocks")
        discard(spark, keyed)
        done.append(met)
        todo = met.where(F.col("end") - F.col("begin") > BLOCK)
        if not todo.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.where(F.col("end") - F.col("begin") <= BLOCK)


def _variants(able: DataFrame) -> DataFrame:
    """lid, first, role, i, v: hashes of lines without word i, in the blocks whose surroundings another line shares.

    A line takes part as the one of m words (role 0; i = -1 is the whole line) and as one with a word more (role 1).
    """
    met = _blocks(able).join(able, "lid")
    inside = F.when(F.col("role") == 1, F.sequence("begin", "end")).otherwise(F.concat(F.array(F.lit(-1)), F.sequence(F.col("begin"), F.col("end") - 1)))
    each = F.explode(F.transform(inside, lambda i: F.struct(i.alias("i"), F.xxhash64(_without(F.col("words"), i)).alias("v")))).alias("x")
    return met.select("lid", "first", "role", each).select("lid", "first", "role", "x.i", "x.v").distinct()


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, pos of the lines to drop: every later occurrence of a line, and the first one where an earlier line is within the bound."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    lines = materialize(spark, lines_of(docs), "lines")
    # 1. Exact: the first occurrence of each line. A common line's places are one side of a plain join, which Spark splits.
    place = F.struct("doc_id", "pos")
    distinct = materialize(spark, lines.groupBy("lid").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("keys").alias("keys")), "distinct-lines")
    several = distinct.where("times > 1").select("lid", "first")
    again = materialize(spark, lines.select("lid", "doc_id", "pos").join(several.hint("merge"), "lid").where(place > F.col("first")).select("doc_id", "pos"), "again")
    discard(spark, lines)
    # 2. Variants of the lines that may have a near one.
    able = materialize(spark, _able(docs, distinct), "near-lines")
    discard(spark, distinct)
    variants = materialize(spark, _variants(able), "variants")
    own = F.struct("first", "lid", "i").alias("best")
    whole, shorter, longer = variants.where("role = 0 AND i < 0"), variants.where("role = 0 AND i >= 0"), variants.where("role = 1")
    replaced = shorter.groupBy("v", "i").agg(F.min(F.struct("first", "lid", "i")).alias("best"), F.count("*").alias("times")).where("times > 1").drop("times")
    pairs = (
        shorter.join(replaced, ["v", "i"])  # one word replaced
        .unionByName(whole.join(longer.groupBy("v").agg(F.min(F.struct("first", "lid", "i")).alias("best")), "v"))  # an earlier line is this one and a word
        .unionByName(longer.join(whole.select("v", own), "v"))  # an earlier line is this one without a word
        .where(F.col("best.first") < F.col("first"))
        .select("lid", "first", "i", F.col("best.lid").alias("other"), F.col("best.i").alias("j"))
    )
    # 3. Verify: the same words remain.
    one, two = able.select("lid", "words"), able.select(F.col("lid").alias("other"), F.col("words").alias("theirs"))
    near = pairs.join(one, "lid").join(two, "other").where(_without(F.col("words"), F.col("i")) == _without(F.col("theirs"), F.col("j"))).select("first.doc_id", "first.pos")
    near = materialize(spark, near, "near")
    discard(spark, able, variants)
    return again.unionByName(near)


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the lines that repeat an earlier one (by doc_id, then line number); adds n_lines and n_removed, sets n_chars.

    Blank lines always stay, and so do null texts. Words are what white space separates. A document whose lines
    all go stays with an empty text. Null ids come first and count as one document, as do repeated rows of one id: their
    lines are dropped alike, never against each other. Other columns stay; n_lines and n_removed are replaced where docs has them.
    A very long text is one row of its lines once, when they are numbered and when they are joined again; lines themselves are compared by hashed blocks.
    """
    spark = docs.sparkSession
    gone = repeated(docs).groupBy("doc_id").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("doc_id", "id")
    drop = materialize(spark, gone, "dropped-lines")
    base = docs.drop("n_lines", "n_removed").select(F.struct("*").alias("row"))
    joined = base.join(drop.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    parts, some = F.split("row.text", "\n"), F.col("gone").isNotNull()
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    kept = F.when(some, F.array_join(let(parts, left), "\n")).otherwise(F.col("row.text"))
    out = joined.select("row", kept.alias("kept"), F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
    columns = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


#: The rows of dedup() over documents, for DuckDB.
ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
able AS (SELECT doc_id, pos, words, len(words) AS n, row_number() OVER (ORDER BY doc_id, pos) AS place FROM lines WHERE len(words) >= 1),
firsts AS (SELECT words, any_value(n) AS n, min(place) AS first FROM able GROUP BY words),
variants AS (
  SELECT first, i, md5(array_to_string(CASE WHEN i < 0 THEN words ELSE list_concat(words[1:i], words[i + 2:]) END, ' ')) AS v
  FROM (SELECT first, words, unnest(range(-1, n)) AS i FROM firsts WHERE n >= 8)),
near AS (
  SELECT a.first FROM variants a JOIN variants b ON a.v = b.v AND b.first < a.first AND (a.i = b.i OR a.i < 0 OR b.i < 0)),
gone AS (
  SELECT a.doc_id, a.pos FROM able a JOIN firsts f USING (words) WHERE a.place > f.first OR f.first IN (SELECT first FROM near))
SELECT d.doc_id,
  CASE WHEN coalesce(g.n, 0) = 0 THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.at, i - 1)), chr(10)) END AS text,
  d.lang, d.source, CASE WHEN coalesce(g.n, 0) = 0 THEN d.n_chars ELSE length(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.at, i - 1)), chr(10))) END AS n_chars,
  coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(g.n, 0) AS n_removed
FROM documents d LEFT JOIN (SELECT doc_id, list(pos) AS at, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
"""
