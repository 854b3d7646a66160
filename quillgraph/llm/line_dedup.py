"""Line dedup by segment-partition edit join, in DataFrame functions only.

Lines within ``tau`` edits share, shifted by few places, at least one of the tau + 1 segments that one of them is cut
into. Every distinct line is indexed by its segments and probes the indexes of the lengths just below its own with the
substrings that can be such a segment. Pairs that meet are verified with a banded bit-parallel edit distance, linked, and
only the first line of each connected class stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, release, shuffle_partitions, with_row
from .components import connected_components

TAU = 2
#: Shorter lines (after white space is reduced) are the same only if equal: two edits make too many of them into others.
MIN_CHARS = 20
#: Lines with 1/HEAVY of all occurrences or more are at most so many: their first places are broadcast.
HEAVY = 50_000
#: Words of 64 bits of the filter that spares most lines the way to the verification: 8 MB, whatever the table's size.
FILTER_WORDS = 1 << 17


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, line_no (from 0), line, h1, h2 for the lines that are not blank; h1 and h2 make 128 bits of identity."""
    reduced = F.coalesce(col(text_col).cast("string"), F.lit(""))
    for white in "\t\x0b\x0c\r":
        reduced = F.replace(reduced, F.lit(white), F.lit(" "))
    reduced = F.when(reduced.contains("  "), F.regexp_replace(reduced, " {2,}", " ")).otherwise(reduced)
    lines = docs.select(col(id_col).alias("doc_id"), _text_hash(col(text_col)).alias("text_hash"), F.posexplode(F.split(reduced, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    return lines.select("doc_id", "text_hash", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _place() -> Column:
    return F.struct(F.isnull("doc_id").alias("last"), "doc_id", "text_hash", "line_no")


def segment_keys(lines: DataFrame, name: str, tau: int, own: bool) -> DataFrame:
    """(name, key) from (h1, line): keys of a line's ``own`` segments, or of its substrings that may be segment i of a line
    that is ``less`` shorter; its own are not among these.

    With i edits at most left of a segment, and tau - i right of it, its place can shift by no more. Places are exploded
    before any key is made, so that the generated code is one small loop.
    """
    segments, places = tau + 1, []
    for less in range(tau + 1):
        for i in range(segments):
            for shift in range(max(-i, less - (tau - i)), min(i, less + tau - i) + 1):
                if own == (not less and not shift):
                    places.append(f"named_struct('i', {i}, 'less', {less}, 'shift', {shift})")
    x = lines.select("h1", "line", F.length("line").alias("n"), F.explode(F.expr(f"array({', '.join(places)})")).alias("x"))
    x = x.selectExpr("h1", "line", "n", "x.i AS i", "n - x.less AS m", "x.shift AS shift")
    x = x.selectExpr("h1", "line", "n", "i", "m", "shift", f"m div {segments} AS base", f"m % {segments} - ({segments} - i) AS over")
    # the last segments take what division leaves
    x = x.selectExpr("h1", "line", "n", "i", "m", "cast(base * i + greatest(0, over) + shift AS int) AS at", "cast(base + if(over >= 0, 1, 0) AS int) AS size")
    return x.where("at >= 0 AND at + size <= n").selectExpr(f"h1 AS {name}", "xxhash64(substring(line, at + 1, size), i, cast(m AS int)) AS key")


def edit_distance(short: str, long: str, tau: int) -> Column:
    """Banded bit-parallel distance of two line columns, ``long`` at most ``tau`` longer: right up to tau, above if above.

    Column by column, the 2 tau + 1 rows around the diagonal are bits of one word: vertical differences +1 (vp) and -1
    (vn), packed with the distance d so far along the diagonal that ends in the last cell.
    """
    w, k = 2 * tau + 1, tau
    mask, extra = (1 << w) - 1, "x.e"
    pad = ", ".join(["''"] * (2 * tau))
    equal = " + ".join(f"if(x.p[j + {i - 1}] = x.c[j - 1], {1 << i}, 0)" for i in range(w))
    vp, vn = f"(s & {mask})", f"(shiftright(s, {w}) & {mask})"
    hp, d1 = f"({vn} | ((d0 | {vp}) ^ {mask}))", "shiftright(d0, 1)"
    fold = f"""
      shiftright(aggregate(sequence(1, size(x.c)), {((1 << (k + 1)) - 1) << k} + shiftleft({extra}, {2 * w}), (s, j) ->
        transform(array({equal}), m ->
          transform(array((((((m & {vp}) + {vp}) ^ {vp}) | m | {vn}) & {mask})), d0 ->
            ((d0 & {vp}) | (({d1} | {hp}) ^ {mask})) | shiftleft({hp} & {d1}, {w})
            | shiftleft(shiftright(s, {2 * w}) + if(j > {extra}, 1 - (shiftright(d0, {k} - {extra}) & 1), 0), {2 * w}))[0])[0]), {2 * w})
    """
    chars = lambda x: f"filter(split({x}, ''), x -> x <> '')"
    blank = ", ".join(["''"] * k)
    padded = f"struct(concat(array({blank}), {chars(short)}, array({pad})) as p, {chars(long)} as c, length({long}) - length({short}) as e)"
    return F.expr(f"transform(array({padded}), x -> {fold})[0]")


def alike(short: str, long: str, tau: int, letters: str = " etaoinsrh") -> Column:
    """True for any pair within ``tau`` edits: as an edit changes the counts of two letters at most, counts differ by no more
    than 2 tau in all."""
    count = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))
    apart = F.lit(0)
    for x in letters:
        apart = apart + F.abs(count(short, x) - count(long, x))
    return apart <= 2 * tau


def near_lines(lines: DataFrame, distinct: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) between the line numbers ``nid`` of ``distinct`` whose lines are within ``tau`` edits."""
    total = distinct.agg(F.sum("n")).first()[0] or 0
    heavy = distinct.where(F.col("n") >= max(2, total / HEAVY)).select("h1", "h2", "first")
    once = (
        lines.select("doc_id", "text_hash", "line_no", "h1", "h2", "line").join(F.broadcast(heavy), ["h1", "h2"], "left")
        .where(F.isnull("first") | (F.col("first") == _place())).select("h1", "line")
    )
    # lines that occur a few times are still there a few times. The joins' own shuffles are the only ones, so that a key that
    # holds many lines can be split among tasks.
    index, probes = segment_keys(once, "a", tau, True), segment_keys(once, "b", tau, False)
    same = index.join(index.withColumnRenamed("a", "b"), "key").where("a < b")
    met = same.unionByName(index.join(probes, "key").where("a <> b"))
    pairs = materialise(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    ids = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
    word = F.pmod(F.shiftright("h1", 6), F.lit(FILTER_WORDS)).cast("int")
    marks = materialise(ids.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h1 & 63 as int)))").alias("bits")), "marks")
    texts = materialise(
        lines.withColumn("word", word).join(F.broadcast(marks), "word")
        .where(F.expr("shiftright(bits, cast(h1 & 63 as int)) & 1 = 1"))
        .select("h1", "h2", "line").join(ids, "h1")  # no semi-join: that would be moved below the filter
        .groupBy("h1", "h2").agg(F.first("line").alias("line")),
        "texts",
    )
    side = lambda c: texts.select(F.col("h1").alias(c), F.col("h2").alias(c + "2"), F.col("line").alias(c + "_line"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    flip = F.length("a_line") > F.length("b_line")
    both = both.select(
        "a", "a2", "b", "b2",
        F.when(flip, F.col("b_line")).otherwise(F.col("a_line")).alias("short"),
        F.when(flip, F.col("a_line")).otherwise(F.col("b_line")).alias("long"),
    )
    # few bytes, much work: an even share for every task. The distance is generated, so the test stays behind the shuffle.
    both = both.where((F.length("long") - F.length("short") <= tau) & alike("short", "long", tau)).repartition(2 * shuffle_partitions(both.sparkSession))
    linked = both.select("a", "a2", "b", "b2", F.explode(F.array(edit_distance("short", "long", tau))).alias("d")).where(F.col("d") <= tau)
    at = lambda c, to: distinct.select(F.col("h1").alias(c), F.col("h2").alias(c + "2"), F.col("nid").alias(to))
    links = materialise(linked.select("a", "a2", "b", "b2").join(at("a", "x"), ["a", "a2"]).join(at("b", "y"), ["b", "b2"]).select("x", "y"), "near")
    release(pairs, marks, texts)
    return links


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS, with_hash: bool = False) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no, class_doc_id, class_line_no (the first line of its
    class by document and place), kept.

    Lines are compared without leading, trailing and repeated white space. Those of ``min_chars`` or more link within
    ``tau`` edits, shorter ones if equal; classes are those connected by links, over all documents and within them. Null
    and empty texts have no line, an empty table gives an empty result. A null id comes last. Rows that repeat both id and
    text count as the same document: its lines stay in all of them; of rows that repeat the id alone, each is a document.
    Other columns are not read.
    """
    lines = materialise(lines_of(docs, id_col, text_col), "lines")
    distinct = materialise(
        lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "distinct",
    )
    links = near_lines(lines.where(F.length("line") >= min_chars), distinct, tau)
    labels = connected_components(links, "x", "y").select(F.col("node").alias("nid"), F.col("component_id").alias("root"))
    members = distinct.join(labels, "nid").select("h1", "h2", "root", "first")
    merged = members.join(members.groupBy("root").agg(F.min("first").alias("class")), "root").select("h1", "h2", "class")
    classes = distinct.join(merged, ["h1", "h2"], "left").select("h1", "h2", "n", F.coalesce("class", "first").alias("class"))
    classes = materialise(classes, "classes")
    return (
        lines.select("doc_id", "text_hash", "line_no", "h1", "h2").join(classes, ["h1", "h2"])
        .select(
            "doc_id", *["text_hash"] * with_hash, "line_no", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"),
            (F.col("class") == _place()).alias("kept"),
        )
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **how) -> DataFrame:
    """``docs`` with every line gone whose class has an earlier one; ``chars_col`` is brought up to date.

    All rows and columns stay, null texts and ids and repeated rows as in ``line_classes``; a document of which no line is
    left has the empty text. An empty table gives an empty result.
    """
    gone = line_classes(docs, id_col, text_col, with_hash=True, **how).where("NOT kept").groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    rows = with_row(docs)
    mine = rows["row"].getField(id_col).eqNullSafe(gone["doc_id"]) & (_text_hash(rows["row"].getField(text_col)) == gone["text_hash"])
    joined = rows.join(gone, mine, "left")
    text = F.col("row").getField(text_col)
    left = F.array_join(F.filter(F.split(text.cast("string"), "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.isnull("gone"), text).otherwise(left)
    changed = {text_col: text} | ({chars_col: F.length(text)} if chars_col else {})
    types = dict(docs.dtypes)
    return joined.select(*[changed.get(c, F.col("row").getField(c)).cast(types[c]).alias(c) for c in docs.columns])
