"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

Two lines within ``threshold`` edits agree exactly in one of threshold + 1 even segments of the shorter one. Every line
is indexed under its segments; every line probes, for each length a partner may have, the substrings at the few places
where an agreeing segment can stand if errors are shared out between what is left and right of it. Pairs found are
verified by an edit distance whose diagonals within the threshold are bits of one number, one step a character.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.work import Step, collect_garbage

THRESHOLD = 2
BROADCAST_IDS = 1_000_000  # eight bytes each
LETTERS = "aeinorstdhlu"
PARTS = 8  # of a line, for the test before the edit distance
MIN_CHARS = 20  # shorter lines are repeated only by equal ones


def _segment(length: Column, i: int | Column, threshold: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of a line of this length; the last ones take what doesn't divide."""
    parts = threshold + 1
    base, rest = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    return i * base + F.greatest(F.lit(0), i - parts + rest), base + F.when(F.lit(i) >= parts - rest, 1).otherwise(0)


def _index_places(threshold: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(threshold + 1)]


def _probe_places(threshold: int) -> list[tuple[int, int, int]]:
    """Places other than those of the line's own segments, which are looked up as well.

    ``shorter`` is by how much the partner is shorter, ``shift`` by how much its segment stands further on here.
    """
    places = []
    for shorter in range(threshold + 1):
        for i in range(threshold + 1):
            right = threshold - i
            places += [(shorter, i, shift) for shift in range(max(-i, shorter - right), min(i, shorter + right) + 1) if shorter or shift]
    return places


def _keyed(lines: DataFrame, places: list[tuple[int, int, int]], threshold: int) -> DataFrame:
    """A row (id, letters, key) for each place (shorter, segment, shift) that lies within a line.

    Lines are repeated first, so that one short expression makes all keys; an array of them is too long to be compiled.
    """
    fixed = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("shorter", "i", "shift"), place, strict=True)]) for place in places])
    rows = lines.select("id", "letters", "line", "n", F.explode(fixed).alias("p"))
    target = F.col("n") - F.col("p.shorter")
    start, size = _segment(target, F.col("p.i"), threshold)
    rows = rows.select("id", "letters", "line", "n", target.alias("target"), "p.i", (start + F.col("p.shift")).alias("at"), size.alias("size"))
    rows = rows.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    return rows.select("id", "letters", F.xxhash64("target", "i", F.substring(F.col("line"), F.col("at") + 1, F.col("size"))).alias("key"))


def blank(line: Column) -> Column:
    """Whether a line has nothing but spaces, tabs and carriage returns; it is read up to the first other character only."""
    return F.ltrim(line, F.lit(" \t\r")) == ""


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def promising(x: Column, y: Column, threshold: int, parts: int = PARTS) -> Column:
    """A cheap test that all pairs within ``threshold`` edits pass: all but so many even parts of y stand in x nearby."""
    length = F.length(y)
    found = F.lit(0)
    for i in range(parts):
        start, size = _segment(length, i, parts - 1)
        around = F.substring(x, F.greatest(F.lit(1), start + 1 - threshold), size + 2 * threshold)
        found = found + F.contains(around, F.substring(y, start + 1, size)).cast("int")
    return found >= parts - threshold


def within(x: Column, y: Column, threshold: int) -> Column:
    """Whether two strings of at least one character are within ``threshold`` edits; x is the longer one.

    For each number of errors, bit k says that the diagonal k - threshold is reached in the current row with at most
    so many. The bits of all numbers of errors are one bigint that is carried from character to character.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    here = lambda xs, ys, i: sum(
        (F.when(F.get(xs, i) == F.get(ys, i + (k - threshold)), 1 << k).otherwise(0) for k in range(width)), start=F.lit(0)
    ).cast("long")

    def level(acc: Column, e: int) -> Column:
        return F.shiftright(acc, e * width).bitwiseAND(F.lit(full))

    def step(acc: Column, same: Column) -> Column:
        rows: list[Column] = []
        for e in range(threshold + 1):
            row = level(acc, e).bitwiseAND(same)
            if e:
                less = level(acc, e - 1)
                row = row.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(rows[-1], 1))
            rows.append(row.bitwiseAND(F.lit(full)))
        packed = rows[0]
        for e, row in enumerate(rows[1:], 1):
            packed = packed.bitwiseOR(F.shiftleft(row, e * width))
        return packed

    first = sum(sum(1 << (threshold + k) for k in range(e + 1)) << (e * width) for e in range(threshold + 1))
    places = F.sequence(F.lit(0), F.length(x) - 1)
    chars = F.array(F.split(x, ""), F.split(y, ""))
    masks = let(chars, lambda c: F.transform(places, lambda i: here(c[0], c[1], i)))
    last = F.aggregate(masks, F.lit(first).cast("long"), step)
    final = F.length(y) - F.length(x) + threshold
    return (F.length(x) - F.length(y) <= threshold) & (
        F.call_function("shiftright", level(last, threshold), final).bitwiseAND(F.lit(1)) == 1
    )


def _letters(line: Column) -> Column:
    """Counts of twelve common letters modulo 16, four bits each."""
    counts = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter)))
        counts = counts.bitwiseOR(F.shiftleft(F.pmod(n, F.lit(16)).cast("long"), 4 * i))
    return counts


def _letters_differ(a: Column, b: Column) -> Column:
    """A lower bound of how many letters must be taken from or put into one line to get the other."""
    total = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        one, other = (F.shiftright(c, 4 * i).bitwiseAND(F.lit(15)) for c in (a, b))
        apart = (one - other).bitwiseAND(F.lit(15))
        total = total + F.least(apart, 16 - apart)
    return total


def near_pairs(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (x_id, y_id) of hashes of lines that may be within ``threshold`` edits: they share a segment.

    ``lines`` has (id, line, n, letters): a 64-bit hash, the line, its length and its letter counts. Pairs come once,
    the smaller hash first. An edit changes the counts of two letters at most; pairs whose counts are further apart
    never leave the join.
    """
    sized = lines.filter(F.col("n") > threshold)
    side = lambda places, s: (lambda rows: rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns]))(_keyed(sized, places, threshold))
    # A line's own segments are among what it probes for; they are shuffled once for both ends.
    own, index, probe = side(_index_places(threshold), "x"), side(_index_places(threshold), "y"), side(_probe_places(threshold), "x")
    close = (F.col("x_key") == F.col("y_key")) & (_letters_differ(F.col("x_letters"), F.col("y_letters")) <= 2 * threshold)
    met = own.join(index, close & (F.col("x_id") < F.col("y_id"))).unionByName(probe.join(index, close & (F.col("x_id") != F.col("y_id"))))
    return met.select(F.least("x_id", "y_id").alias("x_id"), F.greatest("x_id", "y_id").alias("y_id")).distinct()


def verified(pairs: DataFrame, lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The places (x, y) of the lines of pairs that are within ``threshold`` edits; equal hashes only add candidates."""
    ids = pairs.select(F.col("x_id").alias("id")).unionByName(pairs.select(F.col("y_id").alias("id"))).distinct()
    if ids.count() <= BROADCAST_IDS:  # a few MB: texts stay where they are
        ids = F.broadcast(ids)
    texts = lines.join(ids, "id", "left_semi").select("id", F.struct("d", "no").alias("place"), "line")
    for s in ("x", "y"):
        pairs = pairs.join(texts.select(F.col("id").alias(f"{s}_id"), F.col("place").alias(s), F.col("line").alias(f"{s}_line")), f"{s}_id")
    longer = F.length("x_line") >= F.length("y_line")
    x, y = F.when(longer, F.col("x_line")).otherwise(F.col("y_line")), F.when(longer, F.col("y_line")).otherwise(F.col("x_line"))
    pairs = pairs.select("x", "y", x.alias("x_line"), y.alias("y_line"))
    x, y = F.col("x_line"), F.col("y_line")
    return pairs.filter(F.when(promising(x, y, threshold), within(x, y, threshold))).select("x", "y")


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns ``key``, those of ``keep``, ``text`` without repeated lines, ``n_lines`` and ``n_dropped``.

    Lines are parted by line feeds and ordered by key and place. A line goes if an equal line stands earlier, or an
    earlier line within ``threshold`` edits, both of at least ``min_chars`` characters; it doesn't matter whether that
    earlier line goes itself. Lines of white space only stay. Keys must be distinct. Null texts stay null and have no
    lines; an empty text has one empty line; rows with a null key are returned as they are. A document may lose all
    its lines: its text is then empty. Other columns aren't read; a kept column with the name of a result is an error.
    """
    if clash := {"text", "n_lines", "n_dropped"} & {key, *keep}:
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    more = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(key).alias("d"), F.col(text).alias("t"), *[F.col(c).alias(a) for c, a in zip(keep, more, strict=True)])
    keyed = rows.filter("d is not null")
    # No line has a line feed, so that splitting gives the same places everywhere.
    places = keyed.select("d", F.posexplode(F.split(F.coalesce("t", F.lit("")), "\n", -1)).alias("no", "line"))
    full = places.filter(~blank(F.col("line")))
    same = [F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2")]
    lines = full.groupBy(*same).agg(F.min(F.struct("d", "no")).alias("at"), F.first("line").alias("line"))
    lines = lines.select("id", "at.d", "at.no", "line", F.length("line").alias("n"), _letters(F.col("line")).alias("letters"))
    lines = Step(lines, "lines")
    long = lines.df.filter(F.col("n") >= min_chars)
    pairs = Step(near_pairs(long, threshold), "pairs")
    gone = Step(verified(pairs.df, long, threshold).select(F.greatest("x", "y").alias("at")).distinct().select("at.*"), "gone")
    pairs.drop()
    # What is left to do needs places only.
    first_of = lines.df.groupBy("d").agg(F.collect_list("no").alias("first"))
    gone_of = gone.df.groupBy("d").agg(F.collect_list("no").alias("gone"))
    marks = Step(first_of.join(gone_of, "d", "left"), "marks")
    lines.drop()
    gone.drop()
    collect_garbage(docs.sparkSession)
    marked = keyed.join(marks.df, "d", "left")

    none = F.array().cast("array<int>")
    all_lines = F.split("t", "\n", -1)

    def kept(lines_: Column) -> Column:
        number = F.sequence(F.lit(0), F.size(lines_) - 1)
        empty = F.filter(number, lambda i: blank(F.get(lines_, i)))
        left = F.array_except(F.coalesce("first", none), F.coalesce("gone", none))
        return let(F.array_sort(F.array_union(left, empty)), lambda k: F.struct(F.transform(k, lambda i: F.get(lines_, i)).alias("lines"), F.size(k).alias("n")))

    out = marked.withColumn("k", F.when(F.col("t").isNotNull(), let(all_lines, kept)))
    size = F.greatest(F.coalesce(F.size(all_lines), F.lit(0)), F.lit(0))
    out = out.select(
        "d",
        *more,
        F.array_join("k.lines", "\n").alias("text"),
        size.cast("long").alias("n_lines"),
        (size - F.coalesce("k.n", F.lit(0))).cast("long").alias("n_dropped"),
    )
    loose = rows.filter("d is null").select(
        "d", *more, F.col("t").alias("text"), size.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")
    )
    return out.unionByName(loose).withColumnsRenamed({"d": key, **dict(zip(more, keep, strict=True))})
