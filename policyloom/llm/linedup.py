"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions alone.

A line occurrence goes if the same line occurs earlier, or if an earlier first occurrence of another
line lies within one edit of it (insertion, deletion or substitution of one character), whatever their lengths.
Earlier means by (doc_id, position); all is judged on the input, so a line may go for one that goes itself.
Lines under near_chars characters are compared exactly, as one edit makes another word or number of them: of `}`, `1` and `2` all stay.
Blank lines are never touched.

1. Exact: lines are keyed by 128 bits of hash; one aggregation with map-side combine finds first occurrences.
2. Anchors: a single edit leaves one half of a line whole, so each distinct line emits a key for each half, for its own
   length and for one less. Keys that two different lines share mark the few lines that can have a partner at
   all; the rest emit nothing more. Those few do the same with sixteenths. This filter is exact.
3. Deletion neighbourhood: those lines emit every variant with one character of the open part deleted, as
   hashed keys that also hold the anchor. Equal variants at one position are one substitution apart; a variant
   equal to a whole line is one insertion apart. An aggregation takes the earliest line of each key, so no
   pairs of a group are formed and hot keys combine before the shuffle.
4. Each line's earliest partner is verified with a banded edit distance, and the documents are rebuilt.

Occurrences meet the verdict on their line by its key. Lines that hold more than a quarter of an even partition's rows are
at most four times as many as there are partitions; their verdicts are broadcast, so no task gets a hot line's occurrences.

The digests of lines are written once and reused; texts of lines for step 3 come from a scan of documents behind
a bitmap filter of fixed size (broadcast, at most bitmap_buckets * 4 KB), so the corpus's text is shuffled once,
when documents meet their removed positions.

Defined results: a null text stays null with no lines; an empty text has one blank line; rows that share a
doc_id count as one document in the order, and equal lines of theirs at one position are one occurrence, kept
in both; a null doc_id comes last in the order. Columns of other names pass through; outputs replace columns
of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, parallelism, stored

_ORDER = "decimal(38,0)"
_SPAN = 1 << 31
_BLANK = " \t\r\x0b\f"


def _place() -> Column:
    """(d, p) as one number that sorts alike; a null d comes last."""
    d = F.coalesce(F.col("d").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    return (d * F.lit(_SPAN).cast("decimal(11,0)") + F.col("p")).cast(_ORDER)


def _digests(docs: DataFrame, id_col: str, text: str, near_chars: int) -> DataFrame:
    """Place, a hash s that tells the texts of one id apart, 128 bits of hash and half anchors a0 to a3 of every non-blank line; no text."""
    split = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("s"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("p", "line"))
    n = F.length("line")
    halves = []
    for less in (0, 1):
        m = n - less
        half = F.floor(m / 2).cast("int")
        halves += [F.xxhash64(F.substring("line", half + less + 1, n), m, F.lit(0)), F.xxhash64(F.substring("line", F.lit(1), half), m, F.lit(1))]
    return split.where(F.btrim(F.col("line"), F.lit(_BLANK)) != "").select(
        "d", "s", "p", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2"),
        *[F.when(n >= near_chars, h).alias(f"a{k}") for k, h in enumerate(halves)],
    )


def _anchors(parts: int) -> Column:
    """Keys of `line`: for each length m in (n, n - 1) and each of the parts left open, a hash of all that stands outside of it.

    Two lines of m and m or m + 1 characters that are one edit apart share the key of the part that holds the edit.
    Each key comes with the open part's start and its size in this line.
    """
    begin, end = f"cast(j * m div {parts} as int)", f"cast((j + 1) * m div {parts} as int)"
    outside = f"xxhash64(substring(line, 1, {begin}), substring(line, n - (m - {end}) + 1, m - {end}), m, j)"
    key = f"struct({outside} as anchor, less, {begin} as start, {end} - {begin} + less as size)"
    lengths = f"transform(array(n - less), m -> transform(sequence(0, {parts} - 1), j -> {key}))[0]"
    return F.expr(f"transform(array(length(line)), n -> flatten(transform(array(0, 1), less -> {lengths})))[0]")


def _bitmap(keys: Column, frame: DataFrame, buckets: int) -> DataFrame:
    """Bitmaps of 4 KB by bucket over a hash of a key; at most `buckets` rows whatever the input."""
    bit = F.pmod(F.xxhash64(keys), F.lit(buckets * 32768))
    return frame.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits"))


def _in_bitmap(frame: DataFrame, key: Column, bitmap: DataFrame, buckets: int) -> DataFrame:
    bit = F.pmod(F.xxhash64(key), F.lit(buckets * 32768))
    byte = F.conv(F.hex(F.expr("substring(__bits, __at div 8 + 1, 1)")), 16, 10).cast("int")
    joined = frame.withColumns({"__bucket": F.bitmap_bucket_number(bit), "__at": F.bitmap_bit_position(bit).cast("int")}).join(F.broadcast(bitmap), "__bucket")
    return joined.where(byte.bitwiseAND(F.expr("shiftleft(1, __at % 8)")) != 0).drop("__bucket", "__at", "__bits")


def _near(docs: DataFrame, first: DataFrame, id_col: str, text: str, bitmap_buckets: int, fine_parts: int) -> DataFrame:
    """Keys (h1, h2) of lines within one edit of a line that occurs first earlier."""
    anchors = first.where("a0 is not null").select("h1", "h2", F.explode(F.array_distinct(F.array("a0", "a1", "a2", "a3"))).alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    wanted = anchors.join(shared, "anchor", "left_semi").select("h1", "h2").distinct()
    place = first.join(wanted, ["h1", "h2"], "left_semi").select(
        "h1", "h2", F.col("first").alias("ord"),
        F.expr(f"try_cast((first - pmod(first, {_SPAN})) / {_SPAN} as bigint)").alias("d"), F.expr(f"cast(pmod(first, {_SPAN}) as int)").alias("p"),
    )
    place = stored(place, "line-places")
    held = _in_bitmap(docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("text")), F.col("d"), _bitmap(F.col("d"), place, bitmap_buckets), bitmap_buckets)
    lines = held.select("d", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).alias("l")
    met = lines.join(place.alias("w"), F.expr("l.d <=> w.d and l.p = w.p and xxhash64(l.line) = w.h1"))
    kept = stored(met.groupBy("h1", "h2", "ord").agg(F.first("line").alias("line")), "line-texts")
    # The few lines that are left take finer anchors, so that long lines emit few and short variants.
    fine = kept.select("h1", "h2", "ord", "line", F.inline(_anchors(fine_parts)))
    open_part = fine.join(fine.groupBy("anchor").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a < b").select("anchor"), "anchor", "left_semi")
    part = F.expr("substring(line, start + 1, size)")
    # role 0: one character substituted; 1: the line itself; 2: a line with one character more, that one deleted.
    deleted = F.expr(
        "transform(if(size > 0, sequence(1, size), array()), i -> struct(if(less = 0, 0, 2) as role, if(less = 0, i, 0) as at,"
        " concat(substring(part, 1, i - 1), substring(part, i + 1)) as v))"
    )
    whole = F.expr("if(less = 0, array(struct(1 as role, 0 as at, part as v)), array())")
    variants = (
        open_part.withColumn("part", part)
        .select("h1", "h2", "ord", "anchor", F.explode(F.concat(deleted, whole)).alias("x"))
        .select("h1", "h2", "ord", "x.role", F.xxhash64("anchor", "x.at", "x.v", F.expr("x.role = 0")).alias("k1"), F.hash("x.v", "x.at", "anchor").alias("k2"))
    )
    earliest = variants.groupBy("k1", "k2").agg(*[F.min(F.when(F.col("role") == r, F.col("ord"))).alias(f"m{r}") for r in (0, 1, 2)])
    partner = F.expr("case role when 0 then m0 when 1 then m2 else m1 end")
    pairs = (
        variants.join(earliest.where("m0 is not null or (m1 is not null and m2 is not null)"), ["k1", "k2"])
        .withColumn("partner", partner).where("partner < ord").groupBy("h1", "h2", "ord").agg(F.min("partner").alias("partner"))
    )
    mine = kept.select("ord", F.col("line").alias("mine"))
    other = kept.select(F.col("ord").alias("partner"), F.col("line").alias("other"))
    verified = pairs.join(mine, "ord").join(other, "partner").where(F.levenshtein("mine", "other", 1).between(0, 1))
    near = stored(verified.select("h1", "h2"), "line-near")
    discard(place, kept)
    return near


def _removed(digests: DataFrame, first: DataFrame, near: DataFrame) -> DataFrame:
    """Places of the occurrences that go."""
    verdict = first.select("h1", "h2", "first", "n").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    total = first.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * (4 * parallelism(digests.sparkSession)) > total
    places = digests.select("d", "s", "p", "h1", "h2")
    # At most four times as many lines as partitions are heavy, so their verdicts fit a broadcast.
    hot = F.broadcast(verdict.where(heavy))
    met = places.join(hot, ["h1", "h2"]).unionByName(places.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(verdict.where(~heavy), ["h1", "h2"]))
    return met.where(F.col("near") | (_place() != F.col("first"))).select("d", "s", "p")


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", near_chars: int = 8, bitmap_buckets: int = 2048, fine_parts: int = 16) -> DataFrame:
    """The documents with removed lines cut out of `text`, and n_lines (before) and n_removed."""
    digests = stored(_digests(docs, id_col, text, near_chars), "line-digests")
    once = [F.first(f"a{k}").alias(f"a{k}") for k in range(4)]
    first = stored(digests.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"), *once), "line-firsts")
    near = _near(docs, first, id_col, text, bitmap_buckets, fine_parts)
    gone = stored(_removed(digests, first, near).groupBy(F.col("d").alias("__d"), F.col("s").alias("__s")).agg(F.collect_set("p").alias("__gone")), "line-gone")
    discard(digests, first, near)
    kept = [c for c in docs.columns if c.lower() not in {"n_lines", "n_removed"}]
    parts = F.split(F.col(text), "\n", -1)
    # The lines are bound once, as a lambda's variable; what is left is picked by position.
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    cut = F.transform(F.array(parts), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    rebuilt = F.when(F.col("__gone").isNotNull(), cut[0]).otherwise(F.col(text))
    joined = docs.select(*[F.col(f"`{c}`") for c in kept]).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__s")), "left")
    return joined.select(
        *[rebuilt.alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
