"""Line dedup by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines in question that are broadcast to find their texts (about 50 bytes each); more of
# them are joined by a shuffle.
BROADCAST_ROWS = 200_000
OWN_PLACE = -(1 << 7)  # marks a segment that stands at its own place


def _lines(docs: DataFrame, min_chars: int, *more: str) -> DataFrame:
    """Every line long enough to be judged: id, h (of the text), pos, norm (compared form)."""
    return (
        docs.select("id", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("id", "h", "pos", F.lower(F.trim("line")).alias("norm"))
        .filter(F.char_length("norm") >= min_chars)
        .select("id", "h", "pos", "norm", F.xxhash64("norm").alias("a"), F.xxhash64(F.lit(1), F.col("norm")).alias("b"))
        .select("id", "h", "pos", "a", "b", *more)
    )


def _base(length: Column, edits: int) -> Column:
    """The least length of a band of lengths that share segments; a band is at least
    ``edits`` wide, so two bands at most hold the lengths from ``length`` - edits on."""
    least = max(4, 1 << (edits - 1).bit_length())
    width = F.when(length < 32, least).when(length < 256, max(8, least)).otherwise(max(32, least))
    return length - length % width


def _keys(base: Column, edits: int) -> list[tuple[bool, Column]]:
    """(whether it stands at its own place, key) of the segments of lines from ``base`` on.

    Of edits + 1 segments that do not overlap, some segment i is kept with exactly i edits
    to its left and edits - i at most to its right, wherever the edits are. So those of the
    first half have moved by i at most, counted from the start of the line, and those of
    the second half by edits - i at most, counted from its end.
    """
    n, parts, keys = F.col("n"), edits + 1, []
    size = F.floor(base / parts)
    for i in range(parts):
        reach = min(i, edits - i)
        start = size * i if 2 * i <= edits else n - size * (parts - i)
        for moved in range(-reach, reach + 1):
            at = start + moved
            fits = (at >= 0) & (at + size <= n)
            keys.append((moved == 0, F.when(fits, F.xxhash64(F.lit(i), base, F.substring("norm", at + 1, size)))))
    return keys


def _alike_in_length(left: Column, right: Column, edits: int) -> Column:
    """Whether lengths, given modulo 128, are within ``edits``; one segment at least is at its own place."""
    gap = F.abs(left.bitwiseAND(F.lit(127)) - right.bitwiseAND(F.lit(127)))
    return (F.least(left, right) < 0) & (F.least(gap, F.lit(128) - gap) <= edits)


def _sketch(text: str) -> Column:
    """64 bits: which hashes of two neighbouring characters occur an odd number of times.

    An edit breaks and makes four such pairs at most, so the sketches of lines within some
    edits differ by four bits an edit at most.
    """
    return F.expr(f"""
      aggregate(split({text}, ''), named_struct('last', '', 'bits', 0L),
        (s, c) -> named_struct('last', c, 'bits', s.bits ^ shiftleft(1L, cast(xxhash64(s.last, c) & 63 as int))),
        s -> s.bits)""")


def edit_distance_within(left: str, right: str, edits: int) -> str:
    """SQL: whether two strings are within ``edits``, by bit vectors along the diagonal band.

    One long holds the 2 * edits + 1 cells of a column of the band. ``left`` and ``right``
    are names of string columns.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    same = " | ".join(
        f"if(coalesce(get(p, j - {edits} + {b}) = get(t, j), false), {1 << b}L, 0L)" if b >= edits else
        f"if(j >= {edits - b} and coalesce(get(p, greatest(j - {edits} + {b}, 0)) = get(t, j), false), {1 << b}L, 0L)"
        for b in range(width)
    )
    d0 = "((((s.x & s.vp) + s.vp) ^ s.vp) | s.x | s.vn) & {0}L".format(full)
    step = f"""
      transform(array(named_struct('vp', s.vp, 'vn', s.vn, 'd', s.d, 'x', {same})),
        s -> named_struct('vp', s.vp, 'vn', s.vn, 'd', s.d, 'd0', {d0}))[0]"""
    step = f"""
      transform(array({step}), s -> named_struct('d', s.d, 'd0', s.d0,
        'hp', (s.vn | ~(s.d0 | s.vp)) & {full}L, 'hn', s.d0 & s.vp))[0]"""
    last = f"shiftright({top}L, least(j - (m - {edits}) + 1, {width}))"
    dist = f"""s.d + if(j < m - {edits}, if((s.d0 & {top}L) = 0, 1, 0),
        if((s.hp & {last}) <> 0, 1, 0) - if((s.hn & {last}) <> 0, 1, 0))"""
    step = f"""
      transform(array({step}), s -> named_struct(
        'vp', (s.hn | ~(shiftright(s.d0, 1) | s.hp)) & {full}L,
        'vn', shiftright(s.d0, 1) & s.hp, 'd', {dist}))[0]"""
    start = ((1 << (edits + 1)) - 1) << edits
    body = f"""
      aggregate(sequence(0, n - 1), named_struct('vp', {start}L, 'vn', 0L, 'd', {edits}),
        (s, j) -> {step}, s -> s.d <= {edits})"""
    for name, value in (("n", f"char_length({right})"), ("m", f"char_length({left})"),
                        ("t", f"split({right}, '')"), ("p", f"split({left}, '')")):
        body = f"transform(array({value}), {name} -> {body})[0]"
    return f"abs(char_length({left}) - char_length({right})) <= {edits} and {body}"


def _if_small(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` for a broadcast if its ``rows`` entries are known to be few, else as it is."""
    return F.broadcast(df) if (rows or 0) <= BROADCAST_ROWS else df


def removals(docs: DataFrame, min_chars: int = 20, edits: int = 2) -> DataFrame:
    """(id, h, drop): the positions of the lines to remove, per document that has any.

    ``docs`` has id, h (hash of the text) and text.
    """
    from .common import written

    order = F.expr("cast(id as decimal(38, 0)) * 4294967296 + pos")
    seen = written(_lines(docs, min_chars).withColumn("at", order), "lines")
    first = seen.groupBy("a", "b").agg(F.min("at").alias("first"))

    # A line has the keys of its own band, and of the next shorter one if lines within
    # ``edits`` are in it. One of two near lines shows a segment at its own place.
    n = F.col("n")
    own, shorter = _base(n, edits), _base(n - edits, edits)
    below = F.when((n >= edits) & (shorter < own), shorter)
    keys = [*_keys(own, edits), *[(False, key) for _, key in _keys(below, edits)]]
    names = [f"k{k}" for k in range(len(keys))]
    keyed = (
        _lines(docs, min_chars, "norm")
        .withColumn("n", F.char_length("norm"))
        .select("a", "b", (n % 128).cast("tinyint").alias("seen"), *[x.alias(name) for name, (_, x) in zip(names, keys)])
        .groupBy("a", "b")
        .agg(*[F.first(name).alias(name) for name in ("seen", *names)])
    )
    seen_at = {True: F.col("seen").bitwiseOR(F.lit(OWN_PLACE).cast("tinyint")), False: F.col("seen")}
    rows = keyed.select(
        "a", F.inline(F.array(*[F.struct(F.col(x).alias("key"), seen_at[at].alias("seen")) for x, (at, _) in zip(names, keys)]))
    ).filter("key is not null")
    # Lines in question share a segment with another one of alike length. Both sides are the
    # same rows, so that they are shuffled once; a row is kept once, however many it meets.
    others = rows.select(F.col("key").alias("okey"), F.col("a").alias("oa"), F.col("seen").alias("oseen"))
    met = (F.col("key") == F.col("okey")) & (F.col("a") != F.col("oa")) & _alike_in_length(F.col("seen"), F.col("oseen"), edits)
    asked = written(rows.join(others, met, "left_semi"), "line-keys")

    # The texts of the lines in question, from the documents where they stand first.
    wanted = asked.select("a").distinct()
    places = (
        seen.join(wanted, "a", "left_semi").join(first, ["a", "b"]).filter("at = first").select("id", "h", "pos", "a", "at")
    )
    listed = written(places.groupBy("id", "h").agg(F.collect_set(F.struct("pos", "a", "at")).alias("places")), "places")
    listed = _if_small(listed, listed.agg(F.sum(F.size("places"))).first()[0])
    texts = (
        docs.join(listed, ["id", "h"])
        .select(F.split("text", "\n").alias("lines"), F.explode("places").alias("p"))
        .select("p.a", "p.at", F.lower(F.trim(F.get("lines", F.col("p.pos")))).alias("norm"))
        .distinct()
        .withColumn("bits", _sketch("norm"))
    )
    # A line goes if any earlier one is near, so no pairs are listed: a row stops at the first.
    later = asked.join(written(texts, "line-texts"), "a")
    earlier = later.select(*[F.col(c).alias(f"o{c}") for c in later.columns])
    before = (F.col("oat") < F.col("at")) | ((F.col("oat") == F.col("at")) & (F.col("a") < F.col("oa")))
    close = F.bit_count(F.col("bits").bitwiseXOR(F.col("obits"))) <= 4 * edits
    near = (
        later.join(earlier, met & before & close & F.expr(edit_distance_within("norm", "onorm", edits)), "left_semi")
        .select("a", "at")
        .distinct()
    )
    copies = seen.join(first, ["a", "b"]).filter("at > first").select("id", "h", "pos")
    similar = seen.join(near, ["a", "at"], "left_semi").select("id", "h", "pos")
    return copies.union(similar).groupBy("id", "h").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, edits: int = 2) -> DataFrame:
    """(row, kept_lines, n_removed) for every row of ``docs`` (doc_id, text, ...).

    Lines end at newlines and are compared trimmed and in lower case. A line of at least
    ``min_chars`` such characters is removed if an equal line, or one within ``edits``
    insertions, deletions and substitutions, stands before it, by doc_id and position (null
    ids last). Lines are judged on the input, so a removed line still removes later ones;
    shorter lines stay. A null text has null ``kept_lines``. Rows that repeat doc_id and
    text are one document: each keeps the same lines. ``row`` holds the input row, so
    other columns may have any names. An empty table gives no rows.

    Texts are shuffled by document only; lines travel as hashes and segment keys.
    """
    keys = (
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64("text").alias("h"),
    )
    drop = removals(docs.select(*keys, F.col("text").cast("string").alias("text")), min_chars, edits)
    kept = F.expr(
        "transform(filter(transform(split(row.text, '\n'), (x, i) -> struct(x as x, i as i)),"
        " s -> not array_contains(coalesce(drop, array()), s.i)), s -> s.x)"
    )
    return docs.select(F.struct("*").alias("row"), *keys).join(drop, ["id", "h"], "left").select(
        "row", kept.alias("kept_lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed")
    )
