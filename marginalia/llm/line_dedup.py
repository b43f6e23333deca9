"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines of at least MIN_CHARS characters are compared, and with a smaller
``min_chars`` those shorter ones too that are not blank; other lines always
stay. Equal lines are one class, known by two
64-bit hashes, and only the first of them in order of (doc_id, text, line) stays.
A class is also dropped when a line within EDITS character edits stands
earlier. Two such lines have a segment in common when one of them is cut in
EDITS + 1 segments: every class posts its own segments and, for each length it
may be compared with, the substrings that can match a segment of that length
(the multi-match-aware choice of starts). What meets is compared by counts of
letters and digits first and then by a banded bit-parallel edit distance.

A segment that more than HOT_LINES classes post is hot (all lines of one
template share some): its lines are not paired. What is left of them without
the segment is within EDITS edits again, so it is cut into EDITS + 1 segments
anew, at places that share out what varies in the bucket, and so on until no
bucket is hot or EDITS characters are left.

Lines of at most EDITS characters have no EDITS + 1 segments: they are all
within EDITS of each other, so only the first stays, and share a character with
any longer line that is near, so those meet by characters.

Hashes meet, and only lines that met, or stand in a hot bucket, are read again.

Defined results: null and empty texts have no lines worth comparing; rows are
told apart by doc_id and text, so several texts with one doc_id are each judged
by themselves, and rows that repeat both are one document, each row reported;
a null doc_id stands before all others; ties go to the smaller line number; an
empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import checkpointed, dropped as delete

EDITS = 2
#: Shortest line compared unless a caller asks for less.
MIN_CHARS = 20
BLANK = " \t\r\x0b\x0c"
#: Characters, or groups of them, whose counts are compared before lines are; each edit moves two of them by one at most.
LETTERS = ("e", "a", "t", "n", "o", "i", "r", "h", "01234", "56789")
#: Characters counted over whole lines, of the lines that are read again; sixteen counts go in one word.
MORE_LETTERS = (*"abcdefghiklmnoprstuvwyz", "jqx", "áéíóúñ", "äöüß", "0123", "456", "789", ",.", "ABCDEFGHIJKLM", "NOPQRSTUVWXYZ")
#: Characters at either end of a line whose letters are counted; all are, of lines of twice as many.
END = 64
#: Classes that may post one segment before its bucket is parted by further segments.
HOT_LINES = 64
#: Rows of (doc_id, line) that may be broadcast when lines are read again; beyond, they are shuffled.
BROADCAST_ROWS = 500_000
#: Columns added for a while; no table has columns of these names.
GONE, TEXT, HASH = "__lines_gone__", "__text_kept__", "__text_hash__"
GONE_ID, GONE_HASH = "__gone_id__", "__gone_hash__"


def _lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, t (the text's hash), pos, line of the lines that are compared."""
    split = documents.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    some = (F.char_length("line") >= min_chars) & (F.trim("line", F.lit(BLANK)) != "")
    return split.where((F.char_length("line") >= MIN_CHARS) | some if min_chars < MIN_CHARS else F.char_length("line") >= min_chars)


def _with_shares(lines: DataFrame, edits: int) -> DataFrame:
    """For each length a line may be compared with (its own, and up to ``edits`` less): q, and the remainder r, of segments.

    Columns of their own keep the generated code of the keys small.
    """
    n = edits + 1
    return lines.withColumns({f"q{t}": F.expr(f"CAST((len - {t}) DIV {n} AS INT)") for t in range(n)} | {f"r{t}": F.expr(f"(len - {t}) % {n}") for t in range(n)})


def _segment(shorter: int, i: int, edits: int) -> tuple[Column, Column]:
    """(first character from 1, size) of segment i of a line ``shorter`` characters less long; the last r segments are one longer."""
    q, r = F.col(f"q{shorter}"), F.col(f"r{shorter}")
    before = edits + 1 - i  # segments from this one on
    return q * i + F.greatest(F.lit(0), r - before) + 1, q + (r >= before).cast("int")


def _shifts(shorter: int, i: int, edits: int) -> range:
    """How far from segment i of a line ``shorter`` characters less long its match may stand: i edits before it at most, the rest after it."""
    return range(max(-i, shorter - edits + i), min(i, shorter + edits - i) + 1)


def _keys(line: str, edits: int) -> tuple[list[Column], list[Column], list[tuple[int, int, int]]]:
    """(own segments' keys, keys of substrings that may match segments of other lines, what these are: shorter, segment, shift)."""
    own, probes, kinds = [], [], []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            start, size = _segment(shorter, i, edits)
            for shift in _shifts(shorter, i, edits):
                key = F.xxhash64(F.substring(line, start + shift, size), F.col("len") - shorter, F.lit(i))
                if shorter == shift == 0:
                    own.append(key)
                else:
                    probes.append(key)
                    kinds.append((shorter, i, shift))
    return own, probes, kinds


def _characters(line: str) -> Column:
    """Keys of a line's different characters."""
    return F.transform(F.array_distinct(F.split(line, "")), lambda c: F.xxhash64(c, F.lit("character")))


def _all_but_the_first(classes: DataFrame) -> DataFrame:
    """h of all classes but the one that stands first."""
    least = classes.agg(F.min("first").alias("least"))
    return classes.join(F.broadcast(least), F.col("first") > F.col("least")).select("h", "g")


def _ends(line: str) -> Column:
    """A line's first and last END characters, or all of a line that has no more.

    An edit within them takes one character of them in and puts another out at
    most, and one between them changes nothing, so an edit moves two counts by one at most here too.
    """
    return F.concat(F.substring(line, F.lit(1), F.lit(END)), F.substring(line, F.greatest(F.col("len") - END, F.lit(END)) + 1, F.lit(END)))


def _counts(ends: str) -> Column:
    """Counts of LETTERS up to 63, six bits each."""
    packed = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        rest = reduce(lambda text, one: F.replace(text, F.lit(one), F.lit("")), letter, F.col(ends))
        n = F.octet_length(ends) - F.octet_length(rest)
        packed = packed.bitwiseOR(F.shiftleft(F.least(n, F.lit(63)).cast("long"), 6 * k))
    return packed


def _all_counts(line: str) -> Column:
    """Counts of MORE_LETTERS in a whole line modulo 16, four bits each, in words of sixteen."""
    words = []
    for first in range(0, len(MORE_LETTERS), 16):
        packed = F.lit(0).cast("long")
        for k, letters in enumerate(MORE_LETTERS[first : first + 16]):
            rest = reduce(lambda text, one: F.replace(text, F.lit(one), F.lit("")), letters, F.col(line))
            packed = packed.bitwiseOR(F.shiftleft((F.char_length(line) - F.char_length(rest)).cast("long").bitwiseAND(F.lit(15)), 4 * k))
        words.append(packed)
    return F.array(*words)


def _all_apart(a: str, b: str) -> Column:
    """Sum of the differences of two lines' counts the shorter way round, which are at most those of the true counts."""
    total = F.lit(0)
    for k in range(len(MORE_LETTERS)):
        x, y = (F.shiftrightunsigned(F.get(c, F.lit(k // 16)), 4 * (k % 16)).bitwiseAND(F.lit(15)) for c in (a, b))
        off = (x - y).bitwiseAND(F.lit(15))
        total = total + F.least(off, 16 - off)
    return total


def _apart(a: str, b: str) -> Column:
    """Sum of the differences of two packed counts."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        x, y = (F.shiftrightunsigned(F.col(c), 6 * k).bitwiseAND(F.lit(63)) for c in (a, b))
        total = total + F.abs(x - y)
    return total


def _shared_start(a: Column, b: Column) -> Column:
    """Characters that both lines begin with, found by halving steps."""
    most = F.least(F.char_length(a), F.char_length(b))

    def step(at, size):
        same = F.substring(a, at + 1, size) == F.substring(b, at + 1, size)
        return F.when((at + size <= most) & same, at + size).otherwise(at)

    sizes = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(F.filter(sizes, lambda s: s <= most), F.lit(0), step)


def within(a: str, b: str, edits: int) -> Column:
    """Whether two lines' edit distance is at most ``edits``: a band of 2 * edits + 1 diagonals in one machine word.

    Bit t of column j stands for row j - edits + t. D0 tells where a diagonal
    step is free; the distance is read off the diagonal that ends in the corner.
    A caller may cut what lines share at both ends, which leaves the distance as it
    is; once the diagonal has cost too much nothing more is computed.
    """
    x, y = F.split(a, ""), F.split(b, "")
    tall, wide = F.greatest(F.char_length(a), F.char_length(b)), F.least(F.char_length(a), F.char_length(b))
    rows = F.when(F.char_length(a) >= F.char_length(b), x).otherwise(y)
    columns = F.when(F.char_length(a) >= F.char_length(b), y).otherwise(x)
    off = tall - wide
    width = 2 * edits + 1
    full = (1 << width) - 1
    packed = F.struct(rows.alias("rows"), columns.alias("columns"), off.cast("int").alias("off"), wide.cast("int").alias("wide"))

    def advance(state, j, given):
        c = F.get(given["columns"], j)
        match = F.lit(0).cast("long")
        for t in range(width):
            row = j - edits + t  # from 0
            match = match.bitwiseOR(F.when((row >= 0) & F.coalesce(F.get(given["rows"], row) == c, F.lit(False)), F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long")))
        vp, vn = state["vp"], state["vn"]
        d0 = ((match.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(full))
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(full))
        hn = d0.bitwiseAND(vp)
        half = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"),
            half.bitwiseAND(hp).alias("vn"),
            (state["far"] + F.when(d0.bitwiseAND(F.element_at(F.array(*[F.lit(1 << (edits + k)).cast("long") for k in range(edits + 1)]), given["off"] + 1)) == 0, 1).otherwise(0)).cast("int").alias("far"),
        )

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(0).alias("far"))
    # The lines' characters are split once and handed to every step.
    far = F.get(F.transform(F.array(packed), lambda g: F.aggregate(F.slice(F.sequence(F.lit(0), g["wide"]), F.lit(1), g["wide"]), start, lambda s, j: F.when(s["far"] + g["off"] > edits, s).otherwise(advance(s, j, g)), lambda s: s["far"] + g["off"])), F.lit(0))
    return F.when(off > edits, False).otherwise(far <= edits)


def _order() -> Column:
    """Which of two classes that meet is told: pairs that meet from both sides are told once."""
    return (F.col("other") & (F.col("h") != F.col("h2"))) | (~F.col("other") & (F.col("h") < F.col("h2")))


def _paired(posted: DataFrame, asking: DataFrame, edits: int, differ=_apart) -> DataFrame:
    """(a, b, apart): classes that meet under a key and have nearly the same letters, by the counts that ``differ`` compares."""
    met = posted.select("k", "h", "counts").join(asking.select("k", "h2", "counts2", "other"), "k")
    met = met.withColumn("apart", differ("counts", "counts2")).where(_order() & (F.col("apart") <= 2 * edits))
    return met.select(F.least("h", "h2").alias("a"), F.greatest("h", "h2").alias("b"), F.col("apart").cast("byte").alias("apart"))


def _met_lines(documents: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, g, line, counts): the lines of all classes that met, and the counts of all their letters."""
    who = pairs.select("later.h", "later.g").unionByName(pairs.select("earlier.h", "earlier.g")).distinct()
    places = checkpointed(firsts.join(who, ["h", "g"]).select("h", "g", "first"))
    read = _read(documents, places)
    out = checkpointed(read.select("h", "g", "line", _all_counts("line").alias("counts")))
    delete(places, read)
    return out


def _alike(pairs: DataFrame, read: DataFrame, edits: int) -> DataFrame:
    """The pairs whose letters are nearly the same over the whole of both lines."""
    side = lambda k: read.select(F.struct("h", "g").alias(k), F.col("counts").alias(f"{k}_counts"))
    both = pairs.select("later", "earlier").join(side("later"), "later").join(side("earlier"), "earlier")
    return checkpointed(both.select("later", "earlier", _all_apart("later_counts", "earlier_counts").alias("apart")).where(F.col("apart") <= 2 * edits))


def _verified(read: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """(h, g): the later classes of the pairs that are within ``edits``."""
    side = lambda k, c: read.select(F.struct("h", "g").alias(k), F.col("line").alias(c))
    # Few bytes, much work: as many tasks as shuffles have.
    dealt = pairs.select("later", "earlier").repartition(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), "later", "earlier")
    texts = dealt.join(side("later", "la"), "later").join(side("earlier", "lb"), "earlier")
    ends = texts.withColumns({"head": _shared_start(F.col("la"), F.col("lb")), "tail": _shared_start(F.reverse("la"), F.reverse("lb"))})
    shorter = F.least(F.char_length("la"), F.char_length("lb")) - F.col("head")
    rest = lambda c: F.substring(c, F.col("head") + 1, F.char_length(c) - F.col("head") - F.least(F.col("tail"), shorter)).alias(c)
    # Written here, or the filter below would be rewritten over these expressions many times.
    trimmed = checkpointed(ends.select("later", rest("la"), rest("lb")))
    near = checkpointed(trimmed.where(within("la", "lb", edits)).select("later.h", "later.g").distinct())
    delete(trimmed)
    return near


def _beside(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row for each of its keys: broadcast if it is small, shuffled if not."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def _read(documents: DataFrame, places: DataFrame) -> DataFrame:
    """(h, g, first, line): the lines of classes, from their first places."""
    by_doc = places.groupBy("first.doc_id", "first.t").agg(F.collect_list(F.struct("first", "h", "g")).alias("wanted"))
    if places.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    texts = documents.select("doc_id", F.xxhash64("text").alias("t"), "text").alias("x")
    read = texts.join(by_doc.alias("y"), F.expr("x.doc_id <=> y.doc_id AND x.t = y.t")).select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
    return checkpointed(read.select("w.h", "w.g", "w.first", F.get("all", F.col("w.first.pos")).alias("line")).dropDuplicates(["h", "g"]))


def _without(text: str, start: Column, size: Column) -> Column:
    """A text without ``size`` characters from ``start`` (from 1) on."""
    return F.concat(F.substring(text, F.lit(1), start - 1), F.substring(text, start + size, F.char_length(text)))


def _cuts(posted: DataFrame, edits: int) -> DataFrame:
    """(k, cut): bounds of EDITS + 1 segments for each bucket's texts (all of one length), which share out the variety of characters."""
    n = edits + 1
    each = posted.select("k", F.char_length("rest").alias("size"), F.posexplode(F.split("rest", "")).alias("pos", "c")).where("c <> ''")
    places = each.groupBy("k", "size", "pos", "c").agg(F.lit(1)).groupBy("k", "size", "pos").agg(F.log(F.count("*")).alias("w"))
    upto = F.sum("w").over(Window.partitionBy("k").orderBy("pos"))
    places = places.withColumns({"upto": upto, "total": F.sum("w").over(Window.partitionBy("k"))})
    ends = [F.min(F.when(F.col("upto") >= F.col("total") * j / n, F.col("pos") + 1)).alias(f"e{j}") for j in range(1, n)]
    step = places.groupBy("k", "size").agg(*ends).withColumn("e0", F.lit(0))
    for j in range(1, n):
        step = step.withColumn(f"e{j}", F.greatest(F.col(f"e{j - 1}") + 1, F.least(F.col(f"e{j}"), F.col("size") - (n - j))))
    return step.select("k", F.array(*[f"e{j}" for j in range(n)], "size").alias("cut"))


def _parted(posted: DataFrame, asking: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """The members of buckets under keys of one more segment, without that segment."""
    cuts = checkpointed(_cuts(posted, edits))
    spot = lambda i: (F.get("cut", F.lit(i)) + 1, F.get("cut", F.lit(i + 1)) - F.get("cut", F.lit(i)))

    def at(i, shift, other):
        start, size = spot(i)
        key = F.xxhash64("k", F.lit(i), F.substring("rest", start + shift, size))
        return F.struct(key.alias("k"), _without("rest", start + shift, size).alias("rest"), other.alias("other"))

    own = F.explode(F.array(*[at(i, 0, F.lit(False)) for i in range(edits + 1)])).alias("x")
    p = _beside(posted, cuts, "k").select("h", "counts", own).select("x.k", "h", "counts", "x.rest")
    asked = [
        F.when(F.col("shorter") == shorter, at(i, shift, F.col("other") | F.lit(bool(shorter or shift))))
        for shorter in range(edits + 1) for i in range(edits + 1) for shift in _shifts(shorter, i, edits)
    ]
    probes = F.explode(F.array_compact(F.array(*asked))).alias("x")
    a = _beside(asking, cuts, "k").select("h2", "counts2", "shorter", probes).select("x.k", "h2", "counts2", "shorter", "x.other", "x.rest")
    p, a = checkpointed(p), checkpointed(a)
    delete(cuts)
    return p, a


def _hot(posted: DataFrame) -> DataFrame:
    return checkpointed(posted.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > HOT_LINES).select("k"))


def _met_in_hot_buckets(documents: DataFrame, firsts: DataFrame, posted: DataFrame, asking: DataFrame, hot: DataFrame, kinds, edits: int) -> list[DataFrame]:
    """(a, b) of the pairs that meet in hot buckets, part by part."""
    p, a = checkpointed(_beside(posted, hot, "k")), checkpointed(_beside(asking, hot, "k"))
    who = p.select("h").unionByName(a.select(F.col("h2").alias("h"))).distinct()
    read = _read(documents, checkpointed(firsts.join(who, "h").select("h", "g", "first")))
    # Lines of one template share their ends, so here all of a line is counted.
    read = checkpointed(read.select("h", F.col("line").alias("rest"), _all_counts("line").alias("counts")))
    sized = lambda rows: _with_shares(rows.withColumn("len", F.char_length("rest")), edits)

    def cut_out(kinds):
        spots = [(*_segment(shorter, i, edits), shift) for shorter, i, shift in kinds]
        return F.array(*[_without("rest", start + shift, size) for start, size, shift in spots])

    p = sized(p.drop("counts").join(read, "h")).select("k", "h", "counts", F.get(cut_out([(0, i, 0) for i in range(edits + 1)]), F.col("at")).alias("rest"))
    every = [(0, i, 0) for i in range(edits + 1)] + kinds
    shorter = F.get(F.array(*[F.lit(x) for x, _, _ in every]), F.col("at"))
    a = sized(a.drop("counts2").join(read.withColumnsRenamed({"h": "h2", "counts": "counts2"}), "h2")).select("k", "h2", "counts2", "other", shorter.alias("shorter"), F.get(cut_out(every), F.col("at")).alias("rest"))
    found = []
    while True:
        p, a = _parted(checkpointed(p), checkpointed(a), edits)
        # Few different texts of EDITS characters are left of any bucket.
        hot = _hot(p.where(F.char_length("rest") > edits))
        if hot.isEmpty():
            return [*found, checkpointed(_paired(p, a, edits, _all_apart).distinct())]
        found.append(checkpointed(_paired(_beside(p, hot, "k", "left_anti"), a, edits, _all_apart).distinct()))
        whole = p, a
        p, a = checkpointed(_beside(p, hot, "k")), checkpointed(_beside(a, hot, "k"))
        delete(hot, *whole)


def classes(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, firsts, near): every compared line's class, each class's first place, and the classes (h, g) that go."""
    raw = _lines(documents, min_chars).withColumns({"len": F.char_length("line"), "h": F.xxhash64("line"), "g": F.xxhash64("line", F.lit(1))})
    own, probes, kinds = _keys("line", edits)
    lines = raw.select("doc_id", "t", "pos", "h", "g")
    keys = F.struct("len", _counts("ends").alias("counts"), F.array(*own).alias("own"), F.array(*probes).alias("probes"), F.when(F.col("len") <= 2 * edits, _characters("line")).alias("chars"))
    keyed = _with_shares(raw, edits).withColumn("ends", _ends("line")).select("h", "g", F.struct("doc_id", "t", "pos").alias("at"), keys.alias("keys"))
    firsts = keyed.groupBy("h", "g").agg(F.min("at").alias("first"), F.first("keys").alias("keys"))
    whole = checkpointed(firsts.select("h", "g", "first", "keys.*"))
    tiny = F.col("len") <= edits
    posted = whole.where(~tiny).select("h", "counts", F.posexplode("own").alias("at", "k"))
    probing = [F.col("h").alias("h2"), F.col("counts").alias("counts2")]
    others = whole.where(~tiny).select(*probing, F.posexplode("probes").alias("at", "k"), F.lit(True).alias("other")).withColumn("at", F.col("at") + (edits + 1))
    asking = others.unionByName(whole.where(~tiny).select(*probing, F.posexplode("own").alias("at", "k"), F.lit(False).alias("other")))
    hot = _hot(posted)
    if hot.isEmpty():
        found = [checkpointed(_paired(posted, asking, edits).distinct())]
    else:
        found = [checkpointed(_paired(_beside(posted, hot, "k", "left_anti"), asking, edits).distinct())]
        found += _met_in_hot_buckets(documents, whole, posted, asking, hot, kinds, edits)
    if min_chars <= edits:
        brief = whole.where(tiny).select("h", "counts", F.explode("chars").alias("k"))
        longer = whole.where(~tiny).select(*probing, F.explode("chars").alias("k"), F.lit(True).alias("other"))
        found.append(_paired(brief, longer, edits))
    firsts = checkpointed(whole.select("h", "g", "first", "len"))
    met = checkpointed(reduce(DataFrame.unionByName, found).distinct())
    delete(hot, whole, *found[: len(found) - (min_chars <= edits)])
    mark = lambda k: firsts.select(F.col("h").alias(k), F.struct("h", "g").alias(f"c{k}"), F.col("first").alias(f"f{k}"))
    swap = F.col("fa") < F.col("fb")
    pairs = met.join(mark("a"), "a").join(mark("b"), "b")
    pairs = checkpointed(pairs.select(F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("later"), F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("earlier"), "apart"))
    delete(met)
    read = _met_lines(documents, firsts, pairs)
    met, pairs = pairs, _alike(pairs, read, edits)
    delete(met)
    # One earlier line is enough: each class is compared with the likeliest one first, and only if that fails with all.
    best = pairs.groupBy("later").agg(F.min(F.struct("apart", "earlier")).alias("x")).select("later", "x.earlier")
    sure = _verified(read, checkpointed(best), edits)
    left = checkpointed(pairs.join(sure.select(F.struct("h", "g").alias("later")), "later", "left_anti"))
    delete(pairs)
    near = sure.unionByName(_verified(read, left, edits))
    delete(left, read)
    if min_chars <= edits:
        near = near.unionByName(_all_but_the_first(firsts.where(tiny))).distinct()
    near = checkpointed(near)
    delete(sure)
    return lines, firsts.select("h", "g", "first"), near


def dropped(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t, exact, near): positions of the lines that go, of documents that have any; t is the text's hash."""
    lines, firsts, near = classes(documents, edits, min_chars)
    # Written, so that a hot line's rows can be split when they meet its one row here.
    known = checkpointed(firsts.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left"))
    judged = lines.join(known, ["h", "g"])
    later = ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.t") == F.col("t")) & (F.col("first.pos") == F.col("pos")))
    gone = judged.select("doc_id", "t", "pos", later.alias("later"), F.coalesce("near", F.lit(False)).alias("near")).where("later OR near").distinct()
    exact = F.collect_list(F.when(F.col("later"), F.col("pos")))
    out = checkpointed(gone.groupBy("doc_id", "t").agg(F.array_sort(exact).alias("exact"), F.array_sort(F.collect_list(F.when(~F.col("later"), F.col("pos")))).alias("near")))
    delete(known, firsts, near)
    return out


def _with_marks(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """``documents`` with the marks of their rows, by doc_id and text."""
    marks = marks.withColumnsRenamed({"doc_id": GONE_ID, "t": GONE_HASH})
    rows = documents.withColumn(HASH, F.xxhash64("text"))
    return rows.join(marks, F.expr(f"doc_id <=> {GONE_ID} AND {HASH} = {GONE_HASH}"), "left")


def report(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: its lines, those dropped as copies and as near copies, and their numbers from 0."""
    none = F.array().cast("array<int>")
    joined = _with_marks(documents.select("doc_id", "text"), dropped(documents, edits, min_chars))
    joined = joined.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    exact, near = F.coalesce("exact", none), F.coalesce("near", none)
    return joined.select(
        "doc_id", "n_lines", F.size(exact).cast("long").alias("n_exact"), F.size(near).cast("long").alias("n_near"),
        F.array_join(F.array_sort(F.concat(exact, near)), ",").alias("dropped"),
    )


def remove_lines(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without their dropped lines; those of which nothing is left go. Columns as given."""
    joined = _with_marks(documents, dropped(documents, edits, min_chars).select("doc_id", "t", F.concat("exact", "near").alias(GONE)))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(GONE, i)), "\n")
    text = F.when(F.col(GONE).isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn(TEXT, text).where(F.col(GONE).isNull() | (F.trim(F.col(TEXT)) != ""))
    columns = [F.col(TEXT).alias("text") if c == "text" else F.length(TEXT).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in documents.columns]
    return out.select(*columns)
