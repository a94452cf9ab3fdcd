"""Line dedup by a segment-partition edit join.

Lines within an edit distance of ``threshold`` of each other are one class, and so is what a chain of such lines joins; of a
class only the line that comes first (by document id, hash of the text, line number) stays. Lines of about one length are cut into
threshold + 1 segments at the same places; a line within the threshold holds one of them unchanged, near its place. So lines are
indexed by their segments with segment number and band of lengths, and probed by the substrings at suitable places. Pairs that
meet are verified by a bit-parallel edit distance inside the band around the diagonal, after cheaper tests that no near pair fails.

For the classes not all pairs are needed. Lines of a bucket are first compared with a few of its lines (stars); what these leave in
different classes is compared in blocks, where a line keeps one verified partner of each class.

Lines are compared without white space at their ends. Those with fewer than ``least_chars`` code points are alike only if they are
equal, as two edits make another word of a short one; those under ``least_exact`` are left as they are, blank ones and those of
null texts always. Equal lines are one line before the join, however many there are. Equal rows
(same id and text) are one document and get equal results; the earliest of them does not displace the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import components, forget, without, table, written

BROADCAST_LINES = 200_000
BLOCK = 256
#: Characters of the lines of a block, at most, unless one line has more.
BLOCK_CHARS = 1 << 20
#: Lengths that share their segments.
BAND = 8
#: Groups of letters whose counts are compared before lines are.
LETTERS = ("aA", "eE", "iI", "oO", "nN", "sS", "tT", "rR", "dlDL", "chCH", " ")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names a value, so that it is computed once in an expression that uses it often."""
    return F.transform(F.array(value), body)[0]


def banded_distance(left: Column, right: Column, threshold: int) -> Column:
    """The edit distance of two strings if it is at most ``threshold``, else a number above it.

    The strings are longer than the threshold and differ in length by no more. A bit vector stands for a column's cells in
    the band of 2 * threshold + 1 diagonals, as steps down (``up``, ``down``); the window moves a row with each column. The
    distance is followed along the lowest diagonal to the last row, and then along that row.
    """
    band = 2 * threshold + 1
    number = lambda n: F.lit(n).cast("bigint")
    mask = number((1 << band) - 1)
    steps_down = F.length(left) - threshold
    start = F.struct(F.lit(threshold).alias("n"), number(((1 << (threshold + 1)) - 1) << threshold).alias("up"), number(0).alias("down"))

    def column(letters: Column, state: Column, j: Column) -> Column:
        up, down = state["up"], state["down"]
        letter = F.get(letters["b"], j)

        def equal() -> Column:
            bits = number(0)
            for bit in range(band):
                row = j + (bit - threshold)
                bits = bits + F.when((row >= 0) & (F.get(letters["a"], F.greatest(row, F.lit(0))) == letter), number(1 << bit)).otherwise(number(0))
            return bits

        def free(match: Column) -> Column:  # cells that cost nothing over their diagonal neighbour
            return (match.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(match).bitwiseOR(down).bitwiseAND(mask)

        def after(same: Column) -> Column:
            more = down.bitwiseOR(same.bitwiseOR(up).bitwiseXOR(mask))  # steps right that cost one more, or one less
            less = same.bitwiseAND(up)
            fallen = F.shiftright(same, 1)
            along = F.when(j < steps_down, F.when(same.bitwiseAND(number(1 << (band - 1))) == 0, 1).otherwise(0)).otherwise(_let(
                F.call_function("shiftleft", number(1), F.greatest(F.lit(0), band - 2 - (j - steps_down))),
                lambda bit: F.when(more.bitwiseAND(bit) != 0, 1).when(less.bitwiseAND(bit) != 0, -1).otherwise(0)))
            return F.struct(
                (state["n"] + along).alias("n"),
                less.bitwiseOR(fallen.bitwiseOR(more).bitwiseXOR(mask)).alias("up"), fallen.bitwiseAND(more).alias("down"))

        return _let(_let(equal(), free), after)

    return _let(F.struct(F.split(left, "").alias("a"), F.split(right, "").alias("b")), lambda letters: F.aggregate(
        F.sequence(F.lit(0), F.size(letters["b"]) - 1), start, lambda state, j: column(letters, state, j), lambda state: state["n"]))


def near(left: Column, right: Column, threshold: int) -> Column:
    """Whether the edit distance is at most the threshold. Most pairs are not near and are told so by Spark's bounded distance, at less cost."""
    return (F.levenshtein(left, right, threshold) >= 0) & (banded_distance(left, right, threshold) <= threshold)


def signatures(line: Column, threshold: int) -> tuple[Column, int, int]:
    """Hashes of a line's segments and probes; how many there are for a band of lengths, and how many of these, the first ones, are segments.

    A line stands in the band of its length and, where a longer one within the threshold is in the next, in that too. Segment i
    of the left half is counted from the start and of the right half from the end, so that fewer than i edits (from that side) lie
    before an unchanged one: it moves by i - 1 letters at most. Room is left for that behind each segment, so one direction of
    probes is enough: of two lines, the one in which the segment stands farther in probes for the other's.
    """
    parts = threshold + 1
    band = max(BAND, parts)
    moves = [min(i, threshold - i) for i in range(parts)]
    n = F.length(line)

    def of_band(k: Column) -> list[Column]:
        base = F.greatest(F.lit(0), F.floor((k * band - threshold - sum(moves)) / parts)).cast("int")
        indexed, probes = [], []
        for i, move in enumerate(moves):
            left = 2 * i <= threshold
            begin = base * i + sum(moves[:i]) if left else base * (threshold - i) + sum(moves[i + 1:])
            for by in range(move + 1):
                start = begin + by + 1 if left else n - begin - by - base + 1
                (probes if by else indexed).append(F.xxhash64(F.lit(i), k, F.substr(line, start, base)))
        return [*indexed, *probes]

    own, next_one = F.floor(n / band).cast("int"), F.floor((n + threshold) / band).cast("int")
    first, second = of_band(own), of_band(next_one)
    return F.concat(F.array(*first), F.when(own < next_one, F.array(*second)).otherwise(F.array().cast("array<bigint>"))), len(first), parts


def _lines(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(doc_id, _text, line_no, line, a, b) of the lines that count; a and b together tell lines apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("_text"), F.posexplode(F.split(whole, "\n", -1)).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).filter(F.length("line") >= max(least, 1))
    return rows.withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64("line", F.lit(1)))


def _signed(lines: DataFrame, threshold: int, *carried: str, least_chars: int = 0) -> DataFrame:
    """A written table of the carried columns, a and the signatures of lines of ``least_chars`` or more."""
    return written(lines.select(*carried, "a", F.when(F.length("line") >= least_chars, signatures(F.col("line"), threshold)[0]).alias("hs")), "signatures")


def _met(signed: DataFrame, threshold: int) -> DataFrame:
    """(a, h, indexed): lines under the signatures that they share with others."""
    _, each, indexed = signatures(F.lit(""), threshold)
    rows = signed.select("a", F.posexplode("hs").alias("place", "h")).select("a", "h", (F.col("place") % each < indexed).alias("indexed"))
    # Most signatures belong to one line alone. Those of several lines are found by counting, not by sorting all.
    shared = written(rows.groupBy("h").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.max("indexed").alias("i"))
                     .filter("low < high AND i").select("h"), "signatures")
    met = written(_bounded(rows, shared, "h").groupBy("a", "h").agg(F.max("indexed").alias("indexed")), "signatures")
    forget(shared)
    return met


def _texts(lines: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b, line, counts) of the lines in ``met``."""
    wanted = written(met.select("a").distinct(), "line-keys")
    counts = F.array(F.length("line"), *[(F.length("line") - F.length(F.translate("line", group, ""))).cast("int") for group in LETTERS])
    texts = written(_bounded(lines.select("a", "b", "line"), wanted, "a").dropDuplicates(["a", "b"]).withColumn("counts", counts), "line-texts")
    forget(wanted)
    return texts


def _may_be_near(counts: Column, others: Column, threshold: int) -> Column:
    """An edit changes a length by one at most, and the counts of two letters by one each."""
    changed = F.aggregate(F.zip_with(F.slice(counts, 2, len(LETTERS)), F.slice(others, 2, len(LETTERS)), lambda p, q: F.abs(p - q)),
                          F.lit(0), lambda t, v: t + v)
    return (F.abs(others[0] - counts[0]) <= threshold) & (changed <= 2 * threshold)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b, a2, b2): the pairs (x, y) of lines within the threshold."""
    left = texts.select(F.col("a").alias("x"), "a", "b", "line", "counts")
    right = texts.select(F.col("a").alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("line").alias("line2"), F.col("counts").alias("counts2"))
    joined = pairs.join(left, "x").join(right, "y").filter(_may_be_near(F.col("counts"), F.col("counts2"), threshold))
    return written(joined.filter(near(F.col("line"), F.col("line2"), threshold)).select("a", "b", "a2", "b2"), "similar")


def similar_lines(lines: DataFrame, threshold: int) -> DataFrame:
    """(a, b, a2, b2): all pairs of different lines within the threshold, from (line, a, b)."""
    signed = _signed(lines, threshold)
    met = _met(signed, threshold)
    texts = _texts(lines, met)
    held = met.filter("indexed").select("h", F.col("a").alias("other"))
    pairs = met.join(held, "h").filter("a <> other").select(F.least("a", "other").alias("x"), F.greatest("a", "other").alias("y")).distinct()
    found = _verified(pairs, texts, threshold)
    forget(signed, met, texts)
    return found


def linked_lines(lines: DataFrame, threshold: int, signed: DataFrame | None = None) -> DataFrame:
    """(a, b, a2, b2): pairs of lines within the threshold, enough of them to join what chains of all such pairs join.

    ``signed`` may hold the signatures of the lines. The pairs of a bucket grow with its lines, not with their square.
    """
    own = signed is None
    signed = _signed(lines, threshold) if own else signed
    met = _met(signed, threshold)
    texts = _texts(lines, met)
    a = F.col("a")
    buckets = met.filter("indexed").groupBy("h").agg(F.array_distinct(F.array(
        F.min("a"), F.max("a"), F.min_by("a", F.xxhash64(a, F.lit(1))), F.min_by("a", F.xxhash64(a, F.lit(2))))).alias("hubs"))
    spokes = met.join(buckets, "h").select("a", F.explode("hubs").alias("hub")).filter("a <> hub")
    stars = _verified(spokes.select(F.least("a", "hub").alias("x"), F.greatest("a", "hub").alias("y")).distinct(), texts, threshold)
    rest = _verified_in_blocks(met, texts, stars, threshold)
    found = stars.unionByName(rest)
    forget(met, texts, *([signed] if own else []))
    return found


def _verified_in_blocks(met: DataFrame, texts: DataFrame, stars: DataFrame, threshold: int) -> DataFrame:
    """(a, b, a2, b2): for each line and each other class of a bucket a partner within the threshold, if there is one.

    A bucket's indexed lines are dealt into blocks; a line is compared with a block inside one row, and only partners leave it.
    Buckets of one class, and those in which every line has been compared with every indexed one, are left out.
    """
    if stars.isEmpty():
        classed = met.withColumn("class", F.col("a"))
    else:
        classes = components(stars.select("a", F.col("a2").alias("b"))).select(F.col("id").alias("a"), "component")
        classed = met.join(classes, "a", "left").select("a", "h", "indexed", F.coalesce("component", "a").alias("class"))
    open_ones = classed.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count_if("indexed").alias("n")).filter(
        "low < high AND n > 2").select("h")  # up to two indexed lines are both hubs
    left = written(classed.join(open_ones, "h").join(texts, "a"), "open-lines")
    blocks = left.filter("indexed").groupBy("h").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("line")) / BLOCK_CHARS)).cast("bigint").alias("blocks"))
    held = (left.filter("indexed").join(blocks, "h").groupBy("h", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
            .agg(F.collect_list(F.struct("a", "b", "class", "counts", "line")).alias("others")))
    asking = left.join(blocks, "h").select("h", "a", "b", "class", "counts", "line", "indexed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))

    def partner(other: Column) -> Column:  # of two indexed lines, one asks
        return (other["class"] != F.col("class")) & (~F.col("indexed") | (other["a"] > F.col("a"))) & _may_be_near(F.col("counts"), other["counts"], threshold) & near(F.col("line"), other["line"], threshold)

    def one_of_each(partners: Column) -> Column:
        return F.map_values(F.map_from_entries(F.transform(F.array_distinct(F.transform(partners, lambda p: p["class"])), lambda c: F.struct(
            c.alias("class"), F.filter(partners, lambda p: p["class"] == c)[0].alias("p")))))

    met_in_block = asking.join(held, ["h", "block"]).select("a", "b", F.filter("others", partner).alias("partners")).filter(F.size("partners") > 0)
    found = met_in_block.select("a", "b", F.explode(one_of_each(F.col("partners"))).alias("p")).select(
        "a", "b", F.col("p.a").alias("a2"), F.col("p.b").alias("b2")).distinct()
    found = written(found, "similar")
    forget(left)
    return found


def _bounded(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in the written table ``keys``; it is broadcast if it is small."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_LINES else keys, on)


def repeated_lines(docs: DataFrame, threshold: int = 2, least_chars: int = 24, doc_id: str = "doc_id", text: str = "text",
                   least_exact: int | None = None) -> DataFrame:
    """(doc_id, _text, line_no, class_doc, class_line, first): occurrences of lines that stand in several places.

    Lines of ``least_chars`` code points or more are compared by edits, those of ``least_exact`` or more (by default the same) exactly.
    """
    lines = _lines(docs, doc_id, text, least_chars if least_exact is None else min(least_chars, least_exact))
    # Texts are cut into lines once for all that needs no text of a line.
    places = _signed(lines, threshold, "doc_id", "_text", "line_no", "b", least_chars=least_chars)
    place = F.struct(F.col("doc_id"), F.col("_text"), F.col("line_no"))
    found = linked_lines(lines.filter(F.length("line") >= least_chars).select("line", "a", "b"), threshold, places)
    node = lambda a, b: F.concat_ws(":", F.hex(a), F.hex(b))
    classes = components(found.select(node("a", "b").alias("a"), node("a2", "b2").alias("b"))) if not found.isEmpty() else None
    # Places are compared for lines only that stand several times or near others.
    counted = places.groupBy("a", "b").agg(F.count("*").alias("n"))
    wanted = counted.filter("n > 1").select("a", "b")
    if classes is not None:
        wanted = wanted.union(found.select("a", "b")).union(found.select("a2", "b2")).distinct()
    wanted = written(wanted, "line-keys")
    rows = places.select("doc_id", "_text", "line_no", "a", "b")
    kinds = written(_bounded(rows, wanted, ["a", "b"]).groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")), "line-kinds")
    if classes is None:
        several = kinds.filter("first <> last").select("a", "b", "first")
    else:
        known = kinds.withColumn("id", node("a", "b")).join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
        firsts = known.groupBy("component").agg(
            F.min("first").alias("class_first"), F.max("last").alias("class_last")).filter("class_first <> class_last")
        several = known.select("a", "b", "component").join(firsts, "component").select("a", "b", F.col("class_first").alias("first"))
    several = written(several, "repeated")
    return _bounded(rows, several, ["a", "b"]).select("doc_id", "_text", "line_no", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"),
                                                      (place.eqNullSafe(F.col("first"))).alias("first"))


def drop_repeated_lines(docs: DataFrame, threshold: int = 2, least_chars: int = 24, doc_id: str = "doc_id", text: str = "text",
                        least_exact: int | None = None) -> DataFrame:
    """The documents with their repeated lines taken out of the text, and n_lines, n_removed, emptied.

    ``n_lines`` counts the lines of the text before, ``emptied`` tells that every line that was not blank has gone. A document
    without a repeated line keeps its text unchanged. Columns of the input that bear a result's name give way to it.
    """
    gone = repeated_lines(docs, threshold, least_chars, doc_id, text, least_exact).filter("NOT first").groupBy(
        F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).agg(F.sort_array(F.collect_set("line_no")).alias("_gone"))
    rows = without(docs, ["n_lines", "n_removed", "emptied", "_h"])
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = rows.withColumn("_h", F.xxhash64(whole)).join(gone, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")), "left")
    parts = F.split(whole, "\n", -1)

    def left_over(both: Column) -> Column:
        # A mask with a place for each line, so that a line is looked up in one step.
        lines, gone = both["lines"], both["gone"]
        mask = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.concat(
            F.array_repeat(F.lit(True), F.coalesce(F.get(gone, i), F.size(lines)) - F.when(
                i > 0, F.get(gone, F.greatest(i - 1, F.lit(0))) + 1).otherwise(0)),
            F.when(i < F.size(gone), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))))
        return F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("line"), mask.alias("keep")), lambda z: z["keep"]), lambda z: z["line"]), "\n")

    left = _let(F.struct(parts.alias("lines"), F.col("_gone").alias("gone")), left_over)
    joined = joined.withColumn("n_lines", F.size(parts).cast("bigint")).withColumn(
        "n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint"))
    joined = joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left))
    return joined.withColumn("emptied", (F.col("n_removed") > 0) & ~F.col(text).rlike(r"\S")).drop("_id", "_t", "_h", "_gone")


def op2_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, least_exact=1).select("doc_id", "text", "n_lines", "n_removed", "emptied")
