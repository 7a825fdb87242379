"""Line dedup: fuzzy lines by MinHash, in DataFrame functions only.

A line's shingles are SHINGLE characters in a row at every place, within words and across blanks. Their MinHash signature has
one minimum for each of 24 classes of hashes (one-permutation hashing); a class without any takes that of one of two others,
else of the whole line. Rows of shingles are aggregated to signatures; those that can hardly be a minimum, by their value and
the line's length, don't get that far. Lines that share a band's hash are compared with the band's pivot, the line that meets most others; lines of a band that
still fall into different components are compared all with each other, in salted blocks. So no two lines that share a band
stay apart unless their similarity was found too small; comparisons grow with the square of the lines of a band that are not
alike. Of these, long lines that agree in fewer than half the classes aren't compared any further, nor lines whose bitmaps of
shingles show that they are too unlike, which loses no link; for all others, and for the pivots' pairs, the Jaccard similarity is
verified on the whole shingle sets.
Union-find over the links leaves one line per component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import columns_free, drop_table, materialize, small_bytes_or_shuffled, small_or_shuffled
from .components import connected_components

SHINGLE, BANDS, BAND_ROWS = 8, 8, 3
#: Similarity from which lines are linked, as a fraction.
SIMILAR = (4, 5)
#: Lines are joined by 64-bit hashes; a second hash finds the lines whose first is shared.
SECOND = 0x5EED
#: Lines of a block; the lines of a band are compared block by block.
BLOCK = 512
#: Shingles of a line that may reach its signature, on average: 3 a class, so that 5 in 100 classes stay empty.
REACH = 72
#: Empty classes beyond which a line has fewer different shingles than its length tells.
FEW_EMPTY = 6
#: Equal classes of 24 from which long lines are verified: 2 in 10,000 pairs at a similarity of 0.8 have fewer. In short lines,
#: of fewer shingles than LONG, classes depend on each other, and all are verified.
AGREE, LONG = 12, 100
#: Words of 64 bits of a line's bitmap of shingles.
WORDS = 64


def shingles(line: Column) -> Column:
    """64-bit hashes of every SHINGLE characters in a row; of the whole line if it is shorter."""
    # Four bytes a character, so any place is reached at once; held by a lambda, so it isn't encoded anew for every place.
    last = lambda wide: F.greatest(F.lit(1), F.octet_length(wide) - (4 * SHINGLE - 1))
    at = lambda wide: F.transform(F.sequence(F.lit(1), last(wide), F.lit(4)), lambda i: F.xxhash64(F.substring(wide, i, F.lit(4 * SHINGLE))))
    return F.transform(F.array(F.encode(line, "UTF-32")), at)[0]


def _hashes(lines: DataFrame) -> DataFrame:
    """id, size (number of shingles with repeats), at and h, the hash of the shingle there, of lines (id, line)."""
    wide = F.encode("line", "UTF-32")
    sized = lines.select("id", wide.alias("w")).withColumn("size", F.greatest(F.lit(1), F.shiftright(F.octet_length("w"), 2) - (SHINGLE - 1)))
    # Exploded places keep to generated code, which hashes some ten times as many shingles a second as a lambda.
    each = sized.select("id", "size", "w", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"))
    return each.select("id", "size", "at", F.xxhash64(F.substring("w", F.col("at") * 4 + 1, F.lit(4 * SHINGLE))).alias("h"))


def _bitmaps(lines: DataFrame) -> DataFrame:
    """id, bits (an array of WORDS longs), in which each shingle of the line sets a bit, and ones, how many bits are set; lines
    (id, line) may come several times."""
    word, bit = F.col("h").bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 8) & 63 as int))")
    # Dealt by id, so that both sums are made where the line is.
    words = _hashes(lines.repartition("id")).groupBy("id", word).agg(F.bit_or(bit).alias("bits"))
    found = words.groupBy("id").agg(F.array(*[F.coalesce(F.max(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")) for i in range(WORDS)]).alias("bits"), F.sum(F.bit_count("bits")).cast("int").alias("ones"))
    return found


def _may_be_similar(x: str = "a", y: str = "b") -> Column:
    """Whether the bitmaps leave open that two lines are similar. The bits that only one of them has are at most as many as the
    shingles that only it has, and a size that counts repeats is at least that of the set, so no similar lines are lost."""
    # The bits that both have are counted once: only a = ones a - both, and of * (size - only a) >= most * (size + only b).
    both, (most, of) = F.aggregate(F.zip_with(f"bits{x}", f"bits{y}", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda n, c: n + c), SIMILAR
    least = lambda p, q: of * F.col(f"ones{p}") + most * F.col(f"ones{q}") - (of - most) * F.col(f"size{p}")
    return (of + most) * both >= F.greatest(least(x, y), least(y, x))


def _minima(lines: DataFrame, reach: int | None) -> DataFrame:
    """id, size (number of shingles with repeats), seen (a bit for each class that has any) and the least value m0 to m23 of each
    class of the shingles of lines (id, line), an id once; null for a class without any within reach, that is, among the lowest
    `reach` of `size`."""
    classes = BANDS * BAND_ROWS
    each = _hashes(lines).select("id", "size", "at", F.shiftrightunsigned("h", 33).cast("int").alias("v"), F.pmod("h", F.lit(classes)).cast("int").alias("class"))
    if reach:  # the first shingle stays, without a class, so that every line has a row
        near = F.col("v") < F.lit(2.0**31 * reach) / F.col("size")
        each = each.where(near | (F.col("at") == 0)).withColumn("class", F.when(near, F.col("class")).otherwise(-1))
    return each.groupBy("id").agg(F.first("size").alias("size"), F.min("v").alias("least"), F.bit_or(F.when(F.col("class") >= 0, F.expr("shiftleft(1, class)"))).alias("seen"), *[F.min(F.when(F.col("class") == i, F.col("v"))).alias(f"m{i}") for i in range(classes)])


def _signatures(lines: DataFrame, near: DataFrame) -> DataFrame:
    """id, size, bands (array) and sig (three longs, a byte for each class) of lines (id, line), once an id, as tables; near holds
    their minima within reach."""
    classes = BANDS * BAND_ROWS
    third = classes // 3
    filled = [F.coalesce(f"m{i}", f"m{(i + third) % classes}", f"m{(i + 2 * third) % classes}", "least") for i in range(classes)]
    band = [F.xxhash64(F.lit(b), *[F.get("m", F.lit(b * BAND_ROWS + r)) for r in range(BAND_ROWS)]) for b in range(BANDS)]
    packed = []
    for part in range(0, classes, 8):
        packed.append(F.lit(0).cast("long"))
        for i in range(part, min(part + 8, classes)):
            packed[-1] = packed[-1].bitwiseOR(F.shiftleft(F.hash(F.get("m", F.lit(i))).cast("long").bitwiseAND(F.lit(255)), 8 * (i - part)))

    def signed(minima: DataFrame) -> DataFrame:
        # A lambda keeps the two steps apart: generated code for both at once is a method so long that the JVM never compiles it.
        found = minima.select("id", "size", "seen", F.transform(F.array(*filled), lambda m: m).alias("m"))
        return found.select("id", "size", "seen", F.array(*band).alias("bands"), *[p.alias(f"sig{i}") for i, p in enumerate(packed)])

    # Lines that repeat a few shingles may have hardly any within reach: for them all are looked at.
    first = materialize(signed(near), "line-signatures")
    poor = (F.coalesce(F.bit_count("seen"), F.lit(0)) < classes - FEW_EMPTY) & (F.col("size") > REACH)
    ids = small_or_shuffled(materialize(first.where(poor).select("id"), "line-poor"))
    again = materialize(signed(_minima(lines.join(ids, "id", "left_semi"), None)), "line-signatures")
    drop_table(ids)
    return first.where(~poor).unionByName(again).drop("seen")


def _agreeing(x: str = "a", y: str = "b") -> Column:
    """Whether two lines, by their columns size and sig0 to sig2 with suffixes, are short or agree in AGREE classes."""
    unlike = F.lit(0)
    for i in range(3):
        d = F.col(f"sig{i}{x}").bitwiseXOR(F.col(f"sig{i}{y}"))
        for by in (4, 2, 1):  # the lowest bit of each byte becomes whether the byte isn't 0
            d = d.bitwiseOR(F.shiftrightunsigned(d, by))
        unlike = unlike + F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return (F.least(f"size{x}", f"size{y}") < LONG) | (unlike <= BANDS * BAND_ROWS - AGREE)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: the lines of each text that aren't blank, trimmed and in lower case."""
    every = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return every.withColumn("line", F.lower(F.trim("line"))).where("line <> ''")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), with what columns they have, whose shingle sets are similar; of texts (id, line), an id once. Sets are made
    where lines have come to, since they are many times as long: one for a line as b, one for a pair as a."""
    ends = small_or_shuffled(pairs.select(F.col("b").alias("id")).distinct())
    sets = texts.join(ends, "id", "left_semi").repartition("id").select(F.col("id").alias("b"), F.array_distinct(shingles(F.col("line"))).alias("sb"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(sets, "b")
    both = both.select(*pairs.columns, F.array_distinct(shingles(F.col("la"))).alias("sa"), "sb")
    both = both.select(*pairs.columns, F.size(F.array_union("sa", "sb")).alias("either"), (F.size("sa") + F.size("sb")).alias("n"))
    # Written before the choice, which would otherwise be moved below and make the sets anew.
    told = materialize(both, "line-told")
    return told.where(SIMILAR[1] * (F.col("n") - F.col("either")) >= SIMILAR[0] * F.col("either")).select(pairs.columns)


def _bucketed(rows: DataFrame) -> DataFrame:
    """Of (id, band), those whose band has several ids, with the band's pivot: of its lines, the one that meets most lines in all
    its bands. In a group of near copies that is a line in the middle, to which most of the others are similar. Counts are
    combined before the exchange, and the joins are ones that Spark can split."""
    spread = materialize(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "line-spread")
    found = materialize(rows.join(small_or_shuffled(spread), "band"), "line-found")
    met = found.join(found.groupBy("id").agg(F.sum("n").alias("met")), "id")
    pivots = met.groupBy("band").agg(F.max(F.struct("met", "id")).alias("most")).select("band", F.col("most.id").alias("pivot"))
    members = materialize(found.select("band", "id").join(pivots, "band"), "line-members")
    for done in (spread, found):
        drop_table(done)
    return members


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Of (band, id, pivot), the (band, id, root) that aren't pivots, of bands whose lines have several roots."""
    placed = members.where("id <> pivot").select("band", "id").join(small_or_shuffled(roots.withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    return placed.join(mixed, "band", "left_semi")


def _all_pairs(apart: DataFrame) -> DataFrame:
    """Every pair (a, b) of lines that share a band, have different roots, agree and may be similar, with their roots ra and rb,
    once: in the first band they share, unless one is that band's pivot, with which it was compared; of (band, id, root) with
    signatures, bands and bitmaps. A band's lines are dealt over blocks, and every two blocks meet under a key of their own."""
    sized = apart.join(apart.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "band")
    sized = sized.withColumn("own", F.pmod(F.xxhash64("id", "band"), F.col("blocks")))
    about = lambda x: [F.col("id").alias(x), F.col("root").alias(f"r{x}"), *[F.col(c).alias(c + x) for c in ("size", "sig0", "sig1", "sig2", "ones", "bits", "bands")]]
    left = sized.select("band", *about("a"), F.col("own").alias("low"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("high"))
    right = sized.select("band", *about("b"), F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("low"), F.col("own").alias("high"))
    first = F.get(F.array_intersect("bandsa", "bandsb"), F.lit(0))  # of a line's bands none is another's of another place
    met = left.join(right, ["band", "low", "high"]).where("ra <> rb and (low < high or a < b)").where(_agreeing()).where(first == F.col("band")).where(_may_be_similar())
    turned = F.col("a") > F.col("b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("rb")).otherwise(F.col("ra")).alias("ra"), F.when(turned, F.col("ra")).otherwise(F.col("rb")).alias("rb"))


def line_components(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), first_doc, first_line, kept for each line of each text of docs that isn't blank.

    first_doc and first_line name the first line (by doc_id, null first, then line_no) of the component, which is kept.
    Lines are compared in lower case without blanks at their ends: equal ones, and those whose shingle sets have a Jaccard
    similarity of 0.8 or more, are linked. Null and empty texts have no lines; of repeated documents the copies' lines go,
    and lines alike in doc_id and line_no are kept or dropped together; an empty table gives no rows.
    """
    # Lines are cut and written once; what follows reads the columns it needs.
    lines = materialize(_lines(docs).select("doc_id", "line_no", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(SECOND), "line").alias("second"), "line"), "lines")
    clash = materialize(lines.groupBy("id").agg(F.min("second").alias("x"), F.max("second").alias("y")).where("x <> y").select("id"), "line-clashes")
    if not clash.isEmpty():
        shared = small_or_shuffled(clash.withColumn("clash", F.lit(True)))
        told = lambda df: df.join(shared, "id", "left").withColumn("id", F.when(F.col("clash"), F.col("second")).otherwise(F.col("id"))).drop("clash")
    else:
        told = lambda df: df
    places = told(lines.drop("line")).drop("second")
    named = told(lines.select("id", "second", "line")).drop("second")

    signed = _signatures(named, _minima(named, REACH))
    members = _bucketed(signed.select("id", F.explode("bands").alias("band")))
    # By both columns, which are alike, so that the sum is by hashes; lines that meet none aren't read again.
    texts = materialize(named.join(small_or_shuffled(materialize(members.select("id").distinct(), "line-ids")), "id", "left_semi").select("id", "line").distinct(), "line-texts")
    pairs = materialize(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "line-pairs")
    near = _links(pairs, texts)
    roots = materialize(connected_components(near), "line-roots")

    # Lines of one band that are still apart are compared with each other.
    apart = materialize(_apart(members, roots), "line-apart")
    for done in (members, near):
        drop_table(done)
    if not apart.isEmpty():
        left = small_or_shuffled(apart.select("id").distinct())
        bitmaps = materialize(_bitmaps(texts.join(left, "id", "left_semi")), "line-bitmaps")
        rest = materialize(apart.join(signed.join(left, "id", "left_semi").join(bitmaps, "id"), "id"), "line-rest")
        for done in (signed, bitmaps):
            drop_table(done)
        met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = materialize(_all_pairs(rest).join(met, ["a", "b"], "left_anti"), "line-pairs")
        drop_table(rest)
        similar = _links(more, texts)
        found = materialize(similar.select("ra", "rb").distinct(), "line-links")
        if not found.isEmpty():
            # Many links join the same two components, so components of roots are found, not of lines anew.
            above = connected_components(found, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("top"))
            nodes = roots.unionByName(above.select(F.col("root").alias("node"), "root")).distinct()
            roots = nodes.join(small_or_shuffled(above), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        for done in (found, similar, more):
            drop_table(done)
    else:
        drop_table(signed)
    for done in (pairs, apart, texts):
        drop_table(done)

    owned = places.join(small_or_shuffled(roots.withColumnRenamed("node", "id")), "id", "left").select("doc_id", "line_no", F.coalesce("root", "id").alias("root"))
    firsts = owned.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = owned.join(small_or_shuffled(materialize(firsts, "line-firsts")), "root", "left")
    out = out.select("doc_id", "line_no", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("first_doc"), F.coalesce("first.line_no", "line_no").alias("first_line"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with the lines that line_components drops taken out of text; blank lines stay.

    Null and empty texts stay as they are; a text of which all lines go is empty; repeated rows lose the same lines; an empty
    table gives no rows; columns may have any names.
    """
    gone, key = columns_free(docs, "gone", "key")
    dropped = line_components(docs).where("not kept").groupBy(F.coalesce("doc_id", F.lit(0)).alias(key), F.col("doc_id").isNull().alias("none")).agg(F.collect_set("line_no").alias(gone))
    marked = docs.join(small_bytes_or_shuffled(dropped, F.size(gone).cast("long") * 4), (F.coalesce(docs["doc_id"], F.lit(0)) == dropped[key]) & (docs["doc_id"].isNull() == dropped["none"]), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    return marked.select(*[text.alias("text") if c == "text" else marked[f"`{c}`"] for c in docs.columns])


def op3_line_minhash(spark, sf_dir: str) -> DataFrame:
    return line_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
