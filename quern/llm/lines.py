"""Operator 8: fuzzy line dedup by MinHash, in DataFrame operations only.

A line is a trimmed, non-empty piece between line feeds; equal lines are one line.
Two lines are near if the Jaccard similarity of their sets of SHINGLE-character
shingles is THRESHOLD or more (a shorter line's set is itself). Linked lines form
components; of each component the occurrence with the smallest (doc_id, place) stays
and every other occurrence goes.

1. Signatures: minima of hashes of the SIGNED-byte strings of a line's UTF-8, in one hash
   aggregate with partial aggregation before the only shuffle; texts aren't shuffled.
   Short lines use every such string (level 0), longer ones those whose hash begins with two
   or four zero bits (levels 1, 2). The levels' ranges of lengths overlap by more than the
   similarity allows, so near lines have a level in common; lines that repeat one to three
   characters again and again have all levels. Lines are named by two 64-bit hashes.
2. Banding: ROWS minima make a key. Members of a bucket are compared with its leaders
   (near.py), a pair a row at most.
3. Every bucket that still holds several parts is compared in full, buckets with the same
   best connected member as one unit. First each member is asked whether sketches allow it
   any partner in another part, in a semi join that makes no pairs; the members left are
   compared by their hashed shingles within the join, so only links become rows.
4. Pairs whose sketches allow it are verified by the exact Jaccard similarity over all
   shingles; components by distributed union-find.

Defined results: null and empty texts have no lines and come back as they are; blank
lines are never repeats and stay; rows with equal doc_id and text are one document and
all keep the same lines; the last tie-break of occurrences is a hash of id and text. A
null doc_id comes after all others. Extra columns stay; n_lines and n_kept replace
columns of that name. An empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import near
from quern.llm.common import drop_written, fingerprint, free_shuffles, written
from quern.llm.components import united
from quern.llm.line_sets import _elements, bags, similar_lines  # noqa: F401  the plain form, for tests

#: Characters of the shingles that the similarity is about, and bytes of the strings that are signed; the latter are
#: longer, as hardly any two unlike lines have them in common by three or four minima.
SHINGLE, SIGNED, THRESHOLD = 4, 7, 0.8
BANDS, ROWS = 12, 4
SHORT_BANDS, SHORT_ROWS = 13, 3
#: Characters of lines of level 0 (up to SHORT[1]), 1 (over SHORT[0], up to LONG[1]) and 2 (over LONG[0]).
SHORT, LONG = (100, 125), (320, 400)
#: Hash bits that are zero in the sample of each level.
BITS = (0, 2, 4)
#: Bytes after which a run repeats: one of period 1, 2, 3 or 6. Lines with runs have all levels, as their length says little of their sets.
PERIOD = 6
#: A hash deals a line's strings into so many bins, each of whose minima is a draw; further draws take further hashes.
BINS = 8
#: Four bits of each of the first minima are the sketch. At the very threshold lines share two thirds of their minima
#: on average; so many equal draws are over 4 standard deviations below, of draws and sample.
DRAWS, LEAST_EQUAL = 48, (19, 10, 10)
#: Members of a unit that one task compares with all others of it: by sketches, by shingles.
LIGHT, HEAVY = 2048, 512
_NULL_ID = 2**63 - 1


def shingles(line: Column, k: int) -> Column:
    """The distinct k-character strings of a line as 64-bit hashes; a shorter line is its own."""
    at = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - (4 * k - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * k))))
    # The encoded line is bound by a lambda, so that it isn't copied for each of its shingles.
    every = F.transform(F.array(F.encode(line, "UTF-32")), at)[0]
    return F.when(F.char_length(line) < k, F.array(F.xxhash64(line))).otherwise(F.array_distinct(every))


def _int(x: Column) -> Column:
    """The low 32 bits of a long."""
    return (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")


def _runs(line: Column) -> Column:
    """Whether the line holds a run; all of at least 3 * PERIOD bytes are found."""
    at = lambda b: F.exists(F.sequence(F.lit(1), F.octet_length(b) - (2 * PERIOD - 1), F.lit(PERIOD)), lambda i: F.substring(b, i, F.lit(PERIOD)) == F.substring(b, i + PERIOD, F.lit(PERIOD)))
    return F.transform(F.array(line.cast("binary")), at)[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """_doc orders the documents, _name is a hash of a row's id and text."""
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    return docs.select(doc.alias("_doc"), F.xxhash64(doc, text).alias("_name"), text.alias("_text")).filter("_text is not null")


def _lined(docs: DataFrame, *columns: str) -> DataFrame:
    """A row for each non-blank line: the columns, place, line and its two names."""
    out = docs.select(*columns, F.posexplode(F.split("_text", "\n", -1)).alias("place", "_piece"))
    out = out.select(*columns, "place", F.trim("_piece").alias("line")).filter("line != ''")
    return out.select("*", fingerprint(F.col("line"), 1).alias("id"), fingerprint(F.col("line"), 2).alias("h2"))


def signatures(keyed: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SIGNED) -> DataFrame:
    """Every distinct line at each of its levels: id, h2, level, name of a document that has it, occurrences n, keys, sketch w0 to w3.

    Lines of less than SHINGLE characters have level -1 and no keys: only equal ones are near.
    """
    draws = -(-max(bands * rows, SHORT_BANDS * SHORT_ROWS, DRAWS) // BINS) * BINS
    hashes = draws // BINS
    size, level, i, x = F.col("size"), F.col("level"), F.col("i"), F.col("x")
    of = lambda *levels: F.array(*[F.lit(n) for n in levels])
    levels = F.when(size < SHINGLE, of(-1)).when(size <= SHORT[0], of(0)).when(_runs(F.col("line")), of(0, 1, 2))
    levels = levels.when(size <= SHORT[1], of(0, 1)).when(size <= LONG[0], of(1)).when(size <= LONG[1], of(1, 2)).otherwise(of(2))
    # Lines that have shingles but are shorter than k are read round, so that "----" meets "----------".
    round_ = F.substring(F.repeat("line", F.lit(k)), F.lit(1), size + (k - 1))
    lines = _lined(keyed, "_name").withColumn("size", F.char_length("line"))
    lines = lines.select("id", "h2", "_name", F.when(size.between(SHINGLE, k - 1), round_).otherwise(F.col("line")).cast("binary").alias("bytes"), F.explode(levels).alias("level"))
    last = F.when(level < 0, 0).otherwise(F.greatest(F.octet_length("bytes") - k, F.lit(0)))
    # One row for each string, made and hashed in generated code.
    marks = lines.select("id", "h2", "_name", "level", "bytes", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    marks = marks.select("id", "h2", "_name", "level", "i", F.xxhash64(F.substring("bytes", i + 1, F.lit(k))).alias("x"))
    drawn = (level == 0) | (level == 1) & (F.shiftrightunsigned(x, 64 - BITS[1]) == 0) | (level == 2) & (F.shiftrightunsigned(x, 64 - BITS[2]) == 0)
    marks = marks.filter(drawn | (i == 0)).select("id", "h2", "level", "_name", (i == 0).cast("int").alias("one"), F.when(drawn, x).alias("x"))
    mixed = [F.xxhash64("x", F.lit(g)).alias(f"z{g}") for g in range(hashes)]
    marks = marks.select("*", *mixed)
    z = [F.col(f"z{g}") for g in range(hashes)]
    marks = marks.select("id", "h2", "level", "_name", "one", *[F.when(x.isNotNull(), F.shiftrightunsigned(z[g], 61)).cast("int").alias(f"b{g}") for g in range(hashes)], *[_int(z[g]).alias(f"v{g}") for g in range(hashes)])
    # Draw n is of hash n % hashes and bin n // hashes, so that the draws of a key are of different hashes. Only one bin a
    # hash takes a string; all buffers are of fixed width, so this is a hash aggregate.
    minima = [F.expr(f"min(v{n % hashes}) filter (where b{n % hashes} = {n // hashes})").alias(f"d{n}") for n in range(draws)]
    made = marks.groupBy("id", "h2", "level").agg(F.min("_name").alias("name"), F.sum("one").alias("n"), *minima)
    # An empty bin takes what the next bins in an order of its own have.
    rng, filled = random.Random(20), []
    for n in range(draws):
        others = [j for j in range(BINS) if j != n // hashes]
        rng.shuffle(others)
        filled.append(F.coalesce(f"d{n}", *[f"d{j * hashes + n % hashes}" for j in others]).alias(f"m{n}"))
    made = made.select("id", "h2", "level", "name", "n", *filled)
    top = F.shiftleft(level.cast("long"), 62)
    key = lambda b, each: F.shiftrightunsigned(F.xxhash64(F.lit(b), *[f"m{n}" for n in range(b * each, (b + 1) * each)]), 2).bitwiseOR(top)
    keys = F.when(F.col("m0").isNull(), F.array().cast("array<bigint>")).when(level == 0, F.array(*[key(b, SHORT_ROWS) for b in range(min(max(SHORT_BANDS, bands), draws // SHORT_ROWS))]))
    keys = keys.otherwise(F.array(*[key(b, rows) for b in range(bands)]))

    def word(bit: int) -> Column:
        out = F.lit(0).cast("long")
        for n in range(DRAWS):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"m{n}"), bit).bitwiseAND(F.lit(1)).cast("long"), n))
        return out.alias(f"w{bit}")

    return made.select("id", "h2", "level", "name", "n", keys.alias("keys"), *[word(bit) for bit in range(4)])


def _allowed(a: str, b: str) -> Column:
    """Whether the sketches of a and b, of one level, allow the similarity."""
    unlike = F.lit(0).cast("long")
    for n in range(4):
        unlike = unlike.bitwiseOR(F.col(f"w{n}{a}").bitwiseXOR(F.col(f"w{n}{b}")))
    return F.bit_count(unlike) <= F.when(F.col(f"level{a}") == 0, DRAWS - LEAST_EQUAL[0]).otherwise(DRAWS - LEAST_EQUAL[1])


_SKETCH = ["w0", "w1", "w2", "w3"]


def _side(columns: list[str], side: str) -> list[Column]:
    return [F.col(c).alias(f"{c}{side}") for c in columns]


def _likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sketches allow the similarity; no text is moved for the others."""
    one = pairs.join(known.select(*_side(["id", "level", *_SKETCH], "_a")), F.col("a") == F.col("id_a"))
    two = one.join(known.select(*_side(["id", "level", *_SKETCH], "_b")), (F.col("b") == F.col("id_b")) & (F.col("level_a") == F.col("level_b")) & _allowed("_a", "_b"))
    return two.select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the distinct pairs (a, b), those whose lines are near."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    # As generated rows, the sets are made once, though the similarity names them often.
    sets = two.select("a", "b", F.explode(F.array(F.struct(shingles(F.col("x"), SHINGLE).alias("x"), shingles(F.col("y"), SHINGLE).alias("y")))).alias("s"))
    sets = sets.select("a", "b", (F.size("s.x") + F.size("s.y")).alias("sum"), F.explode(F.array(F.size(F.array_intersect("s.x", "s.y")))).alias("both"))
    return sets.filter(F.col("both") >= threshold * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b")


def _texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and line of the wanted (id, h2, name): one document of each line is looked through."""
    hit = _lined(keyed.join(wanted.select(F.col("name").alias("_name")).distinct(), "_name"), "_name").select(F.col("_name").alias("name"), "id", "h2", "line")
    return hit.join(wanted, ["name", "id", "h2"]).select("id", "line").dropDuplicates(["id"])


def _mained(rows: DataFrame, size: int, few: bool) -> DataFrame:
    """rows (unit, level, id, part) of units with several parts: is_main of the largest part's, and the cuts into size members or, if few, members outside it."""
    sizes = rows.groupBy("unit", "level", "part").agg(F.count("*").alias("m")).groupBy("unit", "level")
    sizes = sizes.agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    many = F.col("all") - F.col("top.m") if few else F.col("all")
    cuts = sizes.select("unit", "level", F.col("top.part").alias("main"), F.ceil(many / size).alias("cuts"))
    return rows.join(cuts, ["unit", "level"]).withColumn("is_main", F.col("part") == F.col("main")).drop("main")


def _facing(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """rows dealt into their unit's cuts, all rows in each cut, and the condition of a join of members of different parts that sketches allow."""
    columns = ["unit", "level", "id", "part", "is_main", *columns]
    one = rows.select(*_side(columns, "_a"), F.pmod(F.xxhash64("id", "unit"), F.col("cuts")).alias("cut_a"))
    two = rows.select(*_side(columns, "_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut_b"))
    on = F.lit(True)
    for c in ("unit", "level", "cut"):
        on = on & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    return one, two, on & (F.col("part_a") != F.col("part_b")) & _allowed("_a", "_b")


def _rest(met: DataFrame, known: DataFrame, texts: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of different parts of each unit."""
    spark = met.sparkSession
    placed = near._placed(met, parts)
    keys = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max(F.struct("meets", "id")).alias("best")).filter("p < q")
    some = placed.join(keys.select("key", F.xxhash64("best.id").alias("unit")), "key").select("unit", "id", "part").distinct()
    rows = written(_mained(some.join(known.select("id", "level", *_SKETCH), "id"), LIGHT, False), "apart")
    one, two, on = _facing(rows, _SKETCH)
    left = written(one.join(two, on, "left_semi").select("unit_a", "level_a", "id_a", "part_a", *[f"{c}_a" for c in _SKETCH]).toDF("unit", "level", "id", "part", *_SKETCH), "left")
    free_shuffles(spark)
    drop_written(rows)
    sets = texts.join(left.select("id").distinct(), "id").select("id", F.transform(shingles(F.col("line"), SHINGLE), _int).alias("set"))
    rows = _mained(left, HEAVY, True).join(sets, "id")
    one, two, on = _facing(rows, [*_SKETCH, "set"])
    # Hashes of 32 bits decide but for one element; what they let pass is verified.
    total = F.size("set_a") + F.size("set_b")
    near_ = F.size(F.array_intersect("set_a", "set_b")) + 1 >= threshold / (1 + threshold) * total - 1e-6
    alike = F.least(F.size("set_a"), F.size("set_b")) + 1 >= threshold * F.greatest(F.size("set_a"), F.size("set_b"))
    pairs = one.filter("not is_main_a").join(two, on & (F.col("is_main_b") | (F.col("id_a") < F.col("id_b"))) & alike & near_)
    likely = written(pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), "likely")
    free_shuffles(spark)
    return _verified(likely, texts, threshold)


def repeats(keyed: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = SIGNED) -> DataFrame:
    """_name, gone array<int>: of each document that loses any, the places between line feeds that go."""
    spark = keyed.sparkSession
    lines = written(signatures(keyed, bands, rows, k), "signatures")
    free_shuffles(spark)
    members = lines.select("id", F.explode("keys").alias("key")).repartition("key")
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(members.join(sizes, "key").distinct(), "members")
    free_shuffles(spark)
    met = written(met.join(met.groupBy("id").agg(F.sum("size").alias("meets")), "id"), "met")
    known = written(lines.join(met.select("id").distinct(), "id", "left_semi").drop("keys", "n"), "known")
    many = written(lines.filter("n > 1").select("id", "h2").distinct(), "many")
    drop_written(lines)
    free_shuffles(spark)
    texts = written(_texts(keyed, known.select("name", "id", "h2").distinct()), "texts")
    free_shuffles(spark)
    parts = written(texts.select(F.col("id").alias("node"), F.col("id").alias("component")), "parts")
    for turn in range(near.TURNS + 1):
        some = met.filter(F.pmod("key", F.lit(near.FIRST)) == 0) if turn == 0 else met.filter("size > 2") if turn == near.TURNS else met
        likely = written(_likely(near._led(some, parts, turn), known).hint("rebalance"), "likely")
        free_shuffles(spark)
        last, parts = parts, united(parts, _verified(likely, texts, threshold))
        drop_written(likely)
        drop_written(last)
        free_shuffles(spark)
    last, parts = parts, united(parts, _rest(met, known, texts, parts, threshold))
    drop_written(last)
    drop_written(met)
    drop_written(texts)
    free_shuffles(spark)
    # Only lines that occur again, or that are linked, can go; the others aren't looked at any more.
    linked = parts.join(parts.filter("node != component").select("component").distinct(), "component", "left_semi").select(F.col("node").alias("id"), "component")
    again = known.select("id", "h2").distinct().join(linked.select("id"), "id", "left_semi").unionByName(many).distinct()
    again = written(again.join(linked, "id", "left").select("id", "h2", F.coalesce("component", "id").alias("part")), "again")
    drop_written(parts)
    at = F.struct("_doc", "place", "_name")
    occurs = _lined(keyed, "_doc", "_name").select("_doc", "place", "_name", "id", "h2")
    every = written(occurs.join(again, ["id", "h2"]).select("part", "_doc", "place", "_name"), "occurrences")
    free_shuffles(spark)
    stays = every.groupBy("part").agg(F.min(at).alias("at")).select("at._name", "at.place", F.lit(True).alias("stays"))
    # By document, not by part: the occurrences of a common line never meet in one task.
    places = every.select("_name", "place", F.lit(False).alias("stays")).unionByName(stays).groupBy("_name")
    gone = places.agg(F.sort_array(F.array_except(F.collect_set("place"), F.collect_set(F.when(F.col("stays"), F.col("place"))))).alias("gone"))
    out = written(gone.filter(F.size("gone") > 0), "gone")
    drop_written(every)
    free_shuffles(spark)
    return out


def dedup(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_kept"), **options: object) -> DataFrame:
    """docs with the numbers of its non-blank lines and of those kept, text without the others. Other columns stay."""
    docs = docs.drop(*counts).withColumn("text", F.col("text").cast("string"))
    gone = repeats(_keyed(docs), **options).withColumnRenamed("_name", "_of")
    name = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), F.col("text"))
    out = docs.select(F.struct(*docs.columns).alias("_row"), name.alias("_name")).join(gone, F.col("_name") == F.col("_of"), "left")
    out = out.withColumn("_pieces", F.split("_row.text", "\n", -1))
    # gone is sorted, so what stays between its places is sliced.
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("_pieces")))
    spans = F.filter(F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct((a + 2).alias("s"), (b - a - 1).alias("n"))), lambda s: s["n"] > 0)
    rest = F.array_join(F.transform(spans, lambda s: F.array_join(F.slice("_pieces", s["s"], s["n"]), "\n")), "\n")
    n = F.coalesce(F.size(F.filter("_pieces", lambda x: F.trim(x) != "")), F.lit(0))
    columns = [F.when(F.col("gone").isNotNull(), rest).otherwise(F.col("_row.text")).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*columns, n.cast("long").alias(counts[0]), (n - F.coalesce(F.size("gone"), F.lit(0))).cast("long").alias(counts[1]))


def report(docs: DataFrame) -> DataFrame:
    """Per document: its non-blank lines, those that stay, and the hash of the text that is left."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def without_repeats(docs: DataFrame, **options: object) -> DataFrame:
    """docs without their repeated lines; documents that had lines and keep none go. All columns stay."""
    out = dedup(docs, ("_quern_lines", "_quern_kept"), **options)
    return out.filter((F.col("_quern_lines") == 0) | (F.col("_quern_kept") > 0)).select(*docs.columns)
