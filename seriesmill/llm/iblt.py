"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line, or a part of up to `PART_WORDS` words of a longer one; a document is the set
of its paragraphs' 64-bit digests. A digest is put into three cells, one in each third of the sketch;
a cell holds how many digests it got, and the exclusive or of the digests and of their checks.
Subtracting the sketches of two versions cell by cell leaves the digests that differ. Peeling takes a
cell with one digest left (its check fits), removes that digest from its three cells, and so on; if
all cells end empty, the differing digests are recovered. If not, larger sketches are tried: the
digests are dealt to blocks of about `BLOCK_DIGESTS` with `BLOCK_CELLS` cells each, a block that fails
gets four times the cells with other hashes, twice, and what fails then is compared directly.

Likeness is 1 - differing / (paragraphs of one + paragraphs of the other), 1 for two empty ones.

All of it is DataFrame functions over arrays in a row, linear in the text but for dealing to
blocks (power 1.5). Scale: the documents are shuffled once, by ranges of ids from quantiles, so that
each finds the next one beside it; the first document of each range is carried to the range before
it by a small table (a row per range, at most `MOST_RANGES`).

Defined results: a null text is empty; rows are documents of their own, ordered by id (null last),
then by text hash, so the document after a repeated id is the next row; a single document is its own
next; blank texts have no paragraphs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import named, written

PART_WORDS = 16
CELLS = 24
BLOCK_DIGESTS = 16
BLOCK_CELLS = 48
ROUNDS = 12
RANGE_ROWS = 1_000
MOST_RANGES = 1 << 16

#: Words are runs of non-blanks; a part does not go beyond its line.
PART = f"(?:[^\\x20\\x09-\\x0D]++[\\x20\\x09\\x0B-\\x0D]*+){{1,{PART_WORDS}}}+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def digests_of(text: Column) -> Column:
    """The set of paragraph digests."""
    parts = F.regexp_extract_all(text, F.lit(PART), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(F.rtrim(x))))


def check_of(digest: Column) -> Column:
    return F.xxhash64(F.lit(97), digest)


def item(digest: Column, sign: Column, third: int, seed: int) -> Column:
    """A digest with its sign, check and place in each third of the sketch (a power of two)."""
    bits = third.bit_length() - 1
    code = F.xxhash64(F.lit(seed), digest) if seed else digest
    place = lambda k: F.shiftrightunsigned(code, k * bits).bitwiseAND(third - 1).cast("int")
    return F.struct(
        sign.cast("int").alias("n"), digest.alias("key"), check_of(digest).alias("check"),
        *[place(k).alias(f"p{k}") for k in range(3)],
    )


def cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.cast("long").alias("key"), check.cast("long").alias("check"))


def combined(x: Column, y: Column, sign: int) -> Column:
    n = x["n"] + y["n"] if sign > 0 else x["n"] - y["n"]
    return cell(n, x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"]))


def put(cells: Column, items: Column, third: int, sign: int) -> Column:
    """The cells with the items added or taken out."""

    def part(k: int) -> Column:
        def filled(old: Column, at: Column) -> Column:
            return F.aggregate(items, old, lambda acc, x: F.when(x[f"p{k}"] == at, combined(acc, x, sign)).otherwise(acc))

        return F.transform(F.slice(cells, k * third + 1, third), filled)

    return F.concat(part(0), part(1), part(2))


def sketch(digests: Column, cells: int = CELLS, seed: int = 0) -> Column:
    """The cells of a set of digests."""
    third = cells // 3
    empty = F.array_repeat(cell(F.lit(0), F.lit(0), F.lit(0)), cells)
    items = F.transform(digests, lambda d: item(d, F.lit(1), third, seed))
    return let(items, lambda x: put(empty, x, third, 1))


def subtract(cells: Column, other: Column) -> Column:
    return F.zip_with(cells, other, lambda x, y: combined(x, y, -1))


def peeled(difference: Column, cells: int = CELLS, seed: int = 0) -> Column:
    """The digests that a difference of sketches holds, with n = 1 or -1 for the side; null on failure."""
    third = cells // 3
    none = F.array().cast("array<struct<n:int,key:bigint>>")
    state = lambda rest, found, on: F.struct(rest.alias("rest"), found.alias("found"), on.alias("on"))

    def turn(acc: Column, _: Column) -> Column:
        alone = F.filter(acc["rest"], lambda x: (F.abs(x["n"]) == 1) & (check_of(x["key"]) == x["check"]))
        single = F.array_distinct(F.transform(alone, lambda x: item(x["key"], x["n"], third, seed)))
        taken = lambda s: F.transform(s, lambda x: F.struct(x["n"].alias("n"), x["key"].alias("key")))
        went = let(single, lambda s: state(put(acc["rest"], s, third, -1), F.concat(acc["found"], taken(s)), F.size(s) > 0))
        return F.when(acc["on"], went).otherwise(acc)

    ends_empty = lambda acc: F.forall(acc["rest"], lambda x: (x["n"] == 0) & (x["key"] == 0) & (x["check"] == 0))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), state(difference, none, F.lit(True)), turn, lambda acc: F.when(ends_empty(acc), acc["found"])
    )


def recovered(a: Column, b: Column, cells: int, seed: int) -> Column:
    """How many digests differ, by sketches of this size; null if peeling fails."""
    return F.array_size(peeled(subtract(sketch(a, cells, seed), sketch(b, cells, seed)), cells, seed))


def compared_directly(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def by_blocks(a: Column, b: Column) -> Column:
    """How many digests differ, by a sketch for each block of digests."""
    blocks = F.greatest(F.ceil((F.size(a) + F.size(b)) / BLOCK_DIGESTS), F.lit(1)).cast("int")

    def dealt(pair: Column, n: Column, seed: int) -> Column:
        part = lambda values, i: F.filter(values, lambda d: F.pmod(F.xxhash64(F.lit(seed), d), n) == i)
        return F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.struct(part(pair["a"], i).alias("a"), part(pair["b"], i).alias("b"))
        )

    def size_of(block: Column) -> Column:
        x, y = block["a"], block["b"]
        tries = [recovered(x, y, BLOCK_CELLS * 4**k, 211 + k) for k in range(3)]
        return F.coalesce(*tries, compared_directly(x, y))

    def total(n: Column) -> Column:
        whole = F.struct(a.alias("a"), b.alias("b"))
        coarse = F.ceil(F.sqrt(n)).cast("int")
        dealt_twice = let(
            coarse, lambda m: F.flatten(F.transform(dealt(whole, m, 101), lambda x: dealt(x, F.ceil(n / m).cast("int"), 103)))
        )
        return F.aggregate(F.transform(dealt_twice, size_of), F.lit(0), lambda acc, x: acc + x)

    return let(blocks, total)


def differing(a: Column, b: Column, cells_a: Column, cells_b: Column, cells: int = CELLS) -> Column:
    """How many digests differ: by the fingerprints' own cells, or by larger sketches.

    The fingerprints' cells cannot hold more differing digests than cells; so sets whose sizes
    differ by more are not tried.
    """
    small = F.array_size(peeled(subtract(cells_a, cells_b), cells))
    return F.coalesce(F.when(F.abs(F.size(a) - F.size(b)) <= cells, small), by_blocks(a, b))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(1 - differing(a, b, cells_a, cells_b) / total)


def as_text(digests: Column, cells: Column) -> Column:
    """The fingerprint: number of paragraphs, and of each cell the count, digests and check in hexadecimal."""
    shown = F.transform(
        cells,
        lambda x: F.concat(
            F.lower(F.hex(x["n"])), F.lit("."), F.lower(F.hex(x["key"])), F.lit("."), F.right(F.lower(F.hex(x["check"])), F.lit(8))
        ),
    )
    return F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(shown, "-"))


def range_of(value: Column, cuts: list) -> Column:
    """The number of cuts at or below a value, found in two steps; beyond all of them for null."""
    step = max(1, int(len(cuts) ** 0.5))
    if not cuts:
        return F.when(value.isNull(), 1).otherwise(0)
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(p[0]) for p in parts])
    table = F.array(*[F.array(*map(F.lit, p)) for p in parts])
    below = lambda values: F.size(F.filter(values, lambda x: x <= value))
    found = let(below(heads), lambda n: F.when(n == 0, 0).otherwise((n - 1) * step + below(F.get(table, n - 1))))
    return F.when(value.isNull(), len(cuts) + 1).otherwise(found)


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (doc_id, text, digests) with the next row's text and digests, by id and text hash."""
    n = min(-(-docs.count() // range_rows), MOST_RANGES)
    shares = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * max(n, 1000)).alias("cuts")).first()["cuts"] if shares else []
    cuts = sorted(set(cuts or []))
    rows = docs.withColumn("range", range_of(F.col("doc_id"), cuts)).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("tie").alias("tie"))
    heads = written(rows.groupBy("range").agg(F.min(order).alias("head")), "iblt-heads")
    # at most two rows more than cuts, so at most MOST_RANGES + 1: bounded, and broadcast for that
    first = F.broadcast(heads.select(F.col("range").alias("head_range"), "head"))
    same = (F.col("range") == F.col("head_range")) & (F.col("tie") == F.col("head.tie")) & F.col("doc_id").eqNullSafe(F.col("head.id"))
    firsts = rows.join(first, same).groupBy("range").agg(F.first("text").alias("after_text"))
    # which range follows which is found among numbers; a range's first text goes to the one before
    turn = Window.orderBy("range")
    everything = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("range").over(turn), F.first("range").over(everything))
    following = heads.select(F.col("range").alias("after_range"), following.alias("range"))
    after = written(following.join(firsts, "range").select("after_range", "after_text"), "iblt-after")
    after = after.withColumn("after_digests", digests_of(F.col("after_text")))
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    beside = rows.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_digests", F.lead("digests").over(inside))
    joined = beside.join(after, F.col("range") == F.col("after_range"))
    return joined.select(
        "doc_id", "text", "digests",
        F.coalesce("next_text", "after_text").alias("next_text"),
        F.coalesce("next_digests", "after_digests").alias("next_digests"),
    )


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the characters (rounded down) replaced by the first as
    many of the next document, or all it has.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("digests", digests_of(F.col("text"))), **options)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "digests", "next_digests")
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.struct(
            F.col("digests"), F.col("next_digests"), digests_of(F.col("edited")).alias("edited_digests"),
            sketch(F.col("digests")).alias("cells"), sketch(F.col("next_digests")).alias("next_cells"),
        ).alias("d"),
    )
    # one evaluation of each array, however often it is used below
    d = F.col("d")
    found = let(
        d,
        lambda d: let(
            sketch(d["edited_digests"]),
            lambda cells: F.struct(
                as_text(d["digests"], d["cells"]).alias("fingerprint"),
                as_text(d["edited_digests"], cells).alias("edited_fingerprint"),
                likeness(d["digests"], d["edited_digests"], d["cells"], cells).alias("near_edited"),
                likeness(d["digests"], d["next_digests"], d["cells"], d["next_cells"]).alias("near_next"),
            ),
        ),
    )
    return rows.select("doc_id", "n_chars", "edited_sha256", found.alias("found")).select(
        "doc_id", "n_chars", "edited_sha256", "found.*"
    )
