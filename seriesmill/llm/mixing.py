"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a share of all words by weight, at most `max_epochs` times its own words.
A source's words are cut into equal blocks of about `block_words` words. Blocks go one after the
other to the source with the highest quotient votes / (2 * blocks + 1), where votes are its target
in its own blocks, so what a source gets is its target but for rounding to one of its blocks. Its
documents lie in seeded order (by shard, to which they are dealt by hash, then by key); its quota
takes all blocks as often as it goes, and the rest as a run of blocks that starts at a seeded block
and goes on from the first after the last. So nearly all documents are taken whole, and what a source gets
does not depend on the number of shards: each takes the part of the run that lies in it.

Scale: only (id, source, size) rows are shuffled, once, by (shard, source); a shard has about
`shard_rows` rows, so a source with a third of all rows is many groups. Per-source figures are
one row per source and shard. Sources may be as many as domains: their ranks, levels and quotients
are running sums over sorted ranges, and two figures of all sources come to the driver.

Defined results: a null source is a source of its own (the last by name); null and empty texts
have size 0 and are never taken; rows with the same id are separate documents, ordered by id,
size and position in the input; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import WORD, free_names, hex_number, named, with_sums_before, word_count, written

WEIGHTS = (1.0, 2.0, 3.0)
BLOCK_WORDS = 16
SHARD_ROWS = 4_000
MAX_EPOCHS = 3
SEED = "mix"


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds weight and target to rows (source, source_size), one per source.

    The share of a source is level * weight, where the level is the same for all sources that
    stay below their limit. In order of limit / weight, a source is at its limit as long as the
    level of the sources from here on would not be below limit / weight.
    """
    kinds = F.array(*map(F.lit, map(float, weights)))
    whole = sources.withColumns({"all": F.lit(0), "one": F.lit(1).cast("long")})
    ranked = with_sums_before(whole, ["all"], [F.col("source").asc_nulls_last()], {"rank_before": "one"}, "mix-ranks")
    ranked = ranked.withColumn("source_rank", (F.col("rank_before") + 1).cast("int"))
    ranked = ranked.withColumn("weight", kinds[F.pmod(F.col("source_rank") - 1, F.lit(len(weights)))])
    limit = (F.col("source_size") * max_epochs).cast("double")
    ranked = ranked.withColumn("cap", limit).withColumn("full_at", F.col("cap") / F.col("weight"))
    sums = {"caps_before": "cap", "weights_before": "weight"}
    levels = with_sums_before(ranked, ["all"], [F.col("full_at"), F.col("source_rank")], sums, "mix-levels")
    words, weight = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(words or 0) - F.col("caps_before")) / (F.lit(weight or 0.0) - F.col("weights_before"))
    levels = levels.withColumn("level", level)
    below = F.col("full_at") > F.col("level")
    # of the sources that stay below their limit, the first in order has the level of all
    first = levels.where(below).agg(F.min_by("level", F.struct("full_at", "source_rank"))).first()[0]
    target = F.when(below, F.lit(first) * F.col("weight")).otherwise(F.col("cap"))
    return levels.withColumn("target", target).select("source", "source_rank", "source_size", "weight", "target")


def apportion(votes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (shard, source_rank, votes) with quota: blocks by highest quotients, per shard.

    The divisor that Sainte-Lague ends at lies between votes / (blocks + n / 2) and
    votes / (blocks - n / 2) for n sources. So each source's quota is known but for a short
    range, and only the quotients of these ranges are ranked: about three per source.
    """
    all_votes, half = F.sum("votes").alias("all_votes"), (F.count(F.lit(1)) / 2).alias("half")
    totals = votes.join(votes.groupBy("shard").agg(all_votes, half), "shard")
    totals = totals.withColumn("blocks", F.round(F.col("all_votes") / block_words).cast("long"))
    share = F.when(F.col("all_votes") > 0, F.col("votes") / F.col("all_votes")).otherwise(0.0)
    low = F.greatest(F.ceil(share * (F.col("blocks") - F.col("half")) - 0.5) - 1, F.lit(0)).cast("long")
    high = F.floor(share * (F.col("blocks") + F.col("half")) + 0.5).cast("long") + 1
    ranges = totals.withColumn("low", low).withColumn("high", F.greatest(high, F.col("low")))
    ranges = written(ranges, "mix-ranges")
    vacant = ranges.groupBy("shard").agg((F.max("blocks") - F.sum("low")).alias("open"))
    seats = ranges.where("votes > 0").withColumn("seat", F.explode(F.expr("sequence(low, high)")))
    seats = seats.withColumn("quotient", F.col("votes") / (2 * F.col("seat") + 1)).withColumn("one", F.lit(1).cast("long"))
    order = [F.desc("quotient"), F.col("source_rank"), F.col("seat")]
    placed = with_sums_before(seats, ["shard"], order, {"place": "one"}, "mix-seats")
    won = placed.join(vacant, "shard").where("place < open")
    gained = won.groupBy("shard", "source_rank").agg(F.count(F.lit(1)).alias("gained"))
    return ranges.join(gained, ["shard", "source_rank"], "left").select(
        "shard", "source_rank", (F.col("low") + F.coalesce("gained", F.lit(0))).alias("quota")
    )


def overlap(start: Column, size: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(start + size, high) - F.greatest(start, low), F.lit(0))


def mix_sizes(
    sizes: DataFrame,
    weights=WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """A written table (row_id, doc_id, source, size) with the words the mix takes.

    Adds source_size, target, taken, epochs (times the whole document is taken), and the
    parts taken once more: words [a_from, a_to) and [b_from, b_to) of the document.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    shards = F.floor((F.count(F.lit(1)) + shard_rows - 1) / shard_rows)
    n_shards = sizes.agg(F.greatest(shards, F.lit(1))).first()[0]
    rows = sizes.withColumn("order_key", key)
    rows = rows.withColumn("shard", F.pmod(hex_number(F.col("order_key")), F.lit(n_shards)))
    groups = written(
        rows.groupBy("shard", "source").agg(F.sum("size").alias("words")), "mix-groups"
    )
    targets = source_targets(
        groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs
    )
    blocks = F.greatest(F.round(F.col("source_size") / block_words).cast("long"), F.lit(1))
    targets = targets.withColumn("blocks", blocks)
    own = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    # written, so that the join on the one shard of all sources stays a join on a key
    votes = written(targets.select(F.lit(0).alias("shard"), "source_rank", own.alias("votes")), "mix-votes")
    quotas = targets.join(apportion(votes, 1), "source_rank")
    quotas = quotas.withColumn("quota", F.least("quota", F.col("blocks") * max_epochs))
    name = F.concat_ws(":", F.lit(seed), F.lit("0"), F.col("source_rank").cast("string"))
    quotas = quotas.withColumn("first", F.pmod(hex_number(F.md5(name)), F.col("blocks")))
    quotas = quotas.withColumn("epochs", F.expr("quota div blocks")).withColumn("end", F.expr("first + quota % blocks"))
    # source_size * block div blocks, without the large product
    edge = lambda block: F.expr(f"source_size div blocks * ({block}) + source_size % blocks * ({block}) div blocks")
    quotas = quotas.select(
        "source", "source_size", "target", "epochs",
        edge("first").alias("low"), edge("least(end, blocks)").alias("high"),
        edge("greatest(end - blocks, 0)").alias("wrapped"),
    )
    up_to = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.select("shard", "source", (F.sum("words").over(up_to) - F.col("words")).alias("offset"))
    same = F.col("g.source").eqNullSafe(F.col("t.source"))
    quotas = placed.alias("g").join(quotas.alias("t"), same).select("shard", "g.source", "offset", *quotas.columns[1:])
    quotas = written(quotas, "mix-quotas")
    inside = Window.partitionBy("shard", "source").orderBy("order_key", "size", "row_id")
    end = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("start", end - F.col("size"))
    same = (F.col("r.shard") == F.col("q.shard")) & F.col("r.source").eqNullSafe(F.col("q.source"))
    joined = placed.alias("r").join(quotas.alias("q"), same).drop(F.col("q.shard"), F.col("q.source"))
    start, size = F.col("offset") + F.col("start"), F.col("size")
    a = overlap(start, size, F.col("low"), F.col("high"))
    b = overlap(start, size, F.lit(0), F.col("wrapped"))
    a_from = F.greatest(F.col("low") - start, F.lit(0))
    return joined.select(
        "row_id", "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * size + a + b).alias("taken"), "epochs",
        a_from.alias("a_from"), (a_from + a).alias("a_to"), F.lit(0).cast("long").alias("b_from"), b.alias("b_to"),
    )


def document_sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Rows (row_id, doc_id, source, size) of all documents."""
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), named(id_col).alias("doc_id"),
        named(source_col).alias("source"), word_count(named(text_col)).alias("size"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and the parts taken."""
    return mix_sizes(written(document_sizes(docs), "mix-sizes"), **options)


def cut_words(text: Column, start: Column, end: Column) -> Column:
    """Words [start, end) with the white space between them."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    return F.rtrim(F.array_join(F.slice(words, (start + 1).cast("int"), (end - start).cast("int")), ""))


def mixed_documents(docs: DataFrame, text_col="text", length_col="n_chars", **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time a document is taken.

    A document taken in part comes with that part as its text (and its length, where the table
    has that column). Rows are written once with their sizes, so that ids agree between the
    table of decisions and the rows they are joined to.
    """
    row_id, size, row, parts, part, new_text = free_names(
        docs, "row_id", "mix_size", "mix_row", "mix_parts", "mix_part", "mix_text"
    )
    kept = written(
        docs.withColumns({row_id: F.monotonically_increasing_id(), size: word_count(named(text_col))}), "mix-docs"
    )
    sizes = kept.select(
        F.col(row_id).alias("row_id"), F.col("doc_id"), F.col("source"), F.col(size).alias("size")
    )
    taken = mix_sizes(sizes, **options).where("taken > 0")
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("low"), F.col("size").alias("high")), F.col("epochs").cast("int"))
    once = F.filter(
        F.array(
            F.struct(F.col("a_from").alias("low"), F.col("a_to").alias("high")),
            F.struct(F.col("b_from").alias("low"), F.col("b_to").alias("high")),
        ),
        lambda x: x["high"] > x["low"],
    )
    taken = written(taken.select(F.col("row_id").alias(row), F.concat(whole, once).alias(parts)), "mix-taken")
    # the list grows with the documents: never broadcast it
    joined = kept.join(taken.hint("merge"), kept[row_id] == taken[row])
    joined = joined.withColumn(part, F.explode(parts))
    low, high = F.col(part)["low"], F.col(part)["high"]
    is_whole = (low == 0) & (high == F.col(size))
    text = F.when(is_whole, named(text_col)).otherwise(cut_words(named(text_col), low, high))
    joined = joined.withColumn(new_text, text)
    out = []
    for field in docs.schema:
        column = named(field.name)
        if field.name == text_col:
            column = F.col(new_text)
        elif field.name == length_col:
            column = F.when(is_whole, column).otherwise(F.length(new_text)).cast(field.dataType)
        out.append(column.alias(field.name))
    return joined.select(*out)
