"""Ledger candidates of a submission: by id, by vendor and date, by similarity.

Every join here looks a key up in a side with one row per key.  A key shared
by many submissions is then only a large left partition, which is split while
it runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.functions.arrays import let
from tallyweave.functions.records import set_similarity, text_of, token_hashes
from tallyweave.functions.text import norm_text, strip
from tallyweave.operators.lookup import lookup
from tallyweave.session import passing, stored


#: Which of several ledger rows of one id counts as the first.
FIRST_ROW_ORDER = [
    "invoice_date",
    "amount",
    "vendor",
    "currency",
    "quantity",
    "fx_rate",
    "invoice_id",
]
#: Which ledger rows of a vendor make up its pool.
POOL_ORDER = ["invoice_id", "invoice_date", "amount", "currency", "quantity", "fx_rate"]
#: Most ledger rows of a page and submissions of a block, about, and rows of both sides that are searched in a round.
TILE, ROUND = 2048, 32_000_000


def first_per_key(ledger: DataFrame, **keys: Column) -> DataFrame:
    """One ledger record per key, the first in ``FIRST_ROW_ORDER``."""
    return (
        ledger.select(
            *[c.alias(name) for name, c in keys.items()], F.struct(*FIRST_ROW_ORDER).alias("_row")
        )
        .groupBy(*keys)
        .agg(F.min("_row").alias("_row"))
        .select(
            *keys,
            F.struct(*[F.col(f"_row.{n}").alias(n) for n in S.RECORD_FIELDS]).alias("record"),
        )
    )


def by_exact_id(submissions: DataFrame, ledger: DataFrame, out: str = "identity") -> DataFrame:
    """Add the ledger record with the same normalised id, NULL if there is none."""
    index = first_per_key(ledger, _norm_id=norm_text(F.col("invoice_id"))).filter("_norm_id <> ''")
    keyed = submissions.withColumn("_norm_id", norm_text(F.col("invoice_id")))
    return lookup(keyed, index.withColumnRenamed("record", out), ["_norm_id"]).drop("_norm_id")


def by_vendor_and_date(
    submissions: DataFrame, ledger: DataFrame, out: str = "weak_identity"
) -> DataFrame:
    """Add the first ledger record of the same vendor and date."""
    index = first_per_key(
        ledger,
        _vendor=F.lower(strip(F.col("vendor"))),
        _date=F.col("invoice_date"),
    )
    keyed = submissions.withColumns(
        {"_vendor": F.lower(strip(F.col("vendor"))), "_date": F.col("invoice_date")}
    )
    return lookup(keyed, index.withColumnRenamed("record", out), ["_vendor", "_date"]).drop(
        "_vendor", "_date"
    )


def by_identity(submissions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger record of the same identity: the id first, else vendor and date.

    Two equi-joins; an OR of both conditions would compare all pairs.
    """
    both = by_vendor_and_date(by_exact_id(submissions, ledger), ledger)
    return both.withColumn("identity", F.coalesce("identity", "weak_identity")).drop(
        "weak_identity"
    )


def identity_counts(submissions: DataFrame, ledger: DataFrame) -> DataFrame:
    """How many of all ledger rows share a submission's identity, whatever their vendor.

    Adds ``same_id`` (equal id, not empty), ``same_vendor_date`` (equal vendor, case and
    margin ignored, and date), and ``same_identity``, rows that are either: both
    counts less the rows that are both.  Three counted keys are looked up; no
    pairs are made, so a key that many rows share costs what its rows cost.
    """
    keyed = lambda df: df.withColumns(
        {
            "_id": F.when(F.col("invoice_id") != "", F.col("invoice_id")),
            "_vendor": F.lower(strip(F.col("vendor"))),
            "_date": F.col("invoice_date"),
        }
    )
    rows, out = keyed(ledger), keyed(submissions)
    ways = {"same_id": ["_id"], "same_vendor_date": ["_vendor", "_date"], "_both": ["_id", "_vendor", "_date"]}
    for name, keys in ways.items():
        counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(name))
        out = lookup(out, counts, keys).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    out = out.withColumn("same_identity", F.col("same_id") + F.col("same_vendor_date") - F.col("_both"))
    return out.drop("_id", "_vendor", "_date", "_both")


def first_of_vendor(ledger: DataFrame, first: int) -> DataFrame:
    """The first ``first`` ledger rows of each vendor as one array, with their positions.

    Ranking keeps ``first`` rows per vendor on the map side already, so a vendor
    that owns much of the ledger still ships few rows.
    """
    order = Window.partitionBy("vendor").orderBy(*POOL_ORDER)
    ranked = (
        ledger.select(*S.RECORD_FIELDS)
        .withColumn("pool_pos", F.row_number().over(order))
        .filter(F.col("pool_pos") <= first)
    )
    entry = F.struct("pool_pos", "invoice_id")
    return ranked.groupBy("vendor").agg(F.array_sort(F.collect_list(entry)).alias("pool"))


def vendor_candidates(
    submissions: DataFrame, ledger: DataFrame, first: int = S.POOL_REPORT
) -> DataFrame:
    """A report: one row per submission and each of the first ledger rows of its vendor.

    Nothing searches this list; :func:`search` looks at all of the vendor's rows.
    """
    return (
        lookup(submissions, first_of_vendor(ledger, first), ["vendor"], "inner")
        .withColumn("entry", F.explode("pool"))
        .select(
            "submission_id",
            "vendor",
            F.col("entry.pool_pos").alias("pool_pos"),
            F.col("entry.invoice_id").alias("candidate_invoice_id"),
        )
    )


def pool_pages(
    ledger: DataFrame, extra: list[str] | None = None, page_rows: int = 256, block: str = "vendor"
) -> tuple[DataFrame, DataFrame]:
    """All ledger rows of every ``block``, in pages of about ``page_rows``, and the pages of each block.

    Returns (block, page, pool) and (block, pages).  Equal rows are folded
    into one entry with their number, so a page stays small whatever repeats,
    and a vendor that owns much of the ledger has many pages, not a large one.
    """
    extra = extra or []
    keys = [*dict.fromkeys([block, *S.RECORD_FIELDS])]
    pages = ledger.groupBy(block).agg(F.ceil(F.count("*") / page_rows).alias("pages"))
    folded = ledger.groupBy(*keys, *extra).agg(F.count("*").alias("copies"))
    placed = lookup(folded, pages, [block], "inner").withColumn(
        "page", F.pmod(F.xxhash64(*S.RECORD_FIELDS, *extra), F.col("pages"))
    )
    entry = F.struct(*POOL_ORDER, "vendor", "copies", *extra)
    return placed.groupBy(block, "page").agg(F.collect_list(entry).alias("pool")), pages


def on_pages(
    rows: DataFrame, ledger: DataFrame, extra: list[str] | None = None, page_rows: int = 256, block: str = "vendor"
) -> DataFrame:
    """Each row once with every page of its block's ledger rows, as ``pool``, and how many ``pages`` it has.

    Pages are looked up by (block, page): many rows of one vendor are shared
    out among tasks, and no task holds more than one page at a time.
    """
    pool, pages = pool_pages(ledger, extra, page_rows, block)
    numbered = lookup(rows, pages, [block], "inner").withColumn(
        "page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pages") - 1))
    )
    return lookup(numbered, pool, [block, "page"], "inner").drop("page")


def search(
    submissions: DataFrame,
    ledger: DataFrame,
    top_k: int = S.RUNTIME_TOP_K,
    features: Callable[[str], Column] | None = None,
    similarity: Callable[[Column, Column], Column] = set_similarity,
    page_rows: int = TILE,
    block_rows: int = TILE,
    round_rows: int = ROUND,
) -> DataFrame:
    """Add ``candidates``: the ``top_k`` most similar of all ledger rows of the vendor.

    ``features`` builds the compared column from a column prefix; the default
    is the token set of the record's text.  Candidates are ranked by the raw
    similarity, equal ones by ``POOL_ORDER``; the score shown has four decimals.

    Submissions alike in vendor and features are searched for once.  A vendor's ledger rows
    are cut into pages and its submissions into blocks, one of each for most vendors; a page
    and a block meet in one tile, which hands on ``top_k`` entries of each submission.  So rows are
    shuffled once for every page or block of the other side, and no task holds more than
    a tile; the scores worked out are submissions times ledger rows, within a vendor.

    The submissions, the ledger's rows and the answers are stored: each step shuffles for itself only, the
    tiles in rounds of some vendors of about ``round_rows`` rows.  Token sets are made where rows have met.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    described = submissions.withColumn("_asked", features("") if features else text_of(""))
    # A name of 128 bits stands for vendor and features; without any none is found.
    known = F.col("vendor").isNotNull() & F.col("_asked").isNotNull()
    named = {
        "_name": F.when(known, F.xxhash64("vendor", "_asked")),
        "_name2": F.xxhash64(F.lit(1), "vendor", "_asked"),
    }
    asking = described.withColumns(named)
    if not features:
        # Read twice; given features are left to be worked out again, as they may be much larger than the rows.
        asking = stored(asking.drop("_asked"), "asking").withColumn("_asked", text_of(""))
    extra = ["features"] if features else []
    compared = ledger.withColumn("features", features("")) if features else ledger
    rows = compared.where("vendor IS NOT NULL").groupBy("vendor", *[n for n in S.RECORD_FIELDS if n != "vendor"], *extra)
    with passing(submissions.sparkSession):
        asked = stored(asking.where(known).select("vendor", "_asked", *named).distinct(), "asked")
        book = stored(rows.agg(F.count("*").alias("copies")), "book")
        pages, blocks = _parts(book, "pages", page_rows), _parts(asked, "blocks", block_rows)
        several = bool(pages.take(1))
        rounds = max(1, -(-(asked.count() + book.count()) // round_rows))
        ranked = []
        for k in range(rounds):
            here = F.pmod(F.xxhash64("vendor"), F.lit(rounds)) == k
            met = _tiles(asked.where(here), book.where(here), pages, blocks, bool(extra))
            best = _ranked(met, top_k, similarity, "vendor", [*named], several)
            ranked.append(stored(best.select(*named, "candidates"), "ranked", outlast=True))
    return asking.drop("_asked").join(reduce(DataFrame.unionByName, ranked), [*named], "left").drop(*named)


def _parts(rows: DataFrame, name: str, most: int) -> DataFrame:
    """(vendor, ``name``) of the vendors with more than ``most`` rows: in how many parts they are cut."""
    counts = rows.groupBy("vendor").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return stored(counts.select("vendor", F.ceil(F.col("n") / most).alias(name)), name)


def _tiles(asked: DataFrame, book: DataFrame, pages: DataFrame, blocks: DataFrame, given: bool) -> DataFrame:
    """Each asked row once with every page of its vendor's ledger rows, as ``pool``; ``pages`` is how many there are.

    ``given`` tells that the features are in the rows; else they are made of texts and fields after the shuffle.
    """

    def cut(rows: DataFrame, own: str, other: str, part: Column) -> DataFrame:
        for parts, name in ((pages, "pages"), (blocks, "blocks")):
            rows = lookup(rows, parts, ["vendor"]).withColumn(name, F.coalesce(name, F.lit(1).cast("bigint")))
        across = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1))
        placed = rows.withColumn(own, F.pmod(part, F.col(f"{own}s"))).withColumn(other, across)
        return placed.repartition(*tile)

    tile = ["vendor", "page", "block"]
    keys = [n for n in book.columns if n not in ("vendor", "copies")]
    entries = cut(book, "page", "block", F.xxhash64("vendor", *keys))
    asking = cut(asked, "block", "page", F.xxhash64(F.lit(2), "_asked")).drop("blocks")
    if given:
        asking = asking.withColumnRenamed("_asked", "_features")
    else:
        entries = entries.withColumn("features", token_hashes(text_of("")))
        asking = asking.withColumn("_features", token_hashes(F.col("_asked"))).drop("_asked")
    pool = entries.groupBy(*tile).agg(
        F.collect_list(F.struct(*POOL_ORDER, "vendor", "copies", "features")).alias("pool")
    )
    return asking.join(pool, tile)


def exhaustive(asked: DataFrame, ledger: DataFrame, top_k: int, page_rows: int = 256) -> DataFrame:
    """(_features, candidates) for token sets compared with every row of the ledger, page by page."""
    described = ledger.withColumns({"features": token_hashes(text_of("")), "_block": F.lit(0)})
    everywhere = asked.select(F.lit(0).alias("_block"), "_features")
    return _best_of_pages(everywhere, described, top_k, set_similarity, page_rows, "_block").drop("_block")


def _best_of_pages(
    asked: DataFrame,
    described: DataFrame,
    top_k: int,
    similarity: Callable[[Column, Column], Column],
    page_rows: int,
    block: str,
) -> DataFrame:
    """(block, _features, candidates) of distinct ``asked`` rows (block, _features)."""
    return _ranked(on_pages(asked, described, ["features"], page_rows, block), top_k, similarity, block, ["_features"])


def _ranked(
    pooled: DataFrame,
    top_k: int,
    similarity: Callable[[Column, Column], Column],
    block: str,
    name: list[str],
    several_pages: bool = True,
) -> DataFrame:
    """(block, name, candidates) of rows (block, name, _features) that each meet the ``pool`` of one of the block's ``pages``.

    ``name`` tells the rows of a block apart; without ``several_pages`` every block has one page.
    """
    scored = F.transform(
        "pool",
        lambda entry: F.struct(
            (-similarity(F.col("_features"), entry["features"])).alias("distance"),
            *[entry[n].alias(n) for n in POOL_ORDER],
            entry["vendor"].alias("vendor"),
            entry["copies"].alias("copies"),
        ),
    )
    best = F.slice(F.array_sort(scored), 1, top_k)
    # Every copy of a ledger row is a candidate.
    each = F.flatten(
        F.transform(
            best, lambda e: F.array_repeat(e, F.least(e["copies"], F.lit(top_k)).cast("int"))
        )
    )
    met = pooled.select(block, *name, "pages", F.slice(each, 1, top_k).alias("each"))

    def shown(e: Column, rank: Column) -> Column:
        return F.struct(
            rank.cast("int").alias("rank"),
            F.round(-e["distance"], 4).alias("semantic_score"),
            F.struct(*[e[n].alias(n) for n in S.RECORD_FIELDS]).alias("ledger_record"),
            norm_text(e["invoice_id"]).alias("norm_id"),
        )

    # The best of a block's only page are the answer; those of several are shuffled and ranked once more.
    whole = met.where("pages = 1").select(
        block, *name, F.transform("each", lambda e, i: shown(e, i + 1)).alias("candidates")
    )
    if not several_pages:
        return whole
    order = Window.partitionBy(block, *name).orderBy(
        "e.distance", *[f"e.{n}" for n in POOL_ORDER], "e.vendor"
    )
    several = (
        met.where("pages > 1")
        .select(block, *name, F.explode("each").alias("e"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
        .select(block, *name, shown(F.col("e"), F.col("rank")).alias("c"))
        .groupBy(block, *name)
        .agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    )
    return whole.unionByName(several)


def promote_identity(
    df: DataFrame, identity: str = "identity", candidates: str = "candidates"
) -> DataFrame:
    """Move the record of verified identity to the front of the candidates.

    If the search returned it, it keeps its own score and rank; otherwise it
    enters with score 1 and rank 1.  The others keep order, score and rank.
    """
    none = F.array().cast(_candidate_type(df, candidates))

    def promoted(known: Column) -> Column:
        entering = F.struct(
            F.lit(1).alias("rank"),
            F.lit(1.0).alias("semantic_score"),
            known["record"].alias("ledger_record"),
            known["norm_id"].alias("norm_id"),
        )

        def in_front(found: Column) -> Column:
            same = F.filter(found, lambda c: c["norm_id"] == known["norm_id"])
            others = F.filter(found, lambda c: c["norm_id"] != known["norm_id"])
            front = F.coalesce(F.try_element_at(same, F.lit(-1)), entering)
            return F.when(known["record"].isNull(), found).otherwise(
                F.concat(F.array(front), others)
            )

        return let(F.coalesce(F.col(candidates), none), in_front)

    known = F.struct(
        F.col(identity).alias("record"),
        norm_text(F.col(identity)["invoice_id"]).alias("norm_id"),
    )
    return df.withColumn(candidates, let(known, promoted))


def _candidate_type(df: DataFrame, candidates: str):
    return df.schema[candidates].dataType


def identity_only(df: DataFrame, identity: str = "identity") -> DataFrame:
    """Candidates that hold nothing but the record of verified identity."""
    ledger_record = F.col(identity)
    only = F.array(
        F.struct(
            F.lit(1).alias("rank"),
            F.lit(1.0).alias("semantic_score"),
            ledger_record.alias("ledger_record"),
            norm_text(ledger_record["invoice_id"]).alias("norm_id"),
        )
    )
    return df.withColumn("candidates", F.when(ledger_record.isNotNull(), only))


def candidate_rows(df: DataFrame, candidates: str = "candidates") -> DataFrame:
    """One row per submission and candidate, with its position."""
    return df.select("submission_id", F.posexplode(candidates).alias("_at", "c")).select(
        "submission_id",
        (F.col("_at") + 1).alias("pos"),
        F.col("c.rank").alias("rank"),
        F.col("c.semantic_score").alias("semantic_score"),
        *[F.col(f"c.ledger_record.{n}").alias(f"ledger_{n}") for n in S.RECORD_FIELDS],
    )


def nest_candidates(rows: DataFrame) -> DataFrame:
    """The reverse of :func:`candidate_rows`, one array per submission."""
    entry = F.struct(
        "pos",
        "rank",
        "semantic_score",
        F.struct(*[F.col(f"ledger_{n}").alias(n) for n in S.RECORD_FIELDS]).alias("ledger_record"),
    )
    return rows.groupBy("submission_id").agg(
        F.array_sort(F.collect_list(entry)).alias("candidates")
    )
