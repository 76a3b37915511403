import math
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import records
from tallyweave.operators import candidates, duplicates, exceptions, nearest, repair
from tallyweave.operators.classify import classify
from tallyweave.plans.evaluate import with_retrieval
from tallyweave.plans.reconcile import reconcile, settle
from tests.helpers import RECORD, ledger, record, submissions


def statuses(df):
    return [(r.status, r.confidence) for r in df.orderBy("submission_id").collect()]


def test_every_status(spark):
    book = ledger(spark, record(), record(invoice_id="INV-00002", amount=77.0))
    subs = submissions(
        spark,
        record(),
        record(amount=1037.5),
        record(fx_rate=1.08),
        record(quantity=12),
        record(currency="USD"),
        record(invoice_id="NEW-1", vendor="Nobody"),
        record(amount=1000.02),
        record(fx_rate=1.005),
    )
    got = [s for s, _ in statuses(reconcile(subs, book))]
    assert got == [
        "matched",
        "amount_mismatch",
        "fx_mismatch",
        "quantity_mismatch",
        "currency_mismatch",
        "unmatched",
        "matched",
        "matched",
    ]


def with_candidates(spark, subs, *scored):
    """Submissions with literal candidates ``(score, record)``."""
    book = ledger(spark, *[r for _, r in scored])
    record_struct = F.struct(*[F.col(c) for c in book.columns])
    structs = book.select(record_struct.alias("r")).collect()
    rows = [
        (i + 1, score, s.r, s.r.invoice_id.lower()) for i, ((score, _), s) in enumerate(zip(scored, structs))
    ]
    kind = f"array<struct<rank:int,semantic_score:double,ledger_record:struct<{RECORD.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>,norm_id:string>>"
    one = spark.createDataFrame([(rows,)], f"candidates {kind}")
    return subs.crossJoin(one)


def test_ladder_thresholds(spark):
    stranger = record(invoice_id="NEW-1", vendor="Other", invoice_date=date(2020, 1, 1))
    subs = submissions(spark, stranger)

    def decide(*scored, **options):
        return statuses(classify(with_candidates(spark, subs, *scored), **options))[0]

    a, b = record(), record(invoice_id="INV-00002")
    assert decide((0.7499, a)) == ("unmatched", 0.2501)
    assert decide((-0.5, a)) == ("unmatched", 1.0)
    assert decide((0.9, a), (0.88, b)) == ("ambiguous", 0.9)
    assert decide((0.9, a), (0.85, b)) == ("unmatched", 0.1)
    assert decide((0.9, a)) == ("unmatched", 0.1)
    assert decide((1.0001, a)) == ("unmatched", 0.0)


def test_identity_and_threshold(spark):
    subs = submissions(spark, record())
    weak = with_candidates(spark, subs, (0.5, record()))
    assert statuses(classify(weak)) == [("unmatched", 0.5)]
    assert statuses(classify(weak, identity_overrides_threshold=True)) == [("matched", 0.5)]
    by_vendor = submissions(spark, record(invoice_id="OTHER", vendor=" ACME corp "))
    near = with_candidates(spark, by_vendor, (0.9, record()), (0.9, record(invoice_id="B")))
    assert statuses(classify(near)) == [("matched", 0.9)]


def test_missing_fields_never_match(spark):
    subs = submissions(spark, record(amount=None), record(quantity=None), record(currency=None))
    assert statuses(reconcile(subs, ledger(spark, record()))) == [("unmatched", 1.0)] * 3


def test_exact_id_beats_similarity(spark):
    """The row of the same id is judged, though another one looks more alike."""
    book = ledger(
        spark,
        record(invoice_id="INV-00009", amount=500.0),
        record(invoice_id="INV-00001", amount=999.0, invoice_date=date(2020, 2, 2)),
    )
    row = reconcile(submissions(spark, record(amount=1500.0)), book).first()
    assert row.status == "amount_mismatch" and row.best_match.invoice_id == "INV-00001"
    assert row.details.amount_delta == 501.0


def test_first_ledger_row_of_an_id(spark):
    book = ledger(
        spark,
        record(amount=5.0, invoice_date=date(2026, 2, 1)),
        record(amount=7.0, invoice_date=date(2026, 1, 1)),
    )
    row = candidates.by_exact_id(submissions(spark, record(invoice_id="inv-0.0001")), book).first()
    assert row.identity.amount == 7.0
    blank = candidates.by_exact_id(
        submissions(spark, record(invoice_id=" ")), ledger(spark, record(invoice_id=" "))
    )
    assert blank.first().identity is None


def test_search_covers_the_whole_pool(spark):
    """Every row of a large vendor is found, whatever its place and however pages are cut."""

    def row(i, **other):
        return record(**{"invoice_id": f"A-{i:03d}", "amount": 100.0 + 7 * i, "quantity": i + 1} | other)

    rows = [row(i) for i in range(100)]
    book = ledger(spark, *rows, rows[90], record(invoice_id="B-1", vendor="Other"))
    # Equal to row 10 and row 90 but for a misread id.
    subs = submissions(spark, *[row(i, invoice_id=f"X-{i:03d}") for i in (10, 90)], record(vendor="None"))
    want = None
    for page_rows in (256, 7):
        got = candidates.search(subs, book, top_k=3, page_rows=page_rows).orderBy("submission_id").collect()
        found = [[(c.rank, c.semantic_score, c.ledger_record.invoice_id) for c in r.candidates or []] for r in got]
        assert found[0][0][2] == "A-010" and [c[2] for c in found[1][:2]] == ["A-090", "A-090"]
        assert [c[0] for c in found[1]] == [1, 2, 3] and found[2] == []
        assert want in (None, found)
        want = found
    assert [r.status for r in reconcile(subs, book).orderBy("submission_id").collect()] == ["matched"] * 2 + ["unmatched"]
    assert candidates.vendor_candidates(subs, book).count() == 120
    with pytest.raises(ValueError):
        candidates.search(subs, book, top_k=0)


def test_promotion(spark):
    """An exact id that the search did not return enters with score 1; one it returned keeps its score."""
    book = ledger(
        spark,
        record(invoice_id="A-001"),
        record(invoice_id="A-002", amount=5.0, quantity=77, invoice_date=date(2020, 2, 2)),
    )
    subs = submissions(spark, record(invoice_id="A-002"), record(invoice_id="A-001", amount=1001.0))
    found = candidates.search(candidates.by_exact_id(subs, book), book, top_k=1)
    shown = candidates.promote_identity(found).orderBy("submission_id").collect()
    outside, inside = shown[0].candidates, shown[1].candidates
    assert outside[0].ledger_record.invoice_id == "A-002"
    assert (outside[0].semantic_score, outside[0].rank, len(outside)) == (1.0, 1, 2)
    assert inside[0].ledger_record.invoice_id == "A-001" and len(inside) == 1
    assert inside[0].semantic_score < 1


def test_ranks_by_raw_score(spark):
    """Two vectors whose scores agree to four decimals: the nearer one first, whatever its id."""
    near, far = [math.cos(0.001), math.sin(0.001)], [math.cos(0.009), math.sin(0.009)]
    df = spark.createDataFrame([(1, far), (2, near)], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = nearest.nearest_neighbours(asked, df, 2).orderBy("rank").collect()
    assert [(r.neighbour_id, r.score) for r in got] == [(2, 1.0), (1, 1.0)]


def test_retrieval_alone(spark):
    """No id lookup: a record of the same id but another vendor is not a candidate."""
    book = ledger(spark, record(), record(invoice_id="INV-00002", vendor="Other", amount=77.0))
    subs = submissions(spark, record(invoice_id="INV-00002"))
    assert with_retrieval(subs.withColumn("scenario", F.lit("matched")), book).first().predicted == "matched"
    assert reconcile(subs, book).first().status == "amount_mismatch"


def test_weak_identity(spark):
    book = ledger(spark, record(invoice_id="Z-1"))
    subs = submissions(spark, record(invoice_id="?", vendor="ACME CORP "), record(vendor="No"))
    got = candidates.by_identity(subs, book).orderBy("submission_id").collect()
    assert got[0].identity.invoice_id == "Z-1" and got[1].identity is None


def test_repair(spark):
    book = ledger(spark, record(amount=653.67, quantity=11))
    subs = submissions(
        spark,
        record(amount=1653.67, quantity=1),
        record(amount=691.17, quantity=5),
        record(amount=12341653.67, quantity=11),
        record(invoice_id="NONE", amount=1653.67, quantity=1),
        record(amount=3653.67, quantity=11),
    )
    fixed = repair.repair_fields(candidates.by_exact_id(subs, book))
    got = fixed.orderBy("submission_id").collect()
    assert [(r.amount, r.quantity) for r in got] == [
        (653.67, 11),
        (691.17, 5),
        (12341653.67, 11),
        (1653.67, 1),
        (653.67, 11),
    ]
    assert [len(r.repairs) for r in got] == [2, 0, 0, 0, 1]
    assert got[0].repairs[0].original_value == 1653.67


def test_duplicates_against_history_and_in_batch(spark):
    book = ledger(spark, record(), record(invoice_id="INV-00002"))
    subs = submissions(
        spark, record(), record(), record(invoice_id="INV-00002"), record(quantity=3), record()
    )
    history = spark.createDataFrame(
        [
            ("e1", "2026-01-01 10:00:00", "r1", "INV-00002", "Acme Corp", 1000.0, "EUR", "matched"),
            ("e2", "2026-01-02 10:00:00", "r2", "INV-00002", "Acme Corp", 1000.0, "EUR", "matched"),
            ("e3", "2026-01-03 10:00:00", "r3", "INV-00001", "Acme Corp", 1000.0, "EUR", "unmatched"),
        ],
        "audit_event_id string, event_timestamp string, run_id string, invoice_id string, "
        "vendor string, amount double, currency string, reconciliation_status string",
    ).withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    got = settle(subs, book, history).orderBy("submission_id").collect()
    assert [r.status for r in got] == [
        "matched",
        "duplicate_charge",
        "duplicate_charge",
        "quantity_mismatch",
        "duplicate_charge",
    ]
    assert got[2].details.prior_audit_event_id == "e2" and got[2].confidence == 1.0
    assert got[0].dispute_draft == "" and "INV-00002" in got[2].dispute_draft


def test_seeded_duplicates(spark):
    results = spark.createDataFrame(
        [(1, "A", "matched"), (2, "B", "matched"), (3, "B", "matched"), (4, "B", "unmatched")],
        "submission_id int, invoice_id string, status string",
    )
    seed = spark.createDataFrame([("A",)], "invoice_id string")
    got = duplicates.flag_later_copies(results, keys=["invoice_id"], accepted=seed)
    assert [r.status for r in got.orderBy("submission_id").collect()] == [
        "duplicate_charge",
        "matched",
        "duplicate_charge",
        "unmatched",
    ]


def test_investigation_covers_every_status(spark):
    subs = submissions(spark, record(amount=1037.5), record(fx_rate=1.08), record())
    got = exceptions.investigate(reconcile(subs, ledger(spark, record())))
    rows = got.orderBy("submission_id").collect()
    assert [(r.root_cause, r.severity) for r in rows] == [
        ("amount_mismatch", "high"),
        ("fx_mismatch", "medium"),
        ("no_action_required", "none"),
    ]
    assert "1,037.50 EUR" in rows[0].summary and "37.50 EUR" in rows[0].dispute_reason
    assert "8.00%" in rows[1].dispute_reason and rows[0].hypotheses == [rows[0].summary]


def brute_force(vectors, ids, k):
    """Ranked by the raw score, shown with four decimals."""
    scores = (vectors[:, None, :] * vectors[None, :, :]).sum(-1)
    out = []
    for i, name in enumerate(ids):
        ranked = sorted((-scores[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out += [(name, r + 1, n, round(-s, 4)) for r, (s, n) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows,unit", [(2048, True), (16, True), (7, False)])
def test_nearest_neighbours_are_exact(spark, block_rows, unit):
    """Clusters, scattered points, one vector that is a third of the table; of one length or of any."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    points = np.concatenate(
        [
            centres[rng.integers(0, 6, 60)] + 0.05 * rng.normal(size=(60, 8)),
            rng.normal(size=(20, 8)),
            np.repeat(rng.normal(size=(1, 8)), 40, axis=0),
        ]
    )
    if unit:
        points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = points.astype("float32")
    ids = [int(i) for i in rng.permutation(len(points))]
    df = spark.createDataFrame(
        [(i, p.tolist()) for i, p in zip(ids, points)], "vec_id bigint, embedding array<float>"
    )
    got = nearest.nearest_neighbours(df, df, 3, exclude_self=True, block_rows=block_rows)
    rows = sorted((r.query_id, r.rank, r.neighbour_id, r.score) for r in got.collect())
    want = brute_force(points.astype("float64"), ids, 3)
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    assert [r[3] for r in rows] == pytest.approx([w[3] for w in want], abs=1.01e-4)


def test_rows_go_to_few_tiles_however_many_there_are():
    """Blocks grow with the table as long as a task has room for them; small tables are one block."""
    assert [nearest._blocks(n, 131_072) for n in (0, 1, 2048, 2049, 16_384, 720_000, 1_048_576)] == [1, 1, 1, 2, 8, 8, 8]
    assert nearest._blocks(2_000_000, 131_072) == 16


@pytest.mark.parametrize("kind", ["scattered", "ties", "not finite"])
def test_best_products_of_a_tile(kind):
    rng = np.random.default_rng(4)
    left, right = rng.normal(size=(300, 4)), rng.normal(size=(25_000, 4))
    if kind != "scattered":
        left, right = np.sign(left), np.sign(right)
    if kind == "not finite":
        left[3, 0] = np.nan
    for pool in (right, right[:3]):
        scores = left @ pool.T
        want = np.argsort(-scores, axis=1, kind="stable")[:, :4]
        row, column, score = nearest._top(left, pool, 4)
        assert row.tolist() == np.repeat(np.arange(300), want.shape[1]).tolist()
        assert column.tolist() == want.ravel().tolist()
        np.testing.assert_allclose(score, np.take_along_axis(scores, want, axis=1).ravel(), rtol=1e-12)


def test_neighbours_reject_bad_vectors(spark):
    good = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    for bad in (None, [1.0, None], [1.0, 0.0, 0.0]):
        one = spark.createDataFrame([(2, bad)], good.schema)
        with pytest.raises(Exception):
            nearest.nearest_neighbours(good, good.unionByName(one), 1).collect()


def test_neighbours_of_small_pools(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = nearest.nearest_neighbours(df, df, 5)
    assert got.count() == 4
    with pytest.raises(ValueError):
        nearest.nearest_neighbours(df, df, 0)
    with pytest.raises(ValueError):
        nearest.nearest_neighbours(df, df.filter("vec_id > 9"), 1)


def test_hot_vendor_is_split(spark):
    """One vendor and one invoice id hold most submissions: results whole, join split."""
    book = ledger(spark, *[record(invoice_id=f"A-{i:03d}", vendor=f"V{i % 50}") for i in range(100)])
    many = spark.range(40000).select(
        F.col("id").alias("submission_id"),
        F.when(F.col("id") % 5 < 4, F.lit("A-000"))
        .otherwise(F.concat(F.lit("A-"), F.lpad((F.col("id") % 97).cast("string"), 3, "0")))
        .alias("invoice_id"),
        F.lit("2026-01-15").cast("date").alias("invoice_date"),
        F.lit("V0").alias("vendor"),
        F.lit(1000.0).alias("amount"),
        F.lit("EUR").alias("currency"),
        F.lit(10).alias("quantity"),
        F.lit(1.0).alias("fx_rate"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = candidates.by_exact_id(many.repartition(16), book).select("submission_id", "identity")
        assert len(found.collect()) == 40000
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pages_hold_each_field_once_and_features_are_shuffled_by_name(spark):
    """A vendor of one page and one of several are searched alike; rows without features find nothing."""
    names = ["V1"] * 40 + ["V2"] * 2
    book = ledger(spark, *[record(invoice_id=f"INV-{k}", vendor=v) for k, v in enumerate(names)])
    pool, pages = candidates.pool_pages(book, page_rows=4)
    assert {r["vendor"]: r["pages"] for r in pages.collect()} == {"V1": 10, "V2": 1}
    fields = pool.schema["pool"].dataType.elementType.names
    assert sorted(fields) == sorted([*candidates.POOL_ORDER, "vendor", "copies"])
    subs = submissions(spark, record(invoice_id="INV-7", vendor="V1"), record(invoice_id="INV-41", vendor="V2"))
    found = candidates.search(subs, book, top_k=2, page_rows=4)
    shown = {
        r["vendor"]: [(c["rank"], c["ledger_record"]["invoice_id"], c["norm_id"]) for c in r["candidates"]]
        for r in found.collect()
    }
    assert shown["V1"][0][:2] == (1, "INV-7") and shown["V2"][0][:2] == (1, "INV-41")
    assert [c[0] for c in shown["V1"]] == [c[0] for c in shown["V2"]] == [1, 2]
    assert len({type(c[2]) for v in shown.values() for c in v}) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and not any(
        "_features" in line for line in plan.splitlines() if "Join LeftOuter" in line or "Window" in line
    )
    none = candidates.search(subs, book, 2, lambda prefix: F.lit(None).cast("array<bigint>"))
    assert [r["candidates"] for r in none.collect()] == [None, None]


def test_search_in_tiles_is_exact(spark):
    """Pages, blocks and rounds of any size give the same candidates: those of a comparison of all pairs."""
    vendors = ["Hot"] * 60 + ["V1", "V2", None]
    rows = [record(invoice_id=f"A-{i:02d}", vendor=v, amount=100.0 + i % 7, quantity=i % 5) for i, v in enumerate(vendors)]
    book = ledger(spark, *rows, rows[3], rows[3])
    subs = submissions(spark, *[record(invoice_id=f"A-{i % 50:02d}", vendor=v, quantity=i % 3) for i, v in enumerate(vendors)], rows[1], rows[1])

    def found(**sizes):
        got = candidates.search(subs, book, top_k=4, **sizes).orderBy("submission_id").collect()
        return [[(c.rank, c.semantic_score, c.ledger_record) for c in r.candidates] if r.candidates else r.candidates for r in got]

    want = found()
    words = lambda r: set("".join(c if c.isalnum() else " " for c in r.text.lower()).split())
    texts = lambda df: df.select("*", records.text_of("").alias("text")).collect()
    for asked, got in zip(sorted(texts(subs), key=lambda r: r.submission_id), want, strict=True):
        pool = [(words(asked), words(r)) for r in texts(book) if r.vendor is not None and r.vendor == asked.vendor]
        best = sorted((len(q & r) / (len(q) * len(r)) ** 0.5 for q, r in pool), reverse=True)[:4]
        assert [c[1] for c in got or []] == [pytest.approx(x, abs=1e-4) for x in best]
    for sizes in ({"page_rows": 7, "block_rows": 5}, {"page_rows": 1, "round_rows": 30}, {"block_rows": 2, "round_rows": 9}):
        assert found(**sizes) == want


def test_search_keeps_answers_only(spark):
    """What was asked and the ledger's rows are gone from the shared folder when the answers are stored."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    found = candidates.search(submissions(spark, record()), ledger(spark, record()))
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert left == {"asking", "ranked"}
    assert [len(r.candidates) for r in found.collect()] == [1]
    assert "token" not in found._jdf.queryExecution().executedPlan().toString()
