from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import dates, fuzzy, money, text
from tallyweave.functions.fuzzy import partial_similarity
from tallyweave.operators import extraction


def over(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    found = rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in found]


def test_amounts_of_both_styles(spark):
    got = over(
        spark,
        ["1,234.56", "1.234,56", "12,5", " 1 234.50 ", "abc", "1.2.3", "1d", ""],
        money.parse_amount,
    )
    assert got == [1234.56, 1234.56, 12.5, 1234.5, None, None, None, None]


def test_last_amount_and_numeric_text(spark):
    assert over(
        spark, ["ROUND TOTAL (RM): 1,234.56", "RM 9.00", "12.00 then -3,50", "none"], money.last_amount
    ) == [1234.56, 9.0, -3.5, None]
    assert over(
        spark, ["RM 9.00", "1,234.56", "1.234,56", "SGD 3", "x"], money.norm_numeric
    ) == ["9.00", "1234.56", "1234.56", "3.00", ""]


def test_dates(spark):
    values = [
        "25/12/2018",
        "12/28/2017",
        "05 MAR 2018",
        "05 MAR 2018 18:24",
        "2017-12-28 22:17PM",
        "2018.03.05",
        "March 5, 2018",
        "05/03/18",
        "05/03/70",
        "12-03/2018",
        "no date",
    ]
    want = [
        date(2018, 12, 25),
        date(2017, 12, 28),
        date(2018, 3, 5),
        date(2018, 3, 5),
        date(2017, 12, 28),
        date(2018, 3, 5),
        date(2018, 3, 5),
        date(2018, 3, 5),
        date(1970, 3, 5),
        None,
        None,
    ]
    assert over(spark, values, lambda c: dates.parse_date(c, names_first=True)) == want
    assert over(spark, values, dates.parse_date) == want
    # Dotted two-digit years are read only when names come first.
    assert over(spark, ["05.03.18"], dates.parse_date) == [None]
    assert over(spark, ["05.03.18"], lambda c: dates.parse_date(c, True)) == [date(2018, 3, 5)]
    assert over(spark, ["on 05/03/18", "on 5 MAR 2018"], dates.extract_date) == [
        None,
        date(2018, 3, 5),
    ]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.dates(date(1970, 1, 1), date(2068, 12, 31)), min_size=20, max_size=40))
def test_dates_read_back(spark, days):
    """Whatever Python writes, the expressions read."""
    for fmt in ("%Y-%m-%d", "%d.%m.%Y", "%d %b %Y", "%d/%m/%y", "%B %d, %Y"):
        written = [d.strftime(fmt) for d in days]
        want = [datetime.strptime(w, fmt).date() for w in written]
        assert over(spark, written, dates.parse_date) == want


def test_currency(spark):
    values = ["total 5 usd in EUROS", "pay US$ 5", "in £", "TERMS apply", "nothing", "5 MYR 3 EUR"]
    assert over(spark, values, extraction.detect_currency) == [
        "USD",
        "USD",
        "GBP",
        "MYR",
        "EUR",
        "EUR",
    ]
    assert over(spark, ["nothing", "5 €"], extraction.norm_currency) == ["MYR", "EUR"]


def test_text_forms(spark):
    assert over(spark, ["  A,b.C \t d "], text.norm_text) == ["abc d"]
    assert over(spark, ["Acme, Corp. (M)"], text.norm_alnum) == ["acme corp m"]
    assert over(spark, ["\n x \t"], text.strip) == ["x"]


def slow_similarity(a, b):
    """Textbook version: every window, dynamic-programming subsequence."""

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for cx in x:
            last = row[:]
            for j, cy in enumerate(y):
                row[j + 1] = last[j] + 1 if cx == cy else max(row[j], last[j + 1])
        return row[-1]

    def one_way(short, long):
        if not short:
            return 0.0 if long else 100.0
        m = len(short)
        pieces = (
            [long[i : i + m] for i in range(len(long) - m + 1)]
            + [long[:i] for i in range(1, m)]
            + [long[-i:] for i in range(1, m)]
        )
        return max(200.0 * lcs(short, p) / (m + len(p)) for p in pieces)

    if len(a) == len(b):
        return max(one_way(a, b), one_way(b, a))
    return one_way(*sorted((a, b), key=len))


def test_partial_similarity_is_symmetric():
    assert partial_similarity("bcdzz", "abcda") == partial_similarity("abcda", "bcdzz") == pytest.approx(75.0)


@settings(max_examples=300, deadline=None)
@given(st.text("abc d", max_size=9), st.text("abc d", max_size=14))
def test_partial_similarity_is_exact(a, b):
    assert partial_similarity(a, b) == pytest.approx(slow_similarity(a, b))


@settings(max_examples=300, deadline=None)
@given(st.text("abc d", max_size=9), st.text("abc d", max_size=14), st.sampled_from([30.0, 45.0, 75.0, 86.0]))
def test_partial_similarity_is_exact_from_the_least_on(a, b, least):
    got, want = partial_similarity(a, b, least), slow_similarity(a, b)
    assert got == pytest.approx(want) if want >= least else got < least


def test_hopeless_pieces_are_not_compared(monkeypatch):
    """Most pieces of a line cannot reach the likeness that is asked for."""
    compared = []
    common = fuzzy._common_subsequence
    monkeypatch.setattr(fuzzy, "_common_subsequence", lambda *x: compared.append(x) or common(*x))
    assert partial_similarity("cu5t0mer 000012345", "customer 000012345", 86.0) == pytest.approx(200 * 16 / 36)
    assert len(compared) <= 10


@settings(max_examples=300, deadline=None)
@given(st.text("abcdef ", min_size=4, max_size=9), st.text("abcdef ", min_size=1, max_size=14))
def test_character_bound_never_loses_a_match(word, name):
    """What the plan rules out by characters alone could not have matched."""
    short, long = (word, name) if len(word) <= len(name) else (name, word)
    lacking = sum(c not in long for c in short)
    if len(word) == len(name):
        lacking = min(lacking, sum(c not in short for c in long))
    t = 0.86
    if lacking > len(short) * (1 - t / (2 - t)) + 1e-9:
        assert slow_similarity(word, name) < 86


@pytest.mark.parametrize("text", ["", "1.2", "1.23", "RM 1,234.50", "12/03.45x", "a1,00", "1 .00", "99999.9 9", "EUR1.000,1", "1.234", "٣.٤٥", "-7,5,25"])
def test_money_is_found_by_its_last_digits(spark, text):
    from tests.helpers import evaluate as results

    both = results(spark, text, *[lambda c, p=p: c.rlike(p) for p in (money.MONEY_PATTERN, money.HAS_MONEY_PATTERN)])
    assert both[0] == both[1]


def test_shuffled_files_go_with_their_job(spark):
    from tallyweave.session import tune

    assert tune(spark).conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
