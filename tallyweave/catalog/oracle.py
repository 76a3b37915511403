"""Plain SQL that says what the registered queries must return.

Written against the given tables only, and on its own terms: windows and
unnested lists where the Spark side uses aggregation and arrays.
"""

from __future__ import annotations

# --- shared table expressions ------------------------------------------------

LEDGER = """ledger AS (
  SELECT o.o_orderkey AS k,
         concat('INV-', lpad(CAST(o.o_orderkey AS VARCHAR), 8, '0')) AS invoice_id,
         CAST(o.o_orderdate AS DATE) AS invoice_date,
         c.c_name AS vendor,
         round(o.o_totalprice, 2) AS amount,
         CASE o.o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP'
              ELSE 'PLN' END AS currency,
         coalesce(l.q, 1) AS quantity,
         CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(1 AS DOUBLE)
              ELSE round(CAST(85 + o.o_orderkey % 36 AS DOUBLE) / 100, 4) END AS fx_rate
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS INT) AS q
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

VARIANTS = """scen AS (
  SELECT *, CAST(round(amount * 100) AS BIGINT) AS cents,
    CAST(round(fx_rate * 10000) AS BIGINT) AS fxi,
    CASE k % 7 WHEN 0 THEN 'matched' WHEN 1 THEN 'amount_mismatch' WHEN 2 THEN 'fx_mismatch'
      WHEN 3 THEN 'quantity_mismatch' WHEN 4 THEN 'duplicate_charge'
      WHEN 5 THEN 'currency_mismatch' ELSE 'unmatched' END AS scenario
  FROM ledger),
changed AS (
  SELECT *,
    CASE WHEN scenario = 'fx_mismatch'
         THEN CAST((fxi * 108 - (fxi * 108) % 100) / 100 AS BIGINT) ELSE fxi END AS fxi2,
    CASE WHEN scenario = 'quantity_mismatch' THEN quantity + 2 ELSE quantity END AS q2
  FROM scen),
priced AS (
  SELECT *, CASE scenario WHEN 'amount_mismatch' THEN cents + 3750
      WHEN 'fx_mismatch' THEN CAST((cents * fxi2 - (cents * fxi2) % fxi) / fxi AS BIGINT)
      WHEN 'quantity_mismatch'
        THEN CAST((cents * q2 - (cents * q2) % quantity) / quantity AS BIGINT)
      ELSE cents END AS cents2
  FROM changed),
variants AS (
  SELECT k * 2 AS submission_id, scenario,
    CASE WHEN scenario = 'unmatched' THEN concat('X', invoice_id) ELSE invoice_id END AS invoice_id,
    invoice_date,
    CASE WHEN scenario = 'unmatched' THEN concat('Unlisted ', vendor) ELSE vendor END AS vendor,
    CAST(cents2 AS DOUBLE) / 100 AS amount,
    CASE WHEN scenario <> 'currency_mismatch' THEN currency
         WHEN currency = 'EUR' THEN 'USD' ELSE 'EUR' END AS currency,
    CAST(q2 AS INTEGER) AS quantity,
    CAST(fxi2 AS DOUBLE) / 10000 AS fx_rate
  FROM priced)"""

SUBS = """subs AS (
  SELECT *, submission_id // 2 AS k FROM (
    SELECT * FROM variants
    UNION ALL
    SELECT submission_id + 1, scenario, invoice_id, invoice_date, vendor, amount, currency,
           quantity, fx_rate
    FROM variants WHERE scenario = 'duplicate_charge'))"""

MISREAD = """misread AS (
  SELECT submission_id, k, scenario, invoice_id, invoice_date, vendor,
    CASE WHEN k % 11 = 0
         THEN CAST(concat('1', CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)) AS DOUBLE)
         ELSE amount END AS amount,
    currency,
    CASE WHEN k % 13 = 0 THEN 1 ELSE quantity END AS quantity, fx_rate
  FROM subs)"""

RAW = """raw AS (
  SELECT submission_id,
    CASE WHEN k % 37 = 0 THEN NULL ELSE strftime(invoice_date, '%Y-%m-%d') END AS invoice_date,
    CASE WHEN k % 41 = 0 THEN NULL ELSE vendor END AS vendor,
    CASE WHEN k % 29 = 0 THEN NULL ELSE amount END AS amount,
    CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(quantity AS DOUBLE) END AS quantity,
    fx_rate
  FROM subs)"""

# The ladder with the exact-id record as only candidate (score 1).
DECIDED = """decided AS (
  SELECT s.*, l.invoice_id AS l_id, l.amount AS l_amount, l.currency AS l_currency,
    l.quantity AS l_quantity, l.fx_rate AS l_fx,
    CASE WHEN l.k IS NULL THEN 'unmatched'
         WHEN s.currency <> l.currency THEN 'currency_mismatch'
         WHEN s.quantity <> l.quantity THEN 'quantity_mismatch'
         WHEN abs(l.fx_rate - s.fx_rate) / l.fx_rate > 0.005 THEN 'fx_mismatch'
         WHEN abs(round(s.amount - l.amount, 2)) > 0.02 THEN 'amount_mismatch'
         ELSE 'matched' END AS status
  FROM subs s LEFT JOIN ledger l ON l.invoice_id = s.invoice_id)"""

EXPLAINED = """explained AS (
  SELECT *,
    CASE WHEN status = 'matched' AND row_number() OVER (
             PARTITION BY invoice_id, vendor, amount, currency, status
             ORDER BY submission_id) > 1
         THEN 'duplicate_charge' ELSE status END AS final
  FROM decided)"""


def _money(value: str, currency: str) -> str:
    return f"concat(format('{{:,.2f}}', {value}), ' ', {currency})"


TOLD = f"""told AS (
  SELECT *, concat('Invoice ', invoice_id, ' of ', vendor) AS who,
    CASE final WHEN 'matched' THEN 'no_action_required' WHEN 'unmatched' THEN 'unmatched_invoice'
         ELSE final END AS root_cause,
    CASE final WHEN 'matched' THEN 'none' WHEN 'unmatched' THEN 'medium'
         WHEN 'fx_mismatch' THEN 'medium' ELSE 'high' END AS severity,
    CASE final
      WHEN 'amount_mismatch' THEN
        'Stop the payment until a corrected invoice or an approval arrives.'
      WHEN 'quantity_mismatch' THEN 'Ask for proof of the delivered quantity before paying.'
      WHEN 'fx_mismatch' THEN 'Check the agreed source of the exchange rate.'
      WHEN 'currency_mismatch' THEN 'Stop the payment and confirm the currency of the contract.'
      WHEN 'duplicate_charge' THEN 'Block the payment and find out why the invoice came again.'
      WHEN 'unmatched' THEN 'Check id, vendor and date before writing to the vendor.'
      ELSE 'Nothing to do.' END AS recommended_action
  FROM explained),
stories AS (
  SELECT *,
    CASE final
      WHEN 'amount_mismatch' THEN concat(who, ' bills ', {_money("amount", "currency")},
        '; the ledger has ', {_money("l_amount", "currency")}, '.')
      WHEN 'quantity_mismatch' THEN concat(who, ' counts ', quantity, '; the ledger has ',
        l_quantity, '.')
      WHEN 'fx_mismatch' THEN concat(who, ' applies rate ', fx_rate, '; the ledger has ', l_fx, '.')
      WHEN 'currency_mismatch' THEN concat(who, ' is in ', currency, '; the ledger has ',
        l_currency, '.')
      WHEN 'duplicate_charge' THEN concat(who, ' was already reconciled.')
      WHEN 'unmatched' THEN concat(who, ' has no valid ledger record.')
      ELSE concat(who, ' agrees with the ledger.') END AS summary,
    CASE final
      WHEN 'amount_mismatch' THEN concat('The amount is off by ',
        {_money("round(amount - l_amount, 2)", "currency")}, '.')
      WHEN 'quantity_mismatch' THEN concat('The quantity is off by ', quantity - l_quantity, '.')
      WHEN 'fx_mismatch' THEN concat('The exchange rate is off by ',
        format('{{:.2f}}', round(round(abs(l_fx - fx_rate) / l_fx, 4) * 100, 2)), '%.')
      WHEN 'currency_mismatch' THEN 'The currencies differ.'
      WHEN 'duplicate_charge' THEN 'The invoice may be charged twice.'
      WHEN 'unmatched' THEN 'There is no ledger record.'
      ELSE '' END AS dispute_reason
  FROM told)"""

DETAILS_JSON = """CASE status
      WHEN 'unmatched' THEN '{"reason":"no ledger candidate was found"}'
      WHEN 'currency_mismatch' THEN concat('{"invoice_currency":"', currency,
        '","ledger_currency":"', l_currency, '"}')
      WHEN 'quantity_mismatch' THEN concat('{"invoice_quantity":', quantity,
        ',"ledger_quantity":', l_quantity, ',"quantity_delta":', quantity - l_quantity, '}')
      WHEN 'fx_mismatch' THEN concat('{"invoice_fx_rate":', fx_rate, ',"ledger_fx_rate":', l_fx,
        ',"relative_fx_rate_difference":', round(abs(l_fx - fx_rate) / l_fx, 4), '}')
      WHEN 'amount_mismatch' THEN concat('{"amount_delta":', round(amount - l_amount, 2),
        ',"invoice_amount":', amount, ',"ledger_amount":', l_amount, '}')
      ELSE '{"reason":"identity, currency, quantity, rate and amount agree"}' END"""

POOL = """pool AS (
  SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY invoice_id, invoice_date, amount,
                               currency, quantity, fx_rate) AS pool_pos
  FROM ledger)"""

EVENT_HISTORY = """history AS (
  SELECT event_id, ts, concat('evt-', event_id) AS audit_event_id,
    concat('run-', event_id % 10) AS run_id,
    concat('INV-', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS invoice_id,
    event_type AS vendor, value AS amount,
    CASE user_id % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'PLN' END
      AS currency,
    CASE event_id % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'amount_mismatch' ELSE 'unmatched' END
      AS status,
    event_id % 101 AS percent
  FROM events)"""

REVIEWS = """reviews AS (
  SELECT * FROM (
    SELECT concat('INV-', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS invoice_id,
      CASE WHEN event_id % 3 = 0 THEN 'prod' ELSE 'local' END AS environment,
      concat('apr-', event_id) AS approval_event_id,
      concat('reviewer-', user_id % 7) AS reviewer_id,
      row_number() OVER (PARTITION BY user_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END
                         ORDER BY ts DESC, concat('apr-', event_id) DESC) AS n
    FROM events WHERE event_id % 2 = 0) WHERE n = 1)"""

WORDS = r"""words AS (
  SELECT doc_id, split, pos, word,
    CASE WHEN regexp_matches(word, '[0-9]') THEN 'TOTAL' WHEN regexp_matches(word, '^[A-Z]')
      THEN 'VENDOR' WHEN ends_with(word, '.') THEN 'DATE' END AS kind
  FROM (SELECT doc_id, split, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
        FROM (SELECT doc_id, lang AS split,
                string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS w
              FROM documents)) WHERE word <> ''),
tagged AS (
  SELECT *, CASE WHEN pos % 7 = 0 THEN 'O' WHEN pos % 11 = 0 THEN 'B-VENDOR' ELSE label END
      AS predicted
  FROM (SELECT *, CASE WHEN kind IS NULL THEN 'O'
               WHEN pos % 3 = 0 THEN concat('B-', kind) ELSE concat('I-', kind) END AS label,
          length(word) % 64 AS sixtyfourths
        FROM words))"""


def _spans(name: str, label: str) -> str:
    """Spans of a label column of ``tagged`` by gaps and islands."""
    return f"""{name}_steps AS (
  SELECT *, CASE WHEN {label} = 'O' THEN '' ELSE substr({label}, 3) END AS etype,
    lag({label}) OVER (PARTITION BY doc_id ORDER BY pos) AS before
  FROM tagged),
{name}_islands AS (
  SELECT *, sum(CASE WHEN {label} LIKE 'B-%' OR before IS NULL OR before = 'O'
      OR substr(before, 3) <> etype THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos) AS island
  FROM {name}_steps WHERE {label} <> 'O' OR TRUE),
{name} AS (
  SELECT doc_id, etype AS entity_type, string_agg(word, ' ' ORDER BY pos) AS text,
    CAST(round(CAST(sum(sixtyfourths) / 64.0 / count(*) AS DECIMAL(28,12)), 4) AS DOUBLE) AS score,
    CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) AS INTEGER) AS end_word
  FROM {name}_islands WHERE {label} <> 'O' GROUP BY doc_id, etype, island)"""


def _r(value: str, digits: int = 4) -> str:
    """Half-up rounding of a double."""
    return f"CAST(round(CAST({value} AS DECIMAL(28,12)), {digits}) AS DOUBLE)"


def _r_printed(value: str, digits: int) -> str:
    """Half-up rounding of a double as it prints, noise in its last digit included."""
    return (
        f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"
    )


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


INVOICES = (LEDGER, VARIANTS, SUBS)
RECORD = """invoice_id, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, vendor, amount,
  currency, quantity, fx_rate"""

# Token sets of record texts.
_TOKENS = r"""list_distinct(string_split(trim(regexp_replace(lower(concat(
      'vendor: ', vendor, ' | invoice id: ', invoice_id, ' | date: ', invoice_date,
      ' | amount: ', format('{:.2f}', amount), ' ', currency, ' | quantity: ', quantity,
      ' | fx rate: ', format('{:.4f}', fx_rate), ' | line items: []')),
      '[^a-z0-9]+', ' ', 'g')), ' ')) AS toks"""

# Similarity of token sets, and the best rows of the vendor by the raw score.  Tokens are
# joined and counted, so that no list meets a list.
SEARCH = (
    f"""described AS MATERIALIZED (SELECT *, {_TOKENS} FROM {{source}}),
pooled AS MATERIALIZED (SELECT *, {_TOKENS} FROM pool),
spoken AS (SELECT submission_id, vendor, unnest(toks) AS t FROM described),
written AS (SELECT k AS l_k, vendor, unnest(toks) AS t FROM pooled),
common AS MATERIALIZED (
  SELECT s.submission_id, w.l_k, count(*) AS n FROM spoken s JOIN written w USING (vendor, t)
  GROUP BY s.submission_id, w.l_k),
scored AS MATERIALIZED (
  SELECT c.submission_id, p.invoice_id AS l_id, p.pool_pos, c.n / sqrt(len(d.toks) * len(p.toks)) AS raw
  FROM common c JOIN described d USING (submission_id) JOIN pooled p ON p.k = c.l_k),
"""
    + """retrieved AS MATERIALIZED (
  SELECT *, """
    + _r("raw")
    + """ AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY raw DESC, pool_pos) AS rank
    FROM scored) WHERE rank <= {top_k})"""
)

#: The most frequent tokens are bits of so many words.
_MASKS = 8
_SET_BITS = ", ".join(f"coalesce(bit_or(1::BIGINT << (b % 62)) FILTER (WHERE b // 62 = {k}), 0) AS m{k}" for k in range(_MASKS))
_SHARED_BITS = " + ".join(f"bit_count(q.m{k} & r.m{k})" for k in range(_MASKS))

# The best of all ledger rows: every submission meets every row.  Frequent tokens are counted as
# bits, for all pairs; the others by joining them.  Only pairs that reach the fifth best by bits
# alone, or share another token, can be among the best.
SEARCH_ALL = (
    f"""described AS MATERIALIZED (SELECT *, {_TOKENS} FROM {{source}}),
pooled AS MATERIALIZED (
  SELECT *, {_TOKENS}, row_number() OVER (
    ORDER BY invoice_id, invoice_date, amount, currency, quantity, fx_rate, vendor) AS pool_pos FROM ledger),
spoken AS MATERIALIZED (SELECT submission_id, unnest(toks) AS t FROM described),
written AS MATERIALIZED (SELECT pool_pos, unnest(toks) AS t FROM pooled),
frequent AS MATERIALIZED (
  SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) - 1 AS b FROM written GROUP BY t),
asked_bits AS MATERIALIZED (
  SELECT submission_id, any_value(len(d.toks)) AS n, {_SET_BITS}
  FROM spoken LEFT JOIN frequent f ON f.t = spoken.t AND b < {62 * _MASKS} JOIN described d USING (submission_id) GROUP BY submission_id),
ledger_bits AS MATERIALIZED (
  SELECT pool_pos, any_value(len(p.toks)) AS n, {_SET_BITS}
  FROM written LEFT JOIN frequent f ON f.t = written.t AND b < {62 * _MASKS} JOIN pooled p USING (pool_pos) GROUP BY pool_pos),
rare_pairs AS MATERIALIZED (
  SELECT s.submission_id, w.pool_pos, count(*) AS c FROM spoken s JOIN written w ON w.t = s.t
  JOIN frequent f ON f.t = s.t AND b >= {62 * _MASKS} GROUP BY s.submission_id, w.pool_pos),
by_bits AS MATERIALIZED (
  SELECT submission_id, list_min(max(({_SHARED_BITS}) / sqrt(q.n * r.n), {{top_k}})) AS least
  FROM asked_bits q, ledger_bits r GROUP BY submission_id),
bounded AS MATERIALIZED (SELECT q.*, least FROM asked_bits q JOIN by_bits USING (submission_id)),
open_pairs AS MATERIALIZED (
  SELECT q.submission_id, r.pool_pos FROM bounded q, ledger_bits r WHERE ({_SHARED_BITS}) / sqrt(q.n * r.n) >= least
  UNION SELECT submission_id, pool_pos FROM rare_pairs),
scored AS MATERIALIZED (
  SELECT q.submission_id, p.invoice_id AS l_id, r.pool_pos, ({_SHARED_BITS} + coalesce(c, 0)) / sqrt(q.n * r.n) AS raw
  FROM open_pairs o JOIN asked_bits q USING (submission_id) JOIN ledger_bits r USING (pool_pos)
  JOIN pooled p USING (pool_pos) LEFT JOIN rare_pairs x USING (submission_id, pool_pos)),
"""
    + """retrieved AS MATERIALIZED (
  SELECT *, """
    + _r("raw")
    + """ AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY raw DESC, pool_pos) AS rank
    FROM scored) WHERE rank <= {top_k})"""
)

PROMOTED = """promoted AS MATERIALIZED (
  SELECT submission_id, CAST(row_number() OVER (PARTITION BY submission_id
           ORDER BY is_id DESC, rank) AS INTEGER) AS pos, CAST(rank AS INTEGER) AS rank,
         score, l_id
  FROM (
    SELECT r.submission_id, r.rank, r.score, r.l_id,
      CASE WHEN r.l_id = s.invoice_id THEN 1 ELSE 0 END AS is_id
    FROM retrieved r JOIN described s USING (submission_id)
    UNION ALL
    SELECT s.submission_id, 1, 1.0, l.invoice_id, 1
    FROM described s JOIN ledger l ON l.invoice_id = s.invoice_id
    LEFT JOIN retrieved r ON r.submission_id = s.submission_id AND r.l_id = l.invoice_id
    WHERE r.rank IS NULL))"""

REPAIRED = """repaired AS (
  SELECT s.submission_id, s.k, s.scenario, s.invoice_id, s.invoice_date, s.vendor, s.currency,
    s.fx_rate,
    CASE WHEN fix_amount THEN l_amount ELSE s.amount END AS amount,
    CASE WHEN fix_quantity THEN l_quantity ELSE s.quantity END AS quantity,
    fix_amount, fix_quantity
  FROM (
    SELECT m.*, l.amount AS l_amount, l.quantity AS l_quantity,
      coalesce(abs(m.amount - l.amount) > 0.02
        AND ends_with(format('{:.2f}', m.amount), format('{:.2f}', l.amount))
        AND length(format('{:.2f}', m.amount)) - length(format('{:.2f}', l.amount))
            BETWEEN 1 AND 3, FALSE) AS fix_amount,
      coalesce(m.quantity = 1 AND l.quantity > 1, FALSE) AS fix_quantity
    FROM misread m LEFT JOIN ledger l ON l.invoice_id = m.invoice_id) s)"""

# The full ladder over promoted candidates; {source} holds the submissions.
LADDER = (
    """best AS (
  SELECT s.*, b.score AS best_score, b.l_id, n.score AS second_score,
    l.vendor AS l_vendor, l.invoice_date AS l_date, l.amount AS l_amount,
    l.currency AS l_currency, l.quantity AS l_quantity, l.fx_rate AS l_fx,
    coalesce(s.invoice_id = l.invoice_id
      OR (lower(trim(s.vendor)) = lower(trim(l.vendor)) AND s.invoice_date = l.invoice_date),
      FALSE) AS same
  FROM {source} s
  LEFT JOIN promoted b ON b.submission_id = s.submission_id AND b.pos = 1
  LEFT JOIN promoted n ON n.submission_id = s.submission_id AND n.pos = 2
  LEFT JOIN ledger l ON l.invoice_id = b.l_id),
laddered AS (
  SELECT submission_id, scenario, l_id,
    CASE WHEN best_score IS NULL OR best_score < 0.75 THEN 'unmatched'
      WHEN NOT same AND best_score - second_score < 0.03 THEN 'ambiguous'
      WHEN NOT same THEN 'unmatched'
      WHEN currency <> l_currency THEN 'currency_mismatch'
      WHEN quantity <> l_quantity THEN 'quantity_mismatch'
      WHEN abs(l_fx - fx_rate) / l_fx > 0.005 THEN 'fx_mismatch'
      WHEN abs(round(amount - l_amount, 2)) > 0.02 THEN 'amount_mismatch'
      ELSE 'matched' END AS status,
    CASE WHEN best_score IS NULL THEN 1.0
      WHEN best_score < 0.75 THEN """
    + _r("1 - best_score")
    + """
      WHEN NOT same AND best_score - second_score < 0.03 THEN best_score
      WHEN NOT same THEN """
    + _r("1 - best_score")
    + """
      ELSE best_score END AS confidence
  FROM best)"""
)


def _search(source: str, top_k: int) -> str:
    return SEARCH.replace("{source}", source).replace("{top_k}", str(top_k))


def _search_all(source: str, top_k: int) -> str:
    return SEARCH_ALL.replace("{source}", source).replace("{top_k}", str(top_k))


def _ladder(source: str) -> str:
    return LADDER.replace("{source}", source)


#: Misread submissions that also lose their id, date, or several fields at once.
DOUBTFUL = (
    MISREAD.replace("misread AS", "readable AS", 1),
    """misread AS (
  SELECT * REPLACE (
    CASE WHEN k % 2 = 0 THEN replace(invoice_id, 'INV-', 'INV-9') ELSE invoice_id END AS invoice_id,
    CASE WHEN k % 3 = 0 THEN CAST(invoice_date + INTERVAL 1 DAY AS DATE) ELSE invoice_date END
      AS invoice_date,
    CASE WHEN k % 8 = 0 THEN 'MYR' ELSE currency END AS currency,
    CASE WHEN k % 8 = 0 THEN quantity + 50 ELSE quantity END AS quantity,
    CASE WHEN k % 8 = 0 THEN (round(amount * 100) + 123450) / 100 ELSE amount END AS amount,
    CASE WHEN k % 16 = 0 THEN 1.75::DOUBLE ELSE fx_rate END AS fx_rate) FROM readable)""",
)

CHECKED = """checked AS (
  SELECT s.submission_id, s.scenario, TRUE AS ok_invoice_id, TRUE AS ok_invoice_date,
    TRUE AS ok_vendor, abs(m.amount - s.amount) <= 0.02 AS ok_amount, TRUE AS ok_currency,
    m.quantity = s.quantity AS ok_quantity, abs(m.fx_rate - s.fx_rate) <= 0.0001 AS ok_fx_rate
  FROM misread m JOIN subs s USING (submission_id))"""

FIELDS = ["invoice_id", "invoice_date", "vendor", "amount", "currency", "quantity", "fx_rate"]
ALL_OK = " AND ".join(f"ok_{f}" for f in FIELDS)


def _share(condition: str) -> str:
    return _r(f"count(*) FILTER (WHERE {condition}) / CAST(count(*) AS DOUBLE)")


def _report(cases: str, labels: list[str] | None = None) -> str:
    """Class report of a table expression with ``expected`` and ``predicted``."""
    if labels:
        universe = " UNION ALL ".join(f"SELECT '{v}' AS label" for v in labels)
    else:
        universe = f"SELECT expected AS label FROM {cases} UNION SELECT predicted FROM {cases}"
    return f"""per AS (
  SELECT u.label,
    (SELECT count(*) FROM {cases} c WHERE c.expected = u.label AND c.predicted = u.label) AS tp,
    (SELECT count(*) FROM {cases} c WHERE c.predicted = u.label) AS np,
    (SELECT count(*) FROM {cases} c WHERE c.expected = u.label) AS support
  FROM ({universe}) u),
ratios AS (
  SELECT label, support,
    CASE WHEN np = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / np END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
    CASE WHEN np + support = 0 THEN 0.0 ELSE 2.0 * tp / (np + support) END AS f1
  FROM per)
SELECT label, {_r("precision")} AS precision, {_r("recall")} AS recall, {_r("f1")} AS f1,
  CAST(support AS BIGINT) AS support FROM ratios
UNION ALL
SELECT 'macro avg', {_r("avg(precision)")}, {_r("avg(recall)")}, {_r("avg(f1)")},
  CAST(sum(support) AS BIGINT) FROM ratios
UNION ALL
SELECT 'weighted avg', {_r("sum(precision * support) / sum(support)")},
  {_r("sum(recall * support) / sum(support)")}, {_r("sum(f1 * support) / sum(support)")},
  CAST(sum(support) AS BIGINT) FROM ratios"""


NEIGHBOURS = (
    """vecs AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings),
near AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, a.label AS expected,
    b.label AS predicted, list_inner_product(a.v, b.v) AS raw
  FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id),
ranked AS (
  SELECT *, """
    + _r("raw")
    + """ AS score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, neighbour_id)
         AS INTEGER) AS rank FROM near),
first_near AS (SELECT * FROM ranked WHERE rank = 1)"""
)

SPLIT = """split AS (
  SELECT submission_id, scenario,
    CASE WHEN row_number() OVER (PARTITION BY scenario
             ORDER BY md5(concat('42:', submission_id)), submission_id)
           <= greatest(1, round_even(count(*) OVER (PARTITION BY scenario) * 0.3, 0))
         THEN 'heldout' ELSE 'development' END AS split
  FROM subs)"""

STATUSES = [
    "matched",
    "duplicate_charge",
    "fx_mismatch",
    "quantity_mismatch",
    "amount_mismatch",
    "currency_mismatch",
    "unmatched",
    "ambiguous",
]
HELDOUT = ["matched", "amount_mismatch", "fx_mismatch", "quantity_mismatch", "duplicate_charge"]
STATELESS = "CASE WHEN scenario = 'duplicate_charge' THEN 'matched' ELSE scenario END"


def _matrix(cases: str, labels: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{v}' AS expected" for v in labels)
    columns = ",\n  ".join(
        f"count(*) FILTER (WHERE c.predicted = '{v}') AS \"as_{v}\"" for v in labels
    )
    return f"""SELECT u.expected, {columns}
FROM ({rows}) u LEFT JOIN {cases} c ON c.expected = u.expected GROUP BY u.expected"""


NOISY = r"""noisy AS (
  SELECT k, invoice_date, amount, k % 12 AS style,
    format('{:.2f}', amount) AS plain, format('{:,.2f}', amount) AS grouped
  FROM ledger)"""

# Currency by stand-alone code, letters of any script counting as letters.
_CODES = "\n".join(
    rf"    WHEN regexp_matches(upper(text), '(^|[^\p{{L}}\p{{N}}_]){c}($|[^\p{{L}}\p{{N}}_])') THEN '{c}'"
    for c in ["EUR", "USD", "GBP", "PLN", "MYR"]
)
_MARKERS = """    WHEN contains({t}, 'EUR') OR contains({t}, '€') THEN 'EUR'
    WHEN contains({t}, 'USD') OR contains({t}, '$') THEN 'USD'
    WHEN contains({t}, 'GBP') OR contains({t}, '£') THEN 'GBP'
    WHEN contains({t}, 'PLN') OR contains({t}, 'ZŁ') OR contains({t}, 'ZL') THEN 'PLN'
    WHEN contains({t}, 'MYR') OR contains({t}, 'RM') THEN 'MYR'"""

TOKENS = """toks AS (
  SELECT doc_id, pos, text, CAST((length(text) * 13 + pos) % 101 AS DOUBLE) AS conf,
    CAST(pos // 400 AS INTEGER) AS block_num, CAST((pos // 40) % 10 AS INTEGER) AS par_num,
    CAST((pos // 10) % 4 AS INTEGER) AS line_num
  FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS text
        FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))"""
_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"

ITEMS = """unified AS (
  SELECT k, amount, fx_rate, 0 AS n,
    CASE k % 3 WHEN 0 THEN 'Item A' WHEN 1 THEN 'Item B' ELSE 'Professional services' END
      AS description, quantity AS qty,
    CASE WHEN k % 3 < 2 THEN CAST((c - c % quantity) / quantity AS BIGINT) / 100.0
      ELSE @PRICE@ END AS price
  FROM (SELECT *, CAST(round(amount * 100) AS BIGINT) AS c FROM ledger)
  UNION ALL
  SELECT k, amount, fx_rate, 1, 'Fee', 1, 2.5 FROM ledger WHERE k % 3 = 1)""".replace(
    "@PRICE@", _r_printed("amount / greatest(quantity * fx_rate, 1)", 2)
)

ORACLE: dict[str, str] = {}

# --- sources and sinks -------------------------------------------------------

ORACLE["ledger_view"] = _with(LEDGER) + f"SELECT k, {RECORD} FROM ledger"
ORACLE["ledger_scan"] = _with(LEDGER) + f"SELECT {RECORD} FROM ledger"
ORACLE["ledger_scan_vendor"] = (
    _with(LEDGER)
    + f"""SELECT {RECORD} FROM (SELECT * FROM ledger WHERE vendor = 'Customer#000000007'
ORDER BY invoice_id, invoice_date, amount LIMIT 60)"""
)
ORACLE["ledger_adhoc_sql"] = (
    _with(LEDGER)
    + """SELECT vendor, currency, count(*) AS invoices,
  CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS cents
FROM ledger WHERE amount >= 1000 GROUP BY vendor, currency"""
)
ORACLE["audit_events"] = (
    _with(*INVOICES, DECIDED)
    + f"""SELECT sha256(concat('run-1:', submission_id)) AS audit_event_id, 'run-1' AS run_id,
  invoice_id, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, amount,
  status AS reconciliation_status, CAST(1 AS DOUBLE) AS confidence, l_id AS best_match_invoice_id,
  {DETAILS_JSON} AS discrepancy_details_json, '{{}}' AS investigation_json,
  CAST(NULL AS VARCHAR) AS dispute_letter_draft
FROM decided"""
)
ORACLE["audit_partitioned_scan"] = (
    _with(EVENT_HISTORY)
    + """SELECT strftime(ts, '%Y-%m-%d') AS event_date, status AS reconciliation_status,
  count(*) AS events
FROM history WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'
GROUP BY ALL"""
)
ORACLE["manifest_flatten"] = (
    _with(LEDGER, VARIANTS)
    + f"""SELECT concat('case-', k) AS case_id, scenario,
  concat('[{{"description":"Services","qty":', quantity, ',"price":1.5}}]') AS line_items, {RECORD}
FROM scen"""
)
ORACLE["ledger_replace"] = (
    _with(LEDGER)
    + """SELECT currency, count(*) AS invoices FROM ledger
WHERE currency IN ('EUR', 'USD') GROUP BY currency"""
)

# --- predicates and projections ----------------------------------------------

ORACLE["record_coerce"] = (
    _with(*INVOICES, RAW)
    + """SELECT *, (invoice_date IS NULL OR vendor IS NULL OR amount IS NULL OR quantity IS NULL)
  AS rejected FROM raw"""
)
ORACLE["validate_fields"] = (
    _with(*INVOICES)
    + """SELECT submission_id, k % 17 <> 0 AS valid_invoice_id, k % 19 <> 0 AS valid_vendor,
  k % 23 <> 0 AS valid_invoice_date,
  k % 29 <> 0 AND amount > 0 AND amount < 10000000 AS valid_amount,
  k % 31 <> 0 AS valid_currency, k % 37 <> 0 AND quantity BETWEEN 1 AND 10000 AS valid_quantity,
  k % 41 <> 0 AS valid_fx_rate
FROM subs"""
)
ORACLE["split_complete"] = (
    _with(*INVOICES, RAW)
    + """SELECT submission_id, CASE WHEN invoice_date IS NULL OR vendor IS NULL OR amount IS NULL
  OR quantity IS NULL THEN 'exception' ELSE 'reconcile' END AS route FROM raw"""
)
ORACLE["split_outcome"] = (
    _with(*INVOICES, DECIDED)
    + """SELECT submission_id, CASE WHEN status = 'matched' THEN 'audit' ELSE 'exception' END
  AS route FROM decided"""
)
ORACLE["identity_predicate"] = (
    _with(*INVOICES, POOL)
    + """SELECT s.submission_id, count(*) AS candidates,
  count(*) FILTER (WHERE s.invoice_id = p.invoice_id OR s.invoice_date = p.invoice_date)
    AS same_identity
FROM subs s JOIN pool p ON p.vendor = s.vendor GROUP BY s.submission_id"""
)
ORACLE["identity_counts"] = (
    _with(*INVOICES, """asked AS (
  SELECT submission_id, invoice_id, invoice_date,
    CASE WHEN submission_id % 10 = 0 THEN 'someone else' ELSE lower(vendor) END AS vendor FROM subs),
by_id AS (
  SELECT a.submission_id, l.k FROM asked a JOIN ledger l ON l.invoice_id = a.invoice_id),
by_vendor AS (
  SELECT a.submission_id, l.k FROM asked a JOIN ledger l ON lower(l.vendor) = a.vendor AND l.invoice_date = a.invoice_date),
either AS (SELECT * FROM by_id UNION SELECT * FROM by_vendor)""")
    + """SELECT submission_id, coalesce(i, 0) AS same_id, coalesce(v, 0) AS same_vendor_date, coalesce(e, 0) AS same_identity
FROM asked
LEFT JOIN (SELECT submission_id, count(*) AS i FROM by_id GROUP BY submission_id) USING (submission_id)
LEFT JOIN (SELECT submission_id, count(*) AS v FROM by_vendor GROUP BY submission_id) USING (submission_id)
LEFT JOIN (SELECT submission_id, count(*) AS e FROM either GROUP BY submission_id) USING (submission_id)"""
)
ORACLE["report_read"] = (
    _with(*INVOICES, DECIDED)
    + f"""SELECT expected, count(*) AS cases, count(*) FILTER (WHERE expected = status) AS correct,
  min(submission_id) AS first_case, CAST(1 AS DOUBLE) AS least_confidence
FROM (SELECT *, {STATELESS} AS expected FROM decided) GROUP BY expected"""
)
ORACLE["compare_fields"] = (
    _with(*INVOICES, MISREAD, CHECKED)
    + f"SELECT submission_id, {', '.join(f'ok_{f}' for f in FIELDS)} FROM checked"
)
ORACLE["compare_doubtful"] = (
    _with(*INVOICES, *DOUBTFUL)
    + """SELECT m.submission_id, m.invoice_id = s.invoice_id AS ok_invoice_id,
  m.k % 9 <> 1 AS ok_vendor, m.invoice_date = s.invoice_date AS ok_invoice_date,
  m.k % 25 <> 0 AND abs(m.amount - s.amount) <= 0.02 AS ok_amount,
  m.currency = s.currency AS ok_currency, m.quantity = s.quantity AS ok_quantity,
  abs(m.fx_rate - s.fx_rate) <= 0.0001 AS ok_fx_rate
FROM misread m JOIN subs s USING (submission_id)"""
)
ORACLE["field_fallback"] = (
    _with(*INVOICES)
    + """SELECT submission_id,
  CASE WHEN k % 19 = 0 AND k % 57 = 0 THEN '4 u' ELSE vendor END AS vendor,
  strftime(invoice_date, '%Y-%m-%d') AS invoice_date,
  amount,
  concat_ws(',', CASE WHEN k % 19 = 0 AND k % 57 <> 0 THEN 'vendor' END,
    CASE WHEN k % 23 = 0 THEN 'invoice_date' END,
    CASE WHEN k % 29 = 0 THEN 'amount' END) AS replaced
FROM subs"""
)

# --- candidates --------------------------------------------------------------

ORACLE["match_exact_id"] = (
    _with(*INVOICES)
    + """SELECT s.submission_id, l.invoice_id AS ledger_invoice_id, l.amount AS ledger_amount
FROM subs s LEFT JOIN ledger l ON lower(l.invoice_id) = lower(s.invoice_id)"""
)
ORACLE["vendor_candidates"] = (
    _with(*INVOICES, POOL)
    + """SELECT s.submission_id, s.vendor, CAST(p.pool_pos AS INTEGER) AS pool_pos,
  p.invoice_id AS candidate_invoice_id
FROM subs s JOIN pool p ON p.vendor = s.vendor AND p.pool_pos <= 60"""
)
ORACLE["match_vendor_date"] = (
    _with(*INVOICES)
    + """SELECT s.submission_id, l.invoice_id AS ledger_invoice_id
FROM subs s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY vendor, invoice_date ORDER BY amount, currency,
    quantity, fx_rate, invoice_id) AS n FROM ledger) l
ON l.vendor = s.vendor AND l.invoice_date = s.invoice_date AND l.n = 1"""
)
ORACLE["match_identity"] = (
    _with(*INVOICES)
    + """SELECT s.submission_id, coalesce(e.invoice_id, w.invoice_id) AS ledger_invoice_id
FROM subs s
LEFT JOIN ledger e ON e.invoice_id = s.invoice_id AND s.k % 3 <> 0
LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY vendor, invoice_date ORDER BY amount, currency,
    quantity, fx_rate, invoice_id) AS n FROM ledger) w
ON w.vendor = s.vendor AND w.invoice_date = s.invoice_date AND w.n = 1"""
)
ORACLE["knn_topk"] = (
    _with(NEIGHBOURS)
    + "SELECT query_id, rank, neighbour_id, score FROM ranked WHERE rank <= 3"
)
ORACLE["knn_vendor_pool"] = (
    _with(*INVOICES, POOL)
    + f"""SELECT submission_id, CAST(n AS INTEGER) AS pos, {_r("raw")} AS semantic_score,
  l_id AS ledger_invoice_id
FROM (
  SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY raw DESC, pool_pos) AS n
  FROM (
    SELECT s.submission_id, p.pool_pos, p.invoice_id AS l_id,
      list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS raw
    FROM subs s JOIN pool p ON p.vendor = s.vendor
    JOIN embeddings a ON a.vec_id = (s.k + 1) % (SELECT count(*) FROM embeddings)
    JOIN embeddings b ON b.vec_id = p.k % (SELECT count(*) FROM embeddings)))
WHERE n <= 3"""
)
ORACLE["ambiguity_gap"] = (
    _with(NEIGHBOURS)
    + f"""SELECT query_id, best, second, {_r("best - second")} AS gap,
  {_r("best - second")} < 0.03 AS ambiguous
FROM (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS best,
        max(score) FILTER (WHERE rank = 2) AS second FROM ranked GROUP BY query_id)"""
)
_RETRIEVED = (*INVOICES, MISREAD, POOL, _search("misread", 3))
ORACLE["candidate_report"] = (
    _with(*_RETRIEVED)
    + f"""SELECT r.submission_id, CAST(r.rank AS INTEGER) AS rank, r.score AS semantic_score,
  r.l_id AS ledger_invoice_id, l.vendor AS ledger_vendor,
  {_money("l.amount", "l.currency")} AS ledger_total
FROM retrieved r JOIN ledger l ON l.invoice_id = r.l_id"""
)
ORACLE["promote_identity"] = (
    _with(*_RETRIEVED, PROMOTED)
    + """SELECT submission_id, pos, rank, score AS semantic_score, l_id AS ledger_invoice_id
FROM promoted"""
)
ORACLE["candidates_nested"] = (
    _with(*_RETRIEVED, PROMOTED)
    + """SELECT submission_id, CAST(count(*) AS INTEGER) AS n,
  string_agg(l_id, ',' ORDER BY pos) AS ledger_invoice_ids
FROM promoted GROUP BY submission_id"""
)
ORACLE["record_text"] = (
    _with(*INVOICES)
    + """SELECT submission_id, concat('vendor: ', vendor, ' | invoice id: ', invoice_id,
  ' | date: ', invoice_date, ' | amount: ', format('{:.2f}', amount), ' ', currency,
  ' | quantity: ', quantity, ' | fx rate: ', format('{:.4f}', fx_rate),
  ' | line items: []') AS record_text
FROM subs"""
)

# --- repair, ladder, duplicates ----------------------------------------------

ORACLE["ledger_repair"] = (
    _with(*INVOICES, MISREAD, REPAIRED)
    + """SELECT submission_id, amount, quantity,
  concat_ws(',', CASE WHEN fix_amount THEN 'amount' END,
    CASE WHEN fix_quantity THEN 'quantity' END) AS repaired
FROM repaired"""
)
ORACLE["classify_rules"] = (
    _with(*INVOICES, DECIDED)
    + """SELECT submission_id, scenario, status, CAST(1 AS DOUBLE) AS confidence,
  l_id AS best_match_invoice_id FROM decided"""
)
ORACLE["reconcile_submissions"] = (
    _with(*INVOICES, MISREAD, REPAIRED, POOL, _search("repaired", 3), PROMOTED, _ladder("repaired"))
    + """SELECT submission_id, scenario, status, confidence, l_id AS best_match_invoice_id
FROM laddered"""
)
ORACLE["reconcile_doubtful"] = (
    _with(
        *INVOICES,
        *DOUBTFUL,
        REPAIRED, POOL, _search("repaired", 3), PROMOTED, _ladder("repaired"),
    )
    + """SELECT submission_id, scenario, status, confidence, l_id AS best_match_invoice_id
FROM laddered"""
)
ORACLE["duplicate_lookup"] = (
    _with(EVENT_HISTORY)
    + """SELECT invoice_id, vendor, audit_event_id, run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY invoice_id, vendor
    ORDER BY ts DESC, audit_event_id DESC) AS n
  FROM history WHERE status = 'matched') WHERE n = 1"""
)
ORACLE["detect_duplicates"] = (
    _with(*INVOICES, DECIDED)
    + """SELECT submission_id,
  CASE WHEN status = 'matched' AND k % 3 = 0 THEN 'duplicate_charge' ELSE status END AS status,
  CAST(1 AS DOUBLE) AS confidence,
  CASE WHEN status = 'matched' AND k % 3 = 0 THEN concat('old-', k) END AS prior_audit_event_id
FROM decided"""
)
ORACLE["sequential_duplicates"] = (
    _with(*INVOICES, DECIDED, EXPLAINED)
    + "SELECT submission_id, scenario, final AS status FROM explained"
)

# --- exceptions, audit, approvals --------------------------------------------

_STORIES = (*INVOICES, DECIDED, EXPLAINED, TOLD)
ORACLE["investigate"] = (
    _with(*_STORIES)
    + """SELECT submission_id, root_cause, severity, summary, recommended_action, dispute_reason
FROM stories"""
)
ORACLE["draft_letters"] = (
    _with(*_STORIES)
    + f"""SELECT submission_id, CASE WHEN final = 'matched' THEN '' ELSE concat(
  'Subject: Question about invoice ', invoice_id, chr(10), chr(10), 'To ', vendor, ',',
  chr(10), chr(10), 'we could not settle your invoice dated ', invoice_date, ' over ',
  {_money("amount", "currency")}, '.', chr(10), chr(10), summary, chr(10), dispute_reason,
  chr(10), chr(10), 'Our next step: ', recommended_action, chr(10),
  'Please send documents or a corrected invoice.', chr(10), chr(10), 'Accounts Payable',
  chr(10)) END AS dispute_draft
FROM stories"""
)
ORACLE["exception_queue"] = (
    _with(*INVOICES, DECIDED)
    + f"""SELECT submission_id, invoice_id, status, CAST(1 AS DOUBLE) AS confidence,
  {DETAILS_JSON} AS details
FROM decided WHERE status <> 'matched'"""
)
ORACLE["review_history"] = (
    _with(EVENT_HISTORY)
    + f"""SELECT audit_event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_timestamp, invoice_id,
  vendor, status AS reconciliation_status, 'amount_mismatch' AS root_cause, 'high' AS severity,
  {_money("amount", "currency")} AS amount, concat(percent, '.0%') AS confidence,
  'Review required' AS review_status
FROM (SELECT * FROM history WHERE status = 'amount_mismatch'
      ORDER BY ts DESC, audit_event_id LIMIT 200)"""
)
ORACLE["json_filter"] = """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events
WHERE json_extract_string(props, '$.k') IN ('7', '42', '69')"""
ORACLE["open_review_gate"] = (
    _with(REVIEWS)
    + "SELECT invoice_id, environment, approval_event_id, reviewer_id FROM reviews"
)
ORACLE["approve_drafts"] = (
    _with(
        *INVOICES,
        DECIDED,
        REVIEWS,
        """requests AS (
  SELECT submission_id * 2 + n AS request_id, invoice_id,
    CASE WHEN k % 17 = 0 THEN 'empty draft' WHEN k % 19 = 0 THEN 'no audit event' END AS refused
  FROM decided JOIN (SELECT 0 AS n UNION ALL SELECT 1) ON n = 0 OR k % 5 = 0
  WHERE ends_with(status, '_mismatch'))""",
    )
    + """SELECT request_id, r.invoice_id, CASE WHEN refused IS NOT NULL THEN refused
  WHEN v.invoice_id IS NOT NULL THEN 'review already open'
  WHEN row_number() OVER (PARTITION BY r.invoice_id, refused ORDER BY request_id) > 1
    THEN 'review already open' ELSE 'approved' END AS outcome
FROM requests r LEFT JOIN reviews v
  ON v.invoice_id = r.invoice_id AND v.environment = 'local'"""
)

# Whatever could be approved is open once the log is read back.
ORACLE["approval_log"] = (
    "SELECT request_id, invoice_id, CASE outcome WHEN 'approved' THEN 'review already open' "
    f"ELSE outcome END AS outcome FROM ({ORACLE['approve_drafts']})"
)

# --- scoring -----------------------------------------------------------------

_ACCURACY = f"""SELECT count(*) AS total_cases,
  count(*) FILTER (WHERE expected = predicted) AS correct_cases,
  {_share("expected = predicted")} AS accuracy"""
_RULE_CASES = f"rule_cases AS (SELECT {STATELESS} AS expected, status AS predicted FROM decided)"

ORACLE["accuracy"] = _with(NEIGHBOURS) + _ACCURACY + " FROM first_near"
ORACLE["class_report"] = _with(NEIGHBOURS) + ", " + _report("first_near")
ORACLE["confusion_matrix"] = _with(NEIGHBOURS) + _matrix(
    "first_near", [str(n) for n in range(10)]
)
ORACLE["label_universe"] = (
    _with(*INVOICES, DECIDED, _RULE_CASES)
    + "SELECT expected AS label FROM rule_cases UNION SELECT predicted FROM rule_cases"
)
_CHECKS = (*INVOICES, MISREAD, CHECKED)
ORACLE["field_accuracy"] = (
    _with(*_CHECKS)
    + "SELECT count(*) AS total_cases, "
    + ", ".join(f"{_share(f'ok_{f}')} AS accuracy_ok_{f}" for f in FIELDS)
    + " FROM checked"
)
ORACLE["all_fields_accuracy"] = (
    _with(*_CHECKS)
    + f"SELECT count(*) AS total_cases, {_share(ALL_OK)} AS all_fields_exact_accuracy FROM checked"
)
_SURE = ["invoice_id", "invoice_date", "vendor", "currency"]
ORACLE["repair_lift"] = (
    _with(
        *INVOICES,
        MISREAD,
        REPAIRED,
        """lift AS (
  SELECT abs(m.amount - s.amount) <= 0.02 AS was_a, m.quantity = s.quantity AS was_q,
    abs(r.amount - s.amount) <= 0.02 AS now_a, r.quantity = s.quantity AS now_q
  FROM subs s JOIN misread m USING (submission_id) JOIN repaired r USING (submission_id))""",
    )
    + "SELECT count(*) AS total_cases, "
    + f"{_share('was_a AND was_q')} AS before_all_fields, "
    + f"{_share('now_a AND now_q')} AS after_all_fields, "
    + ", ".join(f"1.0::DOUBLE AS {p}_{f}" for p in ("before", "after") for f in _SURE)
    + f", {_share('was_a')} AS before_amount, {_share('was_q')} AS before_quantity"
    + f", {_share('now_a')} AS after_amount, {_share('now_q')} AS after_quantity FROM lift"
)
ORACLE["error_summary"] = (
    _with(
        *_CHECKS,
        """wrong AS (
  SELECT scenario, 'amount' AS field, NOT ok_amount AS bad FROM checked
  UNION ALL SELECT scenario, 'quantity', NOT ok_quantity FROM checked
  UNION ALL SELECT scenario, 'fx_rate', NOT ok_fx_rate FROM checked)""",
    )
    + f"""SELECT coalesce(scenario, 'ALL') AS scenario, field,
  count(*) FILTER (WHERE bad) AS failures, {_share("bad")} AS failure_rate
FROM wrong GROUP BY GROUPING SETS ((scenario, field), (field))
HAVING count(*) FILTER (WHERE bad) > 0"""
)
ORACLE["failed_cases"] = (
    _with(*_CHECKS)
    + f"""SELECT submission_id, scenario, concat_ws(',',
  CASE WHEN NOT ok_amount THEN 'amount' END, CASE WHEN NOT ok_quantity THEN 'quantity' END,
  CASE WHEN NOT ok_fx_rate THEN 'fx_rate' END) AS incorrect_fields
FROM checked WHERE NOT ({ALL_OK})"""
)
ORACLE["scenario_counts"] = (
    _with(*INVOICES) + "SELECT scenario, count(*) AS cases FROM subs GROUP BY scenario"
)
ORACLE["worst_cases"] = (
    _with(NEIGHBOURS)
    + """SELECT query_id AS submission_id, expected, predicted, score AS confidence
FROM first_near WHERE expected <> predicted ORDER BY score, query_id LIMIT 10"""
)
ORACLE["stratified_split"] = (
    _with(*INVOICES, SPLIT) + "SELECT submission_id, scenario, split FROM split"
)
ORACLE["split_distribution"] = (
    _with(*INVOICES, SPLIT) + "SELECT split, scenario, count(*) AS cases FROM split GROUP BY ALL"
)
ORACLE["metrics_rollup"] = (
    _with(*_CHECKS, DECIDED, _RULE_CASES)
    + f"""SELECT * FROM (SELECT count(*) AS extraction_cases,
  {_share(ALL_OK)} AS all_fields_exact_accuracy FROM checked),
(SELECT count(*) AS reconciliation_cases, {_share("expected = predicted")} AS accuracy
 FROM rule_cases)"""
)

# --- evaluation pipelines ----------------------------------------------------

_EVAL = (
    *INVOICES,
    """repaired AS (
  SELECT s.submission_id, s.k, s.scenario, s.invoice_id, s.invoice_date, s.vendor, s.currency,
    s.fx_rate,
    CASE WHEN abs(s.amount - l.amount) > 0.02
          AND ends_with(format('{:.2f}', s.amount), format('{:.2f}', l.amount))
          AND length(format('{:.2f}', s.amount)) - length(format('{:.2f}', l.amount))
              BETWEEN 1 AND 3 THEN l.amount ELSE s.amount END AS amount,
    CASE WHEN s.quantity = 1 AND l.quantity > 1 THEN l.quantity ELSE s.quantity END AS quantity
  FROM subs s LEFT JOIN ledger l ON l.invoice_id = s.invoice_id)""",
    _search_all("repaired", 5),
    PROMOTED,
    _ladder("repaired"),
    f"eval_cases AS (SELECT {STATELESS} AS expected, status AS predicted FROM laddered)",
)
# Search and ladder alone: ranks are positions, nothing is promoted or repaired.
_EVAL_RETRIEVAL = (
    *INVOICES,
    _search_all("subs", 5),
    "promoted AS (SELECT submission_id, rank AS pos, rank, score, l_id FROM retrieved)",
    _ladder("subs"),
    f"eval_cases AS (SELECT {STATELESS} AS expected, status AS predicted FROM laddered)",
)
ORACLE["eval_rules"] = _with(*INVOICES, DECIDED, _RULE_CASES) + ", " + _report("rule_cases")
ORACLE["eval_retrieval"] = _with(*_EVAL_RETRIEVAL) + ", " + _report("eval_cases")
ORACLE["eval_end_to_end"] = _with(*_EVAL) + _matrix("eval_cases", STATUSES)
ORACLE["eval_heldout"] = (
    _with(
        *_EVAL,
        SPLIT,
        """held AS (
  SELECT l.submission_id, l.scenario AS expected, l.status, s.invoice_id
  FROM laddered l JOIN split p USING (submission_id) JOIN subs s USING (submission_id)
  WHERE p.split = 'heldout'),
held_cases AS (
  SELECT expected, CASE WHEN status = 'matched' AND (
      invoice_id IN (SELECT invoice_id FROM held WHERE expected = 'duplicate_charge')
      OR row_number() OVER (PARTITION BY invoice_id, status ORDER BY submission_id) > 1)
    THEN 'duplicate_charge' ELSE status END AS predicted
  FROM held)""",
    )
    + ", "
    + _report("held_cases", HELDOUT)
)
ORACLE["eval_combined"] = (
    _with(*_EVAL_RETRIEVAL)
    + f"""SELECT * FROM (SELECT count(*) AS extraction_cases,
  CAST(1 AS DOUBLE) AS all_fields_exact_accuracy FROM subs),
({_ACCURACY} FROM eval_cases)"""
)

# --- text functions ----------------------------------------------------------

ORACLE["norm_text"] = r"""SELECT doc_id, trim(regexp_replace(replace(replace(lower(text), ',', ''),
  '.', ''), '\s+', ' ', 'g')) AS norm FROM documents"""
ORACLE["norm_alnum"] = """SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))
  AS norm FROM documents"""
ORACLE["parse_amount"] = (
    _with(LEDGER) + "SELECT k, CASE WHEN k % 4 = 3 THEN NULL ELSE amount END AS amount FROM ledger"
)
ORACLE["last_amount"] = (
    _with(LEDGER)
    + "SELECT k, CASE WHEN k % 12 % 3 = 0 THEN -amount ELSE amount END AS amount FROM ledger"
)
ORACLE["norm_numeric"] = (
    _with(LEDGER) + "SELECT k, format('{:.2f}', amount) AS numeric_text FROM ledger"
)
ORACLE["detect_currency"] = f"""SELECT doc_id, CASE
{_CODES}
{_MARKERS.format(t="upper(text)")}
    ELSE 'EUR' END AS currency FROM documents"""
ORACLE["norm_currency"] = f"""SELECT doc_id, CASE
{_MARKERS.format(t="upper(text)")}
    ELSE 'MYR' END AS currency FROM documents"""
# A day up to twelve in month/day/year order reads as day/month/year.
_SWAPPED = """CASE WHEN style = 10 AND day(invoice_date) <= 12
  THEN make_date(year(invoice_date), day(invoice_date), month(invoice_date))
  ELSE invoice_date END"""
ORACLE["parse_dates"] = (
    _with(LEDGER, NOISY)
    + f"""SELECT k, CASE WHEN style < 11 THEN strftime({_SWAPPED}, '%Y-%m-%d') END AS numeric_first,
  CASE WHEN style < 11 THEN strftime({_SWAPPED}, '%Y-%m-%d') END AS names_first FROM noisy"""
)
ORACLE["extract_date"] = (
    _with(LEDGER, NOISY)
    + f"""SELECT k, CASE WHEN style < 8 OR style = 10 THEN strftime({_SWAPPED}, '%Y-%m-%d') END
  AS invoice_date FROM noisy"""
)
ORACLE["extract_invoice_id"] = (
    _with(*INVOICES) + "SELECT submission_id, invoice_id FROM subs"
)
ORACLE["extract_vendor"] = (
    _with(*INVOICES)
    + """SELECT submission_id, CASE WHEN k % 2 = 0 THEN vendor
  ELSE concat('Currency: ', currency) END AS vendor FROM subs"""
)
ORACLE["extract_total"] = _with(*INVOICES) + "SELECT submission_id, amount FROM subs"
ORACLE["extract_quantity"] = (
    _with(*INVOICES)
    + """SELECT submission_id, CASE WHEN k % 4 = 0 THEN 1
  WHEN quantity > 999 THEN 1 ELSE quantity END AS quantity FROM subs"""
)
ORACLE["extract_fx_rate"] = _with(*INVOICES) + "SELECT submission_id, fx_rate FROM subs"
ORACLE["extract_fields"] = _with(*INVOICES) + f"SELECT submission_id, {RECORD} FROM subs"
ORACLE["chunk_words"] = (
    _with(WORDS)
    + """SELECT doc_id, CAST(pos // 8 AS INTEGER) AS n, string_agg(word, ' ' ORDER BY pos) AS line
FROM words GROUP BY doc_id, pos // 8"""
)
ORACLE["assemble_lines"] = (
    _with(TOKENS)
    + f"""SELECT doc_id, block_num, par_num, line_num,
  string_agg({_STRIPPED}, ' ' ORDER BY pos) AS line_text
FROM toks WHERE {_STRIPPED} <> '' GROUP BY ALL"""
)
ORACLE["doc_text"] = (
    _with(TOKENS)
    + f"""SELECT doc_id,
  coalesce(string_agg({_STRIPPED}, ' ' ORDER BY pos)
    FILTER (WHERE {_STRIPPED} <> '' AND conf >= 30), '') AS text,
  count(*) FILTER (WHERE {_STRIPPED} <> '' AND conf >= 30) AS n_words
FROM toks GROUP BY doc_id"""
)
ORACLE["doc_confidence"] = (
    _with(TOKENS)
    + f"""SELECT doc_id, count(*) FILTER (WHERE kept) AS n_words,
  coalesce({_r("avg(conf) FILTER (WHERE kept)", 2)}, 0) AS mean_confidence
FROM (SELECT *, {_STRIPPED} <> '' AND conf >= 30 AS kept FROM toks) GROUP BY doc_id"""
)
ORACLE["normalize_boxes"] = """SELECT CASE WHEN l_partkey % 97 = 0 THEN 'rejected'
  ELSE concat_ws(',', least(x0, x1), least(y0, y1), greatest(x0, x1), greatest(y0, y1)) END AS norm,
  count(*) AS boxes
FROM (SELECT l_partkey,
  least(1000, (l_partkey % 700) * 1000 // 640) AS x0,
  least(1000, (l_suppkey % 900) * 1000 // 960) AS y0,
  least(1000, (l_orderkey % 800) * 1000 // 640) AS x1,
  least(1000, CAST(l_quantity * 20 AS BIGINT) * 1000 // 960) AS y1 FROM lineitem)
GROUP BY ALL"""

# --- token labels ------------------------------------------------------------

ORACLE["token_checks"] = """SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS accepted
FROM documents"""
# A line resembles a name if some piece of the longer text shares a subsequence of at least 86 % with
# the shorter one.  Every piece is measured, one bit of a number per character of the shorter text;
# only pairs are left out whose shorter text has too few of its characters in the other at all.
ORACLE["fuzzy_vendor_match"] = (
    _with(
        *INVOICES,
        r"""read AS (
  SELECT submission_id, trim(regexp_replace(lower(translate(vendor, 'so', '50')), '[^a-z0-9]+', ' ', 'g'))
      AS name, unnest([vendor, 'INVOICE', concat('Invoice No.: ', invoice_id),
      concat('Invoice Date: ', invoice_date), concat('Currency: ', currency),
      concat('FX Rate: ', CAST(fx_rate AS DECIMAL(10,4))), 'Description Qty Unit Price Line Total',
      concat('Services ', quantity, ' ', CAST(amount AS DECIMAL(18,2))),
      concat('Subtotal ', CAST(amount AS DECIMAL(18,2))), 'Tax 0.00',
      concat('TOTAL DUE ', CAST(amount AS DECIMAL(18,2)), ' ', currency)]) AS line,
    generate_subscripts(range(11), 1) AS place
  FROM subs),
plain AS (
  SELECT submission_id, place, name,
    trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS line FROM read),
pairs AS (
  SELECT DISTINCT name, line FROM plain
  WHERE name <> '' AND length(line) >= 4 AND NOT contains(name, line)),
sides AS (
  SELECT name, line, name AS short, line AS long FROM pairs WHERE length(name) <= length(line)
  UNION ALL SELECT name, line, line, name FROM pairs WHERE length(line) <= length(name)),
likely AS (
  SELECT *, length(short) AS m, length(long) AS n FROM sides
  WHERE length(regexp_replace(short, concat('[^', long, ']'), '', 'g')) >= 0.75 * length(short)),
marks AS (
  SELECT name, line, m, n, (1::HUGEINT << m::INT) - 1 AS full_row,
    list_transform(string_split(long, ''), lambda ch: list_sum(list_transform(range(m), lambda p:
      CASE WHEN substr(short, p + 1, 1) = ch THEN 1::HUGEINT << p::INT ELSE 0::HUGEINT END))::HUGEINT) AS hits
  FROM likely),
pieces AS (
  SELECT name, line, m, full_row, least(start + m, n) - greatest(start, 0) AS size,
    hits[greatest(start, 0) + 1 : least(start + m, n)] AS hits
  FROM (SELECT *, unnest(range(1 - m, n)) AS start FROM marks)),
similar_pairs AS (
  SELECT DISTINCT name, line FROM pieces
  WHERE 200.0::DOUBLE * (m - bit_count(list_reduce(hits, lambda r, h:
      ((r + (r & h)) | (r - (r & h))) & full_row, full_row))) / (m + size) >= 86),
flagged AS (
  SELECT submission_id, place, (p.name <> '' AND p.line <> '' AND contains(p.name, p.line))
    OR s.line IS NOT NULL AS hit
  FROM plain p LEFT JOIN similar_pairs s ON s.name = p.name AND s.line = p.line)""",
    )
    + """SELECT submission_id, CAST(count(*) FILTER (WHERE hit) AS INTEGER) AS matching_lines,
  bool_or(hit AND place = 1) AS header_matches
FROM flagged GROUP BY submission_id"""
)
ORACLE["bio_labels"] = (
    _with(
        *INVOICES,
        r"""lines AS (
  SELECT submission_id, vendor, invoice_date, amount, string_split_regex(concat_ws(' ', vendor,
    'INVOICE Invoice No.:', invoice_id, 'Invoice Date:', invoice_date, 'Currency:', currency,
    'FX Rate:', CAST(fx_rate AS DECIMAL(10,4)), 'Description Qty Unit Price Line Total Services',
    quantity, CAST(amount AS DECIMAL(18,2)), 'Subtotal', CAST(amount AS DECIMAL(18,2)),
    'Tax 0.00 TOTAL DUE', CAST(amount AS DECIMAL(18,2)), currency), '\s+') AS w
  FROM subs),
marks AS (
  SELECT *, regexp_replace(lower(word), '[^a-z0-9]+', ' ', 'g') AS norm FROM (
    SELECT submission_id, vendor, invoice_date, amount, generate_subscripts(w, 1) AS pos,
      unnest(w) AS word FROM lines)),
kinds AS (
  SELECT submission_id, pos,
    trim(norm) <> '' AND contains(trim(regexp_replace(lower(vendor), '[^a-z0-9]+', ' ', 'g')),
      trim(norm)) AS is_vendor,
    word = CAST(invoice_date AS VARCHAR) AS is_date,
    word = CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS is_total
  FROM marks),
firsts AS (
  SELECT *, min(pos) FILTER (WHERE is_vendor) OVER d AS v, min(pos) FILTER (WHERE is_date) OVER d
    AS dt, min(pos) FILTER (WHERE is_total) OVER d AS t
  FROM kinds WINDOW d AS (PARTITION BY submission_id)),
named AS (
  SELECT submission_id, pos, CASE
    WHEN is_vendor THEN CASE WHEN pos = v THEN 1 ELSE 2 END
    WHEN is_date THEN CASE WHEN pos = dt THEN 3 ELSE 4 END
    WHEN is_total THEN CASE WHEN pos = t THEN 5 ELSE 6 END ELSE 0 END AS label_id
  FROM firsts)""",
    )
    + """SELECT submission_id, string_agg(['O', 'B-VENDOR', 'I-VENDOR', 'B-DATE', 'I-DATE',
  'B-TOTAL', 'I-TOTAL'][label_id + 1], ' ' ORDER BY pos) AS labels,
  string_agg(CAST(label_id AS VARCHAR), ' ' ORDER BY pos) AS label_ids
FROM named GROUP BY submission_id"""
)
ORACLE["bio_spans"] = (
    _with(WORDS, _spans("true_spans", "label"))
    + "SELECT doc_id, entity_type, text, score, start_word, end_word FROM true_spans"
)
ORACLE["first_subtoken"] = (
    _with(WORDS)
    + """SELECT doc_id, CAST(pos AS INTEGER) AS word,
  CASE WHEN pos % 9 = 0 THEN 'O' ELSE label END AS label,
  CASE WHEN pos % 9 = 0 THEN 0.0 ELSE sixtyfourths / 64.0::DOUBLE END AS score
FROM tagged"""
)
ORACLE["training_labels"] = (
    _with(WORDS)
    + """SELECT doc_id, string_agg(concat(CASE label WHEN 'O' THEN 0 WHEN 'B-VENDOR' THEN 1
    WHEN 'I-VENDOR' THEN 2 WHEN 'B-DATE' THEN 3 WHEN 'I-DATE' THEN 4 WHEN 'B-TOTAL' THEN 5
    ELSE 6 END, repeat(' -100', (length(word) + 3) // 4 - 1)), ' ' ORDER BY pos) AS label_ids
FROM tagged GROUP BY doc_id"""
)
ORACLE["label_distribution"] = (
    _with(WORDS) + "SELECT split, label, count(*) AS n FROM tagged GROUP BY ALL"
)
ORACLE["entity_coverage"] = (
    _with(WORDS)
    + f"""SELECT split, entity_type, count(*) FILTER (WHERE has) AS documents, count(*) AS total,
  {_share("has")} AS coverage
FROM (SELECT d.lang AS split, d.doc_id, e.entity_type,
        EXISTS (SELECT 1 FROM words w WHERE w.doc_id = d.doc_id AND w.kind = e.entity_type) AS has
      FROM documents d, (SELECT unnest(['VENDOR', 'DATE', 'TOTAL']) AS entity_type) e)
GROUP BY ALL"""
)
ORACLE["class_weights"] = (
    _with(
        WORDS,
        """names AS (
  SELECT unnest(range(7)) AS label_id, unnest(['O', 'B-VENDOR', 'I-VENDOR', 'B-DATE', 'I-DATE',
    'B-TOTAL', 'I-TOTAL']) AS label),
counts AS (
  SELECT label, count(*) AS n FROM tagged WHERE pos % 13 <> 0 GROUP BY label)""",
    )
    + f"""SELECT CAST(label_id AS INTEGER) AS label_id, label, coalesce(n, 0) AS n,
  CASE WHEN label = 'O' THEN 1.0 WHEN n IS NULL THEN 25.0 ELSE least(25.0,
    {_r("CAST((SELECT n FROM counts WHERE label = 'O') AS DOUBLE) / n")}) END AS weight
FROM names LEFT JOIN counts USING (label)"""
)
ORACLE["missing_label_rates"] = (
    _with(WORDS)
    + f"""SELECT split, count(*) FILTER (WHERE lacks) AS missing, count(*) AS total,
  {_share("lacks")} AS rate
FROM (SELECT d.lang AS split, NOT EXISTS (SELECT 1 FROM words w
        WHERE w.doc_id = d.doc_id AND w.kind = 'TOTAL') AS lacks FROM documents d)
GROUP BY split"""
)
ORACLE["missing_label_docs"] = (
    _with(
        WORDS,
        """lacking AS (
  SELECT d.lang AS split, d.doc_id,
    CAST(row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS INTEGER) AS nth
  FROM documents d WHERE NOT EXISTS (
    SELECT 1 FROM words w WHERE w.doc_id = d.doc_id AND w.kind = 'DATE')),
digits AS (
  SELECT doc_id, pos, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM words WHERE regexp_matches(word, '[0-9]'))""",
    )
    + """SELECT l.split, l.doc_id, l.nth,
  coalesce(string_agg(g.word, ' ' ORDER BY g.pos), '') AS digit_words
FROM lacking l LEFT JOIN digits g ON g.doc_id = l.doc_id AND g.n <= 30
WHERE l.nth <= 15 GROUP BY ALL"""
)
ORACLE["o_ratio"] = (
    _with(WORDS)
    + f"""SELECT count(*) AS tokens, {_share("predicted = 'O'")} AS predicted_o_ratio,
  {_share("label = 'O'")} AS true_o_ratio FROM tagged"""
)
ORACLE["span_metrics"] = (
    _with(
        WORDS,
        _spans("true_spans", "label"),
        _spans("guessed_spans", "predicted"),
        """kinds AS (SELECT unnest(['ALL', 'VENDOR', 'DATE', 'TOTAL']) AS kind),
sums AS (
  SELECT kind,
    (SELECT count(*) FROM true_spans t WHERE kind IN ('ALL', t.entity_type)) AS nt,
    (SELECT count(*) FROM guessed_spans g WHERE kind IN ('ALL', g.entity_type)) AS np,
    (SELECT count(*) FROM true_spans t JOIN guessed_spans g
       USING (doc_id, entity_type, start_word, end_word)
     WHERE kind IN ('ALL', entity_type)) AS tp
  FROM kinds)""",
    )
    + f"""SELECT kind AS entity_type,
  CASE WHEN np = 0 THEN 0 ELSE {_r("CAST(tp AS DOUBLE) / np")} END AS precision,
  CASE WHEN nt = 0 THEN 0 ELSE {_r("CAST(tp AS DOUBLE) / nt")} END AS recall,
  CASE WHEN np + nt = 0 THEN 0 ELSE {_r("2.0 * tp / (np + nt)")} END AS f1,
  CAST(nt AS BIGINT) AS support
FROM sums"""
)
ORACLE["token_accuracy"] = (
    _with(WORDS)
    + f"SELECT count(*) AS tokens, {_share('predicted = label')} AS accuracy FROM tagged"
)
ORACLE["best_label"] = """SELECT vec_id, CAST(list_position(CAST(embedding AS FLOAT[]),
  list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings"""
ORACLE["best_spans"] = (
    _with(
        WORDS,
        _spans("true_spans", "label"),
        """tops AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type
      ORDER BY score DESC, start_word) AS n FROM true_spans) WHERE n = 1),
wide AS (
  SELECT d.doc_id, d.text AS raw, v.text AS vendor, t.text AS total_text, a.text AS date_text,
    (coalesce(v.score, 0) + coalesce(a.score, 0) + coalesce(t.score, 0)) / nullif(
      (v.score IS NOT NULL)::INT + (a.score IS NOT NULL)::INT + (t.score IS NOT NULL)::INT, 0)
      AS mean
  FROM documents d
  LEFT JOIN tops v ON v.doc_id = d.doc_id AND v.entity_type = 'VENDOR'
  LEFT JOIN tops a ON a.doc_id = d.doc_id AND a.entity_type = 'DATE'
  LEFT JOIN tops t ON t.doc_id = d.doc_id AND t.entity_type = 'TOTAL')""",
    )
    + f"""SELECT doc_id, coalesce(vendor, 'UNKNOWN-VENDOR') AS vendor,
  coalesce(date_text, '') AS date_text, coalesce(total_text, '') AS total_text,
  CASE
{_MARKERS.format(t="upper(coalesce(total_text, raw))")}
    ELSE 'MYR' END AS currency,
  coalesce({_r_printed("mean", 4)}, 0) AS overall_confidence
FROM wide"""
)
ORACLE["span_records"] = (
    _with(
        LEDGER,
        NOISY,
        """scored AS (
  SELECT l.*, style, CASE WHEN k % 5 > 0 THEN (k % 4 + 4) / 8.0::DOUBLE END AS v,
    CASE WHEN k % 7 > 0 THEN 0.75::DOUBLE END AS d,
    CASE WHEN k % 6 > 0 THEN (k % 3 + 1) / 8.0::DOUBLE END AS t
  FROM ledger l JOIN (SELECT k, style FROM noisy) USING (k)),
named AS (
  SELECT *, (coalesce(v, 0) + coalesce(d, 0) + coalesce(t, 0)) / nullif(
    (v IS NOT NULL)::INT + (d IS NOT NULL)::INT + (t IS NOT NULL)::INT, 0) AS mean FROM scored)""",
    )
    + f"""SELECT k, 'UNKNOWN-INVOICE-ID' AS invoice_id,
  CASE WHEN d IS NOT NULL AND style < 11 THEN strftime({_SWAPPED}, '%Y-%m-%d')
    ELSE '1970-01-01' END AS invoice_date,
  CASE WHEN v IS NULL THEN 'UNKNOWN-VENDOR' ELSE vendor END AS vendor,
  CASE WHEN t IS NULL THEN 0.0 WHEN style % 3 = 0 THEN -amount ELSE amount END AS amount,
  CASE WHEN t IS NULL THEN currency ELSE 'MYR' END AS currency,
  1 AS quantity, 1.0::DOUBLE AS fx_rate,
  coalesce({_r_printed("mean", 4)}, 0) AS overall_confidence,
  coalesce(v, 0) AS vendor_confidence, coalesce(d, 0) AS invoice_date_confidence,
  coalesce(t, 0) AS amount_confidence FROM named"""
)

# --- cases -------------------------------------------------------------------

ORACLE["document_variants"] = (
    _with(LEDGER, VARIANTS) + f"SELECT submission_id, scenario, {RECORD} FROM variants"
)
ORACLE["inject_discrepancies"] = (
    _with(
        LEDGER,
        """whole AS (
  SELECT *, 900 + k * 7919 % 201 AS permille, CAST(round(amount * 100) AS BIGINT) AS c,
    CAST(round(fx_rate * 10000) AS BIGINT) AS f,
    CASE k % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 2 END AS step
  FROM ledger),
dup AS (SELECT * FROM whole ORDER BY md5(concat('duplicate:', k)), k LIMIT 20),
fx AS (SELECT *, f * permille // 1000 AS f2 FROM whole ORDER BY md5(concat('fx:', k)), k LIMIT 15),
qty AS (SELECT * FROM whole ORDER BY md5(concat('quantity:', k)), k LIMIT 15),
everything AS (
  SELECT k, 'ledger' AS origin, invoice_id, invoice_date, vendor, amount, currency, quantity,
    fx_rate FROM ledger
  UNION ALL
  SELECT k, 'duplicate', invoice_id, invoice_date, vendor, CAST(c * permille // 1000 AS DOUBLE) / 100,
    currency, quantity, fx_rate FROM dup
  UNION ALL
  SELECT k, 'fx_error', invoice_id, invoice_date, vendor, CAST(c * f2 // f AS DOUBLE) / 100,
    currency, quantity, CAST(f2 AS DOUBLE) / 10000 FROM fx
  UNION ALL
  SELECT k, 'quantity_error', invoice_id, invoice_date, vendor,
    CAST(c * (quantity + step) // quantity AS DOUBLE) / 100, currency, quantity + step, fx_rate
  FROM qty)""",
    )
    + f"SELECT k, origin, {RECORD} FROM everything"
)
ORACLE["balanced_cases"] = (
    _with(*INVOICES)
    + """SELECT concat(scenario, '-', lpad(CAST(n AS VARCHAR), 3, '0')) AS case_id, scenario,
  submission_id
FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY submission_id) AS n FROM subs)
WHERE n <= 30"""
)
ORACLE["line_items_explode"] = (
    _with(LEDGER, ITEMS)
    + "SELECT k, CAST(n AS INTEGER) AS n, description, qty, CAST(price AS DOUBLE) AS price FROM unified"
)
ORACLE["line_item_totals"] = (
    _with(LEDGER, ITEMS)
    + f"""SELECT k, CAST(count(*) AS INTEGER) AS items,
  {_r("sum(" + _r_printed("CAST(qty * price AS DOUBLE) * fx_rate", 2) + ")", 2)} AS items_total, any_value(amount) AS amount
FROM unified GROUP BY k"""
)

# --- streaming ---------------------------------------------------------------

ORACLE["stream_reconcile"] = (
    _with(*INVOICES, DECIDED, EXPLAINED)
    + "SELECT final AS reconciliation_status, count(*) AS events FROM explained GROUP BY final"
)
ORACLE["stream_settle"] = (
    _with(
        *INVOICES, MISREAD, REPAIRED, POOL, _search("repaired", 3), PROMOTED, _ladder("repaired"),
        """settled AS (
  SELECT CASE WHEN status = 'matched' AND row_number() OVER (
      PARTITION BY r.invoice_id, r.vendor, r.amount, r.currency, status
      ORDER BY submission_id) > 1 THEN 'duplicate_charge' ELSE status END AS final
  FROM laddered l JOIN repaired r USING (submission_id))""",
    )
    + "SELECT final AS reconciliation_status, count(*) AS events FROM settled GROUP BY final"
)
ORACLE["stream_audit_dedupe"] = """SELECT event_type, count(*) AS events,
  count(DISTINCT event_id) AS ids FROM events GROUP BY event_type"""
