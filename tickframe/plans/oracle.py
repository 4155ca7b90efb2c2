"""DuckDB SQL of the queries in tickframe.plans.queries, written independently of them: interval joins instead of folds."""

from __future__ import annotations

from tickframe.layouts import ITCH, ITCH_HEADER, PITCH

_FEED = """
feed AS (
  SELECT event_id AS seq, epoch_us(ts)::BIGINT AS ts_us, ((epoch_us(ts) % 86400000000) * 1000)::BIGINT AS ts_ns, user_id AS stock,
         CASE event_type WHEN 'view' THEN 'A' WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'E' WHEN 'error' THEN 'D' ELSE 'U' END AS type,
         CASE event_type WHEN 'view' THEN 'B' WHEN 'signup' THEN 'S' END AS side,
         CASE WHEN event_type IN ('view', 'signup', 'click') THEN event_id END AS order_id,
         PRICE AS px, 1 + regexp_extract(props, '([0-9]+)', 1)::BIGINT AS shares
  FROM events
), referred AS (
  SELECT *, CASE WHEN side IS NULL THEN last_value(order_id IGNORE NULLS) OVER (PARTITION BY stock ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ref FROM feed
)"""
_CENTS, _EXACT = "(round(value * 100)::BIGINT * 100)", "round(value * 10000)::BIGINT"
_STATES = """, marked AS (
  SELECT *, count(order_id) OVER (PARTITION BY stock ORDER BY seq) AS block,
         count(side) OVER (PARTITION BY stock ORDER BY seq) AS chain,
         CASE WHEN order_id IS NOT NULL THEN 0 WHEN type = 'D' THEN 1099511627776 ELSE shares END AS asked
  FROM referred
), orders_ AS (
  SELECT m.stock, m.block, m.chain, m.seq AS created, m.px AS order_px, m.shares AS size, m.type,
         greatest(0, m.shares - coalesce((SELECT sum(x.asked) FROM marked x WHERE x.stock = m.stock AND x.block = m.block), 0))::BIGINT AS rest
  FROM marked m WHERE order_id IS NOT NULL
), chained AS (
  SELECT o.*, p.rest AS old_qty, p.order_px AS old_px,
         min(CASE WHEN o.type = 'U' AND coalesce(p.rest, 0) = 0 THEN 0 ELSE 1 END)
           OVER (PARTITION BY o.stock, o.chain ORDER BY o.block) = 1 AND o.chain > 0 AS lives
  FROM orders_ o LEFT JOIN orders_ p ON p.stock = o.stock AND p.block = o.block - 1
), states AS (
  SELECT m.seq, m.ts_us, m.ts_ns, m.stock, m.type, m.order_id, m.ref, m.shares, m.chain, c.order_px AS px,
         first_value(m.side IGNORE NULLS) OVER (PARTITION BY m.stock, m.chain ORDER BY m.seq) AS side,
         greatest(0, c.size - sum(m.asked) OVER w)::BIGINT AS left_,
         greatest(0, c.size - (sum(m.asked) OVER w - m.asked))::BIGINT AS found,
         m.asked, coalesce(c.lives, false) AS lives,
         CASE WHEN m.type = 'U' THEN c.old_px ELSE 0 END AS old_px, CASE WHEN m.type = 'U' THEN c.old_qty ELSE 0 END AS old_qty
  FROM marked m LEFT JOIN chained c ON c.stock = m.stock AND c.block = m.block
  WINDOW w AS (PARTITION BY m.stock, m.block ORDER BY m.seq)
), done AS (
  SELECT *, lives AND (order_id IS NOT NULL OR found > 0) AS accepted,
         (CASE WHEN order_id IS NOT NULL THEN shares ELSE -least(asked, found) END)::BIGINT AS qty
  FROM states
), updates AS (
  SELECT seq, ts_us, ts_ns, stock, side, px, qty, type = 'U' AS is_replace, old_px, old_qty FROM done WHERE accepted
), deltas AS (
  SELECT seq, 0 AS sub, stock, side, CASE WHEN is_replace THEN old_px ELSE px END AS px, CASE WHEN is_replace THEN -old_qty ELSE qty END AS delta
  FROM updates
  UNION ALL SELECT seq, 1, stock, side, px, qty FROM updates WHERE is_replace
)"""
_LEVELS = """, running AS (
  SELECT seq, sub, stock, side, px, sum(delta) OVER (PARTITION BY stock, side, px ORDER BY seq, sub)::BIGINT AS qty FROM deltas
), quantities AS (
  SELECT seq, stock, side, px, arg_max(qty, sub)::BIGINT AS qty FROM running GROUP BY seq, stock, side, px
), intervals AS (
  SELECT * FROM (SELECT stock, side, px, qty, seq AS seq_from, lead(seq) OVER (PARTITION BY stock, side, px ORDER BY seq) AS seq_to FROM quantities)
  WHERE qty > 0
)"""
_BOOK = """, alive AS (
  SELECT u.seq, i.side AS level_side, i.px AS level_px, i.qty AS level_qty
  FROM updates u JOIN intervals i ON i.stock = u.stock AND i.seq_from <= u.seq AND (i.seq_to IS NULL OR i.seq_to > u.seq)
), quotes AS (
  SELECT seq, max(level_px) FILTER (level_side = 'B') AS bid_px, arg_max(level_qty, level_px) FILTER (level_side = 'B') AS bid_qty,
         min(level_px) FILTER (level_side = 'S') AS offer_px, arg_min(level_qty, level_px) FILTER (level_side = 'S') AS offer_qty,
         min(level_px) FILTER (level_side = 'B') AS worst_bid_px, arg_min(level_qty, level_px) FILTER (level_side = 'B') AS worst_bid_qty,
         max(level_px) FILTER (level_side = 'S') AS worst_offer_px, arg_max(level_qty, level_px) FILTER (level_side = 'S') AS worst_offer_qty,
         count(*) FILTER (level_side = 'B') AS buy_levels, count(*) FILTER (level_side = 'S') AS sell_levels
  FROM alive GROUP BY seq
), book AS (
  SELECT u.*, coalesce(bid_px, 0)::BIGINT AS bid_px, coalesce(bid_qty, 0)::BIGINT AS bid_qty, coalesce(offer_px, 2000000000)::BIGINT AS offer_px,
         coalesce(offer_qty, 0)::BIGINT AS offer_qty, coalesce(worst_bid_px, 0)::BIGINT AS worst_bid_px,
         coalesce(worst_bid_qty, 0)::BIGINT AS worst_bid_qty, coalesce(worst_offer_px, 2000000000)::BIGINT AS worst_offer_px,
         coalesce(worst_offer_qty, 0)::BIGINT AS worst_offer_qty, coalesce(buy_levels, 0)::BIGINT AS buy_levels,
         coalesce(sell_levels, 0)::BIGINT AS sell_levels
  FROM updates u LEFT JOIN quotes USING (seq)
)"""
_REPORTED = """CASE WHEN side = 'B' THEN (CASE WHEN is_replace THEN old_px ELSE px END) >= bid_px
  ELSE (CASE WHEN is_replace THEN old_px ELSE px END) <= offer_px END"""


def _with(*parts: str, exact: bool = False) -> str:
    return "WITH " + "".join(parts).replace("PRICE", _EXACT if exact else _CENTS) + " "


FEED, STATES = _with(_FEED), _with(_FEED, _STATES)
LEVELS, BOOK = _with(_FEED, _STATES, _LEVELS), _with(_FEED, _STATES, _LEVELS, _BOOK)
_PENNY = "CASE WHEN {0} < 10000 THEN {0} ELSE {0} - {0} % 100 END"
_OLD_OR_NEW = "CASE WHEN is_replace THEN old_px ELSE px END"
#: The changes of a book whose levels above a dollar are cents.
PENNY_STATES = _STATES.replace(f"{_OLD_OR_NEW} AS px", _PENNY.format(f"({_OLD_OR_NEW})") + " AS px").replace(
    "seq, 1, stock, side, px, qty", f"seq, 1, stock, side, {_PENNY.format('px')}, qty"
)


def levels_sql(low: str, high: str) -> str:
    """Price levels from low to high, both raw."""
    return f"(greatest(0, least({high}, 10000) - {low}) + greatest(0, {high} - greatest({low}, 10000)) // 100)::BIGINT"


_DEPTH = f"({levels_sql('worst_bid_px', 'bid_px')} + {levels_sql('offer_px', 'worst_offer_px')})"
_EVENT_DEPTH = f"""CASE WHEN side = 'B' THEN CASE WHEN px < bid_px THEN {levels_sql('px', 'bid_px')} ELSE 0 END
  ELSE CASE WHEN px > offer_px THEN {levels_sql('offer_px', 'px')} ELSE 0 END END"""


def quantile_sql(samples: str, keys: str, shares: dict[str, float], low: int, high: int) -> str:
    """CTEs and columns for quantiles of unit bins over [low, high): samples has keys, v and w."""
    partition = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    columns = []
    for name, q in shares.items():
        q = f"CAST({q} AS DOUBLE)"
        columns.append(
            f"""coalesce(arg_min(CASE WHEN (bin = {high - low} AND {q} < upto) OR (bin < {high - low} AND {q} <= upto)
              THEN floor(a + ({q} - base) * (b - a) / height) END,
              CASE WHEN (bin = {high - low} AND {q} < upto) OR (bin < {high - low} AND {q} <= upto) THEN bin END), max(hi))::BIGINT AS {name}"""
        )
    return f"""binned AS (
  SELECT {head}v, w, CASE WHEN v < {low} THEN -1 WHEN v >= {high} THEN {high - low} ELSE v - {low} END AS bin FROM ({samples}) WHERE w > 0
), bins AS (
  SELECT {head}bin, sum(w) AS w, min(v) AS lo, max(v) AS hi FROM binned GROUP BY {head}bin
), shares AS (
  SELECT {head}bin, w, min(lo) OVER ({partition}) AS lo, max(hi) OVER ({partition}) AS hi, sum(w) OVER ({partition}) AS n,
         sum(w) OVER ({partition} ORDER BY bin) AS cum FROM bins
), ends AS (
  SELECT *, CAST(cum AS DOUBLE) / n AS upto, CAST(cum - w AS DOUBLE) / n AS base, CAST(w AS DOUBLE) / n AS height,
         CASE WHEN bin = -1 THEN lo WHEN bin = {high - low} THEN {high} ELSE bin + {low} END::DOUBLE AS a,
         CASE WHEN bin = -1 THEN {low} WHEN bin = {high - low} THEN hi ELSE bin + {low} + 1 END::DOUBLE AS b FROM shares
)
SELECT {head}max(n)::BIGINT AS n, min(lo)::BIGINT AS min, {', '.join(columns)}, max(hi)::BIGINT AS max FROM ends {group}"""


SUMMARY = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
DEPTH = {**SUMMARY, "p999": 0.999, "p9999": 0.9999}
ARRIVAL = {
    "p0001": 0.0001, "p001": 0.001, "p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99,
}


def _steps(key: str, measure: int, sample: int) -> str:
    """CTE steps (key, tick, rate, weight) of the trailing rate."""
    n = measure // sample
    head, partition = (f"{key}, ", f"PARTITION BY {key}") if key else ("", "")
    join = f"USING ({key})" if key else "ON true"
    return f"""counts AS (
  SELECT {head}tick, count(*) AS events FROM (
    SELECT {head}max(ts_us // {sample}) OVER ({partition} ORDER BY seq) AS tick FROM feed) GROUP BY {head}tick
), breaks AS (
  SELECT {head}tick, sum(change) AS change FROM (
    SELECT {head}tick, events AS change FROM counts UNION ALL SELECT {head}tick + {n}, -events FROM counts) GROUP BY {head}tick
), ends_ AS (SELECT {head}max(tick) AS last FROM counts {'GROUP BY ' + key if key else ''}), runs AS (
  SELECT {head}tick, sum(change) OVER ({partition} ORDER BY tick) AS rate,
         least(coalesce(lead(tick) OVER ({partition} ORDER BY tick), last), last) - tick AS weight
  FROM breaks JOIN ends_ {join}
), steps AS (SELECT {head}tick::BIGINT AS tick, rate::BIGINT AS rate, weight::BIGINT AS weight FROM runs WHERE weight > 0)"""


HOUR, MINUTE = 3_600_000_000, 60_000_000
_ROTATED = "SELECT vec_id, list_transform(range(64), lambda i: embedding[1 + ((i - 17) + 64) % 64]) AS series FROM embeddings"
_PX = "(round(o_totalprice * 100)::BIGINT * 100)"

SQL: dict[str, str] = {
    "feed_messages": FEED + "SELECT seq, ts_us, ts_ns, stock, type, side, order_id, ref, px, shares FROM referred",
    "type_counts": FEED + "SELECT type, count(*) AS messages FROM feed GROUP BY type",
    "trades": FEED + """SELECT ts_ns, ref AS order_id, side_ AS side, shares, stock, px // 10000 || '.' || lpad((px % 10000)::VARCHAR, 4, '0') AS price, seq AS match
      FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'S' END AS side_ FROM referred) WHERE type = 'E'""",
    "symbols": FEED + "SELECT DISTINCT stock FROM feed",
    "order_updates": STATES + "SELECT seq, stock, side, px, qty, is_replace, old_px, old_qty FROM updates",
    "skipped_messages": STATES + "SELECT seq, stock, type, ref FROM done WHERE NOT accepted",
    "order_remaining": STATES + """SELECT order_id, stock, side, px, size, rest AS remaining FROM (
      SELECT c.created AS order_id, c.stock, c.order_px AS px, c.size, c.rest, d.side FROM chained c JOIN done d ON d.seq = c.created WHERE c.lives)""",
    "replace_chain": STATES + """SELECT stock, chain, min(seq) AS first_order, max(seq) AS last_order, count(*) AS orders
      FROM done WHERE accepted AND order_id IS NOT NULL GROUP BY stock, chain""",
    "level_quantity": LEVELS + "SELECT seq, stock, side, px, qty FROM quantities",
    "level_intervals": LEVELS + "SELECT stock, side, px, qty, seq_from, seq_to FROM intervals",
    "bbo": BOOK + "SELECT seq, stock, bid_px, bid_qty, offer_px, offer_qty FROM book",
    "worst_quotes": BOOK + "SELECT seq, stock, worst_bid_px, worst_bid_qty, worst_offer_px, worst_offer_qty FROM book",
    "level_counts": BOOK + "SELECT seq, stock, buy_levels, sell_levels, buy_levels + sell_levels AS levels FROM book",
    "inside_reported": BOOK + f"SELECT seq, ts_ns, stock, bid_px, bid_qty, offer_px, offer_qty FROM book WHERE {_REPORTED}",
    "inside_lines": BOOK + f"SELECT seq, concat_ws(' ', ts_ns, stock, stock, bid_px, bid_qty, offer_px, offer_qty) AS line FROM book WHERE {_REPORTED}",
    "inside_changed": BOOK + """SELECT seq, stock, bid_px, bid_qty, offer_px, offer_qty FROM (
      SELECT *, lag((bid_px, bid_qty, offer_px, offer_qty)) OVER (PARTITION BY stock ORDER BY seq) AS before FROM book)
      WHERE before IS NULL OR before <> (bid_px, bid_qty, offer_px, offer_qty)""",
    "published_inside": BOOK + """SELECT seq, stock, side, px, bid_px, bid_qty, offer_px, offer_qty FROM book
      WHERE CASE WHEN side = 'B' THEN px = bid_px ELSE px = offer_px END""",
    "top_n_levels": BOOK + """SELECT u.seq, u.stock, r.level_side AS side, r.place, r.level_px AS px, r.level_qty AS qty FROM updates u JOIN (
      SELECT *, row_number() OVER (PARTITION BY seq, level_side ORDER BY CASE level_side WHEN 'B' THEN -level_px ELSE level_px END) AS place FROM alive) r
      USING (seq) WHERE place <= 4""",
    "price_levels": f"SELECT o_orderkey, {levels_sql(_PX + ' // 4', _PX)} AS levels FROM orders",
    "level_to_price": """SELECT o_orderkey, (CASE WHEN v <= 10000 THEN v ELSE (v - 10000) * 100 + 10000 END)::BIGINT AS price
      FROM (SELECT o_orderkey, o_orderkey % 30000 AS v FROM orders)""",
    "penny_book_bbo": _with(_FEED, PENNY_STATES, _LEVELS, _BOOK, exact=True)
    + "SELECT seq, stock, bid_px, bid_qty, offer_px, offer_qty FROM book",
    "book_depth": BOOK + f"SELECT seq, stock, {_DEPTH} AS depth FROM book",
    "event_depth": BOOK + f"SELECT seq, stock, ({_EVENT_DEPTH})::BIGINT AS depth FROM book",
    "book_depth_stats": BOOK + ", " + quantile_sql(f"SELECT {_DEPTH} AS v, 1 AS w FROM book", "", DEPTH, 0, 8192),
    "event_depth_stats": BOOK + ", " + quantile_sql(f"SELECT ({_EVENT_DEPTH})::BIGINT AS v, 1 AS w FROM book", "", DEPTH, 0, 8192),
    "depth_stats_by_symbol": BOOK + ", " + quantile_sql(
        f"SELECT stock, d AS v, 1 AS w FROM (SELECT stock, {_DEPTH} AS d FROM book) UNION ALL SELECT NULL, {_DEPTH}, 1 FROM book", "stock", DEPTH, 0, 5000
    ),
    "depth_statistics": BOOK + ", stats AS (WITH " + quantile_sql(
        f"SELECT stock::VARCHAR AS stock, {_DEPTH} AS v, 1 AS w FROM book UNION ALL SELECT '__aggregate__', {_DEPTH}, 1 FROM book", "stock", DEPTH, 0, 5000
    ) + ") SELECT stock AS Name, n AS NSamples, " + ", ".join(f"{c} AS {c}BookDepth" for c in ("min", *DEPTH, "max")) + " FROM stats",
    "interarrival": FEED + """SELECT stock, seq, gap FROM (SELECT stock, seq, ts_us - lag(ts_us) OVER (PARTITION BY stock ORDER BY seq) AS gap FROM feed)
      WHERE gap IS NOT NULL""",
    "rate_steps": FEED + ", " + _steps("stock", 24 * HOUR, HOUR) + " SELECT stock, tick, rate, weight FROM steps",
    "rate_histogram": FEED + ", " + _steps("", HOUR, MINUTE) + " SELECT rate, sum(weight)::BIGINT AS weight FROM steps GROUP BY rate",
    "rate_quantiles": FEED + ", " + _steps("", HOUR, MINUTE) + ", " + quantile_sql("SELECT rate AS v, weight AS w FROM steps", "", DEPTH, 0, 1000),
    "arrival_quantiles": FEED + ", " + quantile_sql(
        f"SELECT (ts_us - lag(ts_us) OVER (PARTITION BY stock ORDER BY seq)) // {MINUTE} AS v, 1 AS w FROM feed QUALIFY v IS NOT NULL", "", ARRIVAL, 0, 100000
    ),
    "feed_stats": FEED + ", " + _steps("stock", 24 * HOUR, HOUR) + ", " + quantile_sql("SELECT stock, rate AS v, weight AS w FROM steps", "stock", DEPTH, 0, 100),
    "hist_integer": """SELECT l_returnflag, CASE WHEN q < 10 THEN -1 WHEN q >= 40 THEN 30 ELSE q - 10 END AS bin, count(*) AS weight
      FROM (SELECT l_returnflag, l_quantity::BIGINT AS q FROM lineitem) GROUP BY ALL""",
    "hist_cuts": """SELECT CASE WHEN v < 100 THEN -1 WHEN v >= 100000 THEN 4 WHEN v >= 50000 THEN 3 WHEN v >= 10000 THEN 2 WHEN v >= 1000 THEN 1 ELSE 0 END AS bin,
      count(*) AS weight FROM (SELECT floor(l_extendedprice) AS v FROM lineitem) GROUP BY ALL""",
    "hist_mean": """WITH b AS (SELECT l_returnflag, l_quantity::BIGINT AS q, CASE WHEN l_quantity < 10 THEN -1 WHEN l_quantity >= 40 THEN 30 ELSE l_quantity::BIGINT - 10 END AS bin FROM lineitem),
      e AS (SELECT l_returnflag, bin, count(*) AS w, min(min(q)) OVER (PARTITION BY l_returnflag) AS lo, max(max(q)) OVER (PARTITION BY l_returnflag) AS hi FROM b GROUP BY l_returnflag, bin)
      SELECT l_returnflag, sum(w)::BIGINT AS n, (sum(w * CASE WHEN bin = -1 THEN lo + (10 - lo) // 2 WHEN bin = 30 THEN 40 + (hi - 40) // 2 ELSE bin + 10 END) // sum(w))::BIGINT AS mean
      FROM e GROUP BY l_returnflag""",
    "hist_summary": "WITH " + quantile_sql("SELECT l_returnflag, l_quantity::BIGINT AS v, 1 AS w FROM lineitem", "l_returnflag", SUMMARY, 5, 45),
    "index_percentile": """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS k,
      count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
      SELECT o_orderpriority, p, o_totalprice AS price FROM r JOIN (SELECT unnest([0, 25, 50, 75, 90, 99]) AS p) ON k = p * n // 100""",
    "text_formats": FEED + """SELECT seq, px // 10000 || '.' || lpad((px % 10000)::VARCHAR, 4, '0') AS price,
      lpad((ts_ns // 3600000000000)::VARCHAR, 2, '0') || lpad((ts_ns // 60000000000 % 60)::VARCHAR, 2, '0') || lpad((ts_ns // 1000000000 % 60)::VARCHAR, 2, '0')
      || '.' || lpad((ts_ns % 1000000000)::VARCHAR, 9, '0') AS time FROM feed""",
    "validation_flags": FEED + """SELECT seq, type IN ('A', 'E', 'D', 'U') AS known_type, coalesce(side IN ('B', 'S'), type <> 'A') AS ok_side,
      ts_ns < 86400000000000 AS ok_time, px BETWEEN 0 AND 2000000000 AS ok_price FROM feed""",
    "stop_after": FEED + "SELECT seq, ts_ns FROM feed WHERE seq < coalesce((SELECT min(seq) FROM feed WHERE ts_ns >= 32400000000000), 9223372036854775807)",
    "sum_square": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS energy FROM embeddings",
    "delay_series": f"SELECT vec_id, u.i - 1 AS i, round(series[u.i]::DOUBLE, 6) AS sample FROM ({_ROTATED}), (SELECT unnest(range(1, 65)) AS i) u",
    "conj_multiply": """SELECT vec_id, i, round(embedding[1 + i]::DOUBLE * embedding[33 + i] + embedding[2 + i]::DOUBLE * embedding[34 + i], 6) AS re,
      round(embedding[1 + i]::DOUBLE * embedding[34 + i] - embedding[2 + i]::DOUBLE * embedding[33 + i], 6) AS im
      FROM embeddings, (SELECT unnest(range(0, 31)) AS i)""",
    "reductions": """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, round(list_min(embedding)::DOUBLE, 6) AS low,
      (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS peak_at, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)), 6) AS head
      FROM embeddings""",
    "time_delay": f"""WITH r AS ({_ROTATED}), p AS (
      SELECT e.vec_id, lag, sum(e.embedding[1 + i]::DOUBLE * r.series[1 + (i + lag) % 64]::DOUBLE) AS c
      FROM embeddings e JOIN r USING (vec_id), (SELECT unnest(range(64)) AS lag), (SELECT unnest(range(64)) AS i) GROUP BY ALL)
      SELECT vec_id, max(c) > 0 AS found, arg_max(lag, c)::BIGINT AS delay FROM p GROUP BY vec_id""",
    "time_delay_confidence": f"""WITH r AS ({_ROTATED}), p AS (
      SELECT e.vec_id, lag, sum(e.embedding[1 + i]::DOUBLE * r.series[1 + (i + lag) % 64]::DOUBLE) AS c
      FROM embeddings e JOIN r USING (vec_id), (SELECT unnest(range(64)) AS lag), (SELECT unnest(range(64)) AS i) GROUP BY ALL)
      SELECT vec_id, round(64 * max(c) / any_value((SELECT sum(x::DOUBLE * x::DOUBLE) FROM (SELECT unnest(q.embedding) AS x FROM embeddings q WHERE q.vec_id = p.vec_id))), 3) AS confidence
      FROM p GROUP BY vec_id""",
    "inside_grid": BOOK + f"""SELECT stock, ts_us // {HOUR} AS tick, arg_max(bid_px, seq) AS bid_px, arg_max(bid_qty, seq) AS bid_qty,
      arg_max(offer_px, seq) AS offer_px, arg_max(offer_qty, seq) AS offer_qty FROM book GROUP BY ALL""",
    "mold_gaps": FEED + """, p AS (SELECT stock, seq AS arrival, count(*) OVER (PARTITION BY stock ORDER BY seq) * 2 - 2 + shares % 2 AS first_seq, shares % 3 AS block_count FROM feed),
      e AS (SELECT *, coalesce(lag(first_seq + block_count) OVER (PARTITION BY stock ORDER BY arrival), 0) AS expected FROM p)
      SELECT stock, arrival, first_seq, block_count, expected::BIGINT AS expected, (first_seq - expected)::BIGINT AS gap FROM e""",
}
SQL["long_delay_sums"] = FEED + f""", ticks AS (
  SELECT stock % 2 AS half, ts_us // {MINUTE} AS tick, sum(px / 10000.0) AS re, sum(shares) AS im FROM feed WHERE px IS NOT NULL GROUP BY ALL
), products AS (
  SELECT a.half, b.tick + 23 - a.tick AS lag, sum(a.re * b.re + a.im * b.im) AS total
  FROM ticks a JOIN ticks b ON a.half = b.half AND b.tick + 23 - a.tick BETWEEN 0 AND 47 GROUP BY ALL
), every AS (SELECT half, lag FROM (SELECT DISTINCT half FROM ticks), (SELECT unnest(range(48)) AS lag))
SELECT half::BIGINT AS half, lag, round(coalesce(total, 0) / 1000)::BIGINT AS total FROM every LEFT JOIN products USING (half, lag)"""
SQL["order_fold"] = SQL["order_updates"]
_AS_ONE = _STATES.replace("SELECT seq, ts_us, ts_ns, stock, side, px, qty, type", "SELECT seq, ts_us, ts_ns, 0::BIGINT AS stock, side, px, qty, type")
SQL["consolidated_bbo"] = _with(_FEED, _AS_ONE, _LEVELS, _BOOK) + "SELECT seq, bid_px, bid_qty, offer_px, offer_qty FROM book"
SQL["file_inside"] = SQL["packet_inside"] = SQL["live_inside"] = BOOK + f"SELECT seq, stock, bid_px, bid_qty, offer_px, offer_qty FROM book WHERE {_REPORTED}"
SQL["invalid_messages"] = FEED + """, typed AS (
  SELECT seq, CASE WHEN type = 'A' AND seq % 2 = 1 THEN 'F' WHEN type = 'E' THEN substr('ECX', 1 + (seq % 3)::INT, 1) ELSE type END AS type, seq % 11 AS way FROM feed)
  SELECT seq, CASE way WHEN 1 THEN 'Z' ELSE type END AS type,
         CASE way WHEN 1 THEN 'unknown type' WHEN 2 THEN 'too short' WHEN 3 THEN 'time of another day' ELSE 'unknown code' END AS reason
  FROM typed WHERE way IN (1, 2, 3) OR way = 4 AND type IN ('A', 'F')"""


def _field_sql(field, place: int, n: str = "o_orderkey") -> str:
    if field.name == "ts_ns":
        return f"{n} * 1000003 % 86400000000000"
    if field.kind in ("u", "price4", "price8"):
        return f"({n} * {place + 3} + {place}) % {min(1 << (8 * field.width), 1 << 31)}"
    if field.codes:
        codes = field.codes.split() if field.kind == "word" else list(field.codes)
        return f"{codes!r}[1 + ({n} + {place}) % {len(codes)}]"
    return f"'T' || {n} % {10 ** (field.width - 1)}" if field.width > 1 else f"['B', 'S'][1 + {n} % 2]"


def _messages_sql(layouts: dict, header: tuple, kind: str) -> str:
    """A message of each type in turn for each order; texts are cut at their first space and never have one."""
    parts = []
    for k, (name, fields) in enumerate(layouts.items()):
        said = " || ' ' || ".join(f"'{f.name}=' || ({_field_sql(f, i)})" for i, f in enumerate((*header, *fields)))
        parts.append(f"SELECT o_orderkey, {name!r}{kind} AS type, {said} AS fields FROM orders WHERE o_orderkey % {len(layouts)} = {k}")
    return " UNION ALL ".join(parts)


SQL["decode_roundtrip"], SQL["pitch_roundtrip"] = _messages_sql(ITCH, ITCH_HEADER, ""), _messages_sql(PITCH, (), "::INT")
SQL["trade_lines"] = FEED + """SELECT concat_ws(' ', ts_ns, ref, CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'S' END, shares, stock,
  px // 10000 || '.' || lpad((px % 10000)::VARCHAR, 4, '0'), seq) AS line FROM referred WHERE type = 'E' AND ref IS NOT NULL"""
SQL["generic_reductions"] = """WITH x AS (
  SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS place, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem
), y AS (SELECT *, lag(cents) OVER (PARTITION BY l_returnflag ORDER BY place, cents) AS before FROM x)
SELECT l_returnflag, sum(cents)::BIGINT AS total, min(cents) AS least, max(cents) AS most,
  min(place) FILTER (WHERE cents = (SELECT max(cents) FROM x WHERE x.l_returnflag = y.l_returnflag))::BIGINT AS most_at,
  first(cents ORDER BY place, cents) AS first, last(cents ORDER BY place, cents) AS last, (count(*) FILTER (WHERE cents > before))::BIGINT AS ascents
FROM y GROUP BY l_returnflag"""
SQL["directory_depth"] = f"""SELECT coalesce(Name, c_custkey::VARCHAR) AS Name, coalesce(NSamples, 0) AS NSamples, {', '.join(f'{c}BookDepth' for c in ('min', *DEPTH, 'max'))}
  FROM ({SQL['depth_statistics']}) FULL JOIN customer ON Name = c_custkey::VARCHAR"""
SQL["inside_statistics"] = BOOK + f", reported AS (SELECT seq, stock, ts_us FROM book WHERE {_REPORTED}), " + quantile_sql(
    f"""SELECT stock, (ts_us - lag(ts_us) OVER (PARTITION BY stock ORDER BY seq)) // {MINUTE} AS v, 1 AS w FROM reported QUALIFY v IS NOT NULL
    UNION ALL SELECT NULL, (ts_us - lag(ts_us) OVER (ORDER BY seq)) // {MINUTE} AS v, 1 FROM reported QUALIFY v IS NOT NULL""", "stock", ARRIVAL, 0, 100000
)
SQL["spectrum"] = """SELECT vec_id, k, round(sum(x * cos(2 * pi() * k * i / 64)), 4) + 0.0 AS re, round(sum(-x * sin(2 * pi() * k * i / 64)), 4) + 0.0 AS im,
    round(64 * sum(CASE WHEN i = k THEN x END), 4) + 0.0 AS back
    FROM (SELECT vec_id, i, embedding[1 + i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS i)), (SELECT unnest(range(64)) AS k) GROUP BY vec_id, k"""
SQL["number_helpers"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderkey END AS number,
    (2 ** ceil(log2(greatest(o_orderkey, 1)) - 1e-12))::BIGINT AS power, abs(o_orderkey - o_custkey) <= 100 AS near FROM orders"""
SQL["packet_table"] = "WITH RECURSIVE " + FEED.removeprefix("WITH ") + """, m AS (
  SELECT stock, seq, ts_us * 1000 AS ts, shares + 19 AS size, row_number() OVER (PARTITION BY stock ORDER BY seq) AS k FROM feed
), walk AS (
  SELECT stock, k, seq AS first_seq, 22 + size AS held, size, ts AS sent FROM m WHERE k = 1
  UNION ALL
  SELECT m.stock, m.k, CASE WHEN m.ts - sent >= 21600000000000 OR held + m.size + 2 >= 220 THEN m.seq ELSE first_seq END,
         CASE WHEN m.ts - sent >= 21600000000000 OR held + m.size + 2 >= 220 THEN 22 + m.size ELSE held + m.size + 2 END, m.size,
         CASE WHEN m.ts - sent >= 21600000000000 OR held + m.size + 2 >= 220 THEN m.ts ELSE sent END
  FROM walk JOIN m ON m.stock = walk.stock AND m.k = walk.k + 1
)
SELECT stock AS session, first_seq, count(*)::BIGINT AS block_count, (20 + sum(size + 2))::BIGINT AS bytes,
       first_seq = max(first_seq) OVER (PARTITION BY stock) AS is_final_partial FROM walk GROUP BY stock, first_seq"""


def _statistics(feed: str, base: str, processing: str | None = None) -> str:
    """A feed's statistics: times in ns, a row for each security and one for everything; feed ends with the table base (stock, seq, ts_us)."""
    took = f", {processing} AS took" if processing else ""
    own, whole = (f"SELECT {name} AS Name, seq, ts_us * 1000 AS ts_us{took} FROM {base}" for name in ("stock::VARCHAR", "'__aggregate__'"))
    parts, columns = [], []
    for suffix, measure, sample, most in RATES:
        rates = " UNION ALL ".join(
            f"(WITH feed AS ({rows}), {_steps('Name', measure, sample)} SELECT Name, rate AS v, weight AS w FROM steps)" for rows in (own, whole)
        )
        parts.append((suffix, "WITH " + quantile_sql(rates, "Name", DEPTH, 0, most), DEPTH))
    gaps = " UNION ALL ".join(
        f"(SELECT Name, ts_us - lag(ts_us) OVER (PARTITION BY Name ORDER BY seq) AS v, 1 AS w FROM ({rows}) QUALIFY v IS NOT NULL)" for rows in (own, whole)
    )
    parts.append(("Arrival", "WITH " + quantile_sql(gaps, "Name", ARRIVAL, 0, 100_000), ARRIVAL))
    shares = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}
    if processing:
        both = " UNION ALL ".join(f"(SELECT Name, took AS v, 1 AS w FROM ({rows}))" for rows in (own, whole))
        parts.append(("Processing", "WITH " + quantile_sql(both, "Name", shares, 0, 1_000_000), shares))
    joins = ""
    for suffix, sql, names in parts:
        joins += f" LEFT JOIN ({sql}) AS t{suffix} USING (Name)"
        columns += [f"t{suffix}.{c} AS {c}{suffix}" for c in ("min", *names, "max")]
    if not processing:
        columns += [f"NULL::BIGINT AS {c}Processing" for c in ("min", *shares, "max")]
    names = f"SELECT Name, count(*) AS NSamples FROM (SELECT stock::VARCHAR AS Name FROM {base} UNION ALL SELECT '__aggregate__' FROM {base}) GROUP BY Name"
    return f"{feed} SELECT Name, NSamples, {', '.join(columns)} FROM ({names}) AS n{joins}"


#: Name, measurement and sampling period in ns, largest rate with a bin of its own.
RATES = (("RatePerSec", 1_000_000_000, 1_000_000, 1_000_000), ("RatePerMSec", 1_000_000, 1_000, 100_000), ("RatePerUSec", 1_000, 1, 100_000))
SQL["feed_statistics"] = SQL["live_statistics"] = _statistics(FEED.replace("feed AS (", "base AS (", 1).replace("FROM feed", "FROM base"), "base")
SQL["inside_feed_statistics"] = _statistics(
    BOOK + f", reported AS (SELECT stock, seq, ts_us, qty FROM book WHERE {_REPORTED})", "reported", "abs(qty) * 1000 + seq % 997"
)
