"""Queries over the driver's tables, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soldlens.functions import categories, dates, money, text, urls
from soldlens.operators import geometry, identity, listing, merge, reports, resolve, slices, stats
from soldlens.plans import observations, priced_events, readings, sales, table
from soldlens.sources import cards, dataset, export, pages, transcribed
from soldlens.streaming import ingest

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_EVENTS = "SELECT event_id, event_type AS currency, value AS price, CAST(NULL AS DOUBLE) AS shipping, CAST(ts AS DATE) AS sold_date FROM events"
_SALES = """SELECT concat(l_orderkey, '-', l_linenumber) AS item_id, l_returnflag AS currency, l_extendedprice AS price, nullif(l_tax, 0.0) * 100 AS shipping, CAST(l_shipdate AS DATE) AS sold_date,
 l_returnflag AS condition, l_linestatus = 'F' AS sponsored, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem"""
_READINGS = f"SELECT *, CAST(l_quantity % 3 AS INT) AS rank, row_number() OVER (PARTITION BY item_id ORDER BY sold_date, l_partkey, l_suppkey, l_quantity, price) AS seq FROM ({_SALES})"
_OBS = f"SELECT 'site' AS site, s.item_id, p.p_name AS keywords_norm, p.p_name AS search_id, l_discount > 0.05 AS matches_query, CAST(l_linenumber AS BIGINT) AS position, sold_date, l_partkey, l_suppkey, l_quantity, price FROM ({_SALES}) s JOIN part p ON p.p_partkey = s.l_partkey"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _stats_sql(rows: str, keys: str, value: str = "price", trim: bool = True, unknown: str = "false") -> str:
    on = " AND ".join(f"v.{k} = g.{k}" for k in keys.split(", "))
    kept = "g.n < 8 OR v.value BETWEEN g.q1 - 1.5 * (g.q3 - g.q1) AND g.q3 + 1.5 * (g.q3 - g.q1)" if trim else "true"
    vk = ", ".join(f"v.{k}" for k in keys.split(", "))
    return f"""WITH v AS (SELECT *, {value} AS value, {unknown} AS unknown FROM ({rows}) WHERE price IS NOT NULL),
g AS (SELECT {keys}, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY {keys}),
k AS (SELECT {vk}, v.value, v.sold_date, v.unknown, ({kept}) AS kept FROM v JOIN g ON {on})
SELECT {keys}, count(*) FILTER (kept) AS count, count(*) FILTER (NOT kept) AS outliers_removed, round(min(value) FILTER (kept), 4) AS min, round(max(value) FILTER (kept), 4) AS max, round(avg(value) FILTER (kept), 4) AS mean,
round(quantile_cont(value, 0.1) FILTER (kept), 4) AS p10, round(quantile_cont(value, 0.25) FILTER (kept), 4) AS p25, round(quantile_cont(value, 0.5) FILTER (kept), 4) AS median, round(quantile_cont(value, 0.75) FILTER (kept), 4) AS p75, round(quantile_cont(value, 0.9) FILTER (kept), 4) AS p90,
min(sold_date) FILTER (kept) AS first_sold, max(sold_date) FILTER (kept) AS last_sold, count(*) FILTER (kept AND unknown) AS shipping_unknown FROM k GROUP BY {keys}"""


# --- statistics -----------------------------------------------------------------------------------------------------


@query(_stats_sql(f"SELECT * REPLACE (upper(currency) AS currency) FROM ({_EVENTS})", "currency"))
def price_stats(spark, d):
    return stats.price_stats(priced_events(spark, d).withColumn("currency", stats.currency_key(F.col("currency"))), scale=4)


@query(_stats_sql(_EVENTS, "currency", trim=False))
def price_stats_untrimmed(spark, d):
    return stats.price_stats(priced_events(spark, d), trim=False, scale=4)


@query(_stats_sql(_SALES, "currency", value="coalesce(round(price + shipping, 2), price)", unknown="shipping IS NULL"))
def price_stats_with_shipping(spark, d):
    return stats.price_stats(sales(spark, d), include_shipping=True, scale=4)


@query(_stats_sql(f"SELECT * FROM ({_EVENTS}) WHERE price IS NOT NULL ORDER BY sold_date DESC, event_id LIMIT 1000", "currency"))
def price_stats_recent_n(spark, d):
    rows = stats.most_recent_priced(priced_events(spark, d), 1000, [F.col("sold_date").desc(), F.col("event_id")])
    return stats.price_stats(rows, scale=4)


for _period, _sql in (("day", "strftime(sold_date, '%Y-%m-%d')"), ("week", "strftime(sold_date, '%G-W%V')"), ("month", "strftime(sold_date, '%Y-%m')")):
    QUERIES[f"price_series_{_period}"] = lambda spark, d, p=_period: stats.price_series(priced_events(spark, d), p, scale=4)
    ORACLE_SQL[f"price_series_{_period}"] = _stats_sql(f"SELECT *, {_sql} AS period FROM ({_EVENTS}) WHERE sold_date IS NOT NULL", "period, currency")


@query(f"""WITH v AS ({_EVENTS}), g AS (SELECT currency, count(*) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM v GROUP BY currency)
SELECT currency, event_id, price AS value FROM v JOIN g USING (currency) WHERE n >= 8 AND NOT price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def iqr_outliers(spark, d):
    return stats.outliers(priced_events(spark, d).select("currency", "event_id", F.col("price").alias("value")), ["currency"])


# --- scope, filters, order ------------------------------------------------------------------------------------------

_KW = "(SELECT min(p_name) FROM part)"


def _keyword(spark, d):
    return table(spark, d, "part").agg(F.min("p_name").alias("keywords_norm"))


def _listings(spark, d):
    return sales(spark, d).groupBy("item_id").agg(F.max("sold_date").alias("sold_date"), F.max("price").alias("price")).withColumn("site", F.lit("site"))


_LISTINGS = f"SELECT item_id, max(sold_date) AS sold_date, max(price) AS price, 'site' AS site FROM ({_SALES}) GROUP BY item_id"


@query(f"SELECT item_id, price FROM ({_LISTINGS}) l WHERE EXISTS (SELECT 1 FROM ({_OBS}) o WHERE o.item_id = l.item_id AND o.keywords_norm = {_KW} AND o.matches_query)")
def scope_keyword_exact(spark, d):
    scope = observations(spark, d).join(F.broadcast(_keyword(spark, d)), "keywords_norm", "left_semi")  # one row
    return listing.in_scope(_listings(spark, d), scope, keyed=True).select("item_id", "price")


@query(f"SELECT item_id, price FROM ({_LISTINGS}) l WHERE EXISTS (SELECT 1 FROM ({_OBS}) o WHERE o.item_id = l.item_id AND o.keywords_norm = {_KW})")
def scope_all_matches(spark, d):
    scope = observations(spark, d).join(F.broadcast(_keyword(spark, d)), "keywords_norm", "left_semi")  # one row
    return listing.in_scope(_listings(spark, d), scope, keyed=True, exact_only=False).select("item_id", "price")


@query(f"""WITH o AS (SELECT * FROM ({_OBS}) WHERE l_quantity > 10) SELECT item_id, price FROM ({_LISTINGS}) l
WHERE EXISTS (SELECT 1 FROM o WHERE o.item_id = l.item_id AND o.matches_query) OR NOT EXISTS (SELECT 1 FROM o WHERE o.item_id = l.item_id)""")
def scope_unkeyed_exact(spark, d):
    return listing.in_scope(_listings(spark, d), observations(spark, d).where("l_quantity > 10"), keyed=False).select("item_id", "price")


@query(f"SELECT item_id, sold_date, price FROM ({_SALES}) WHERE sold_date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND NOT sponsored")
def filter_since_until(spark, d):
    return listing.filtered(sales(spark, d), since="1995-01-01", until="1996-06-30").select("item_id", "sold_date", "price")


@query(f"SELECT item_id, condition FROM ({_SALES}) WHERE condition = 'R'")
def filter_condition_nocase(spark, d):
    return listing.filtered(sales(spark, d), condition=" r ", include_sponsored=True).select("item_id", "condition")


@query(f"SELECT item_id, price FROM ({_SALES}) WHERE nullif(currency, 'N') IS NULL AND NOT sponsored")
def filter_unknown_currency(spark, d):
    rows = sales(spark, d).withColumn("currency", F.nullif("currency", F.lit("N")))
    return listing.filtered(rows, currency="unknown", priced_only=True).select("item_id", "price")


@query(f"SELECT item_id, price, l_quantity FROM ({_SALES}) WHERE NOT sponsored")
def filter_sponsored(spark, d):
    return listing.filtered(sales(spark, d)).select("item_id", "price", "l_quantity")


@query(f"SELECT item_id, sold_date, price FROM (SELECT *, sold_date AS last_seen_at FROM ({_LISTINGS})) ORDER BY sold_date DESC NULLS LAST, last_seen_at DESC, item_id LIMIT 100")
def list_newest_first_topn(spark, d):
    return listing.newest_first(_listings(spark, d).withColumn("last_seen_at", F.col("sold_date")), 100).select("item_id", "sold_date", "price")


@query(f"SELECT site, item_id, bool_or(matches_query) AS obs_match, arg_max(position, struct_pack(a := sold_date, b := l_partkey, c := l_suppkey, d := l_quantity, e := price)) AS obs_position FROM ({_OBS}) GROUP BY ALL")
def latest_position(spark, d):
    rows = observations(spark, d).withColumn("id", F.struct("l_partkey", "l_suppkey", "l_quantity", "price")).withColumnRenamed("sold_date", "observed_at")
    return listing.latest(rows)


@query("SELECT c_custkey AS item_id, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def lookup_by_key(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("item_id"), "n_name", "r_name")


@query("SELECT 'site' AS site, CASE WHEN s_suppkey % 3 = 0 THEN concat('real-', s_suppkey) ELSE concat('s-', s_suppkey) END AS item_id, s_name FROM supplier")
def alias_lookup(spark, d):
    s = table(spark, d, "supplier").select(F.lit("site").alias("site"), F.concat(F.lit("s-"), "s_suppkey").alias("item_id"), "s_name", "s_suppkey")
    aliases = s.where("s_suppkey % 3 = 0").select("site", F.col("item_id").alias("alias_id"), F.concat(F.lit("real-"), "s_suppkey").alias("item_id"))
    return listing.resolve_alias(s.select("site", "item_id", "s_name"), aliases).select("site", "item_id", "s_name")


@query("SELECT n_nationkey AS id, page FROM nation, range(1, 4) t(page)")
def search_page_grid(spark, d):
    return reports.search_pages(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), 3).select("id", F.col("page").cast("long").alias("page"))


# --- reports --------------------------------------------------------------------------------------------------------


@query(f"""SELECT p.keywords_norm AS search_id, p.pages, p.total_results, coalesce(o.listings, 0) AS listings, coalesce(o.exact_matches, 0) AS exact_matches
FROM (SELECT p_name AS keywords_norm, count(*) AS pages, CAST(max(p_size) AS BIGINT) AS total_results FROM part GROUP BY p_name) p
LEFT JOIN (SELECT search_id, count(DISTINCT item_id) AS listings, count(DISTINCT item_id) FILTER (matches_query) AS exact_matches FROM ({_OBS}) GROUP BY search_id) o ON o.search_id = p.keywords_norm""")
def searches_report(spark, d):
    p = table(spark, d, "part")
    pages_ = p.select(F.col("p_name").alias("search_id"), F.col("p_size").cast("long").alias("total_results"))
    out = reports.searches_report(p.select(F.col("p_name").alias("id")).distinct(), pages_, observations(spark, d).select("site", "item_id", "search_id", "matches_query"))
    return out.select("search_id", "pages", "total_results", "listings", "exact_matches")


@query(f"SELECT count(*) AS listings, count(price) AS priced, count(*) FILTER (l_quantity > 25) AS with_real_id, count(*) FILTER (sponsored) AS sponsored, count(DISTINCT currency) AS sites, min(sold_date) AS first_sold, max(sold_date) AS last_sold FROM ({_SALES})")
def store_summary(spark, d):
    return reports.summary(sales(spark, d).withColumn("has_real_id", F.col("l_quantity") > 25).withColumn("site", F.col("currency")))


@query(f"SELECT currency, count(*) AS n FROM ({_SALES}) GROUP BY currency")
def summary_by_currency(spark, d):
    return reports.counts_by(sales(spark, d), "currency")


@query("""WITH c AS (SELECT *, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) = 0 AS matches_query FROM conversations)
SELECT conv_id, turn, matches_query, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM c WHERE role <> 'system'""")
def divider_flag(spark, d):
    c = table(spark, d, "conversations").withColumn("is_divider", F.col("role") == "system")
    return reports.positions(c, "conv_id", "turn").select("conv_id", "turn", "matches_query", "position")


@query("""WITH p AS (SELECT l_orderkey AS search_id, CAST(l_linenumber AS BIGINT) AS page, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, CAST(l_quantity - 1 AS BIGINT) AS listings, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS loose, l_tax > 0.01 AS has_next FROM lineitem),
u AS (SELECT * FROM p WHERE k = 1), s AS (SELECT *, coalesce(max(CASE WHEN listings = 0 OR loose > 0 OR NOT has_next THEN 1 ELSE 0 END) OVER (PARTITION BY search_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM u)
SELECT search_id, page, listings FROM s WHERE stopped = 0""")
def pages_until_stop(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1")
    rows = li.select(F.col("l_orderkey").alias("search_id"), F.col("l_linenumber").cast("long").alias("page"), (F.col("l_quantity") - 1).cast("long").alias("listings"), (F.col("l_discount") > 0.08).cast("int").alias("loose"), (F.col("l_tax") > 0.01).alias("has_next"))
    return reports.kept_pages(rows).select("search_id", "page", "listings")


@query("""SELECT event_type AS field, count(*) FILTER (value > 10) AS total, count(*) FILTER (value > 10 AND event_id % 7 <> 0 AND event_id % 5 <> 0) AS correct, count(*) FILTER (value > 10 AND event_id % 7 = 0) AS missing,
round(count(*) FILTER (value > 10 AND event_id % 7 <> 0 AND event_id % 5 <> 0) / nullif(count(*) FILTER (value > 10), 0), 4) AS accuracy FROM events GROUP BY event_type""")
def eval_accuracy(spark, d):
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, "no").otherwise("YES")
    return reports.field_accuracy(e.select(F.col("event_type").alias("field"), F.when(F.col("value") > 10, "yes").alias("expected"), said.alias("predicted")))


@query("SELECT count(*) AS requests, CAST(sum(least(ceil(p_size * 100.0 * 1500 / 750), 4784) + 700) AS BIGINT) AS input_tokens, count(*) * 1200 AS output_tokens, round((sum(least(ceil(p_size * 100.0 * 1500 / 750), 4784) + 700) * 3.0 + count(*) * 1200 * 15.0) / 1e6, 4) AS usd FROM part")
def cost_estimate(spark, d):
    return reports.cost_estimate(table(spark, d, "part").select((F.col("p_size") * 100).alias("w"), F.lit(1500).alias("h")), 700, 1200, 3.0, 15.0)


# --- merge ----------------------------------------------------------------------------------------------------------

_BY = "struct_pack(r := rank, s := seq)"


@query(f"""SELECT item_id, arg_max(condition, {_BY}) FILTER (condition IS NOT NULL) AS condition, arg_max(shipping, {_BY}) FILTER (shipping IS NOT NULL) AS shipping, arg_max(price, {_BY}) FILTER (price IS NOT NULL) AS price,
arg_max(CASE WHEN l_discount > 0.05 THEN price * 2 END, {_BY}) FILTER (l_discount > -1) AS price_max, ['vision', 'llm', 'dom'][max(rank) + 1] AS extraction FROM ({_READINGS}) GROUP BY item_id""".replace("arg_max(CASE", "arg_max_null(CASE"))
def precedence_merge(spark, d):
    rows = readings(spark, d).withColumn("price_max", F.when(F.col("l_discount") > 0.05, F.col("price") * 2))
    return merge.precedence_merge(rows, ["item_id"], ["condition", "shipping", "price", "price_max"]).select("item_id", "condition", "shipping", "price", "price_max", "extraction")


@query(f"SELECT item_id, min(sold_date) AS first_seen_at, max(sold_date) AS last_seen_at FROM ({_READINGS}) GROUP BY item_id")
def seen_interval(spark, d):
    rows = readings(spark, d).withColumn("seen_at", F.col("sold_date"))
    return merge.precedence_merge(rows, ["item_id"], ["price"]).select("item_id", "first_seen_at", "last_seen_at")


@query(f"""WITH s AS (SELECT item_id, seq, arg_max(shipping, CASE WHEN shipping IS NOT NULL THEN {_BY} END) OVER w AS shipping, arg_max(condition, {_BY}) OVER w AS condition, max(rank) OVER w AS rank
FROM ({_READINGS}) WINDOW w AS (PARTITION BY item_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, lag(shipping) OVER o AS ls, lag(condition) OVER o AS lc, lag(rank) OVER o AS lr, row_number() OVER o AS rn FROM s WINDOW o AS (PARTITION BY item_id ORDER BY seq))
SELECT count(*) FILTER (rn = 1) AS new, count(*) FILTER (rn > 1 AND (shipping IS DISTINCT FROM ls OR condition IS DISTINCT FROM lc OR rank IS DISTINCT FROM lr)) AS updated,
count(*) FILTER (rn > 1 AND shipping IS NOT DISTINCT FROM ls AND condition IS NOT DISTINCT FROM lc AND rank IS NOT DISTINCT FROM lr) AS unchanged FROM l""")
def upsert_stats(spark, d):
    return merge.upsert_stats(readings(spark, d), ["item_id"], ["shipping", "condition"])


@query(f"""WITH t AS (SELECT *, max(rank) OVER (PARTITION BY item_id ORDER BY seq) AS top FROM ({_READINGS}))
SELECT item_id, arg_max(l_discount > 0.05, seq) AS matches_query, arg_max(rank, seq) AS rank, arg_max(CASE WHEN l_quantity > 20 THEN l_suppkey END, seq) FILTER (l_quantity > 20) AS position FROM t WHERE rank >= top GROUP BY item_id""")
def observation_upsert(spark, d):
    rows = readings(spark, d).withColumn("matches_query", F.col("l_discount") > 0.05).withColumn("position", F.when(F.col("l_quantity") > 20, F.col("l_suppkey")))
    return merge.upsert_observations(rows, ["item_id"])


@query(f"SELECT item_id, arg_max(price, seq) AS price, arg_max(sold_date, seq) AS sold_date, max(seq) AS seq FROM ({_READINGS}) GROUP BY item_id")
def page_row_replace(spark, d):
    return merge.replace_by_key(readings(spark, d).select("item_id", "price", "sold_date", "seq"), ["item_id"])


# --- entity resolution ----------------------------------------------------------------------------------------------


def _second_readings(spark, d):
    """A second reading of every order against all orders; either side misses some prices and dates."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    price, day = F.floor(F.col("o_totalprice") / 5000) * 5000.0, F.to_date("o_orderdate")
    left = o.select(key.cast("string").alias("rid"), F.when(key % 3 != 0, price).alias("r_price"), F.when(key % 4 != 0, day).alias("r_date"), F.col("o_orderpriority").alias("r_title"))
    return left, o.select(key.cast("string").alias("item_id"), F.when(key % 7 != 0, price).alias("price"), F.when(key % 5 != 0, day).alias("sold_date"), F.col("o_orderpriority").alias("title_norm"))


_SECOND = """WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice / 5000) * 5000.0 AS price, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS title FROM orders),
a AS (SELECT CAST(k AS VARCHAR) AS rid, CASE WHEN k % 3 <> 0 THEN price END AS r_price, CASE WHEN k % 4 <> 0 THEN day END AS r_date, title AS r_title FROM o),
b AS (SELECT CAST(k AS VARCHAR) AS item_id, CASE WHEN k % 7 <> 0 THEN price END AS price, CASE WHEN k % 5 <> 0 THEN day END AS sold_date, title AS title_norm FROM o),
p AS (SELECT *, 1 + coalesce(CAST(r_date = sold_date AS INT), 0) AS shared FROM a JOIN b ON r_price = price WHERE coalesce(r_date = sold_date, true)
UNION ALL SELECT *, 1 AS shared FROM a JOIN b ON r_date = sold_date WHERE r_price IS NULL OR price IS NULL)"""


@query(f"{_SECOND} SELECT a.rid, count(*) FILTER (shared = 1) AS one, count(*) FILTER (shared = 2) AS two FROM a LEFT JOIN p ON p.rid = a.rid GROUP BY a.rid")
def blocking_candidates_whole(spark, d):
    return resolve.candidate_counts(*_second_readings(spark, d))


@query(f"""{_SECOND}, t AS (SELECT *, rank() OVER (PARTITION BY rid ORDER BY shared DESC) AS k FROM p WHERE r_title = title_norm)
SELECT rid, min(item_id) AS item_id, 4 AS tier, max(shared) AS shared FROM t WHERE k = 1 GROUP BY rid HAVING count(DISTINCT (title_norm, price, sold_date)) = 1""")
def best_fit_whole(spark, d):
    return resolve.best_fit_by_looks(*_second_readings(spark, d))


def _beside_next(t, key, value, by=()):
    """Each row beside the one with the next key: two different titles."""
    after = t.select(*by, (F.col(key) - 1).alias(key), F.col(value).alias("next"))
    return t.join(after, [*by, key], "left")


_WHOLE_TIER = "CASE WHEN a IS NULL OR {b} IS NULL OR a = '' OR {b} = '' THEN 0 WHEN a = {b} THEN 4 WHEN least(length(a), length({b})) >= 20 AND (starts_with(a, {b}) OR starts_with({b}, a)) THEN 3 ELSE 0 END"


@query(f"""WITH d AS (SELECT doc_id, text AS a, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN text WHEN 1 THEN left(text, length(text) - length(text) // 4) WHEN 2 THEN concat(text, ' ', text) ELSE concat(left(text, length(text) - 1), '#') END AS b FROM documents)
SELECT d.doc_id, {_WHOLE_TIER.format(b='b')} AS tier, coalesce(length(b) < length(a) AND starts_with(a, b), false) AS truncates, {_WHOLE_TIER.format(b='n.text')} AS next_tier FROM d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1""")
def title_tier_exact_whole(spark, d):
    n = "char_length(a)"
    t = _beside_next(table(spark, d, "documents").select("doc_id", F.col("text").alias("a")), "doc_id", "a")
    t = t.withColumn("b", F.expr(f"CASE doc_id % 4 WHEN 0 THEN a WHEN 1 THEN left(a, {n} - {n} div 4) WHEN 2 THEN concat(a, ' ', a) ELSE concat(left(a, {n} - 1), '#') END"))
    return t.select("doc_id", resolve.exact_tier(F.col("a"), F.col("b")).alias("tier"), F.coalesce(text.truncates(F.col("b"), F.col("a")), F.lit(False)).alias("truncates"), resolve.exact_tier(F.col("a"), F.col("next")).alias("next_tier"))


@query()
def title_tier_fuzzy(spark, d):
    """Whole titles of parts and pages, each against a misreading of itself and against the next one."""
    parts = table(spark, d, "part").select(F.lit("part").alias("source"), F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("title"))
    titles = parts.unionByName(table(spark, d, "pages").select(F.lit("page").alias("source"), F.col("page_id").cast("long").alias("id"), urls.page_title(F.col("html")).alias("title")))
    t = _beside_next(titles.select("source", "id", text.normalize_title("title").alias("a")), "id", "a", by=("source",))
    misread = F.regexp_replace("a", "e", "c")
    both = lambda b: (resolve.fuzzy_tier("a", b), F.round(resolve.similarity("a", b), 4))
    (tier, alike), (next_tier, next_alike) = both(misread), both(F.col("next"))
    return t.select("source", "id", tier.alias("tier"), alike.alias("similarity"), next_tier.alias("next_tier"), next_alike.alias("next_similarity"))


# --- text -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x{200B}-\\x{200F}\\x{2060}-\\x{2064}\\x{FEFF}\\x{AD}]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


@query("SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS slug FROM documents")
def slug(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, regexp_replace(trim(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g')), '^new listing\\s+', '') AS title_norm FROM documents")
def normalize_title_ascii(spark, d):
    """Every document; letters beyond ASCII part words here, where normalize_title keeps them."""
    return table(spark, d, "documents").select("doc_id", text.normalize_title_ascii(F.col("text")).alias("title_norm"))


@query()
def normalize_title(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_title("text").alias("title_norm"))


@query(f"SELECT item_id, l_suppkey, concat('x-', left(sha1(concat('www.ebay.com|', p_name, '|', printf('%.2f', price), '|', strftime(sold_date, '%Y-%m-%d'))), 16)) AS synthetic FROM ({_SALES}) JOIN part ON p_partkey = l_partkey WHERE regexp_full_match(p_name, '[a-z0-9 ]+')")
def synthetic_id(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name").where(F.col("p_name").rlike("^[a-z0-9 ]+$"))
    return sales(spark, d).join(p, "l_partkey").select("item_id", "l_suppkey", text.synthetic_id(F.lit(urls.DEFAULT_SITE), F.col("p_name"), F.col("price"), F.col("sold_date")).alias("synthetic"))


# --- money, dates, categories ---------------------------------------------------------------------------------------


@query(f"SELECT item_id, l_suppkey, round(price, 2) AS amount, CASE l_linenumber % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' ELSE 'EUR' END AS currency FROM ({_SALES})")
def parse_money_roundtrip(spark, d):
    n = F.format_number("price", 2)
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("US $"), n)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("£"), n)).otherwise(F.concat(F.translate(n, ",.", ".,"), F.lit(" EUR")))
    rows = sales(spark, d).withColumn("m", money.parse_money(shown))
    return rows.select("item_id", "l_suppkey", "m.amount", "m.currency")


@query(f"SELECT item_id, l_suppkey, round(price, 2) AS amount, round(price + 10, 2) AS amount_max FROM ({_SALES})")
def parse_money_range(spark, d):
    shown = F.concat(F.lit("$"), F.format_number("price", 2), F.lit(" to $"), F.format_number(F.col("price") + 10, 2))
    return sales(spark, d).withColumn("m", money.parse_money(shown, F.lit("USD"))).select("item_id", "l_suppkey", "m.amount", "m.amount_max")


@query(f"SELECT item_id, l_suppkey, CASE WHEN shipping IS NULL THEN 0.0 WHEN l_linenumber = 1 THEN NULL ELSE round(shipping, 2) END AS shipping FROM ({_SALES})")
def parse_shipping(spark, d):
    shown = F.when(F.col("shipping").isNull(), "Free delivery").when(F.col("l_linenumber") == 1, "Delivery in 2-4 days").otherwise(F.concat(F.lit("+$"), F.format_number("shipping", 2), F.lit(" delivery")))
    return sales(spark, d).select("item_id", "l_suppkey", money.parse_shipping(shown).alias("shipping"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 37 ELSE (o_orderkey % 90 + 10) * 100 END AS n FROM orders")
def parse_count(spark, d):
    k = F.col("o_orderkey")
    shown = F.when(k % 2 == 0, F.concat(F.format_number(k * 37, 0), F.lit(" bids"))).otherwise(F.concat(F.format_string("%.1f", (k % 90 + 10) / 10.0), F.lit("K sold")))
    return table(spark, d, "orders").select("o_orderkey", money.parse_count(shown).alias("n"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS sold FROM orders")
def parse_sold_date(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.concat(F.lit("Sold "), F.date_format(day, "MMM d, yyyy"))).when(k == 1, F.concat(F.lit("Verkauft "), F.date_format(day, "d. MMM. yyyy"))).when(k == 2, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "'Sold 'd MMMM yyyy"))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_sold_date(shown, F.lit("2026-05-01").cast("date")).alias("sold"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS sold FROM orders")
def parse_sold_date_day_first(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.parse_sold_date(F.date_format("o_orderdate", "dd/MM/yyyy"), F.current_date(), True).alias("sold"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'auction' WHEN event_id % 4 = 1 THEN 'best_offer' WHEN event_id % 4 = 2 THEN 'buy_it_now' ELSE 'unknown' END AS format, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 AS INT) END AS bids FROM events")
def classify_format(spark, d):
    k = F.col("event_id")
    row = F.when(k % 4 == 0, F.concat((k % 50).cast("string"), F.lit(" bids"))).when(k % 4 == 1, "or Best Offer").when(k % 4 == 2, "Buy It Now").otherwise("Located in Spain")
    return table(spark, d, "events").withColumn("f", categories.classify_format(F.array(F.lit("Pre-Owned"), row))).select("event_id", "f.format", "f.bids")


@query("SELECT s_suppkey, s_name AS seller, 99.5 AS pct, s_suppkey * 11 AS count, n_name AS location FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def parse_feedback_location(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    n = F.format_number(F.col("s_suppkey") * 11, 0)
    shown = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" 99.5% positive ("), n, F.lit(")"))).otherwise(F.concat("s_name", F.lit(" ("), n, F.lit(") 99.5%")))
    return s.withColumn("f", categories.parse_feedback(shown)).select("s_suppkey", "f.seller", "f.pct", "f.count", categories.parse_location(F.concat(F.lit("Located in "), "n_name")).alias("location"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.2f', p_retailprice), '0') END AS short FROM part")
def short_price(spark, d):
    return table(spark, d, "part").select("p_partkey", money.short_price(F.col("p_retailprice")).alias("short"))


# --- pages ----------------------------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1))"


@query(f"""SELECT page_id, concat(lower(regexp_extract(url, '^([^:]+)://', 1)), '://', {_HOST}, CASE WHEN p = '' THEN '/' ELSE p END, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) AS key FROM (
SELECT page_id, url, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS p, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'mk'))), '&') AS q FROM pages)""")
def cache_key(spark, d):
    return table(spark, d, "pages").select("page_id", urls.cache_key(F.col("url")).alias("key"))


@query("SELECT page_id, string_split(x, '=')[1] AS name, string_split(x, '=')[2] AS value FROM (SELECT page_id, unnest(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda y: y <> '')) AS x FROM pages)")
def url_params(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(urls.url_params(F.col("url"))).alias("p")).select("page_id", "p.name", "p.value")


@query("SELECT page_id, nullif(regexp_extract(concat('https://www.ebay.com/itm/', CASE WHEN page_id % 2 = 0 THEN 'title/' ELSE '' END, 100000000 + page_id, '?x=1'), '/itm/(?:[^/?#]+/)?(\\d{9,15})', 1), '') AS item_id FROM pages")
def item_id_from_url(spark, d):
    k = F.col("page_id")
    url = F.concat(F.lit("https://www.ebay.com/itm/"), F.when(k % 2 == 0, "title/").otherwise(""), 100000000 + k, F.lit("?x=1"))
    return table(spark, d, "pages").select("page_id", urls.item_id_from_url(url).alias("item_id"))


@query("SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", urls.page_title(F.col("html")).alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'rate_limited' WHEN page_id % 10 = 1 THEN 'captcha' WHEN page_id % 10 = 2 THEN 'signin' WHEN page_id % 10 = 3 THEN 'access_denied' WHEN page_id % 10 = 4 THEN 'interstitial' END AS kind FROM pages")
def page_classify(spark, d):
    k = F.col("page_id") % 10
    status = F.when(k == 0, 429).when(k == 3, 403).otherwise(200)
    url = F.when(k == 2, "https://signin.ebay.com/x").otherwise(F.col("url"))
    html = F.when(k == 1, F.concat(F.lit('<div class="g-recaptcha"></div>'), "html")).when(k == 4, F.lit("<title>Pardon Our Interruption...</title><p>x</p>")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", urls.classify_page(status, url, html).alias("kind"))


@query("""SELECT page_id, CAST(i AS BIGINT) AS position, hrefs[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages) t, LATERAL unnest(range(1, len(hrefs) + 1)) u(i)""")
def html_links(spark, d):
    return pages.links(table(spark, d, "pages")).select("page_id", "position", "href")


@query()
def visible_text_length(spark, d):
    return table(spark, d, "pages").select("page_id", F.char_length(urls.visible_text(F.col("html"))).alias("n"))


# --- geometry -------------------------------------------------------------------------------------------------------

_BOXES = "SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS id, l_partkey % 500 AS x, l_suppkey % 90 AS y, l_quantity + 20.0 AS w, l_linenumber * 10.0 AS h FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1"
_OVER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0.0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0.0)"


def _boxes(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1")
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_partkey") % 500).cast("double").alias("x"), (F.col("l_suppkey") % 90).cast("double").alias("y"), (F.col("l_quantity") + 20.0).alias("w"), (F.col("l_linenumber") * 10.0).alias("h"))


def _boxed(df, name):
    return df.select("page", F.col("id").alias(name), geometry.box(*(F.col(c) for c in "xywh")).alias(f"{name}_box"))


@query(f"SELECT a.page, a.id AS a, b.id AS b, round({_OVER} / (a.w * a.h + b.w * b.h - {_OVER}), 4) AS iou FROM ({_BOXES}) a JOIN ({_BOXES}) b ON a.page = b.page AND a.id < b.id WHERE {_OVER} > 0")
def box_iou(spark, d):
    boxes = _boxes(spark, d)
    pairs = _boxed(boxes, "a").join(_boxed(boxes, "b"), "page").where("a < b")
    a, b = F.col("a_box"), F.col("b_box")
    return pairs.where(geometry.intersection(a, b) > 0).select("page", "a", "b", F.round(geometry.iou(a, b), 4).alias("iou"))


@query(f"""WITH p AS (SELECT a.page, a.id AS field, b.id AS card, {_OVER} / (a.w * a.h) AS share FROM ({_BOXES}) a JOIN ({_BOXES}) b ON a.page = b.page WHERE a.id <= 3 AND b.id > 3)
SELECT page, field, arg_min(card, struct_pack(s := -share, c := card)) AS card, round(max(share), 4) AS share FROM p WHERE share >= 0.5 GROUP BY page, field""")
def box_containment_join(spark, d):
    boxes = _boxes(spark, d)
    fields = _boxed(boxes.where("id <= 3"), "field").withColumnRenamed("field_box", "box")
    return geometry.assign_fields(fields, _boxed(boxes.where("id > 3"), "card")).select("page", "field", "card", F.round("share", 4).alias("share"))


@query("SELECT p_partkey, CAST(i * 1120 AS BIGINT) AS start, CAST(least(i * 1120 + 1280, p_size * 200) AS BIGINT) AS end_ FROM part, LATERAL unnest(range(0, CAST(CASE WHEN p_size * 200 <= 1280 THEN 1 ELSE ceil((p_size * 200 - 1280) / 1120.0) + 1 END AS BIGINT))) u(i)")
def tile_windows(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(geometry.spans(F.col("p_size") * 200, 1280, 160)).alias("s"))
    return p.select("p_partkey", "s.start", F.col("s.end").alias("end_"))


@query()
def reading_order(spark, d):
    return geometry.reading_order(_boxes(spark, d))


@query()
def greedy_matches(spark, d):
    boxes = _boxes(spark, d)
    pairs = _boxed(boxes.where("id <= 3"), "a").join(_boxed(boxes.where("id > 3"), "b"), "page")
    return geometry.match_greedily(pairs.withColumn("score", geometry.iou(F.col("a_box"), F.col("b_box"))), least=0.2)


# --- export, json, streams ------------------------------------------------------------------------------------------


@query(f"SELECT item_id, price, shipping, round(price + shipping, 2) AS total_price, sponsored FROM ({_SALES})")
def export_projection(spark, d):
    rows = sales(spark, d).withColumn("total_price", money.total_price(F.col("price"), F.col("shipping")))
    return rows.select(*[c for c in export.export_columns() if c in rows.columns and c in ("item_id", "price", "shipping", "total_price", "sponsored")])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_map_roundtrip(spark, d):
    m = F.from_json(F.to_json(F.from_json("props", "map<string,bigint>")), "map<string,bigint>")
    return table(spark, d, "events").select("event_id", m["k"].alias("k"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return ingest.run_available(ingest.daily_counts(stream))


# --- result cards, slices, detector data ----------------------------------------------------------------------------

_ORDER_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem"


def _lines(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("i", F.row_number().over(w))


@query(f"""SELECT l_orderkey AS page_id, CAST(i AS INT) AS position, CAST(100000000000 + l_partkey AS VARCHAR) AS item_id, concat('Part ', l_partkey, ' & ', l_returnflag) AS title, l_linenumber <= 3 AS matches_query,
 round(l_extendedprice, 2) AS price, CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE round(l_quantity, 2) END AS shipping, CAST(l_shipdate AS DATE) AS sold_date, CASE WHEN l_returnflag = 'A' THEN 'Pre-Owned' ELSE 'Brand New' END AS condition FROM ({_ORDER_LINES})""")
def result_cards(spark, d):
    """Every order as a saved result page, read back."""
    c = lambda f, *names: F.format_string(f, *names)
    condition = F.when(F.col("l_returnflag") == "A", "Pre-Owned").otherwise("Brand New")
    delivery = F.when(F.col("l_linestatus") == "O", "Free delivery").otherwise(c("+$%.2f delivery", "l_quantity"))
    item = c(
        '<li class="s-card" data-listingid="%d"><div class="s-card__title"><span class="su-styled-text">Part %d &amp; %s</span></div><div class="s-card__caption">Sold %s</div><div class="s-card__subtitle">%s</div>'
        '<div class="su-card-container__attributes__primary"><div class="s-card__attribute-row"><span class="s-card__price">$%.2f</span></div><div class="s-card__attribute-row">%s</div></div></li>',
        F.col("l_partkey") + 100_000_000_000, "l_partkey", "l_returnflag", F.date_format("l_shipdate", "MMM d, yyyy"), condition, "l_extendedprice", delivery,
    )
    divide = F.when(F.col("l_linenumber") > 3, '<li class="srp-river-answer--REWRITE_START"></li>').otherwise("")
    rows = _lines(spark, d).groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("i", F.concat(divide, item).alias("h")))).alias("x"))
    html = rows.select("page_id", F.concat(F.lit('<ul class="srp-results">'), F.array_join("x.h", ""), F.lit("</ul>")).alias("html"))
    return cards.listings(cards.read_cards(html)).select("page_id", "position", "item_id", "title", "matches_query", "price", "shipping", "sold_date", "condition")


@query(f"SELECT l_orderkey AS page, CAST(i AS BIGINT) AS position, concat('part ', i) AS title, CAST(l_partkey AS VARCHAR) AS price_text, i > 3 AS below_fewer_words_heading FROM ({_ORDER_LINES})")
def merged_slices(spark, d):
    """Every order's lines as slices of three that overlap by one, joined again."""
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("page"), "i", F.format_string("part %d", "i").alias("title"), F.col("l_partkey").cast("string").alias("price_text"), (F.col("i") > 3).alias("below_fewer_words_heading"))
    at = F.floor((F.col("i") - 1) / 2)
    again = (F.col("i") % 2 == 1) & (F.col("i") > 1)
    cut = rows.withColumn("slice", F.explode(F.when(again, F.array(at - 1, at)).otherwise(F.array(at)))).withColumn("position", F.col("i").cast("long")).drop("i")
    return slices.merge_slices(cut).select("page", "position", "title", "price_text", "below_fewer_words_heading")


@query(f"""WITH b AS (SELECT page, id, CASE WHEN id > 3 THEN 'listing' ELSE 'title' END AS cls, x, y, w, h FROM ({_BOXES})), t AS (SELECT DISTINCT page, k AS tile, k * 40.0 AS ty FROM ({_BOXES}), LATERAL unnest(range(0, 4)) u(k)),
v AS (SELECT b.*, t.tile, greatest(0, least(x + w, 1000.0) - greatest(x, 0.0)) * greatest(0, least(y + h, ty + 50.0) - greatest(y, ty)) / (w * h) AS visible FROM b JOIN t USING (page) WHERE w * h > 0)
SELECT page AS render, tile, id AS region, cls, round(visible, 4) AS visible FROM v WHERE visible > 0 AND visible + 1e-9 >= CASE WHEN cls = 'listing' THEN 0.3 ELSE 0.5 END""")
def tile_labels(spark, d):
    boxes = _boxes(spark, d)
    b = boxes.select(F.col("page").alias("render"), F.col("id").alias("region"), F.when(F.col("id") > 3, "listing").otherwise("title").alias("cls"), geometry.box(*(F.col(c) for c in "xywh")).alias("box"), F.lit(None).cast("string").alias("text"))
    tile = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("tile")
    t = boxes.select(F.col("page").alias("render")).distinct().select("render", tile)
    t = t.select("render", "tile", geometry.box(F.lit(0.0), F.col("tile") * 40.0, F.lit(1000.0), F.lit(50.0)).alias("tile_box"), F.lit(1.0).alias("scale"), F.lit(1000).alias("img_w"), F.lit(50).alias("img_h"))
    return dataset.visible_boxes(b, t).select("render", "tile", "region", "cls", F.round("visible", 4).alias("visible"))


# --- identity, and entries of the interfaces that have no query above ------------------------------------------------


def _known_sales(spark, d):
    """Every order as a row, seven in eight with a real id; and a reading of every order, half of them without an id."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    shown = o.select(key, F.concat(F.lit("order number "), key.cast("string")).alias("title_norm"), F.lit("s").alias("site"), F.round("o_totalprice", 2).alias("price"), F.to_date("o_orderdate").alias("sold_date"))
    own = text.synthetic_id(F.col("site"), F.col("title_norm"), F.col("price"), F.col("sold_date"))
    rows = shown.where("o_orderkey % 5 <> 0").select(F.when(key % 8 == 0, own).otherwise(key.cast("string")).alias("item_id"), "site", "title_norm", "price", "sold_date")
    read = shown.withColumn("price", F.when(key % 3 != 0, F.col("price"))).withColumn("sold_date", F.when(key % 7 != 0, F.col("sold_date")))
    read = read.select(key.cast("string").alias("rid"), F.when(key % 2 == 0, key.cast("string")).alias("item_id"), "site", "title_norm", "price", "sold_date")
    aliased = shown.where("o_orderkey % 11 = 0").select(own.alias("alias_id"), F.concat(F.lit("merged-"), key.cast("string")).alias("item_id"))
    return read, rows, aliased


_SHORT = "concat('x-', left(sha1(concat('s|order number ', o_orderkey, '|', coalesce(printf('%.2f', {p}), ''), '|', coalesce(strftime({d}, '%Y-%m-%d'), ''))), 16))"
_FULL_ID = _SHORT.format(p="round(o_totalprice, 2)", d="o_orderdate")
_READ_ID = _SHORT.format(p="CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice, 2) END", d="CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END")


@query(f"""WITH o AS (SELECT *, {_READ_ID} AS read_id, {_FULL_ID} AS full_id, o_orderkey % 3 <> 0 OR o_orderkey % 7 <> 0 AS keyed, read_id = full_id AS whole FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS rid, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN whole AND o_orderkey % 11 = 0 THEN concat('merged-', o_orderkey)
 WHEN o_orderkey % 5 <> 0 AND keyed THEN CAST(o_orderkey AS VARCHAR) ELSE read_id END AS item_id,
 CASE WHEN o_orderkey % 2 = 0 THEN 'real' WHEN whole AND o_orderkey % 11 = 0 THEN 'alias' WHEN o_orderkey % 5 <> 0 AND keyed THEN 'match' ELSE 'new' END AS how FROM o""")
def identity_assignment(spark, d):
    """A reading of every order against rows of the others; titles differ in a number, so only a reading's own row fits."""
    return identity.assign(*_known_sales(spark, d), fuzzy=False)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS rid, CAST(o_orderkey % 10 AS VARCHAR) AS item_id FROM orders WHERE o_orderkey >= 10")
def alias_replay(spark, d):
    """Chains of ids, each ten below the one before, followed to their ends over all orders."""
    o = table(spark, d, "orders").where("o_orderkey >= 10")
    return resolve.follow(o.select(F.col("o_orderkey").cast("string").alias("rid"), (F.col("o_orderkey") - 10).cast("string").alias("item_id")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS item_id, concat('order number ', o_orderkey) AS title_norm, round(o_totalprice, 2) AS price, CAST(o_orderdate AS DATE) AS sold_date FROM orders""")
def absorb_fixpoint(spark, d):
    """Every order, real, beside two synthetic readings that show its price or its date alone: the rows that are left."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    title, price, day = F.concat(F.lit("order number "), key.cast("string")), F.round("o_totalprice", 2), F.to_date("o_orderdate")
    row = lambda i, p, s: o.select(i.alias("item_id"), F.lit("s").alias("site"), title.alias("title_norm"), p.cast("double").alias("price"), s.alias("sold_date"))
    none = F.lit(None)
    rows = row(key.cast("string"), price, none.cast("date")).unionByName(row(F.concat(F.lit("x-a"), key), price, day)).unionByName(row(F.concat(F.lit("x-b"), key), none, day))
    return identity.absorb(rows, fuzzy=False)[0].drop("site")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey = 3")
def filter_site(spark, d):
    s = table(spark, d, "supplier").withColumn("site", F.col("s_nationkey").cast("string")).withColumn("sponsored", F.lit(False))
    return listing.filtered(s, site="3").select("s_suppkey", "s_nationkey")


@query(f"SELECT item_id, price FROM ({_SALES}) WHERE item_id = '7-1'")
def filter_item_id(spark, d):
    return listing.filtered(sales(spark, d), item_id="7-1", include_sponsored=True).select("item_id", "price")


@query(f"SELECT item_id, l_suppkey, round(price + shipping, 2) AS total_price FROM ({_SALES})")
def total_price(spark, d):
    return sales(spark, d).select("item_id", "l_suppkey", money.total_price(F.col("price"), F.col("shipping")).alias("total_price"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def iso_utc(spark, d):
    return table(spark, d, "events").select("event_id", dates.iso_utc(F.col("ts")).alias("at"))


@query("SELECT user_id, event_type, max(value) AS value, arg_max(event_id, (value, -event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type")
def most_confident_field(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL").select("user_id", "event_type", F.struct("value", -F.col("event_id")).alias("conf"), "value", "event_id")
    return geometry.most_confident(e, ["user_id", "event_type"]).select("user_id", "event_type", "value", "event_id")


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus, l_quantity")
def replayed_readings(spark, d):
    """Each line twice, as a replay gives it: every reading counts once."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("search_id"), F.col("l_returnflag").alias("page"), F.col("l_linestatus").alias("extraction"), F.col("l_quantity").alias("position")).agg(F.min("l_linenumber").alias("l_linenumber"))
    return ingest.first_of_each(rows.unionByName(rows)).select(F.col("search_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'dom' WHEN page_id % 2 = 0 THEN 'vision' ELSE 'llm' END AS extraction FROM pages")
def extractor_fallback(spark, d):
    p = table(spark, d, "pages").select("page_id")
    some = lambda name, condition: lambda left: left.where(condition).withColumn("extraction", F.lit(name))
    return pages.first_that_found(p, "page_id", some("dom", "page_id % 3 = 0"), some("vision", "page_id % 2 = 0"), some("llm", "true"))


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'expected' WHEN o_orderkey % 10 = 1 THEN 'predicted' ELSE 'both' END AS side, (o_orderkey % 25) / 25.0 AS s FROM orders)
SELECT round(count(*) FILTER (side = 'both') / count(*) FILTER (side <> 'expected'), 4) AS precision, round(count(*) FILTER (side = 'both') / count(*) FILTER (side <> 'predicted'), 4) AS recall,
round(avg(s) FILTER (side = 'both'), 4) AS mean_similarity, round(count(*) FILTER (side = 'both' AND s >= 0.9) / count(*) FILTER (side = 'both'), 4) AS share_near FROM c""")
def card_report(spark, d):
    key = F.col("o_orderkey") % 10
    side = F.when(key == 0, "expected").when(key == 1, "predicted").otherwise("both")
    return reports.card_report(table(spark, d, "orders").select(side.alias("side"), (F.col("o_orderkey") % 25 / 25.0).alias("similarity")))


@query("SELECT event_type, count(*) AS requests, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS tokens_out, CAST(coalesce(sum(CASE WHEN event_id % 2 = 0 THEN 1 END), 0) AS BIGINT) AS cached FROM events GROUP BY event_type")
def usage_sums(spark, d):
    calls = table(spark, d, "events").select("event_type", F.col("event_id").alias("tokens_in"), F.col("user_id").alias("tokens_out"), F.when(F.col("event_id") % 2 == 0, 1).alias("cached"))
    return reports.usage(calls, ["event_type"])


@query("SELECT l_orderkey, l_linenumber, l_suppkey, round(greatest(0, least(1, (l_discount + l_tax) / 2 * 0.9 * CASE WHEN l_quantity > 25 THEN 0.5 ELSE 1 END * CASE WHEN l_linenumber = 1 THEN 0.7 ELSE 1 END)), 3) AS confidence FROM lineitem")
def confidence_score(spark, d):
    fields = F.map_from_arrays(F.array(F.lit("price"), F.lit("title")), F.array("l_discount", "l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", reports.confidence(fields, F.lit(0.9), F.col("l_quantity") > 25, F.col("l_linenumber") == 1).alias("confidence"))


# --- transcribed cards, texts off pixels, crops ----------------------------------------------------------------------


@query(f"""WITH e AS (SELECT *, bool_or(l_linenumber = 4) OVER (PARTITION BY l_orderkey ORDER BY i) AS below FROM ({_ORDER_LINES})) SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS position,
 concat('Part ', l_partkey) AS title, NOT below AS matches_query, CASE WHEN l_returnflag <> 'N' THEN round(l_extendedprice, 2) END AS price, CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice + 10, 2) END AS original_price,
 concat('$', printf('%.2f', l_extendedprice)) AS price_text, CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE round(l_quantity, 2) END AS shipping, CAST(l_shipdate AS DATE) AS sold_date, 'Pre-Owned' AS condition,
 CASE WHEN l_linestatus = 'F' THEN 'auction' ELSE 'best_offer' END AS listing_format, CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS INT) END AS bids FROM e WHERE l_linenumber % 3 <> 0""")
def transcribed_cards(spark, d):
    """Every order's lines as a transcribed page: untitled entries, struck prices, and loose matches from the fourth line on."""
    line = F.col("l_linenumber")
    usd = lambda c: F.format_string("$%.2f", c)
    by_flag = lambda a, n, r: F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "N", n).otherwise(r)
    price, none = F.col("l_extendedprice"), F.lit(None).cast("string")
    closed = F.col("l_linestatus") == "F"
    entry = F.struct(
        "i", F.when(line % 3 == 0, " ").otherwise(F.format_string("New Listing Part %d", "l_partkey")).alias("title"), by_flag(usd(price), none, usd(price)).alias("price_text"), by_flag(none, usd(price), usd(price + 10)).alias("original_price_text"),
        F.date_format("l_shipdate", "'Sold' MMM d, yyyy").alias("sold_date_text"), F.when(closed, F.format_string("+$%.2f delivery", "l_quantity")).otherwise("Free delivery").alias("shipping_text"), F.lit("Pre-Owned · Maker").alias("condition"),
        F.when(closed, none).otherwise("or Best Offer").alias("format_text"), F.when(closed, F.format_string("%d bids", line)).alias("bids_text"), (line == 4).alias(transcribed.FLAG),
    )
    answers = _lines(spark, d).groupBy(F.col("l_orderkey").alias("page")).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("answer"))
    read = transcribed.listings(transcribed.entries(answers))
    return read.select("page", "position", "title", "matches_query", "price", "original_price", "price_text", "shipping", "sold_date", "condition", "listing_format", "bids")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, concat('Part ', l_partkey) AS title, round(l_extendedprice, 2) AS price, CASE WHEN l_returnflag = 'A' THEN 'GBP' ELSE 'USD' END AS currency, CASE WHEN l_linestatus = 'O' THEN 0.0 END AS shipping,
 CAST(l_shipdate AS DATE) AS sold_date, CASE WHEN l_tax > 0.04 THEN 'Pre-Owned' END AS condition FROM lineitem""")
def pixel_cards(spark, d):
    """Every line as the texts that were read off its card."""
    sign = F.when(F.col("l_returnflag") == "A", "£%.2f").otherwise("$%.2f")
    shown = {"title": F.format_string("NEW LISTING Part %d", "l_partkey"), "price": F.when(sign == "£%.2f", F.format_string("£%.2f", "l_extendedprice")).otherwise(F.format_string("$%.2f", "l_extendedprice")), "shipping": F.when(F.col("l_linestatus") == "O", "Free delivery"), "sold_date": F.date_format("l_shipdate", "'Sold' d MMM yyyy"), "condition": F.when(F.col("l_tax") > 0.04, " Pre-Owned")}
    texts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in shown.items()]), lambda e: e["v"].isNotNull()))
    read = transcribed.from_pixels(table(spark, d, "lineitem").withColumn("texts", texts), ["l_orderkey", "l_linenumber", "l_suppkey"])
    return read.select("l_orderkey", "l_linenumber", "l_suppkey", "title", "price", "currency", "shipping", "sold_date", "condition")


@query(f"""WITH b AS ({_BOXES}), o AS (SELECT a.page, a.id, a.y, a.h, a.y + a.h / 2 AS m, c.y AS oy, c.h AS oh, c.y + c.h / 2 AS om FROM b a LEFT JOIN b c ON c.page = a.page AND c.id <> a.id AND least(a.x + a.w, c.x + c.w) > greatest(a.x, c.x)),
t AS (SELECT page, id, any_value(y) AS y, any_value(h) AS h, max(least(oy + oh, m - 1)) FILTER (om < m) AS roof, min(greatest(oy, m + 1)) FILTER (om > m) AS floor FROM o GROUP BY page, id)
SELECT page, id, round(greatest(y, coalesce(roof, y)), 4) AS top, round(greatest(1.0, least(y + h, coalesce(floor, y + h)) - greatest(y, coalesce(roof, y))), 4) AS height FROM t""")
def trimmed_boxes(spark, d):
    """Each box cut where others of its page come in."""
    boxed = _boxes(spark, d).select("page", "id", geometry.box(*(F.col(c) for c in "xywh")).alias("box"))
    beside = boxed.groupBy("page").agg(F.collect_list(F.struct("id", "box")).alias("all"))
    others = F.transform(F.filter("all", lambda o: o["id"] != F.col("id")), lambda o: o["box"])
    cut = boxed.join(beside, "page").select("page", "id", geometry.trimmed(F.col("box"), others).alias("cut"))
    return cut.select("page", "id", F.round("cut.y", 4).alias("top"), F.round("cut.h", 4).alias("height"))


@query("""SELECT p_partkey, CASE WHEN p_size > 20 THEN 20 ELSE p_size END AS w, CASE WHEN p_size > 20 THEN greatest(1, CAST(round_even(p_partkey * 20.0 / p_size, 0) AS BIGINT)) ELSE p_partkey END AS h FROM part""")
def scaled_sizes(spark, d):
    return table(spark, d, "part").select("p_partkey", geometry.scaled_size(F.col("p_size"), F.col("p_partkey"), 20).alias("s")).select("p_partkey", "s.w", "s.h")
