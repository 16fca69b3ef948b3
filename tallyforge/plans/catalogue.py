"""The registered queries of the engine, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates as A
from ..operators import context as C
from ..operators import linegraph as G
from ..operators import predicates as P
from ..operators import scanning as S
from ..session import shared_path
from ..sources import logs, parts, readers
from ..streaming import live
from .lite_sql import lite_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _micros(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


# filters and aggregates


@query("SELECT count(*)::BIGINT AS n FROM events")
def q01_count_all(spark, sf_dir):
    return _events(spark, sf_dir).agg(A.count_rows().alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE user_id > 50")
def q02_count_gt(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.filter(P.greater(e, "user_id", 50)).agg(A.count_rows().alias("n"))


@query("SELECT coalesce(sum(user_id), 0)::BIGINT AS s FROM events WHERE event_id > 500")
def q03_sum_gt(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.filter(P.greater(e, "event_id", 500)).agg(A.sum_or_zero(e, "user_id").alias("s"))


@query("SELECT coalesce(sum(user_id), 0)::BIGINT AS s, coalesce(max(user_id), 0)::BIGINT AS m FROM events WHERE event_id < 0")
def q04_sum_max_empty(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.filter("event_id < 0").agg(A.sum_or_zero(e, "user_id").alias("s"), A.max_or_zero(e, "user_id").alias("m"))


@query("SELECT max(user_id)::BIGINT AS m FROM events")
def q05_max(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.agg(A.max_or_zero(e, "user_id").alias("m"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE epoch_us(ts) BETWEEN 1704067200000000 AND 1704672000000000")
def q06_range_count(spark, sf_dir):
    e = _events(spark, sf_dir)
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 00:00:00", "2024-01-08 00:00:00"))
    return e.filter(P.in_range(e, "ts", low, high)).agg(A.count_rows().alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE contains(props, '87')")
def q07_contains_count(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.filter(P.contains(e, "props", "87")).agg(A.count_rows().alias("n"))


@query("SELECT count(*) FILTER (WHERE starts_with(url, 'http://'))::BIGINT AS n FROM pages")
def q08_prefix_count(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.agg(A.count_where(P.starts_with(p, "url", "http://")).alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE user_id > 50 AND contains(props, '8')")
def q09_gt_and_contains(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.filter(P.every(P.greater(e, "user_id", 50), P.contains(e, "props", "8"))).agg(A.count_rows().alias("n"))


@query("SELECT ((sum(v) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS s FROM (SELECT 9223372036854775807::HUGEINT - 10 * event_id AS v FROM events)")
def q04b_wrapping_sum(spark, sf_dir):
    e = _events(spark, sf_dir).select((F.lit((1 << 63) - 1) - 10 * F.col("event_id")).alias("v"))
    return e.agg(A.sum_or_zero(e, "v", wrap=True).alias("s"))


@query("SELECT count(*) FILTER (WHERE user_id > 100)::BIGINT AS n FROM events")
def q02b_count_if(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.agg(A.count_where(P.greater(e, "user_id", 100)).alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE event_type IN ('click', 'view') AND NOT (user_id <= 20 OR user_id = 33) AND props LIKE '%k%' AND props IS NOT NULL")
def q09b_other_predicates(spark, sf_dir):
    e = _events(spark, sf_dir)
    c = F.col
    return e.filter(c("event_type").isin("click", "view") & ~((c("user_id") <= 20) | (c("user_id") == 33)) & c("props").like("%k%") & c("props").isNotNull()).agg(A.count_rows().alias("n"))


# the small SQL


def _lite(spark, sf_dir, text):
    return lite_sql(spark, text.replace("EVENTS", f"'{sf_dir}/events.parquet'"))


@query('SELECT count(*)::BIGINT AS "count" FROM events WHERE event_id > 500')
def q10_lite_count(spark, sf_dir):
    return _lite(spark, sf_dir, "SELECT COUNT(*) FROM EVENTS WHERE 0 > 500")


@query("SELECT coalesce(sum(user_id), 0)::BIGINT AS sum_user_id FROM events WHERE contains(props, '8')")
def q11_lite_sum(spark, sf_dir):
    return _lite(spark, sf_dir, "select sum(2) from EVENTS where 5 contains '8'")


@query('SELECT count(*)::BIGINT AS "count", coalesce(sum(user_id), 0)::BIGINT AS sum_user_id, coalesce(max(event_id), 0)::BIGINT AS max_event_id FROM events WHERE event_id BETWEEN 100 AND 900 AND user_id > 20')
def q12_lite_several(spark, sf_dir):
    return _lite(spark, sf_dir, "SELECT COUNT(*), SUM(user_id), MAX(0) FROM EVENTS WHERE event_id BETWEEN 100 AND 900 AND user_id > 20;")


@query('SELECT event_type, count(*)::BIGINT AS "count", max(user_id)::BIGINT AS max_user_id FROM events WHERE user_id >= 10 GROUP BY event_type ORDER BY "count" DESC, event_type LIMIT 3')
def q12b_lite_grouped(spark, sf_dir):
    return _lite(spark, sf_dir, "SELECT event_type, COUNT(*), MAX(user_id) FROM EVENTS WHERE user_id >= 10 GROUP BY event_type ORDER BY count DESC, event_type LIMIT 3")


@query("SELECT count(*)::BIGINT AS \"count\" FROM events WHERE event_type = 'click'")
def q12c_lite_text(spark, sf_dir):
    return _lite(spark, sf_dir, "SELECT COUNT(*) FROM EVENTS WHERE event_type = 'click'")


@query("SELECT min(user_id)::BIGINT AS min_user_id, avg(user_id) AS avg_user_id, count(*)::BIGINT AS \"count\" FROM events WHERE (event_type IN ('click', 'view') OR props LIKE '%7%') AND NOT user_id = 33 AND props IS NOT NULL AND value >= 1.5")
def q12d_lite_logic(spark, sf_dir):
    return _lite(spark, sf_dir, "SELECT MIN(user_id), AVG(user_id), COUNT(*) FROM EVENTS WHERE (event_type IN ('click', 'view') OR props LIKE '%7%') AND NOT user_id = 33 AND props IS NOT NULL AND value >= 1.5")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click') ORDER BY event_id DESC LIMIT 7 OFFSET 2")
def q12e_lite_rows(spark, sf_dir):
    return _lite(spark, sf_dir, "SELECT event_id, 3 FROM EVENTS WHERE event_type NOT IN ('click') ORDER BY event_id DESC LIMIT 7 OFFSET 2")


@query("SELECT event_id, epoch_us(ts + INTERVAL 36 HOURS)::BIGINT AS later_us, epoch_us(ts - INTERVAL 1 MONTH)::BIGINT AS before_us, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS days FROM events")
def q06b_intervals(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.unix_micros((F.col("ts") + F.expr("INTERVAL 36 HOURS")).cast("timestamp")).alias("later_us"), F.unix_micros((F.col("ts") - F.expr("INTERVAL 1 MONTH")).cast("timestamp")).alias("before_us"), F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("days"))


# parts

_GRANULES = "SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS g, epoch_us(ts) AS t FROM events"
_GRANULE_INDEX = f"SELECT g::BIGINT AS granule_id, min(t)::BIGINT AS min_ts, max(t)::BIGINT AS max_ts, count(*)::BIGINT AS n_rows FROM ({_GRANULES}) GROUP BY g"
_LOW, _HIGH = 1704672000000000, 1705017600000000


def _granules(spark, sf_dir):
    e = _events(spark, sf_dir).select(_micros().alias("ts"), "event_id")
    return parts.granule_index(e, "ts", "event_id", rows=1000)


@query(_GRANULE_INDEX)
def q13_granule_index(spark, sf_dir):
    return _granules(spark, sf_dir)


@query(f"SELECT * FROM ({_GRANULE_INDEX}) WHERE max_ts >= {_LOW} AND min_ts <= {_HIGH}")
def q14_granule_prune(spark, sf_dir):
    return parts.prune_granules(_granules(spark, sf_dir), _LOW, _HIGH)


@query(f"SELECT count(*) FILTER (WHERE max_ts >= {_LOW} AND min_ts <= {_HIGH})::BIGINT AS matched, count(*)::BIGINT AS total, count(*) FILTER (WHERE NOT (max_ts >= {_LOW} AND min_ts <= {_HIGH}))::BIGINT AS skipped FROM ({_GRANULE_INDEX})")
def q14b_pruning_report(spark, sf_dir):
    return parts.pruning_report(_granules(spark, sf_dir), _LOW, _HIGH)


def _merged(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", _micros().alias("ts"), "user_id", "event_type", "value", "props")
    at = [shared_path(spark, f"part{i}") for i in range(2)]
    for i, p in enumerate(at):
        parts.write_part(e.filter(F.col("event_id") % 2 == i), p, "ts", "event_id")
    return parts.merge_parts(spark, at, shared_path(spark, "merged"), "ts", "event_id")


@query("SELECT event_id, epoch_us(ts)::BIGINT AS ts, user_id, event_type, value, props FROM events")
def q15_merge_parts(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(f"SELECT count(*)::BIGINT AS n FROM events WHERE epoch_us(ts) BETWEEN {_LOW} AND {_HIGH}")
def q16_pruned_range(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return m.filter(P.in_range(m, "ts", _LOW, _HIGH)).agg(A.count_rows().alias("n"))


@query("SELECT 'online' AS state, count(*)::BIGINT AS n_rows, 6::INTEGER AS n_columns, 8192::INTEGER AS page_rows FROM events")
def q16b_part_status(spark, sf_dir):
    return parts.status(spark, f"{sf_dir}/events.parquet").drop("n_files", "n_bytes")


@query("SELECT codec, count(*)::BIGINT AS n_rows, codec <> 'uncompressed' AS is_smaller FROM events CROSS JOIN (VALUES ('uncompressed'), ('snappy'), ('zstd')) c(codec) GROUP BY codec")
def q15b_codecs(spark, sf_dir):
    sizes = parts.codec_sizes(_events(spark, sf_dir), shared_path(spark, "codecs"), ["uncompressed", "snappy", "zstd"], "ts", "event_id")
    plain = sizes.agg(F.max("n_bytes")).first()[0]
    return sizes.select("codec", "n_rows", (F.col("n_bytes") < plain).alias("is_smaller"))


@query("SELECT count(*)::BIGINT AS n, min(ts)::BIGINT AS first_ts, max(ts)::BIGINT AS last_ts, count(*) FILTER (WHERE value BETWEEN 0 AND 999)::BIGINT AS in_bounds FROM (SELECT range AS ts, 0 AS value FROM range(20000))")
def q16c_made_records(spark, sf_dir):
    r = logs.made_records(spark, 20000)
    return r.agg(A.count_rows().alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), A.count_where(P.in_range(r, "value", 0, 999)).alias("in_bounds"))


# text

_HITS = "sum((length({c}) - length(replace({c}, '{p}', ''))) // {n})::BIGINT"


@query(f"SELECT {_HITS.format(c='html', p='<div', n=4)} AS hits FROM pages")
def q17_occurrences(spark, sf_dir):
    return S.count_pattern(_table(spark, sf_dir, "pages"), "html", "<div")


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, {_HITS.format(c='text', p=p, n=len(p))} AS hits FROM documents" for p in ("the", "an", "th")))
def q18_indicator_report(spark, sf_dir):
    return S.indicator_report(_table(spark, sf_dir, "documents"), "text", ["the", "an", "th"])


@query(" UNION ALL ".join(f"SELECT role, '{p}' AS pattern, {_HITS.format(c='text', p=p, n=len(p))} AS hits FROM conversations GROUP BY role" for p in ("e", "in")))
def q18b_report_by_group(spark, sf_dir):
    return S.indicator_report(_table(spark, sf_dir, "conversations"), "text", ["e", "in"], "role")


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, {_HITS.format(c='text', p=p, n=len(p))} AS hits FROM documents" for p in ("the", "and", "/.env")))
def q18c_scan_files(spark, sf_dir):
    at = shared_path(spark, "raw")
    _table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit(""))).write.text(at)
    return S.scan_files(spark, [at, at + "-missing"], ["the", "and", "/.env"]).groupBy("pattern").agg(F.sum("hits").alias("hits"))


@query("SELECT 20000::BIGINT AS n_lines, 20000::BIGINT AS n_parsed, 4::BIGINT AS n_odd, 0::BIGINT AS n_other_odd_status")
def q19_weblog_parse(spark, sf_dir):
    p = logs.parse_weblog(logs.made_weblog(spark, 20000))
    odd = F.col("ip").isin(*logs.ODD_IPS)
    return p.agg(A.count_rows().alias("n_lines"), F.count("ts").alias("n_parsed"), A.count_where(odd).alias("n_odd"), A.count_where(odd & (F.col("status") != 404)).alias("n_other_odd_status"))


_LINES = ["unit A energy=80 -> B", "unit B energy 55", "energy=-5 -> 0", "subunit C energy=- -> Nowhere", "", "-> A unit A", "unit D energy=49 -> 1x"]


@query("""
WITH l(line_no, text) AS (VALUES """ + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_LINES)) + r"""),
a AS (SELECT line_no::BIGINT AS line_no, text, regexp_extract(text, 'unit  *([^ \r\n]{0,63})', 1) AS unit,
  regexp_extract(text, 'energy[^0-9-]*(-?[0-9]*)', 1) AS e, regexp_extract(text, '-> *([^ \r\n]{0,63})', 1) AS raw FROM l),
b AS (SELECT *, CASE e WHEN '' THEN -1 WHEN '-' THEN 0 ELSE e::INTEGER END AS energy,
  CASE WHEN regexp_matches(raw, '^[0-9]') THEN '' ELSE raw END AS target_name,
  CASE WHEN raw = '' THEN -1 WHEN regexp_matches(raw, '^[0-9]') THEN regexp_extract(raw, '^([0-9]+)', 1)::INTEGER ELSE -2 END AS target_line FROM a),
u AS (SELECT unit, min(line_no) AS place FROM b WHERE unit <> '' GROUP BY unit),
r AS (SELECT b.*, CASE WHEN target_line >= 0 THEN target_line::BIGINT WHEN target_line = -2 THEN coalesce(place, -1) ELSE -1 END AS resolved_idx FROM b LEFT JOIN u ON b.target_name = u.unit)
SELECT r.line_no, r.text, r.unit, r.energy::INTEGER AS energy, CASE WHEN r.energy >= 80 THEN 'red' WHEN r.energy >= 50 THEN 'orange' WHEN r.energy >= 0 THEN 'green' ELSE 'blue' END AS colour,
  r.target_name, r.target_line::INTEGER AS target_line, r.resolved_idx::BIGINT AS resolved_idx, coalesce(t.energy, -1)::INTEGER AS target_energy FROM r LEFT JOIN r t ON r.resolved_idx = t.line_no
""")
def q20_line_language(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(_LINES)), "line_no long, text string")
    return G.with_target_energy(G.analyse(lines)).fillna(-1, ["target_energy"])


@query("SELECT i::INTEGER AS ticks, round(80 - 80 * power(0.9::DOUBLE, i), 6) AS value FROM (VALUES (0), (1), (10), (40)) t(i)")
def q20b_smoothing(spark, sf_dir):
    one = spark.range(1)
    values = [F.struct(F.lit(n).alias("ticks"), F.round(G.smoothed(F.lit(0), F.lit(80), n), 6).alias("value")) for n in (0, 1, 10, 40)]
    return one.select(F.explode(F.array(*values)).alias("v")).select("v.*")


@query("SELECT s::INTEGER AS step, round(3 * (1 - s / 20.0) * (1 - s / 20.0) * (s / 20.0) * 10 + 3 * (1 - s / 20.0) * (s / 20.0) * (s / 20.0) * 20 + (s / 20.0) * (s / 20.0) * (s / 20.0) * 40, 6)::DOUBLE AS y FROM range(21) t(s)")
def q20c_curve(spark, sf_dir):
    edge = spark.range(1).select(F.lit(0).alias("a"), F.lit(10).alias("b"), F.lit(20).alias("c"), F.lit(40).alias("d"))
    return G.curve(edge, "a", "b", "c", "d").select("step", F.round("at", 6).alias("y"))


# grouping, order, joins


@query("SELECT event_type, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS s, min(user_id) AS low, max(user_id) AS high, round(avg(user_id), 6) AS mean, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def q21_group_by(spark, sf_dir):
    return A.summarise(_events(spark, sf_dir), "event_type", n=A.count_rows(), s=F.sum("user_id"), low=F.min("user_id"), high=F.max("user_id"), mean=F.round(F.avg("user_id"), 6), users=F.count_distinct("user_id"))


@query("SELECT c_mktsegment, coalesce(c_nationkey, -1)::INTEGER AS c_nationkey, count(*)::BIGINT AS n, grouping(customer.c_nationkey)::TINYINT AS g FROM customer GROUP BY CUBE (c_mktsegment, customer.c_nationkey)")
def q21b_cube(spark, sf_dir):
    return _table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.grouping("c_nationkey").alias("g")).fillna(-1, ["c_nationkey"])


_LOOSE = "coalesce(c_mktsegment, '-') AS c_mktsegment, coalesce(c_nationkey, -1)::INTEGER AS c_nationkey, count(*)::BIGINT AS n"


@query(f"SELECT {_LOOSE} FROM customer GROUP BY ROLLUP (customer.c_mktsegment, customer.c_nationkey)")
def q21c_rollup(spark, sf_dir):
    return _table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(A.count_rows().alias("n")).fillna(-1, ["c_nationkey"]).fillna("-", ["c_mktsegment"])


@query(f"SELECT {_LOOSE} FROM customer GROUP BY GROUPING SETS ((customer.c_mktsegment), (customer.c_nationkey), ())")
def q21d_grouping_sets(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    sets = c.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey")
    return sets.agg(A.count_rows().alias("n")).fillna(-1, ["c_nationkey"]).fillna("-", ["c_mktsegment"])


@query("SELECT event_type, round(stddev_samp(user_id), 6) AS sd, round(var_pop(user_id), 6) AS variance, median(user_id) AS middle, TRUE AS about FROM events GROUP BY event_type")
def q21e_spread(spark, sf_dir):
    about = F.abs(F.approx_count_distinct("user_id", 0.02) - F.count_distinct("user_id")) <= 0.1 * F.count_distinct("user_id")
    return A.summarise(_events(spark, sf_dir), "event_type", sd=F.round(F.stddev_samp("user_id"), 6), variance=F.round(F.var_pop("user_id"), 6), middle=F.median("user_id"), about=about)


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def q22_top_k(spark, sf_dir):
    return A.top(A.summarise(_events(spark, sf_dir), "event_type", n=A.count_rows()), 3, F.col("n").desc(), F.col("event_type"))


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 3")
def q22b_preview(spark, sf_dir):
    return A.top(_events(spark, sf_dir).select("event_id", "user_id", "value"), 3, F.col("event_id"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 4 OFFSET 11")
def q22c_offset(spark, sf_dir):
    return A.top(_events(spark, sf_dir).select("event_id", "user_id"), 4, F.col("event_id"), skip=11)


@query("SELECT c_mktsegment, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def q23_fact_dimension(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return A.summarise(C.with_dimension(o.withColumnRenamed("o_custkey", "c_custkey"), c, "c_custkey", "inner"), "c_mktsegment", n=A.count_rows())


_AS_OF = """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
k AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, coalesce(k.click_id, -1) AS click_id FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.ts >= k.ts
"""


@query(_AS_OF)
def q24_as_of(spark, sf_dir):
    e = _events(spark, sf_dir)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return C.as_of(left, right, ["user_id"], "ts", "click_ts", ["click_id"], ["click_id"]).select("event_id", "user_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"))


@query("SELECT e.event_id, r.lo FROM events e JOIN (SELECT DISTINCT event_id // 100 * 100 AS lo FROM events) r ON e.event_id BETWEEN r.lo AND r.lo + 30")
def q24b_range_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    low = (F.floor(F.col("event_id") / 100) * 100).cast("long")
    ranges = e.select(low.alias("lo"), (low + 30).alias("hi")).distinct()
    return C.range_join(e, ranges, "event_id", "lo", "hi", 50.0).select("event_id", "lo")


_RICH = "SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000"


@query(f"SELECT 'with' AS kind, count(*)::BIGINT AS n FROM customer WHERE EXISTS ({_RICH}) UNION ALL SELECT 'without', count(*)::BIGINT FROM customer WHERE NOT EXISTS ({_RICH})")
def q25_semi_anti(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    rich = _table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how, kind: c.join(rich, "c_custkey", how).agg(A.count_rows().alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query("SELECT n_name, s_name FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey")
def q25b_outer_join(spark, sf_dir):
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "full").select("n_name", "s_name")


@query("SELECT 'left' AS kind, n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey UNION ALL SELECT 'right', n_name, s_name FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal > 0")
def q25d_one_sided_joins(spark, sf_dir):
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    same = n.n_nationkey == s.s_nationkey
    left = n.join(s, same, "left").select(F.lit("left").alias("kind"), "n_name", "s_name")
    return left.unionByName(s.join(n, same & (s.s_acctbal > 0), "right").select(F.lit("right").alias("kind"), "n_name", "s_name"))


@query("(SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') EXCEPT SELECT user_id FROM events WHERE user_id > 75 UNION SELECT -1")
def q25c_set_operations(spark, sf_dir):
    e = _events(spark, sf_dir)
    ids = lambda where: e.filter(where).select("user_id")
    both = ids("event_type = 'click'").intersect(ids("event_type = 'purchase'"))
    return both.subtract(ids("user_id > 75")).union(spark.range(1).select(F.lit(-1).cast("long"))).distinct()


@query("""
SELECT event_id, round((value - m) / s, 6) AS z FROM (SELECT event_id, value, avg(value) OVER w AS m, CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w END AS s
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
""")
def q26_drift(spark, sf_dir):
    return C.drift(_events(spark, sf_dir).select("event_id", "ts", "event_type", "value"), "value", ["event_type"], ["ts", "event_id"]).select("event_id", F.round("z", 6).alias("z"))


@query("SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events")
def q27_json_field(spark, sf_dir):
    return C.json_fields(_events(spark, sf_dir).select("event_id", "props"), "props", "k INT").select("event_id", "k")


@query("SELECT count(*)::BIGINT AS n FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'")
def q27b_time_travel(spark, sf_dir):
    return C.as_at(_events(spark, sf_dir), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).agg(A.count_rows().alias("n"))


@query("SELECT event_type, arg_max(user_id, (m, user_id)) AS best_setting, round(max(m), 6) AS mean_outcome FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY event_type")
def q27c_best_setting(spark, sf_dir):
    return C.best_setting(_events(spark, sf_dir), "event_type", "user_id", "value").withColumn("mean_outcome", F.round("mean_outcome", 6))


@query("SELECT event_id, sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM events")
def q27d_running_total(spark, sf_dir):
    return C.running(_events(spark, sf_dir).select("event_id", "ts", "event_type", "user_id"), "user_id", ["event_type"], ["ts", "event_id"]).select("event_id", "total")


# streams

_EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _stream(spark, sf_dir, where="true", heartbeat=False):
    """The events as a part that a stream reads; with a heartbeat also one event of a far day, which ends all windows."""
    at = shared_path(spark, "stream-in")
    e = _events(spark, sf_dir).filter(where).withColumn("ts", F.col("ts").cast("timestamp"))
    if heartbeat:
        e = e.unionByName(spark.sql("SELECT -1L AS event_id, TIMESTAMP '2100-01-01' AS ts, -1L AS user_id, '' AS event_type, 0D AS value, '' AS props"))
    parts.write_part(e, at, "ts", "event_id")
    return live.stream_parts(spark, at, _EVENT)


@query("SELECT epoch_us(date_trunc('day', ts))::BIGINT AS day_us, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def q28_tumbling(spark, sf_dir):
    out = live.drain(live.tumbling(_stream(spark, sf_dir), "ts", "1 day", "event_type", delay="2 days"), "update", "window_start", "event_type")
    return out.select(F.unix_micros("window_start").alias("day_us"), "event_type", "n")


@query("""
SELECT epoch_us(t - to_hours(h::BIGINT))::BIGINT AS start_us, count(*)::BIGINT AS n FROM
(SELECT date_trunc('hour', ts) AS t, unnest([0, 1, 2]) AS h FROM events) GROUP BY 1
""")
def q28b_sliding(spark, sf_dir):
    out = live.drain(live.tumbling(_stream(spark, sf_dir), "ts", "3 hours", slide="1 hour", delay="2 days"), "update", "window_start")
    return out.select(F.unix_micros("window_start").alias("start_us"), "n")


@query("SELECT epoch_us(date_trunc('day', ts))::BIGINT AS day_us, count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def q28c_late_data(spark, sf_dir):
    """The first days come in after the watermark has passed them: their windows are closed."""
    at = shared_path(spark, "stream-in")
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    parts.write_part(e.filter("ts >= '2024-01-05'"), at, "ts", "event_id", files=1)
    stream = live.stream_parts(spark, at, _EVENT, files_per_batch=1)
    late = lambda: parts.write_part(e.filter("ts < '2024-01-05'"), at, "ts", "event_id", files=1, mode="append")
    out = live.drain(live.tumbling(stream, "ts", "1 day", delay="1 day"), "update", "window_start", again=late)
    return out.select(F.unix_micros("window_start").alias("day_us"), "n")


@query("""
WITH f AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, epoch_us(max(ts) + INTERVAL 6 HOURS)::BIGINT AS end_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, k
""")
def q29_sessions(spark, sf_dir):
    out = live.drain(live.sessions(_stream(spark, sf_dir, heartbeat=True), "ts", "6 hours", "user_id", delay="2 days"), "append")
    return out.filter("user_id >= 0").select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def q30_live_tail(spark, sf_dir):
    """Three batches: two have become a part when the query runs, one is in flight."""
    at = shared_path(spark, "stream-in")
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    parts.write_part(e, at, "ts", "event_id", files=3)
    table = live.LiveTable(spark, shared_path(spark, "live"), _EVENT, "ts", "event_id", flush_rows=e.count() // 2)
    table.ingest(live.stream_parts(spark, at, _EVENT, files_per_batch=1), shared_path(spark, "log")).awaitTermination()
    return table.read().select("event_id", "user_id", "event_type")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def q30b_stream_dimension(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = C.with_dimension(_stream(spark, sf_dir), c, "user_id", "inner")
    return live.drain(joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT DISTINCT user_id FROM events")
def q30c_stream_distinct(spark, sf_dir):
    return live.drain(live.distinct_within(_stream(spark, sf_dir), "ts", "60 days", "user_id").select("user_id"), "append")


@query("SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 12 HOURS")
def q30d_stream_join(spark, sf_dir):
    clicks = _stream(spark, sf_dir, "event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    bought = _stream(spark, sf_dir, "event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return live.drain(live.stream_join(clicks, bought, "user_id", "click_ts", "ts", "12 hours", "2 days"), "append").select("click_id", "purchase_id")


@query("SELECT count(*)::BIGINT AS n_rows FROM events")
def q30e_health(spark, sf_dir):
    done = live.ingest(_stream(spark, sf_dir), shared_path(spark, "ingested"), shared_path(spark, "log"), "ts", "event_id")
    done.awaitTermination()
    return live.health_table(spark, done).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


# other sources


@query("SELECT event_id, user_id, event_type FROM events")
def q31_formats(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type")
    out = []
    for i, kind in enumerate(("orc", "json", "csv")):  # a third of the table each
        at = shared_path(spark, kind)
        readers.write_files(e.filter(F.col("event_id") % 3 == i), at, kind)
        out.append(readers.read_files(spark, at, kind, e.schema))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT range::BIGINT AS line_no, 'line ' || range AS line FROM range(20000)")
def q31b_numbered_lines(spark, sf_dir):
    at = shared_path(spark, "lines")
    spark.range(20000).coalesce(1).select(F.concat(F.lit("line "), F.col("id"))).write.text(at)
    return logs.numbered_lines(spark, at).select("line_no", "line")


@query("SELECT n_name AS line FROM nation UNION ALL SELECT text FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM conversations) WHERE text <> ''")
def q31c_wide_text(spark, sf_dir):
    at = shared_path(spark, "utf16")
    told = _table(spark, sf_dir, "conversations").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter("line <> ''")
    logs.write_lines(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("line")).unionByName(told), at, encoding="UTF-16LE", line_end="\r\n")
    return logs.read_lines(spark, at, encoding="UTF-16LE").select("line")


_SYSLOG = ["<34>Oct 11 22:14:15 mymachine su[230]: failed for lonvick", "<165>1 2024-10-11T22:14:15.003Z host.example.com app 77 ID47 - started", "no syslog", "<13>Feb  5 17:32:18 10.0.0.99 cron: run"]


@query("SELECT * FROM (VALUES (4, 'critical', 'mymachine', 'su', 230, 'failed for lonvick'), (20, 'notice', 'host.example.com', 'app', 77, 'started'), (-1, '-', '-', '-', -1, '-'), (1, 'notice', '10.0.0.99', 'cron', -1, 'run')) t(facility, severity, host, app, pid, message)")
def q32_syslog(spark, sf_dir):
    lines = spark.createDataFrame([(x,) for x in _SYSLOG], "line string")
    return readers.parse_syslog(lines).drop("raw").fillna(-1).fillna("-")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COUNT and SUM behind one threshold: scan, pushed filter, partial and final aggregate."""
    e = _events(spark, sf_dir)
    return e.filter(P.greater(e, "event_id", 500)).agg(A.count_rows().alias("n"), A.sum_or_zero(e, "user_id").alias("s"))
