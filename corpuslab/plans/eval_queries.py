"""Pools, picks and evaluation statistics: orders are cases, their lines are candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import presets as P
from corpuslab.functions import stats as A
from corpuslab.operators import ordered as O
from corpuslab.operators import pools as D
from corpuslab.registry import query
from corpuslab.sources import table

#: Candidates in engine order: the position among an order's lines.
CANDS = """c AS (SELECT l_orderkey AS id, l_partkey AS text, CAST(l_quantity AS INTEGER) % 10 AS source, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'R' END AS answers,
 CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_tax > 0.05 END AS trusted, l_extendedprice AS price, l_discount AS discount,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx FROM lineitem)"""
#: A case's gold is the line with the highest price; scorers rank by other measures.
CASES = CANDS + """, g AS (SELECT id, max(idx) AS last_idx, arg_min(idx, struct_pack(a := -price, b := idx)) AS gold, arg_min(idx, struct_pack(a := -discount, b := idx)) AS pick_d, arg_min(idx, struct_pack(a := source, b := idx)) AS pick_s FROM c GROUP BY id)"""


def _cands(spark, sf):
    li = table(spark, sf, "lineitem")
    one = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity").cast("int") % 10).alias("source"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("answers"),
        F.when(F.col("l_linestatus") != "O", F.col("l_tax") > 0.05).alias("trusted"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
    )
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("c"))


def _flat(spark, sf):
    return _cands(spark, sf).select("id", F.posexplode("c").alias("idx", "x")).select("id", F.col("idx").cast("bigint").alias("idx"), F.col("x.l_partkey").alias("text"), "x.source", "x.answers", "x.trusted", "x.price", "x.discount")


def _first_max(a, value):
    """Index of the first candidate with the highest value."""
    v = F.transform(a, value)
    return F.array_position(v, F.array_max(v)) - 1


def _cases(spark, sf):
    c = F.col("c")
    return _cands(spark, sf).select("id", (F.size(c) - 1).cast("bigint").alias("last_idx"), _first_max(c, lambda x: x["price"]).alias("gold"), _first_max(c, lambda x: x["discount"]).alias("pick_d"), _first_max(c, lambda x: -x["source"]).alias("pick_s"))


def _outcomes(spark, sf):
    """(id, status, priority, engine, d, s): whether each scorer's pick is the gold, for cases with two candidates."""
    k = _cases(spark, sf).where("last_idx >= 1")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    g = F.col("gold")
    return k.join(o, "id").select("id", "status", "priority", (g == 0).alias("engine"), (g == F.col("pick_d")).alias("d"), (g == F.col("pick_s")).alias("s"))


OUT = "WITH " + CASES + ", o AS (SELECT id, o_orderstatus AS status, o_orderpriority AS priority, gold = 0 AS engine, gold = pick_d AS d, gold = pick_s AS s FROM g JOIN orders ON o_orderkey = id WHERE last_idx >= 1)\n"
LONG = OUT.rstrip() + ", t AS (SELECT id, status, priority, unnest(['d', 'engine', 's']) AS scorer, unnest([d, engine, s]) AS hit FROM o)\n"


def _long(spark, sf):
    o = _outcomes(spark, sf)
    pairs = F.array(*[F.struct(F.lit(k).alias("scorer"), F.col(k).alias("hit")) for k in ("d", "engine", "s")])
    return o.select("id", "status", "priority", F.explode(pairs).alias("p")).select("id", "status", "priority", "p.*")


WILSON = """round(greatest(0.0, (h / n + {z}*{z} / (2*n) - {z} * sqrt(h / n * (1 - h / n) / n + {z}*{z} / (4*n*n))) / (1 + {z}*{z} / n)), 4) AS low,
 round(least(1.0, (h / n + {z}*{z} / (2*n) + {z} * sqrt(h / n * (1 - h / n) / n + {z}*{z} / (4*n*n))) / (1 + {z}*{z} / n)), 4) AS high""".replace("{z}", "1.959963984540054")


@query(LONG + "SELECT scorer, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 9) AS rate FROM t GROUP BY scorer")
def a08_hits(spark, sf):
    return _long(spark, sf).groupBy("scorer").agg(F.count("*").alias("n"), A.hits(F.col("hit")).alias("hits"), F.round(A.rate(F.col("hit")), 9).alias("rate"))


@query(LONG + f", h AS (SELECT scorer, priority, count(*) FILTER (WHERE hit)::DOUBLE AS h, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2) SELECT scorer, priority, {WILSON} FROM h")
def a09_wilson(spark, sf):
    h = _long(spark, sf).groupBy("scorer", "priority").agg(A.hits(F.col("hit")).cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    low, high = A.wilson(F.col("h"), F.col("n"))
    return h.select("scorer", "priority", low.alias("low"), high.alias("high"))


PAIRS = LONG.rstrip() + """, q AS (SELECT x.scorer AS a, y.scorer AS b, x.priority AS subset, count(*) AS n, count(*) FILTER (WHERE x.hit AND NOT y.hit) AS a_only, count(*) FILTER (WHERE y.hit AND NOT x.hit) AS b_only
 FROM t x JOIN t y ON x.id = y.id AND x.scorer < y.scorer GROUP BY 1, 2, 3)
"""


def _pairs(spark, sf):
    o = _outcomes(spark, sf)
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("d", "engine"), ("d", "s"), ("engine", "s"))])
    flat = o.select(F.col("priority").alias("subset"), F.explode(both).alias("p")).select("subset", "p.*")
    return flat.groupBy("a", "b", "subset").agg(F.count("*").alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("a_only"), F.count_if(F.col("y") & ~F.col("x")).alias("b_only"))


@query(PAIRS + """SELECT a, b, subset, a_only, b_only, round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2)))
 FROM unnest(range(least(a_only, b_only) + 1)) u(i))) END, 6) AS p FROM q""")
def a10_mcnemar(spark, sf):
    return _pairs(spark, sf).select("a", "b", "subset", "a_only", "b_only", F.round(A.mcnemar(F.col("a_only"), F.col("b_only")), 6).alias("p"))


NEEDED = "pow(1.959963984540054 / 2 + 0.8416212335729143 * sqrt({q} * (1 - {q})), 2) / pow({q} - 0.5, 2) / disc"


@query(PAIRS + f", r AS (SELECT a, b, subset, n, (a_only + b_only)::DOUBLE / n AS disc FROM q WHERE a_only + b_only > 0), s AS (SELECT *, least((disc + 0.01) / (2 * disc), 1 - 1e-12) AS k FROM r) SELECT a, b, subset, round(disc, 6) AS discordance, round({NEEDED.format(q='k')}, 3) AS needed FROM s")
def a11_cases_needed(spark, sf):
    disc = (F.col("a_only") + F.col("b_only")) / F.col("n")
    return _pairs(spark, sf).where("a_only + b_only > 0").select("a", "b", "subset", F.round(disc, 6).alias("discordance"), F.round(A.cases_needed(disc, F.lit(0.01)), 3).alias("needed"))


@query(PAIRS.replace("WITH", "WITH RECURSIVE", 1) + f""", r AS (SELECT a, b, subset, n, (a_only + b_only)::DOUBLE / n AS disc FROM q),
z AS (SELECT *, 0 AS step, 1e-6 AS low, disc AS high FROM r WHERE disc > 0
 UNION ALL SELECT a, b, subset, n, disc, step + 1, CASE WHEN short THEN middle ELSE low END, CASE WHEN short THEN high ELSE middle END
 FROM (SELECT *, {NEEDED.format(q='least((disc + middle) / (2 * disc), 1 - 1e-12)')} > n AS short FROM (SELECT *, (low + high) / 2 AS middle FROM z WHERE step < 100)))
SELECT r.a, r.b, r.subset, r.n, round(CASE WHEN {NEEDED.format(q='least(disc * 1.999999 / (2 * disc), 1 - 1e-12)').replace('disc', 'r.disc')} <= r.n THEN high END, 6) AS net
FROM r LEFT JOIN z ON z.a = r.a AND z.b = r.b AND z.subset = r.subset AND step = 100""")
def a11_detectable_net(spark, sf):
    disc = (F.col("a_only") + F.col("b_only")) / F.col("n")
    return _pairs(spark, sf).select("a", "b", "subset", "n", F.round(A.detectable_net(F.col("n"), disc), 6).alias("net"))


@query(PAIRS + """SELECT subset, round(median((a_only + b_only)::DOUBLE / n), 6) AS median, round(min((a_only + b_only)::DOUBLE / n), 6) AS least, round(max((a_only + b_only)::DOUBLE / n), 6) AS most FROM q
 WHERE a IN (SELECT scorer FROM (SELECT scorer, row_number() OVER (ORDER BY count(*) FILTER (WHERE hit) DESC, scorer DESC) AS k FROM t GROUP BY scorer) WHERE k <= 2)
 AND b IN (SELECT scorer FROM (SELECT scorer, row_number() OVER (ORDER BY count(*) FILTER (WHERE hit) DESC, scorer DESC) AS k FROM t GROUP BY scorer) WHERE k <= 2) GROUP BY subset""")
def a12_power_summary(spark, sf):
    """Discordance between the strongest scorers: half of them, two at least."""
    top = _long(spark, sf).groupBy("scorer").agg(A.hits(F.col("hit")).alias("h")).orderBy(F.desc("h"), F.desc("scorer")).limit(2)
    q = _pairs(spark, sf).withColumn("disc", (F.col("a_only") + F.col("b_only")) / F.col("n"))
    q = q.join(F.broadcast(top.select(F.col("scorer").alias("a"))), "a", "left_semi").join(F.broadcast(top.select(F.col("scorer").alias("b"))), "b", "left_semi")  # two rows
    return q.groupBy("subset").agg(F.round(F.median("disc"), 6).alias("median"), F.round(F.min("disc"), 6).alias("least"), F.round(F.max("disc"), 6).alias("most"))


@query(LONG + """, u AS (SELECT unnest(list_filter(['all', 'status/' || status, 'priority/' || priority, CASE WHEN status = 'F' AND priority LIKE '1%' THEN 'urgent/F' END], lambda x: x IS NOT NULL)) AS subset, scorer, hit FROM t)
SELECT subset, scorer, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM u GROUP BY 1, 2""")
def a13_overlapping_subsets(spark, sf):
    keys = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("status/"), "status"), F.concat(F.lit("priority/"), "priority"), F.when((F.col("status") == "F") & F.col("priority").startswith("1"), "urgent/F")))
    return _long(spark, sf).select(F.explode(keys).alias("subset"), "scorer", "hit").groupBy("subset", "scorer").agg(F.count("*").alias("n"), A.hits(F.col("hit")).alias("hits"))


#: What is known of a case beside its picks, in Spark and in SQL.
TRAITS = {
    "level": "CASE WHEN priority < '3' THEN 'clause' ELSE 'word' END",
    "style": "CASE WHEN priority < '4' THEN 'full' WHEN priority < '5' THEN 'initials' ELSE 'mixed' END",
    "origin": "CASE WHEN id % 3 = 0 THEN 'gov' ELSE 'dialogue' END",
    "has_context": "id % 4 < 2",
    "stripped": "id % 4 = 0",
    "seen": "id % 5 = 0",
    "swap": "id % 7 = 0",
}


IN_SUBSETS = LONG.rstrip() + ", k AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in TRAITS.items()) + " FROM t), u AS (SELECT id, scorer, hit, unnest(list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{k}' END" for k, p in P.SUBSETS.items()) + "], lambda x: x IS NOT NULL)) AS subset FROM k)\n"


def _in_subsets(spark, sf):
    """(id, scorer, hit, subset): a row for each subset of a case."""
    k = _long(spark, sf).select("*", *[F.expr(e).alias(n) for n, e in TRAITS.items()])
    return k.select("id", "scorer", "hit", F.explode(F.array_compact(F.array(*[F.when(F.expr(p), n) for n, p in P.SUBSETS.items()]))).alias("subset"))


@query(IN_SUBSETS + "SELECT subset, scorer, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM u GROUP BY 1, 2")
def a13_subset_definitions(spark, sf):
    return _in_subsets(spark, sf).groupBy("subset", "scorer").agg(F.count("*").alias("n"), A.hits(F.col("hit")).alias("hits"))


SCORERS = (("d", "by discount", "feature", "line", 8), ("engine", "order of lines", "baseline", "none", 0), ("s", "by source", "feature", "line", 4))


@query(IN_SUBSETS.rstrip() + f""", h AS (SELECT scorer, subset, count(*) FILTER (WHERE hit)::DOUBLE AS h, count(*)::DOUBLE AS n, count(*) FILTER (WHERE id % 2 = 0) AS timed_n,
 quantile_disc(id % 97, 0.5) FILTER (WHERE id % 2 = 0) AS p50, quantile_disc(id % 97, 0.95) FILTER (WHERE id % 2 = 0) AS p95 FROM u GROUP BY 1, 2)
SELECT h.scorer, label, "group", inputs, subset, CAST(h AS BIGINT) AS hits, CAST(n AS BIGINT) AS n, round(h / n, 4) AS rate, {WILSON.replace(" AS low", " AS wilson_low").replace(" AS high", " AS wilson_high")}, timed_n, p50 AS decision_ms_p50, p95 AS decision_ms_p95, weights_bytes
FROM h JOIN (VALUES {", ".join(map(str, SCORERS))}) s(scorer, label, "group", inputs, weights_bytes) USING (scorer)""")
def snk04_results_table(spark, sf):
    """A row for each scorer and subset in the 14 columns of a report; the time of a case is a stand-in from its id."""
    rows = _in_subsets(spark, sf)
    h = rows.groupBy("scorer", "subset").agg(A.hits(F.col("hit")).alias("hits"), F.count("*").alias("n"), F.count_if(F.col("id") % 2 == 0).alias("timed_n"))
    times = O.at_ranks(rows.where("id % 2 = 0").withColumn("ms", F.col("id") % 97), ["scorer", "subset"], "ms", {"decision_ms_p50": O.nearest_rank("0.5"), "decision_ms_p95": O.nearest_rank("0.95")})
    low, high = A.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    who = spark.createDataFrame(SCORERS, "scorer string, label string, group string, inputs string, weights_bytes int")
    out = h.join(times, ["scorer", "subset"], "left").join(F.broadcast(who), "scorer")  # three rows
    return out.select("scorer", "label", "group", "inputs", "subset", "hits", "n", F.round(F.col("hits") / F.col("n"), 4).alias("rate"), low.alias("wilson_low"), high.alias("wilson_high"), "timed_n", "decision_ms_p50", "decision_ms_p95", "weights_bytes")


REFERENCES = ("engine", "d", "s")
P_VALUE = """CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2)))
 FROM unnest(range(least(a_only, b_only) + 1)) u(i))) END"""


@query(LONG.rstrip() + f""", h AS (SELECT scorer, count(*) FILTER (WHERE hit)::DOUBLE AS h, count(*)::DOUBLE AS n FROM t GROUP BY 1),
m AS (SELECT scorer, run, median(CAST((id * (run + 1)) % 97 AS DOUBLE)) AS ms FROM t, range(3) r(run) WHERE scorer <> 'engine' GROUP BY 1, 2),
q AS (SELECT y.scorer, x.scorer AS ref, count(*) FILTER (WHERE x.hit AND NOT y.hit) AS a_only, count(*) FILTER (WHERE y.hit AND NOT x.hit) AS b_only FROM t x JOIN t y ON x.id = y.id AND x.scorer <> y.scorer GROUP BY 1, 2),
w AS (SELECT scorer, ref, a_only, b_only, round({P_VALUE}, 6) AS p FROM q)
SELECT h.scorer AS id, label, "group", inputs, CAST(h AS BIGINT) AS hits, CAST(n AS BIGINT) AS n, round(h / n, 4) AS rate, {WILSON.replace(" AS low", " AS wilson_low").replace(" AS high", " AS wilson_high")}, least_ms AS decision_ms_p50_min, most_ms AS decision_ms_p50_max, weights_bytes,
 {", ".join(f"CAST({r}.a_only AS DOUBLE) AS vs_{r}_ref_only, CAST({r}.b_only AS DOUBLE) AS vs_{r}_this_only, {r}.p AS vs_{r}_p" for r in REFERENCES)}
FROM h JOIN (VALUES {", ".join(map(str, SCORERS))}) k(scorer, label, "group", inputs, weights_bytes) ON k.scorer = h.scorer
 LEFT JOIN (SELECT scorer, round(min(ms), 2) AS least_ms, round(max(ms), 2) AS most_ms FROM m GROUP BY scorer) z ON z.scorer = h.scorer
 {" ".join(f"LEFT JOIN w {r} ON {r}.scorer = h.scorer AND {r}.ref = '{r}'" for r in REFERENCES)}""")
def snk04_scorer_table(spark, sf):
    """A row for each scorer in the 21 columns of a report: hits, the range of medians of repeated runs (of which the engine has
    none; times are stand-ins from ids), and what it wins and loses against three references; blank where nothing was run."""
    rows = _long(spark, sf).select("id", "scorer", "hit")
    h = rows.groupBy("scorer").agg(A.hits(F.col("hit")).alias("hits"), F.count("*").alias("n"))
    runs = rows.where("scorer <> 'engine'").select("scorer", "id", F.explode(F.array(*map(F.lit, range(3)))).alias("run")).withColumn("ms", (F.col("id") * (F.col("run") + 1)) % 97)
    middle = O.at_ranks(runs, ["scorer", "run"], "ms", {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.ceil((n + 1) / 2)})
    medians = middle.select("scorer", ((F.col("low") + F.col("high")) / 2).alias("ms")).groupBy("scorer").agg(F.round(F.min("ms"), 2).alias("decision_ms_p50_min"), F.round(F.max("ms"), 2).alias("decision_ms_p50_max"))
    low, high = A.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    who = spark.createDataFrame(SCORERS, "scorer string, label string, group string, inputs string, weights_bytes int")
    out = h.join(F.broadcast(who), "scorer").join(medians, "scorer", "left").join(D.against_references(rows, REFERENCES), "scorer")  # three rows
    blocks = [F.round(c, 6).alias(c) if c.endswith("_p") else F.col(c).cast("double").alias(c) for r in REFERENCES for c in (f"vs_{r}_ref_only", f"vs_{r}_this_only", f"vs_{r}_p")]
    return out.select(F.col("scorer").alias("id"), "label", "group", "inputs", "hits", "n", F.round(F.col("hits") / F.col("n"), 4).alias("rate"), low.alias("wilson_low"), high.alias("wilson_high"), "decision_ms_p50_min", "decision_ms_p50_max", "weights_bytes", *blocks)


@query("SELECT o_orderpriority AS subset, bool_and(l_orderkey IS NOT NULL) AS run, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_orderpriority, l_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1")
def a14_subset_run(spark, sf):
    has = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("pick", F.lit(1))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(has, "o_orderkey", "left")
    return o.groupBy(F.col("o_orderpriority").alias("subset")).agg(F.bool_and(F.col("pick").isNotNull()).alias("run"), F.count("*").alias("n"))


@query(OUT + """SELECT status, count(*) FILTER (WHERE d AND NOT engine) AS recovered, count(*) FILTER (WHERE engine AND NOT d) AS broken, count(*) FILTER (WHERE NOT (d OR engine OR s)) AS missed_by_all,
 count(*) FILTER (WHERE d AND NOT engine AND NOT s) AS only_d, count(*) FILTER (WHERE s AND NOT engine AND NOT d) AS only_s FROM o GROUP BY status""")
def a15_recovered_broken(spark, sf):
    d, e, s = F.col("d"), F.col("engine"), F.col("s")
    return _outcomes(spark, sf).groupBy("status").agg(
        F.count_if(d & ~e).alias("recovered"), F.count_if(e & ~d).alias("broken"), F.count_if(~(d | e | s)).alias("missed_by_all"), F.count_if(d & ~e & ~s).alias("only_d"), F.count_if(s & ~e & ~d).alias("only_s")
    )


@query(OUT + "SELECT coalesce(priority, 'all') AS bucket, count(*) AS n, count(*) FILTER (WHERE engine) AS engine, count(*) FILTER (WHERE d) AS reranked, count(*) FILTER (WHERE d) - count(*) FILTER (WHERE engine) AS delta FROM o GROUP BY ROLLUP (priority)")
def a16_bucket_rollup(spark, sf):
    out = _outcomes(spark, sf).rollup("priority").agg(F.count("*").alias("n"), F.count_if("engine").alias("engine"), F.count_if("d").alias("reranked"))
    return out.select(F.coalesce("priority", F.lit("all")).alias("bucket"), "n", "engine", "reranked", (F.col("reranked") - F.col("engine")).alias("delta"))


@query("WITH m AS (SELECT event_type, user_id, median(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, round(quantile_disc(v, 0.5), 6) AS p50, round(quantile_disc(v, 0.95), 6) AS p95 FROM m GROUP BY event_type")
def a17_median_then_percentiles(spark, sf):
    """A median is the mean of the two values in the middle, or of one twice."""
    middle = {"a": lambda n: F.floor((n + 1) / 2), "b": lambda n: F.ceil((n + 1) / 2)}
    m = O.at_ranks(table(spark, sf, "events"), ["event_type", "user_id"], "value", middle).select("event_type", ((F.col("a") + F.col("b")) / 2).alias("v"))
    p = O.at_ranks(m, ["event_type"], "v", {"p50": O.nearest_rank("0.5"), "p95": O.nearest_rank("0.95")})
    return p.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def a18_nearest_rank(spark, sf):
    shares = {"p50": "0.5", "p95": "0.95", "p99": "0.99"}
    return O.at_ranks(table(spark, sf, "events"), ["event_type"], "value", {k: O.nearest_rank(q) for k, q in shares.items()})


@query("SELECT user_id, list_sort(list(value))[CAST(least(count(*), floor(count(*) * 0.95) + 1) AS BIGINT)] AS p95 FROM events GROUP BY user_id")
def a19_floor_index(spark, sf):
    return O.at_ranks(table(spark, sf, "events"), ["user_id"], "value", {"p95": O.floor_rank("0.95")})


@query("SELECT event_type, count(*) AS n, round(count(*) FILTER (WHERE value > 16) / count(*), 9) AS over, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def a20_over_budget(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(A.over_budget(v, 16), 9).alias("over"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"))


@query("WITH " + CASES + """ SELECT o_orderstatus AS kind, count(*) AS typed, count(*) FILTER (WHERE gold >= 0) AS anywhere, count(*) FILTER (WHERE last_idx >= 1) AS kept, count(*) FILTER (WHERE last_idx = 0) AS single,
 count(*) FILTER (WHERE gold = 0) AS engine_top1 FROM g JOIN orders ON o_orderkey = id GROUP BY 1""")
def a06_conditional_counters(spark, sf):
    k = _cases(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind")), "id")
    c = lambda e: F.count_if(F.expr(e))
    return k.groupBy("kind").agg(F.count("*").alias("typed"), c("gold >= 0").alias("anywhere"), c("last_idx >= 1").alias("kept"), c("last_idx = 0").alias("single"), c("gold = 0").alias("engine_top1"))


@query("SELECT l_returnflag AS kind, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def a07_merged_counters(spark, sf):
    """Counters of chunks, then their sums: what partial aggregation does anyway."""
    chunks = table(spark, sf, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 16).alias("chunk")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))
    return chunks.groupBy(F.col("l_returnflag").alias("kind")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("""SELECT source, count(*) AS clauses, count(*) FILTER (WHERE text IN (SELECT text FROM benchmark)) AS exact, count(*) FILTER (WHERE length(text) >= 500) AS long,
 count(*) FILTER (WHERE length(text) >= 500 AND text IN (SELECT text FROM benchmark)) AS long_exact FROM documents GROUP BY source""")
def a21_overlap_summary(spark, sf):
    b = table(spark, sf, "benchmark").select("text").distinct().withColumn("hit", F.lit(True))
    d = table(spark, sf, "documents").select("source", "text").join(b, "text", "left")
    long, hit = F.length("text") >= 500, F.col("hit").isNotNull()
    return d.groupBy("source").agg(F.count("*").alias("clauses"), F.count_if(hit).alias("exact"), F.count_if(long).alias("long"), F.count_if(long & hit).alias("long_exact"))


@query("SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN regexp_matches(text, '[0-9]') THEN 'digits' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def a22_drop_reasons(spark, sf):
    why = F.when(F.col("n_chars") < 200, "short").when(F.rlike("text", F.lit("[0-9]")), "digits").when(F.col("lang") != "en", "language").otherwise("kept")
    return table(spark, sf, "documents").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT lang || '/' || source AS kind, count(*) AS n FROM documents GROUP BY 1 ORDER BY 1")
def a23_counts_by_kind(spark, sf):
    return table(spark, sf, "documents").groupBy(F.concat("lang", F.lit("/"), "source").alias("kind")).agg(F.count("*").alias("n")).orderBy("kind")


@query("WITH " + CANDS + """, z AS (SELECT id, price / 10000 AS x, discount * 50 AS y FROM c), s AS (SELECT id, x, y, max(x) OVER w AS mx, max(y) OVER w AS my FROM z WINDOW w AS (PARTITION BY id)),
l AS (SELECT id, x - mx - ln(sum(exp(x - mx)) OVER w) AS lx, y - my - ln(sum(exp(y - my)) OVER w) AS ly FROM s WINDOW w AS (PARTITION BY id))
SELECT id, round(sum(exp(lx) * (lx - ly)), 6) AS kl, round(sum(-exp(lx) * ly), 6) AS ce FROM l GROUP BY id""")
def a26_page_loss(spark, sf):
    """KL and cross-entropy of a teacher's and a student's softmax over each page; arrays of one page, no window."""
    from corpuslab.functions import tensor as M

    p = _cands(spark, sf).select("id", F.transform("c", lambda x: x["price"] / 10000).alias("x"), F.transform("c", lambda x: x["discount"] * 50).alias("y"))
    p = p.select("id", F.zip_with("x", "y", lambda x, y: F.struct((x - M.log_normalizer(F.col("x"))).alias("lx"), (y - M.log_normalizer(F.col("y"))).alias("ly"))).alias("l"))
    total = lambda f: F.aggregate(F.transform("l", f), F.lit(0.0), lambda s, v: s + v)
    return p.select("id", F.round(total(lambda t: F.exp(t["lx"]) * (t["lx"] - t["ly"])), 6).alias("kl"), F.round(total(lambda t: -F.exp(t["lx"]) * t["ly"]), 6).alias("ce"))


@query("""SELECT label, count(*) AS n, round(avg(z), 6) AS mean, round(stddev(z), 6) AS sd FROM (SELECT label, ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) AS z FROM embeddings) GROUP BY label""")
def a27_normalizer_statistics(spark, sf):
    from corpuslab.functions import tensor as M

    z = table(spark, sf, "embeddings").select("label", M.log_normalizer(F.col("embedding")).alias("z"))
    return z.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean"), F.round(F.stddev("z"), 6).alias("sd"))


@query("WITH " + CASES + ", x AS (SELECT c.id, round(max(abs(discount - source / 100.0)), 9) AS gap FROM c GROUP BY c.id) SELECT count(*) AS n, count(*) FILTER (WHERE pick_d = pick_s) AS same, round(max(gap), 9) AS worst FROM g JOIN x USING (id)")
def a30_scorer_agreement(spark, sf):
    gap = F.array_max(F.transform("c", lambda x: F.abs(x["discount"] - x["source"] / 100.0)))
    k = _cands(spark, sf).select(gap.alias("gap"), _first_max(F.col("c"), lambda x: x["discount"]).alias("a"), _first_max(F.col("c"), lambda x: -x["source"]).alias("b"))
    return k.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.round(F.max("gap"), 9).alias("worst"))


@query("WITH " + CASES + ", x AS (SELECT id, list_sort(list(discount), 'DESC') AS d FROM c GROUP BY id) SELECT id, pick_d AS reference, pick_s AS changed, round(d[1] - d[2], 9) AS gap FROM g JOIN x USING (id) WHERE pick_d <> pick_s")
def a30_changed_picks(spark, sf):
    """Cases where a second scorer picks otherwise, and by how much the reference's first candidate leads its second."""
    top = F.sort_array(F.transform("c", lambda x: x["discount"]), asc=False)
    k = _cands(spark, sf).select("id", _first_max(F.col("c"), lambda x: x["discount"]).alias("reference"), _first_max(F.col("c"), lambda x: -x["source"]).alias("changed"), top.alias("d"))
    return k.where("reference <> changed").select("id", "reference", "changed", F.round(F.col("d")[0] - F.col("d")[1], 9).alias("gap"))


@query("WITH " + CANDS + """, r AS (SELECT id, idx, price, row_number() OVER (PARTITION BY id ORDER BY price DESC, idx) AS k FROM c)
SELECT a.id, a.idx AS best, b.idx AS runner_up, round(a.price - b.price, 4) AS lead FROM r a JOIN r b ON a.id = b.id AND a.k = 1 AND b.k = 2""")
def a31_runner_up(spark, sf):
    ranked = F.sort_array(F.transform("c", lambda x, i: F.struct((-x["price"]).alias("p"), i.alias("i"))))
    k = _cands(spark, sf).where(F.size("c") >= 2).select("id", ranked.alias("r"))
    return k.select("id", F.col("r")[0]["i"].cast("bigint").alias("best"), F.col("r")[1]["i"].cast("bigint").alias("runner_up"), F.round(F.col("r")[1]["p"] - F.col("r")[0]["p"], 4).alias("lead"))


@query("WITH " + CANDS + " SELECT id, idx, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY price DESC, idx) AS k FROM c) WHERE k = 1")
def w13_first_wins(spark, sf):
    return D.best_first(_flat(spark, sf), ["id"], "price", "idx").select("id", "idx", "price")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, event_id, coalesce((SELECT max(k) FROM unnest(range(1, length(event_type) + 1)) u(k) WHERE left(event_type, k) = left(prev, k)), 0) AS shared FROM e""")
def w14_shared_prefix(spark, sf):
    from pyspark.sql import Window

    from corpuslab.functions.text import prefixes

    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", prev.alias("prev"))
    shared = F.size(F.filter(prefixes(F.col("event_type")), lambda p: F.startswith(F.col("prev"), p)))
    return e.select("user_id", "event_id", F.when(F.col("prev").isNull(), 0).otherwise(shared).cast("bigint").alias("shared"))


FACTS = CANDS + """, a AS (SELECT id, list(struct_pack(idx := idx, text := text, source := source, answers := coalesce(answers, length(CAST(text AS VARCHAR)) = length(CAST(lt AS VARCHAR))), trusted := coalesce(trusted, source IN (0, 1))) ORDER BY idx) AS f
 FROM (SELECT *, first_value(text) OVER (PARTITION BY id ORDER BY idx) AS lt FROM c) GROUP BY id),
k AS (SELECT id, f, list_filter(f, lambda x: x.answers)[1:9] AS same FROM a)"""
OPEN = "NOT f[1].trusted AND f[1].answers AND len(same) >= 2"


def _facts(spark, sf):
    c = F.transform("c", lambda x: F.struct(x["l_partkey"].cast("string").alias("text"), x["source"].alias("source"), x["answers"].alias("answers_key"), x["trusted"].alias("trusted_dictionary_hit")))
    return _cands(spark, sf).select("id", c.alias("c"))


@query("WITH " + FACTS + " SELECT id, array_to_string(list_transform(same, lambda x: CAST(x.text AS VARCHAR)), ',') AS first_nine FROM k")
def t01_first_nine(spark, sf):
    f = _facts(spark, sf)
    same = F.slice(F.filter(F.transform("c", lambda x: D.with_facts(x, F.get("c", F.lit(0)))), lambda x: x["answers"]), 1, 9)
    return f.select("id", F.array_join(F.transform(same, lambda x: x["text"]), ",").alias("first_nine"))


@query("WITH " + CANDS + """, l AS (SELECT id, text, min(idx) AS idx FROM c WHERE length(CAST(text AS VARCHAR)) = 4 GROUP BY 1, 2)
SELECT id, string_agg(CAST(text AS VARCHAR), ',' ORDER BY idx) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx) AS k FROM l) WHERE k <= 9 GROUP BY id""")
def t02_distinct_same_length(spark, sf):
    texts = F.slice(F.array_distinct(F.filter(F.transform("c", lambda x: x["l_partkey"].cast("string")), lambda t: F.length(t) == 4)), 1, 9)
    return _cands(spark, sf).select("id", texts.alias("t")).where(F.size("t") > 0).select("id", F.array_join("t", ",").alias("texts"))


@query("WITH " + FACTS + f" SELECT id, CASE WHEN {OPEN} THEN len(same) ELSE 0 END AS compared FROM k")
def d04_gate(spark, sf):
    return _facts(spark, sf).select("id", F.size(D.comparable(F.col("c"))).cast("bigint").alias("compared"))


@query("WITH " + FACTS + " SELECT count(*) AS cases, CAST(sum(len(list_filter(f, lambda x: x.answers))) AS BIGINT) AS answering, CAST(sum(len(list_filter(f, lambda x: x.trusted))) AS BIGINT) AS trusted FROM k")
def d05_fallback_facts(spark, sf):
    f = _facts(spark, sf).select(F.transform("c", lambda x: D.with_facts(x, F.get("c", F.lit(0)))).alias("f"))
    count = lambda k: F.sum(F.size(F.filter("f", lambda x: x[k])))
    return f.agg(F.count("*").alias("cases"), count("answers").alias("answering"), count("trusted").alias("trusted"))


@query("WITH " + CASES + " SELECT id, coalesce(nullif(gold, 0), -1) AS best FROM g")
def d06_best_where(spark, sf):
    """-1 where the leader wins, so nothing changes."""
    return _cases(spark, sf).select("id", F.coalesce(F.nullif(F.col("gold"), F.lit(0)), F.lit(-1)).alias("best"))


@query("WITH " + CANDS + ", m AS (SELECT id, arg_min(price, idx) AS lead_price, max(price) AS top, arg_min(idx, struct_pack(a := -price, b := idx)) AS best FROM c GROUP BY id) SELECT id, CASE WHEN top - lead_price > 5000 THEN best ELSE 0 END AS pick FROM m")
def d07_margin(spark, sf):
    best = _first_max(F.col("c"), lambda x: x["price"])
    top = F.array_max(F.transform("c", lambda x: x["price"]))
    return _cands(spark, sf).select("id", F.when(top - F.col("c")[0]["price"] > 5000, best).otherwise(F.lit(0)).alias("pick"))


@query("WITH " + CASES + """, w AS (SELECT r, d FROM (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0), (4.0)) a(r), (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0), (4.0)) b(d)),
s AS (SELECT c.id, idx, r, d, idx = gold AS ok, round(discount * 100 - r * idx + d * CAST(source IN (0, 1) AS INTEGER), 9) AS score FROM c JOIN g USING (id), w),
b AS (SELECT id, r, d, arg_max(ok, struct_pack(a := score, b := -idx)) AS ok FROM s GROUP BY 1, 2, 3)
SELECT r AS rank_weight, d AS dict_weight, count(*) AS n, count(*) FILTER (WHERE ok) AS hits FROM b GROUP BY 1, 2""")
def d08_hybrid_grid(spark, sf):
    gold = _first_max(F.col("c"), lambda x: x["price"])
    rows = _cands(spark, sf).select("id", gold.alias("gold"), F.posexplode("c").alias("idx", "x"))
    rows = rows.select("id", F.col("idx").cast("bigint").alias("idx"), (F.col("x.discount") * 100).alias("score"), F.col("x.source").isin(0, 1).alias("is_dict"), (F.col("idx") == F.col("gold")).alias("ok"))
    w = (0.0, 0.5, 1.0, 2.0, 4.0)
    return D.hybrid_grid(rows, w, w, "id", "score", "idx", "is_dict", "ok")


@query("WITH " + CANDS + " SELECT id, bool_or(source IN (8, 9)) AND NOT bool_or(source IN (0, 1) AND idx = 0) AS rerank FROM c GROUP BY id")
def d09_source_gate(spark, sf):
    return _cands(spark, sf).select("id", (F.exists("c", lambda x: x["source"].isin(8, 9)) & ~F.col("c")[0]["source"].isin(0, 1)).alias("rerank"))


@query("WITH " + CASES + " SELECT id, string_agg(CAST(text AS VARCHAR), ',' ORDER BY CASE WHEN idx = gold THEN -1 ELSE idx END) AS promoted FROM c JOIN g USING (id) GROUP BY id")
def d10_promote(spark, sf):
    texts = F.transform("c", lambda x: x["l_partkey"].cast("string"))
    return _cands(spark, sf).select("id", F.array_join(D.promote(texts, _first_max(F.col("c"), lambda x: x["price"]).cast("int")), ",").alias("promoted"))


@query("""WITH t AS (SELECT conv_id, turn, text, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM conversations)
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS recent FROM t WHERE coalesce(after, 0) < 128 GROUP BY conv_id""")
def d11_recent_context(spark, sf):
    from corpuslab.operators.corpus import within_budget

    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", (-F.col("turn")).alias("back"))
    kept = within_budget(rows, F.octet_length("text"), ["back"], 128, ["conv_id"])
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("recent"))


@query("WITH " + CANDS + ", f AS (SELECT id, text, min(idx) AS idx FROM c WHERE source IN (8, 9) GROUP BY 1, 2) SELECT id, string_agg(CAST(text AS VARCHAR), ',' ORDER BY idx) AS pool FROM f GROUP BY id")
def d12_decoder_pool(spark, sf):
    pool = F.array_distinct(F.transform(F.filter("c", lambda x: x["source"].isin(8, 9)), lambda x: x["l_partkey"].cast("string")))
    return _cands(spark, sf).select("id", pool.alias("p")).where(F.size("p") > 0).select("id", F.array_join("p", ",").alias("pool"))


@query("WITH " + CANDS + " SELECT id, count(*) AS n FROM c GROUP BY id HAVING count(*) >= 2 AND bool_or(price > 50000)")
def d13_pool_keep(spark, sf):
    return _cands(spark, sf).where((F.size("c") >= 2) & F.exists("c", lambda x: x["price"] > 50000)).select("id", F.size("c").cast("bigint").alias("n"))


@query("SELECT conv_id || ':' || turn AS id, '' AS context, text FROM conversations WHERE turn > 0 AND text <> ''")
def d14_stripped_twin(spark, sf):
    return table(spark, sf, "conversations").where("turn > 0 and text <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("").alias("context"), "text")


@query("WITH " + CANDS + " SELECT o_orderkey AS id, coalesce(min(idx) FILTER (WHERE idx < 32 AND text = o_custkey), -1) AS rank FROM orders LEFT JOIN c ON id = o_orderkey GROUP BY 1")
def d15_gold_rank(spark, sf):
    texts = _cands(spark, sf).select(F.col("id").alias("o_orderkey"), F.transform("c", lambda x: x["l_partkey"]).alias("t"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(texts, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("id"), F.coalesce(D.rank_of(F.col("t"), F.col("o_custkey")), F.lit(-1)).cast("bigint").alias("rank"))


@query("WITH " + CASES + " SELECT count(*) FILTER (WHERE pick_d = gold AND pick_s <> gold) AS rescued, count(*) FILTER (WHERE pick_d <> gold AND pick_s = gold) AS broken, count(*) FILTER (WHERE pick_d <> pick_s) AS changed FROM g")
def d16_run_comparison(spark, sf):
    c = lambda e: F.count_if(F.expr(e))
    return _cases(spark, sf).agg(c("pick_d = gold and pick_s <> gold").alias("rescued"), c("pick_d <> gold and pick_s = gold").alias("broken"), c("pick_d <> pick_s").alias("changed"))


@query(PAIRS + "SELECT subset, a || ' vs ' || b AS pair, n, a_only, b_only, coalesce(CAST(nullif(a_only + b_only, 0) AS VARCHAR), '') AS discordant FROM q")
def snk04_results_csv(spark, sf):
    both = F.col("a_only") + F.col("b_only")
    return _pairs(spark, sf).select("subset", F.concat("a", F.lit(" vs "), "b").alias("pair"), "n", "a_only", "b_only", F.coalesce(F.nullif(both, F.lit(0)).cast("string"), F.lit("")).alias("discordant"))


@query(LONG + "SELECT priority, count(*) FILTER (WHERE hit AND scorer = 'd') AS d, count(*) FILTER (WHERE hit AND scorer = 'engine') AS engine, count(*) FILTER (WHERE hit AND scorer = 's') AS s FROM t GROUP BY priority")
def snk05_pivot(spark, sf):
    return _long(spark, sf).groupBy("priority").pivot("scorer", ["d", "engine", "s"]).agg(F.count_if("hit")).na.fill(0)


@query("SELECT c.conv_id, c.turn, NOT (contains(text, chr(9)) OR contains(text, chr(10))) AS safe FROM conversations c")
def snk02_guard(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", (~F.rlike("text", F.lit("[\\t\\n]"))).alias("safe"))
