"""The queries of the analytics operators over the driver's tables, each with the same query in SQL.

The tables are not trial records; each query keeps an operator's semantics on what there is: documents with labels are
trials with outcomes, orders with lineitems are trials with attempts, events are progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.functions import stats, text
from trialweave.operators import graph, lists, metrics, scoring, store
from trialweave.session import shared_dir
from trialweave.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents with their labels: arm = source, direction = lang, correct = quality (null where unlabelled)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


_WILSON = """CASE WHEN {n} > 0 THEN greatest(0.0, ({x}/{n} + {z2}/(2*{n}) ) / (1 + {z2}/{n}) - 1.959963984540054 * sqrt({x}/{n}*(1-{x}/{n})/{n} + {z2}/(4*{n}*{n})) / (1 + {z2}/{n})) END AS wilson_low,
CASE WHEN {n} > 0 THEN least(1.0, ({x}/{n} + {z2}/(2*{n}) ) / (1 + {z2}/{n}) + 1.959963984540054 * sqrt({x}/{n}*(1-{x}/{n})/{n} + {z2}/(4*{n}*{n})) / (1 + {z2}/{n})) END AS wilson_high"""


def wilson_sql(x: str, n: str) -> str:
    return _WILSON.format(x=f"({x})::DOUBLE", n=f"({n})::DOUBLE", z2="(1.959963984540054*1.959963984540054)")


def rounded(df: DataFrame, *cols: str, places: int = 9) -> DataFrame:
    """Floats that two engines may add up in another order, cut to fixed places."""
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(f"""SELECT source AS arm, lang AS direction, num, den, excluded, CASE WHEN den > 0 THEN round(num::DOUBLE/den, 9) END AS value, round(wilson_low, 9) AS wilson_low, round(wilson_high, 9) AS wilson_high FROM (SELECT *, {wilson_sql('num', 'den')} FROM (
SELECT source, lang, count(*) FILTER (WHERE quality = 1) AS num, count(quality) AS den, count(*) - count(quality) AS excluded FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang))""")
def rate_wilson(spark, d):
    g = labelled(spark, d).groupBy(F.col("source").alias("arm"), F.col("lang").alias("direction")).agg(*stats.rate(F.col("quality") == 1, "q"))
    low, high = stats.wilson(F.col("q_num"), F.col("q_den"))
    out = g.select("arm", "direction", F.col("q_num").alias("num"), F.col("q_den").alias("den"), F.col("q_excluded").alias("excluded"), stats.ratio(F.col("q_num"), F.col("q_den")).alias("value"), low.alias("wilson_low"), high.alias("wilson_high"))
    return rounded(out, "value", "wilson_low", "wilson_high")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a scored trial, with nulls where nothing was computed."""
    x = labelled(spark, d)
    q, tox = F.col("quality").cast("double"), F.col("toxic").cast("double")
    return x.select(
        F.col("source").alias("arm"), F.col("lang").alias("direction"), F.concat(F.lit("s"), F.pmod("doc_id", F.lit(4))).alias("scenario"), (F.pmod("doc_id", F.lit(3))).alias("corrections"),
        F.when(F.pmod("doc_id", F.lit(11)) != 0, F.when(q == 1.0, "S5").when(q == 0.0, "S1").otherwise("S4")).alias("stage"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "host").alias("device"),
        F.when(F.pmod("doc_id", F.lit(13)) != 0, F.when(q == 0.0, 0.0).otherwise(1.0)).alias("compiled"), q.alias("correct"), F.when(q.isNotNull(), (F.pmod("doc_id", F.lit(3)) == 0).cast("double")).alias("first_try"),
        F.when(F.pmod("doc_id", F.lit(5)) != 0, F.pmod("n_chars", F.lit(1000)) / 1000.0).alias("sim_t"), F.lit(None).cast("double").alias("sim_t_tiktoken"),
        F.when(F.pmod("doc_id", F.lit(7)) == 0, 1.0).otherwise(0.0).alias("cap_hit"), F.pmod("doc_id", F.lit(2)).cast("double").alias("fence_quirk"), F.lit(None).cast("string").alias("correct_note"), tox.alias("toxic"),
    )


_SCORED = """scored AS (SELECT source AS arm, lang AS direction, 's' || (doc_id % 4) AS scenario, doc_id % 3 AS corrections, CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN quality = 1 THEN 'S5' WHEN quality = 0 THEN 'S1' ELSE 'S4' END END AS stage,
CASE WHEN doc_id % 2 = 0 THEN 'host' END AS device, CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN quality = 0 THEN 0.0 ELSE 1.0 END END AS compiled, quality AS correct, CASE WHEN quality IS NOT NULL THEN (doc_id % 3 = 0)::INT END AS first_try,
CASE WHEN doc_id % 5 <> 0 THEN (n_chars % 1000) / 1000.0 END AS sim_t, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS cap_hit, doc_id % 2 AS fence_quirk FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""WITH {_SCORED}, wide AS (SELECT arm, direction, count(*) AS n,
count(*) FILTER (WHERE compiled = 1) AS c0, count(compiled) AS d0, count(*) FILTER (WHERE compiled IS NOT NULL AND stage = 'S5') AS c1, count(compiled) AS d1, count(*) FILTER (WHERE correct = 1) AS c2, count(correct) AS d2,
count(*) FILTER (WHERE compiled IS NOT NULL AND cap_hit = 1) AS c3, count(*) FILTER (WHERE compiled IS NOT NULL AND fence_quirk > 0) AS c4, count(*) FILTER (WHERE correct = 1 AND first_try = 1) AS c5, count(*) FILTER (WHERE correct = 1 AND first_try IS NOT NULL) AS d5,
count(*) FILTER (WHERE correct = 1 AND sim_t > 0.595) AS c6, count(*) FILTER (WHERE correct = 1 AND sim_t IS NOT NULL) AS d6 FROM scored GROUP BY arm, direction),
rows AS (SELECT arm, direction, 0 AS ordinal, 'compile_rate' AS metric, c0 AS x, d0 AS m, n - d0 AS excluded FROM wide UNION ALL SELECT arm, direction, 1, 'run_rate', c1, d1, n - d1 FROM wide UNION ALL SELECT arm, direction, 2, 'correct_rate', c2, d2, n - d2 FROM wide
UNION ALL SELECT arm, direction, 3, 'cap_hit_rate', c3, d0, n - d0 FROM wide UNION ALL SELECT arm, direction, 4, 'fence_quirk_rate', c4, d0, n - d0 FROM wide UNION ALL SELECT arm, direction, 5, 'first_try_rate', c5, d5, c2 - d5 FROM wide
UNION ALL SELECT arm, direction, 6, 'sim_t_ge_0.6_rate', c6, d6, c2 - d6 FROM wide)
SELECT arm, direction, ordinal::BIGINT AS ordinal, metric, CASE WHEN m > 0 THEN x::DOUBLE END AS numerator, CASE WHEN m > 0 THEN m END AS denominator, excluded, CASE WHEN m > 0 THEN round(x::DOUBLE/m, 9) END AS value, round(wilson_low, 9) AS wilson_low, round(wilson_high, 9) AS wilson_high FROM (SELECT *, {wilson_sql('x', 'm')} FROM rows)""")
def metric_rates(spark, d):
    rows = metrics.metric_rows(scored(spark, d)).where(F.col("ordinal") < 7)
    return rounded(rows.select("arm", "direction", "ordinal", "metric", "numerator", "denominator", "excluded", "value", "wilson_low", "wilson_high"), "value", "wilson_low", "wilson_high")


@query("""WITH s AS (SELECT lang, source, count(quality) AS n, count(*) FILTER (WHERE quality = 1) AS c FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source),
p AS (SELECT *, CASE WHEN n - c < 1 THEN 1.0 ELSE 1 - (n-c)::DOUBLE/n END AS p1, CASE WHEN n < 3 THEN NULL WHEN n - c < 3 THEN 1.0 ELSE 1 - ((n-c)::DOUBLE*(n-c-1)*(n-c-2))/(n::DOUBLE*(n-1)*(n-2)) END AS p3 FROM s WHERE n > 0)
SELECT lang AS direction, count(*) AS scenarios, round(sum(p1)/count(*), 9) AS pass_1, CASE WHEN bool_or(n < 3) THEN NULL ELSE round(sum(p3)/count(*), 9) END AS pass_3 FROM p GROUP BY lang""")
def pass_at_k(spark, d):
    x = labelled(spark, d).select(F.lit("all").alias("arm"), F.col("lang").alias("direction"), F.col("source").alias("scenario"), F.col("quality").alias("correct"))
    p = metrics.pass_rates(x)
    return rounded(p.where("pass_den > 0").select("direction", F.col("pass_den").alias("scenarios"), (F.col("pass1_num") / F.col("pass_den")).alias("pass_1"), (F.col("pass3_num") / F.col("pass_den")).alias("pass_3")), "pass_1", "pass_3")


@query(f"""WITH {_SCORED}, s AS (SELECT unnest(['S0','S1','S2','S3','S4','S5','none']) AS stage, unnest(range(7)) AS ordinal), g AS (SELECT DISTINCT arm, direction FROM scored), c AS (SELECT arm, direction, coalesce(stage, 'none') AS stage, count(*) AS n FROM scored GROUP BY ALL)
SELECT g.arm, g.direction, s.ordinal::BIGINT AS ordinal, s.stage, coalesce(c.n, 0) AS count FROM g CROSS JOIN s LEFT JOIN c ON c.arm = g.arm AND c.direction = g.direction AND c.stage = s.stage""")
def stage_distribution(spark, d):
    return metrics.stage_reached(scored(spark, d))


@query(f"WITH {_SCORED} SELECT arm, direction, corrections, count(*) AS count FROM scored GROUP BY ALL")
def correction_distribution(spark, d):
    return metrics.corrections(scored(spark, d))


@query("SELECT o_orderpriority AS grp, count(*) AS orders, min(n) AS least, max(n) AS most, sum(n)::BIGINT AS lines FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def span_per_group(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    j = n.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").alias("orders"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("lines"))


@query("SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus, CASE WHEN l_quantity > 25 THEN l_linenumber END)) AS places FROM lineitem GROUP BY 1")
def distinct_warnings(spark, d):
    place = F.struct("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 25, F.col("l_linenumber")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(place).alias("places"))


@query("""SELECT user_id, max_by(event_id, struct_pack(ts, event_id)) AS last_event, max_by(event_type, struct_pack(ts, event_id)) AS last_type, max_by(event_id, struct_pack(ts, event_id)) FILTER (WHERE event_type = 'purchase') AS standing_event,
min_by(event_id, struct_pack(ts, event_id)) AS first_event, count(*) AS events FROM events GROUP BY 1""")
def last_and_standing(spark, d):
    at = F.struct("ts", "event_id")
    bought = F.col("event_type") == "purchase"
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("last_event"), F.max_by("event_type", at).alias("last_type"), F.max(F.when(bought, F.struct("ts", "event_id")))["event_id"].alias("standing_event"), F.min_by("event_id", at).alias("first_event"), F.count("*").alias("events"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN -1.0 ELSE CASE l_linestatus WHEN 'F' THEN 0.2 ELSE 0.0 END - 0.02 * least(l_quantity::INT, 10) + CASE WHEN l_linestatus = 'F' THEN 0.8 * l_tax ELSE 0.0 END END, 9) AS r FROM lineitem""")
def attempt_score(spark, d):
    return attempts(spark, d).select("l_orderkey", "l_linenumber", F.round("r", 9).alias("r"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """lineitems as attempts of orders: F is a clean run, tax its alignment, quantity its warnings, a large discount on a return a broken guard."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_quantity", "l_tax", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"))
    guard = stats.any_true_all_false((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08))
    stage = F.when(F.col("l_linestatus") == "F", "S5").otherwise("S4")
    return x.select("l_orderkey", "l_linenumber", "k", guard.alias("guard"), scoring.reward(stage, F.col("l_quantity").cast("int"), F.col("l_tax"), guard, scoring.Weights()).alias("r"))


@query("""WITH a AS (SELECT l_orderkey, struct_pack(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_returnflag = 'R' AND l_discount > 0.08 AS bad, CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN -1.0 ELSE CASE l_linestatus WHEN 'F' THEN 0.2 ELSE 0.0 END - 0.02 * least(l_quantity::INT, 10) + CASE WHEN l_linestatus = 'F' THEN 0.8 * l_tax ELSE 0.0 END END AS r FROM lineitem)
SELECT l_orderkey, round(min_by(r, k), 9) AS single_turn, round((CASE WHEN bool_or(bad) THEN -1.0 ELSE max_by(r, k) END) - 0.05 * (count(*) - 1), 9) AS multi_turn FROM a GROUP BY 1""")
def trial_score(spark, d):
    g = attempts(spark, d).groupBy("l_orderkey").agg(F.min_by("r", "k").alias("single_turn"), F.max_by("r", "k").alias("last"), F.bool_or(F.col("guard") == 1.0).alias("broken"), F.count("*").alias("n"))
    multi = F.when(F.col("broken"), F.lit(-1.0)).otherwise(F.col("last")) - F.lit(0.05) * (F.col("n") - 1)
    return g.select("l_orderkey", F.round("single_turn", 9).alias("single_turn"), F.round(multi, 9).alias("multi_turn"))


@query("SELECT turns - 1 AS corrections, count(*) AS count FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) GROUP BY 1")
def corrections_per_conversation(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return n.groupBy(F.greatest(F.col("turns") - 1, F.lit(0)).alias("corrections")).agg(F.count("*").alias("count"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles, array_to_string(list(sha256(text) ORDER BY turn), ',') AS hashes, count(*) AS messages FROM conversations GROUP BY 1")
def request_arrays(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.sha2("text", 256).alias("sha")))).alias("m"))
    return m.select("conv_id", F.concat_ws(",", "m.role").alias("roles"), F.concat_ws(",", "m.sha").alias("hashes"), F.size("m").cast("long").alias("messages"))


@query("""SELECT 'embedding' AS kind, vec_id AS id, NULL::BIGINT AS attempt_index, (i - 1)::BIGINT AS ordinal, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
UNION ALL SELECT 'turn', conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, length(text)::DOUBLE FROM conversations""")
def flatten_explode(spark, d):
    v = table(spark, d, "embeddings").select(F.lit("embedding").alias("kind"), F.col("vec_id").alias("id"), F.lit(None).cast("long").alias("attempt_index"), F.posexplode("embedding").alias("ordinal", "value"))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    t = t.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.posexplode("t").alias("ordinal", "x")).select("kind", "id", F.col("x.turn").alias("attempt_index"), "ordinal", F.col("x.n").alias("value"))
    return v.unionByName(t).withColumns({"ordinal": F.col("ordinal").cast("long"), "value": F.col("value").cast("double")})


@query("""WITH w AS (SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS nation, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS credit FROM customer)
SELECT c_custkey, 'acctbal' AS component, c_acctbal AS value, 0 AS ordinal FROM w UNION ALL SELECT c_custkey, 'nation', nation, 1 FROM w UNION ALL SELECT c_custkey, 'credit', credit, 2 FROM w UNION ALL SELECT c_custkey, 'scalar', credit, 3 FROM w""")
def component_long(spark, d):
    return components(spark, d).select(F.col("trial_id").alias("c_custkey"), "component", "value", "ordinal")


def components(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda v, n: F.struct(v.cast("double").alias("value"), F.lit(None).cast("string").alias("note")).alias(n)
    bal = F.col("c_acctbal")
    wide = table(spark, d, "customer").select(F.col("c_custkey").alias("trial_id"), cell(bal, "acctbal"), cell(F.col("c_nationkey"), "nation"), cell(F.when(bal >= 0, bal), "credit"))
    return scoring.to_long(wide, "customer", "credit", ("acctbal", "nation", "credit"))


@query("SELECT c_custkey, c_acctbal AS acctbal, c_nationkey::DOUBLE AS nation, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS credit FROM customer")
def component_pivot(spark, d):
    return scoring.to_wide(components(spark, d), ("acctbal", "nation", "credit")).withColumnRenamed("trial_id", "c_custkey")


_MASK = "[0-9]{3}"


@query(f"""WITH m AS (SELECT doc_id, source, lang, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '{_MASK}') THEN NULL ELSE x END) AS ls FROM documents), f AS (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY 1, 2)
SELECT m.doc_id, f.first, (m.ls IS NOT DISTINCT FROM r.ls)::INT::DOUBLE AS score FROM m JOIN f ON m.source = f.source AND m.lang = f.lang JOIN m r ON r.doc_id = f.first""")
def mask_equal(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    first = docs.groupBy("source", "lang").agg(F.min_by(F.struct(F.col("doc_id").alias("first"), F.col("text").alias("ref")), "doc_id").alias("f")).select("source", "lang", "f.*")
    return docs.join(first, ["source", "lang"]).select("doc_id", "first", text.mask_score(F.col("ref"), F.col("text"), [_MASK]).alias("score"))


@query(r"SELECT doc_id, (regexp_matches(text, '\bPASS\b') AND NOT regexp_matches(text, '\bFAIL\b'))::INT::DOUBLE AS score FROM documents")
def pass_fail(spark, d):
    return table(spark, d, "documents").select("doc_id", text.pass_fail(F.col("text")).alias("score"))


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT source, doc_id, line, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT source, doc_id, sum(n) AS lines FROM c GROUP BY ALL),
f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY 1), k AS (SELECT c.doc_id, sum(least(c.n, r.n)) AS m FROM c JOIN f USING (source) JOIN c r ON r.doc_id = f.first AND r.line = c.line GROUP BY 1)
SELECT t.doc_id, f.first, round(coalesce(k.m, 0)::DOUBLE / greatest(t.lines, u.lines), 9) AS sim_l FROM t JOIN f USING (source) JOIN t u ON u.doc_id = f.first LEFT JOIN k ON k.doc_id = t.doc_id""")
def sim_l_pairs(spark, d):
    """Each document against the first of its source, by counts of lines: the join key is (source, line), counted before the shuffle."""
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    c = docs.select("source", "doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("source", "doc_id", "line").agg(F.count("*").alias("n"))
    total = docs.select("source", "doc_id", F.size(F.split("text", "\n", -1)).alias("lines"))
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    ref = c.join(first, (c["doc_id"] == first["first"]) & (c["source"] == first["source"])).select(c["source"], "line", F.col("n").alias("m"))
    same = c.join(ref, ["source", "line"]).groupBy("doc_id").agg(F.sum(F.least("n", "m")).alias("common"))
    of = total.select(F.col("doc_id").alias("first"), F.col("lines").alias("ref_lines"))
    out = total.join(first, "source").join(of, "first").join(same, "doc_id", "left")
    return out.select("doc_id", "first", F.round(F.coalesce("common", F.lit(0)).cast("double") / F.greatest("lines", "ref_lines"), 9).alias("sim_l"))


@query()
def sim_t_c_pairs(spark, d):
    """Token similarity of each benchmark item with the first one, whose text is the one value that the driver reads (an Arrow UDF)."""
    docs = table(spark, d, "benchmark").select("item_id", "text")
    first = docs.agg(F.min_by("text", "item_id").alias("ref")).first()
    ref = F.lit(first["ref"]).cast("string")
    return docs.select("item_id", F.round(text.sim_t_c(ref, "text"), 9).alias("sim_t_c"), F.round(text.sim_t(ref, "text"), 9).alias("sim_t"), F.lit(text.INTERPRETER).alias("interpreter"))


@query()
def similarity_measures(spark, d):
    """Each document against the first one of its source and language: all similarities, by tokens and by lines."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("of"))
    first = docs.groupBy("of").agg(F.min_by("text", "doc_id").alias("reference"))
    pairs = graph.looked_up(docs.repartition("doc_id"), "of", first, "reference").sortWithinPartitions("of")  # references are not shuffled
    return pairs.select("doc_id", text.measure(F.col("reference"), F.col("text")).alias("m")).select("doc_id", "m.sim_t", "m.sim_l", "m.sim_t_c", "m.python")


@query("""SELECT coalesce(n.n_nationkey, c.k)::INT AS nation, CASE WHEN n.n_nationkey IS NULL THEN 'unknown' WHEN c.k IS NULL THEN 'missing' ELSE 'both' END AS side, coalesce(c.n, 0) AS customers, coalesce(c.ok, FALSE) AS all_positive
FROM (SELECT * FROM nation WHERE n_nationkey <> 3) n FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n, bool_and(c_acctbal > -900) AS ok FROM customer WHERE c_nationkey <> 5 GROUP BY 1) c ON n.n_nationkey = c.k""")
def full_outer_compare(spark, d):
    n = table(spark, d, "nation").where("n_nationkey <> 3").select("n_nationkey")
    c = table(spark, d, "customer").where("c_nationkey <> 5").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.bool_and(F.col("c_acctbal") > -900).alias("ok"))
    side = F.when(F.col("n_nationkey").isNull(), "unknown").when(F.col("k").isNull(), "missing").otherwise("both")
    return n.join(c, F.col("n_nationkey") == F.col("k"), "full").select(F.coalesce("n_nationkey", "k").alias("nation"), side.alias("side"), F.coalesce("n", F.lit(0)).alias("customers"), F.coalesce("ok", F.lit(False)).alias("all_positive"))


@query("""WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, count(*) AS n, round(CASE WHEN bool_and(x = y) THEN 1.0 WHEN min(x) = max(x) OR min(y) = max(y) THEN 0.0 ELSE corr(x, y) END, 6) AS pcc, round(max(abs(x - y)), 9) AS max_abs FROM p GROUP BY 1""")
def array_compare(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    p = v.join(nxt, "vec_id").select("vec_id", F.explode(F.arrays_zip("embedding", "other")).alias("e")).select("vec_id", F.col("e.embedding").cast("double").alias("x"), F.col("e.other").cast("double").alias("y"))
    return p.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(stats.pearson("x", "y"), 6).alias("pcc"), F.round(F.max(F.abs(F.col("x") - F.col("y"))), 9).alias("max_abs"))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 6) AS ratio, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice / l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3""")
def top_slowest(spark, d):
    r = table(spark, d, "lineitem").withColumn("ratio", F.col("l_extendedprice") / F.col("l_quantity"))
    top = lists.top_k(r.select("l_returnflag", "l_orderkey", "l_linenumber", "ratio"), ["l_returnflag"], [F.desc("ratio"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)
    return rounded(top.withColumn("rank", F.col("rank").cast("long")), "ratio", places=6)


@query("SELECT sha256(text) AS sha256, 'texts/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt' AS path, count(*) AS n, length(any_value(text)) AS chars FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_store(spark, d):
    return store.put(table(spark, d, "documents").select("text")).select("sha256", "path", "n", F.length("payload").alias("chars").cast("long"))


@query("SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def split_guard(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents"


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH l AS ({_LINES}), s AS (SELECT *, sum((length(line) > 200)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM l), c AS (SELECT *, max((length(line) < 40 AND length(line) <= 200)::INT) OVER (PARTITION BY doc_id, s ORDER BY pos) AS closed FROM s)
SELECT doc_id, s::BIGINT AS block, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM c WHERE s > 0 AND closed = 0 GROUP BY 1, 2""")
def log_islands(spark, d):
    start, end = F.length("line") > 200, F.length("line") < 40
    b = lists.islands(doc_lines(spark, d), ["doc_id"], "pos", start, end).where("block is not null")
    return b.groupBy("doc_id", "block").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(f"""WITH l AS ({_LINES}), r AS (SELECT *, row_number() OVER w AS n, sum(strlen(line) + 1) OVER w AS size FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), f AS (SELECT *, max((n > 50 OR size > 4096)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS over FROM r)
SELECT doc_id, count(*) FILTER (WHERE over = 0) AS kept, count(*) FILTER (WHERE over = 1) AS left_out FROM f GROUP BY 1""")
def byte_cap(spark, d):
    c = lists.capped_lines(doc_lines(spark, d), ["doc_id"], "pos", "line", 50, 4096)
    return c.groupBy("doc_id").agg(F.count_if(F.col("kept")).alias("kept"), F.count_if(~F.col("kept")).alias("left_out"))


_EDGES = """SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"))
    c = table(spark, d, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))
    return n.unionByName(s).unionByName(c)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r(v, label) AS (SELECT s, s FROM (VALUES ('r1'), ('n2')) x(s) UNION ALL SELECT e.dst, r.label FROM r JOIN e ON e.src = r.v) SELECT v, min(label) AS label FROM r GROUP BY 1""")
def reachability(spark, d):
    sources = spark.range(2).select(F.when(F.col("id") == 0, "r1").otherwise("n2").alias("v"))
    return graph.reach_labels(edges(spark, d), sources)


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(v) AS (SELECT 'r1' UNION SELECT e.dst FROM r JOIN e ON e.src = r.v) SELECT v FROM r")
def reach_closure(spark, d):
    return graph.reach_closure(edges(spark, d), spark.range(1).select(F.lit("r1").alias("v")))


@query("""SELECT user_id, event_id AS read_event, (SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view' AND x.event_id < e.event_id) AS seen_event FROM events e WHERE event_type <> 'view'""")
def visible_definitions(spark, d):
    e = table(spark, d, "events")
    pick = lambda c: e.where(c).select(F.col("user_id").alias("var"), F.col("event_id").alias("pos"))
    v = graph.visible_definitions(pick(F.col("event_type") == "view"), pick(F.col("event_type") != "view"))
    return v.select(F.col("var").alias("user_id"), F.col("read_pos").alias("read_event"), F.col("def_pos").alias("seen_event"))


@query("""SELECT user_id, max(event_id) AS last_seq, max_by(event_type, event_id) AS last_kind, max_by(value, event_id) AS last_snapshot, count(*) AS events FROM events GROUP BY 1""")
def progress_latest(spark, d):
    """The stream's answer once it has seen all events."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    events = stream.select(F.col("user_id").alias("trial_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("value").alias("snapshot"))
    out = shared_dir(spark)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")  # noqa: E731  a batch that comes again replaces itself
    q = progress.latest(events).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(write).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(f"{out}/rows").groupBy("trial_id").agg(F.max_by(F.struct("last_seq", "last_kind", "last_snapshot", "events"), "batch").alias("x"))
    return rows.select(F.col("trial_id").alias("user_id"), "x.*")


@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return progress.windowed(e, "ts", "1 hour", "10 minutes", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL ELSE greatest(30.0, o_totalprice / 10000) END AS time_limit, CASE WHEN o_custkey % 256 > 128 AND o_custkey % 256 <= 192 THEN 128 - o_custkey % 256 ELSE o_custkey % 256 END AS return_code FROM orders""")
def run_limits(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scoring.time_limit(F.col("o_totalprice") / 10000, 1.0).alias("time_limit"), scoring.return_code(F.pmod("o_custkey", F.lit(256))).alias("return_code"))


@query("SELECT doc_id, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, len(string_split(text, chr(10))) - (CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END) AS n_lines FROM documents")
def text_sizes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), text.word_count(t).cast("long").alias("words"), F.size(text.lines(t)).cast("long").alias("n_lines"))


@query(r"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '[^\x00-\x7F]')) AS not_ascii, count(*) FILTER (WHERE regexp_matches(line, '@[a-z]+\.')) AS addresses FROM (""" + _LINES + ") GROUP BY 1")
def text_policy(spark, d):
    has = lambda p: F.count_if(F.col("line").rlike(p))
    return doc_lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), has(r"[^\x00-\x7F]").alias("not_ascii"), has(r"@[a-z]+\.").alias("addresses"))


@query("SELECT i.n_name AS item, r.r_name AS direction, k AS run FROM nation i JOIN region r ON TRUE, range(1, 4) t(k)")
def run_plan(spark, d):
    """Every item in every direction, three runs each: two small dimensions and a sequence."""
    n, r = table(spark, d, "nation").select(F.col("n_name").alias("item")), table(spark, d, "region").select(F.col("r_name").alias("direction"))
    return n.crossJoin(r).withColumn("run", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS index, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, o_orderstatus AS after FROM orders""")
def attempt_order(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("index"), F.lag("o_orderstatus").over(w).alias("before"), F.col("o_orderstatus").alias("after"))


@query("""SELECT c_custkey, 'p/' || replace(c_mktsegment, '/', '--') || '/b/d/i' || c_nationkey || '/run' || CASE WHEN c_custkey < 100 THEN lpad(c_custkey::VARCHAR, 2, '0') ELSE c_custkey::VARCHAR END AS trial_id, c_custkey AS run, 'b/i' || c_nationkey AS scenario FROM customer""")
def trial_ids(spark, d):
    from trialweave.functions import ids

    c = table(spark, d, "customer")
    made = ids.make(F.lit("p"), ids.arm_segment(F.col("c_mktsegment")), F.lit("b"), F.lit("d"), F.concat(F.lit("i"), "c_nationkey"), F.col("c_custkey"))
    x = c.select("c_custkey", made.alias("trial_id")).withColumn("p", ids.parse(F.col("trial_id")))
    return x.select("c_custkey", "trial_id", F.col("p.run").alias("run"), ids.scenario(F.col("p.bench"), F.col("p.item")).alias("scenario"))


@query("SELECT lower(p_name) AS folded, count(DISTINCT p_name) AS spellings, count(*) AS n FROM part GROUP BY 1")
def name_collisions(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("folded")).agg(F.count_distinct("p_name").alias("spellings"), F.count("*").alias("n"))


@query("""SELECT doc_id, event_type, seen FROM (SELECT event_id AS doc_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seen FROM events) WHERE seen = 1""")
def first_seen(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("doc_id"))
    return lists.first_seen(e, ["user_id", "event_type"], ["doc_id"]).select("doc_id", "event_type", F.lit(1).cast("long").alias("seen"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_tax > l_discount) AS above, count(*) FILTER (WHERE l_discount >= 0.06) AS reach, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem""")
def correlation_line(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > F.col("l_discount")).alias("above"), F.count_if(F.col("l_discount") >= 0.06).alias("reach"), F.round(stats.pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("""SELECT a.path, CASE WHEN b.sha IS NULL THEN 'removed' WHEN a.sha <> b.sha THEN 'changed' END AS change FROM (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents) a LEFT JOIN (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS sha FROM documents WHERE doc_id % 7 <> 0) b USING (path) WHERE b.sha IS NULL OR a.sha <> b.sha""")
def changed_files(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    path = F.col("doc_id").cast("string").alias("path")
    after = t.where("doc_id % 7 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return store.changed_files(t.select(path, F.sha2("text", 256).alias("sha256")), after)


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 1.0 WHEN bool_and(l_returnflag <> 'R') AND count(*) > 1 THEN 0.0 END::DOUBLE AS guard FROM lineitem GROUP BY 1""")
def guard_states(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.count("*").alias("n"))
    return g.select("l_orderkey", stats.any_true_all_false(F.col("a"), F.when(F.col("n") > 1, F.lit(False))).alias("guard"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["rate_wilson"](spark, d)

