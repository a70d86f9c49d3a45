"""Registered queries of the extraction operators and their SQL counterparts.

The given tables stand in for clinical records: customer for Patient, orders for Encounter (a period of 31 days from the
order date), lineitem for what links an encounter to part (Medication) and supplier (Organization), region and nation for a
code tree, events for consent provisions. Every query covers whole tables.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.functions import paths
from cohortlake.functions.references import parse_reference
from cohortlake.operators import bindings, cascade, codes, consent, intervals, load, redact, report, resolve, spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- stand-ins -------------------------------------------------------------------------------------------------------


def encounters(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        F.lit("Encounter").alias("resource_type"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("patient_id"), F.array(F.concat(F.lit("p/"), "o_orderstatus", F.lit("|1.0"))).alias("profiles"),
        F.array(F.struct(F.lit("prio").alias("system"), F.col("o_orderpriority").alias("code"))).alias("codes"), start.alias("period_start"), F.date_add(start, 30).alias("period_end"), "o_totalprice",
    )


def provisions(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_add(F.lit(datetime.date(1995, 1, 1)), ((F.col("event_id") * 37) % 2400).cast("int"))
    code = F.element_at(F.array(*(F.lit(c) for c in ("A", "B", "GATE", "RETRO"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("patient_id"), (F.col("user_id") * 10 + F.col("event_id") % 3).alias("consent_id"), code.alias("code"), start.alias("start"), F.date_add(start, F.floor("value").cast("int")).alias("end"), (F.col("event_type") != "error").alias("permit")
    )


_ENC = "enc AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, CAST(o_orderdate AS DATE) s, CAST(o_orderdate AS DATE) + 30 e FROM orders)"
_PROV = """prov AS (SELECT event_id, user_id patient_id, user_id * 10 + event_id % 3 consent_id, ['A','B','GATE','RETRO'][event_id % 4 + 1] code,
  DATE '1995-01-01' + CAST((event_id * 37) % 2400 AS INT) s, DATE '1995-01-01' + CAST((event_id * 37) % 2400 + floor(value) AS INT) e, event_type <> 'error' permit FROM events)"""


def _days(source: str, keys: str, where: str) -> str:
    return f"SELECT DISTINCT {keys}, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) d FROM {source} WHERE {where}"


def _islands(source: str, keys: str) -> str:
    return f"SELECT {keys}, min(d) AS period_start, max(d) AS period_end FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY {keys} ORDER BY d) AS INT) g FROM {source}) GROUP BY {keys}, g"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "period_start", "end": "period_end"})


# --- filters and survival --------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_type, p_brand FROM part WHERE p_type = 'PROMO' OR p_brand IN ('Brand#1', 'Brand#2')")
def token_filter(spark: SparkSession, d: str) -> DataFrame:
    coding = F.array(F.struct(F.lit("type").alias("system"), F.col("p_type").alias("code")), F.struct(F.lit("brand").alias("system"), F.col("p_brand").alias("code")))
    return table(spark, d, "part").where(load.token_filter(coding, [("type", "PROMO"), ("brand", "Brand#1"), ("brand", "Brand#2")])).select("p_partkey", "p_type", "p_brand")


@query(f"WITH {_ENC} SELECT o_orderkey, s AS period_start, e AS period_end FROM enc WHERE e >= DATE '1996-01-15' AND s <= DATE '1996-03-15'")
def date_filter(spark: SparkSession, d: str) -> DataFrame:
    found = load.group_filter(encounters(spark, d), "Encounter", low=datetime.date(1996, 1, 15), high=datetime.date(1996, 3, 15))
    return found.select(F.col("id").cast("long").alias("o_orderkey"), "period_start", "period_end")


@query(f"WITH {_ENC} SELECT o_orderkey, o_custkey AS patient_id FROM enc WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND e >= DATE '1997-01-01'")
def token_or_date_and(spark: SparkSession, d: str) -> DataFrame:
    found = load.group_filter(encounters(spark, d), "Encounter", "p/F", [("prio", "1-URGENT"), ("prio", "2-HIGH")], low=datetime.date(1997, 1, 1))
    return found.select(F.col("id").cast("long").alias("o_orderkey"), "patient_id")


@query("SELECT o_orderkey, o_custkey AS patient_id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def cohort_semi(spark: SparkSession, d: str) -> DataFrame:
    cohort = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient_id"))
    return load.in_cohort(encounters(spark, d), cohort).select(F.col("id").cast("long").alias("o_orderkey"), "patient_id")


@query("""SELECT c_custkey AS patient_id FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('2-HIGH', '3-MEDIUM'))
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW' AND o_totalprice >= 450000)""")
def cohort_criteria(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.lit("prio").alias("system"), F.col("o_orderpriority").alias("code"), F.col("o_totalprice").alias("value"))
    c = codes.Criterion
    include = [[c([("prio", "1-URGENT")], "gt", 300000.0)], [c([("prio", "2-HIGH")]), c([("prio", "3-MEDIUM")])]]
    return codes.select_cohort(table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id")), records, include, [[c([("prio", "5-LOW")], "ge", 450000.0)]])


@query(f"""WITH {_ENC}, ok AS (SELECT o_custkey FROM enc WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND s <= DATE '1999-12-31' AND o_totalprice > 100000)
SELECT c_custkey AS patient_id, c_acctbal, (SELECT count(*) FROM enc WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND s <= DATE '1999-12-31') AS encounters
FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM ok)""")
def must_have_survivors(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient_id"), "c_acctbal")
    wanted = [("prio", p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")]
    found = load.in_cohort(load.group_filter(encounters(spark, d), "Encounter", "p/F", wanted, high=datetime.date(1999, 12, 31)), people)
    state, _ = load.must_have(load.claims_profile(F.col("profiles"), F.lit("p/F")), [("price", F.col("o_totalprice") > 100000)])
    evaluated = found.select("patient_id", F.lit("encounter").alias("group_id"), (state == "fulfilled").alias("fulfilled")).union(people.select("patient_id", F.lit("patient"), F.col("c_acctbal") > 0))
    left = load.survivors(people, evaluated, ["patient", "encounter"])
    return left.join(found.groupBy("patient_id").agg(F.count(F.lit(1)).alias("encounters")), "patient_id").select("patient_id", "c_acctbal", "encounters")


@query("""SELECT p_partkey AS resource_id, attribute_ref FROM (SELECT p_partkey, attribute_ref, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) n FROM (
SELECT p_partkey, 1 ord, 'size' attribute_ref, p_size >= 10 present FROM part UNION ALL SELECT p_partkey, 2, 'price', p_retailprice >= 950 FROM part UNION ALL SELECT p_partkey, 3, 'type', p_type <> 'PROMO' FROM part)
WHERE NOT present) WHERE n = 1""")
def first_violation(spark: SparkSession, d: str) -> DataFrame:
    checks = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("attribute_ref"), c.alias("present")) for i, (n, c) in enumerate((("size", F.col("p_size") >= 10), ("price", F.col("p_retailprice") >= 950), ("type", F.col("p_type") != "PROMO")))))
    return load.first_violations(table(spark, d, "part").select(F.col("p_partkey").alias("resource_id"), F.inline(checks)))


# --- references ------------------------------------------------------------------------------------------------------

_REF = """CASE s_suppkey % 6 WHEN 0 THEN 'http://x/Organization/' || s_suppkey WHEN 1 THEN 'urn:uuid:' || s_suppkey WHEN 2 THEN '/Organization/' || s_suppkey WHEN 3 THEN 'Organization/ ' ELSE 'Organization/' || s_suppkey END"""


@query(f"""WITH r AS (SELECT s_suppkey, {_REF} ref FROM supplier), p AS (SELECT *, regexp_extract(ref, '^([^/]+)/([^/]+)$', 1) t, regexp_extract(ref, '^([^/]+)/([^/]+)$', 2) i FROM r),
ok AS (SELECT *, NOT contains(ref, '://') AND NOT starts_with(ref, 'urn:') AND trim(t) <> '' AND trim(i) <> '' good FROM p)
SELECT s_suppkey, CASE WHEN good THEN t END AS ref_type, CASE WHEN good THEN i END AS ref_id FROM ok""")
def ref_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "supplier").withColumn("r", parse_reference(F.expr(_REF)))
    return parsed.select("s_suppkey", F.col("r.type").alias("ref_type"), F.col("r.id").alias("ref_id"))


@query("""SELECT DISTINCT l_orderkey AS src_id, l_partkey AS dst_id, l_suppkey % 2 AS grp FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND ((l_suppkey % 2 = 0 AND p_type = 'PROMO') OR (l_suppkey % 2 = 1 AND p_size > 25)))""")
def ref_not_found(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.lit("Medication").alias("dst_type"), F.col("l_partkey").alias("dst_id"), F.array((F.col("l_suppkey") % 2)).alias("linked_groups")).distinct()
    groups = spark.createDataFrame([(0, "Medication"), (1, "Medication")], "group_id long, type string")
    part = table(spark, d, "part").select(F.lit("Medication").alias("type"), F.col("p_partkey").alias("id"), "p_type", "p_size")
    targets = part.where("p_type = 'PROMO'").select("type", "id", F.lit(0).cast("long").alias("group_id")).union(part.where("p_size > 25").select("type", "id", F.lit(1).cast("long")))
    return resolve.not_found(resolve.link_groups(refs, groups), targets).select("src_id", "dst_id", F.col("linked_group").alias("grp"))


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS patient_id, 'Encounter' AS type, o_orderkey AS id, 'enc' AS group_id FROM orders WHERE o_orderstatus = 'F'
UNION SELECT * FROM (
 SELECT NULL, 'Medication', p_partkey, 'med' FROM r JOIN lineitem ON r.type = 'Encounter' AND l_orderkey = r.id JOIN part ON p_partkey = l_partkey WHERE p_type <> 'STANDARD'
 UNION ALL SELECT NULL, 'Organization', s_suppkey, 'org' FROM r JOIN lineitem ON r.type = 'Medication' AND l_partkey = r.id JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0))
SELECT * FROM r""")
def resolve_closure(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    seeds = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("patient_id"), F.lit("Encounter").alias("type"), F.col("o_orderkey").alias("id"), F.lit("enc").alias("group_id"))
    drugs = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").selectExpr("o_custkey AS patient_id", "'Encounter' AS src_type", "l_orderkey AS src_id", "'enc' AS group_id", "'med' AS linked_group", "'Medication' AS dst_type", "l_partkey AS dst_id")
    makers = lines.selectExpr("CAST(NULL AS BIGINT) AS patient_id", "'Medication' AS src_type", "l_partkey AS src_id", "'med' AS group_id", "'org' AS linked_group", "'Organization' AS dst_type", "l_suppkey AS dst_id")
    core = "CAST(NULL AS BIGINT) AS patient_id"
    targets = table(spark, d, "part").selectExpr("'Medication' AS type", "p_partkey AS id", core, "'med' AS group_id", "p_type <> 'STANDARD' AS valid").union(table(spark, d, "supplier").selectExpr("'Organization'", "s_suppkey", core, "'org'", "s_acctbal > 0"))
    return resolve.closure(seeds, drugs.union(makers), targets)


# --- intervals and consent -------------------------------------------------------------------------------------------


@query(f"""WITH {_PROV}, a AS (SELECT *, max(e) OVER (PARTITION BY patient_id, code ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM prov),
b AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id, code ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM a)
SELECT patient_id, code, min(s) AS period_start, max(e) AS period_end FROM b GROUP BY patient_id, code, g""")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return _named(intervals.merge(provisions(spark, d), ["patient_id", "code"]))


@query(f"WITH {_PROV}, a AS ({_days('prov', 'patient_id, code', 'permit')}), b AS ({_days('prov', 'patient_id, code', 'NOT permit')}), x AS (SELECT * FROM a EXCEPT SELECT * FROM b) {_islands('x', 'patient_id, code')}")
def interval_subtract(spark: SparkSession, d: str) -> DataFrame:
    keys, p = ["patient_id", "code"], provisions(spark, d)
    return _named(intervals.subtract(intervals.merge(p.where("permit"), keys), p.where("NOT permit"), keys))


_AB = "code IN ('A', 'B') AND permit"


@query(f"WITH {_PROV}, a AS ({_days('prov', 'patient_id, code', _AB)}), x AS (SELECT patient_id, d FROM a GROUP BY ALL HAVING count(*) = 2) {_islands('x', 'patient_id')}")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _named(intervals.intersect_all(provisions(spark, d).where("permit AND code IN ('A', 'B')"), ["patient_id"], "code", 2))


@query(f"""WITH {_PROV}, {_ENC}, a AS (SELECT event_id, min(enc.s) t FROM prov JOIN enc ON o_custkey = patient_id AND enc.s < prov.s AND prov.s <= enc.e WHERE code <> 'GATE' GROUP BY 1)
SELECT event_id, code, coalesce(t, s) AS period_start, e AS period_end FROM prov LEFT JOIN a USING (event_id)""")
def encounter_shift(spark: SparkSession, d: str) -> DataFrame:
    visits = encounters(spark, d).select("patient_id", F.col("period_start").alias("start"), F.col("period_end").alias("end"))
    return _named(consent.shift_to_encounters(provisions(spark, d), visits, ["GATE"]).select("event_id", "code", "start", "end"))


@query(f"""WITH {_PROV} SELECT event_id, consent_id, code FROM prov WHERE permit AND code IN ('A', 'B') AND consent_id IN (SELECT consent_id FROM prov WHERE permit AND code IN ('A', 'B') GROUP BY 1 HAVING count(DISTINCT code) = 2)""")
def consent_package(spark: SparkSession, d: str) -> DataFrame:
    return consent.complete_packages(provisions(spark, d), ["A", "B"]).select("event_id", "consent_id", "code")


@query(f"""WITH {_PROV}, hit AS (SELECT DISTINCT a.event_id FROM prov a JOIN prov b ON a.consent_id = b.consent_id AND b.code = 'RETRO' AND b.permit AND a.s <= b.e AND b.s <= a.e WHERE a.permit AND a.code = 'A'),
moved AS (SELECT event_id, consent_id, patient_id, least(s, DATE '1994-06-01') s, e FROM prov WHERE event_id IN (SELECT event_id FROM hit)),
days AS ({_days('moved', 'event_id, consent_id, patient_id', 'true')}), gone AS ({_days('prov', 'consent_id', "code = 'RETRO' AND NOT permit")}),
x AS (SELECT * FROM days WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.consent_id = days.consent_id AND gone.d = days.d)), y AS ({_islands('x', 'event_id, consent_id, patient_id')})
SELECT patient_id, consent_id, period_start, period_end, true AS extended FROM y
UNION ALL SELECT patient_id, consent_id, s, e, false FROM prov WHERE permit AND code = 'A' AND event_id NOT IN (SELECT event_id FROM hit)""")
def retro_extension(spark: SparkSession, d: str) -> DataFrame:
    out = consent.retro_extended(provisions(spark, d), consent.retro_rules(spark, {"A": "RETRO"}, datetime.date(1994, 6, 1)))
    return _named(out.select("patient_id", "consent_id", "start", "end", "extended"))


@query(f"""WITH {_PROV}, rule AS (SELECT * FROM (VALUES ('A', 'RETRO', DATE '1994-06-01'), ('A', 'GATE', DATE '1994-06-01'), ('B', 'RETRO', DATE '1990-03-01')) v(code, retro, back)),
hit AS (SELECT DISTINCT a.event_id FROM prov a JOIN rule r ON r.code = a.code JOIN prov b ON a.consent_id = b.consent_id AND b.code = r.retro AND b.permit AND a.s <= b.e AND b.s <= a.e WHERE a.permit),
moved AS (SELECT event_id, consent_id, patient_id, p.code, least(s, back) s, e FROM prov p JOIN (SELECT DISTINCT code, back FROM rule) USING (code) WHERE event_id IN (SELECT event_id FROM hit)),
days AS ({_days('moved', 'event_id, consent_id, patient_id, code', 'true')}), gone AS (SELECT DISTINCT consent_id, rule.code, d FROM ({_days('prov', 'consent_id, code', "NOT permit")}) x JOIN rule ON retro = x.code),
x AS (SELECT * FROM days WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.consent_id = days.consent_id AND gone.code = days.code AND gone.d = days.d)), y AS ({_islands('x', 'event_id, consent_id, patient_id, code')})
SELECT patient_id, consent_id, code, period_start, period_end, true AS extended FROM y
UNION ALL SELECT patient_id, consent_id, code, s, e, false FROM prov WHERE permit AND code IN ('A', 'B') AND event_id NOT IN (SELECT event_id FROM hit)""")
def retro_modifiers(spark: SparkSession, d: str) -> DataFrame:
    """Codes with several retro codes, and lookbacks of their own."""
    day = datetime.date
    rules = spark.createDataFrame([("A", "RETRO", day(1994, 6, 1)), ("A", "GATE", day(1994, 6, 1)), ("B", "RETRO", day(1990, 3, 1))], "code string, retro_code string, lookback date")
    return _named(consent.retro_extended(provisions(spark, d), rules).select("patient_id", "consent_id", "code", "start", "end", "extended"))


@query(f"""WITH {_PROV}, now AS (SELECT * FROM prov WHERE code = 'GATE' AND s <= DATE '1997-06-15' AND e >= DATE '1997-06-15')
SELECT DISTINCT patient_id FROM now WHERE permit AND patient_id NOT IN (SELECT patient_id FROM now WHERE NOT permit)""")
def consent_gate(spark: SparkSession, d: str) -> DataFrame:
    return consent.gate_open(provisions(spark, d), ["GATE"], datetime.date(1997, 6, 15))


_WINDOWS = f"""{_PROV}, pack AS (SELECT * FROM prov WHERE permit AND code IN ('A', 'B') AND consent_id IN (SELECT consent_id FROM prov WHERE permit AND code IN ('A', 'B') GROUP BY 1 HAVING count(DISTINCT code) = 2)),
pd AS ({_days('pack', 'patient_id, code', 'true')}), nd AS ({_days('prov', 'patient_id, code', "NOT permit AND code IN ('A', 'B')")}), ld AS (SELECT * FROM pd EXCEPT SELECT * FROM nd),
wd AS (SELECT patient_id, d FROM ld GROUP BY ALL HAVING count(*) = 2), win AS ({_islands('wd', 'patient_id')})"""


@query(f"WITH {_WINDOWS} SELECT * FROM win")
def consent_windows(spark: SparkSession, d: str) -> DataFrame:
    return _named(consent.windows(provisions(spark, d), ["A", "B"]))


@query(f"WITH {_WINDOWS}, {_ENC} SELECT o_orderkey, o_custkey AS patient_id FROM enc WHERE EXISTS (SELECT 1 FROM win WHERE patient_id = o_custkey AND period_start <= s AND e <= period_end)")
def within_window(spark: SparkSession, d: str) -> DataFrame:
    found = consent.consented(encounters(spark, d), consent.windows(provisions(spark, d), ["A", "B"]))
    return found.select(F.col("id").cast("long").alias("o_orderkey"), "patient_id")


# --- graphs ----------------------------------------------------------------------------------------------------------


@query("""WITH s1 AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
 WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING bool_and(p_size <= 20)),
s2 AS (SELECT l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 20 GROUP BY 1 HAVING bool_and(l_orderkey IN (SELECT o_orderkey FROM s1)))
SELECT 'O' || o_orderkey AS node FROM s1 JOIN orders USING (o_orderkey) WHERE o_orderstatus <> 'P' UNION ALL SELECT 'P' || l_partkey FROM s2""")
def cascade_down_up(spark: SparkSession, d: str) -> DataFrame:
    orders, parts = table(spark, d, "orders"), table(spark, d, "part")
    nodes = orders.selectExpr("concat('O', o_orderkey) AS node", "false AS reference_only", "o_orderstatus <> 'P' AS valid").union(parts.selectExpr("concat('P', p_partkey)", "true", "p_size > 20"))
    links = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    edges = links.selectExpr("concat('O', l_orderkey) AS parent", "concat('O', l_orderkey, '.medication') AS attribute", "concat('P', l_partkey) AS child", "o_orderpriority = '1-URGENT' AS must_have")
    return cascade.cascade(nodes, edges)


@query("""WITH RECURSIVE n AS (SELECT count(*) c FROM part), r AS (SELECT p_partkey AS node FROM part WHERE p_size >= 48 UNION SELECT (r.node * 7 + 3) % n.c FROM r, n)
SELECT p_partkey AS node FROM part WHERE p_size < 48 AND p_partkey NOT IN (SELECT node FROM r)""")
def unfounded_sweep(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    n = parts.count()
    nodes = parts.selectExpr("p_partkey AS node", "p_size < 48 AS reference_only", "true AS valid")
    edges = parts.selectExpr("p_partkey AS parent", "concat('P', p_partkey) AS attribute", f"(p_partkey * 7 + 3) % {n} AS child", "false AS must_have")
    return cascade.unfounded(nodes, edges)


_TREE = """tree AS (SELECT 'R' || n_regionkey p, 'N' || n_nationkey c FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""


@query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT 'R' || r_regionkey k FROM region UNION ALL SELECT 'N' || n_nationkey FROM nation UNION ALL SELECT 'X' || s_suppkey FROM supplier),
r AS (SELECT k AS root, k AS code FROM w UNION SELECT root, c FROM r JOIN tree ON p = code) SELECT 'geo' AS system, root, code FROM r""")
def code_expand(spark: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    edges = nation.selectExpr("'geo' AS system", "concat('R', n_regionkey) AS parent", "concat('N', n_nationkey) AS child").union(supplier.selectExpr("'geo'", "concat('N', s_nationkey)", "concat('S', s_suppkey)"))
    wanted = region.selectExpr("'geo' AS system", "concat('R', r_regionkey) AS code").union(nation.selectExpr("'geo'", "concat('N', n_nationkey)")).union(supplier.selectExpr("'geo'", "concat('X', s_suppkey)"))
    return codes.expand(wanted, edges)


@query("""SELECT c_custkey AS patient_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 50000 AND o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2)""")
def group_survival(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("group_id"), (F.col("o_totalprice") > 50000).alias("valid"))
    return cascade.group_survivors(table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id")), groups, ["F", "O"])


# --- reports ---------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_partkey id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) groups FROM lineitem WHERE l_discount > 0.02 GROUP BY 1),
r AS (SELECT l_partkey id, string_agg(DISTINCT 'S' || l_suppkey, ',' ORDER BY 'S' || l_suppkey) refs FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT 'Medication' AS type, id, groups, refs FROM g LEFT JOIN r USING (id)""")
def extraction_info(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    groups = lines.select(F.lit("Medication").alias("type"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("group_id"), (F.col("l_discount") > 0.02).alias("valid"))
    attributes = lines.select(F.lit("Medication").alias("type"), F.col("l_partkey").alias("id"), F.lit("manufacturer").alias("attribute_ref"), F.concat(F.lit("S"), "l_suppkey").alias("child"), (F.col("l_linestatus") == "F").alias("valid"))
    out = report.extraction_info(groups, attributes)
    return out.select("type", "id", F.array_join("groups", ",").alias("groups"), F.array_join(F.try_element_at("refs", F.lit("manufacturer")), ",").alias("refs"))


@query("""SELECT o_custkey AS patient_id, o_orderstatus AS group_id, string_agg(DISTINCT 'Encounter/' || o_orderkey, ',' ORDER BY 'Encounter/' || o_orderkey) AS targets, sha256(o_custkey || '|' || o_orderstatus) AS provenance_id FROM orders GROUP BY 1, 2""")
def provenance_targets(spark: SparkSession, d: str) -> DataFrame:
    out = report.provenance(encounters(spark, d).select("patient_id", F.substring(F.col("profiles")[0], 3, 1).alias("group_id"), F.col("resource_type").alias("type"), "id"))
    return out.withColumn("targets", F.array_join("targets", ",")).select("patient_id", "group_id", "targets", "provenance_id")


_STAMP = '"occurredPeriod":{"start":"2020-01-01T00:00:00"},"recorded":"2020-01-01T00:00:00","agent":[{"who":{"identifier":{"system":"urn:cohortlake:program","value":"cohortlake"}}}]'


@query(f"""WITH r AS (SELECT o_custkey p, o_orderstatus g, o_orderkey k, (row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CAST(o_orderkey AS VARCHAR)) - 1) // 3 c FROM orders),
t AS (SELECT p, g, c, string_agg('{{"reference":"Encounter/' || k || '"}}', ',' ORDER BY 'Encounter/' || k) t, sha256(p || '|' || g || CASE WHEN c > 0 THEN '|' || c ELSE '' END) i FROM r GROUP BY ALL),
e AS (SELECT p, '0' || CAST(k AS VARCHAR) o, '{{"fullUrl":"Encounter/' || k || '","resource":{{"id":"' || k || '"}},"request":{{"method":"PUT","url":"Encounter/' || k || '"}}}}' j FROM r
UNION ALL SELECT p, '1' || g || lpad(CAST(c AS VARCHAR), 12, '0'), '{{"fullUrl":"Provenance/' || i || '","resource":{{"resourceType":"Provenance","id":"' || i || '","target":[' || t || '],{_STAMP},"entity":[{{"role":"source","what":{{"identifier":{{"system":"urn:cohortlake:attribute-group","value":"' || g || '"}}}}}},{{"role":"source","what":{{"identifier":{{"system":"urn:cohortlake:extraction","value":"x1"}}}}}}]}},"request":{{"method":"PUT","url":"Provenance/' || i || '"}}}}' FROM t)
SELECT p AS patient_id, '{{"resourceType":"Bundle","type":"transaction","entry":[' || string_agg(j, ',' ORDER BY o) || ']}}' AS value FROM e GROUP BY 1""")
def provenance_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Bundles with a provenance record for each group, whose targets go on in a further record after three."""
    from cohortlake.sources.sinks import transaction_bundles as bundles

    visits = encounters(spark, d).withColumns({"group_id": F.substring(F.col("profiles")[0], 3, 1), "body": F.concat(F.lit('{"id":"'), "id", F.lit('"}'))})
    lists = report.provenance(visits.select("patient_id", "group_id", F.col("resource_type").alias("type"), "id"), 3)
    return bundles(visits, report.provenance_resources(lists, "x1", datetime.datetime(2020, 1, 1)))


@query("SELECT o_orderstatus AS group_id, count(DISTINCT o_orderkey) AS resources, count(DISTINCT o_custkey) AS patients FROM orders GROUP BY 1")
def inclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.inclusion_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("group_id"), F.lit("Encounter").alias("type"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id")))


_REASONS = ("click", "error", "purchase", "signup", "view")


@query(f"SELECT user_id AS group_id, {', '.join(f"count(*) FILTER (event_type = '{r}') AS {r}" for r in _REASONS)} FROM events GROUP BY 1")
def exclusion_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.exclusion_summary(table(spark, d, "events").select(F.col("user_id").alias("group_id"), F.col("event_type").alias("reason")), _REASONS)


@query("""SELECT s AS stage, count(DISTINCT user_id) AS patients FROM (VALUES ('click'), ('error'), ('none')) v(s) LEFT JOIN events ON event_type = s GROUP BY 1""")
def patient_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return report.patient_exclusions(table(spark, d, "events").select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("stage")), ["click", "error", "none"])


@query("""WITH f AS (SELECT count(*) n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), c AS (SELECT count(*) n FROM customer)
SELECT c.n AS cohort, f.n AS final, c.n - f.n AS excluded, true AS balanced FROM f, c""")
def count_reconcile(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"))
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id")).distinct()
    return report.reconcile(people, people.join(seen, "patient_id", "left_semi"), people.join(seen, "patient_id", "left_anti"))


@query("""WITH v AS (SELECT o_orderpriority AS stage, list_sort(list(CAST(floor(o_totalprice * 1000) AS BIGINT))) x, count(*) n, CAST(sum(CAST(floor(o_totalprice * 1000) AS BIGINT)) AS BIGINT) s FROM orders GROUP BY 1)
SELECT stage, x[n // 2 + 1] AS median, s // n AS mean, n FROM v""")
def stage_median(spark: SparkSession, d: str) -> DataFrame:
    return report.duration_stats(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "stage"), "stage", F.floor(F.col("o_totalprice") * 1000).cast("long"))


# --- projection and specs --------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, '{"id":' || o_orderkey || ',"subject":{"reference":"Patient/' || o_custkey || '"},"tags":[{"code":"' || o_orderpriority || '"},{"code":"' || o_orderstatus || '"}]}' AS body FROM orders""")
def copy_project(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(F.struct(F.col("o_orderpriority").alias("code"), F.lit("prio").alias("system")), F.struct(F.col("o_orderstatus").alias("code"), F.lit("status").alias("system")))
    subject = F.struct(F.concat(F.lit("Patient/"), "o_custkey").alias("reference"), F.lit("shown").alias("display"))
    whole = table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), subject.alias("subject"), tags.alias("tags")).alias("body"))
    tree = redact.copy_tree(["Order.id", "Order.subject.reference", "Order.tags.code"])
    return whole.select("o_orderkey", F.to_json(redact.copied(F.col("body"), whole.schema["body"].dataType, [(None, "Order", tree)], [])).alias("body"))


def _redacted_by(rows: DataFrame, elements: list[redact.Element], refs: Column | None = None) -> Column:
    """The body of rows, redacted by one profile of these elements."""
    none = F.create_map().cast("map<string,array<string>>")
    return redact.redacted(F.col("body"), rows.schema["body"].dataType, [redact.Profile("p", elements)], "Order", refs if refs is not None else none)


@query("""SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN 'Patient/' || o_custkey ELSE 'masked' END AS ref FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def mask_refs(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.create_map(F.lit("Order.subject"), F.array(F.concat(F.lit("Patient/"), "c_custkey"))).alias("refs"))
    body = F.struct(F.struct(F.concat(F.lit("Patient/"), "o_custkey").alias("reference")).alias("subject"))
    rows = table(spark, d, "orders").join(allowed, "o_custkey", "left").select("o_orderkey", body.alias("body"), F.coalesce("refs", F.create_map().cast("map<string,array<string>>")).alias("refs"))
    subject = _redacted_by(rows, [redact.Element("Order.subject", "Order.subject", types=("Reference",))], F.col("refs"))["subject"]
    return rows.select("o_orderkey", F.coalesce(subject["reference"], F.get(subject["_reference"]["extension"], F.lit(0))["valueCode"]).alias("ref"))


@query("""SELECT l_partkey, string_agg(DISTINCT 'Encounter/' || l_orderkey, ',' ORDER BY 'Encounter/' || l_orderkey) FILTER (o_orderstatus = 'F') AS shown, count(DISTINCT l_orderkey) FILTER (o_orderstatus <> 'F') AS masked
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def wide_references(spark: SparkSession, d: str) -> DataFrame:
    """Records of parts with a reference to each order that has them; those to finished orders may be shown."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct().join(orders, "l_orderkey").withColumn("child", F.concat(F.lit("Encounter/"), "l_orderkey"))
    links = lines.where("o_orderstatus = 'F'").select(F.lit(None).cast("long").alias("patient_id"), F.lit("List").alias("type"), F.col("l_partkey").alias("id"), F.lit("List.entry.item").alias("attribute_ref"), "child")
    entry = F.transform(F.array_sort(F.collect_list("child")), lambda c: F.struct(F.struct(c.alias("reference")).alias("item")))
    rows = lines.groupBy("l_partkey").agg(F.struct(entry.alias("entry")).alias("body")).join(resolve.allowed_references(links).select(F.col("id").alias("l_partkey"), "refs"), "l_partkey", "left")
    profile = redact.Profile("p", [redact.Element("List.entry", "List.entry", types=("BackboneElement",)), redact.Element("List.entry.item", "List.entry.item", types=("Reference",))])
    refs = F.coalesce("refs", F.create_map().cast("map<string,array<string>>"))
    items = redact.redacted(F.col("body"), rows.schema["body"].dataType, [profile], "List", refs)["entry"]
    done = rows.select("l_partkey", F.transform(items, lambda e: e["item"]).alias("items"))
    shown = F.filter(F.transform("items", lambda i: i["reference"]), lambda r: r.isNotNull())
    masked = F.size(F.filter("items", lambda i: F.get(i["_reference"]["extension"], F.lit(0))["valueCode"] == redact.MASKED))
    return done.select("l_partkey", F.when(F.size(shown) > 0, F.array_join(shown, ",")).alias("shown"), masked.cast("long").alias("masked"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 10 THEN CAST(p_size AS VARCHAR) WHEN p_type = 'PROMO' THEN 'masked' END AS size FROM part""")
def required_mask(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one type belong to a profile that requires the size."""
    rows = table(spark, d, "part").select("p_partkey", "p_type", F.struct(F.when(F.col("p_size") >= 10, F.col("p_size").cast("string")).alias("size")).alias("body"))
    of = lambda least: _redacted_by(rows, [redact.Element("Order.size", "Order.size", min=least, types=("string",))])
    done = F.when(F.col("p_type") == "PROMO", of(1)).otherwise(of(0))
    return rows.withColumn("done", done).select("p_partkey", F.coalesce(F.col("done.size"), F.get(F.col("done._size.extension"), F.lit(0))["valueCode"]).alias("size"))


_SPEC = """g AS (SELECT o_custkey spec_id, CAST(o_orderkey AS VARCHAR) group_id, 'p/' || o_orderstatus profile_url, CASE o_orderpriority WHEN '1-URGENT' THEN 'Patient' WHEN '2-HIGH' THEN 'Parameters' ELSE 'Observation' END type FROM orders),
a AS (SELECT o_custkey spec_id, CAST(l_orderkey AS VARCHAR) group_id, CASE l_linenumber WHEN 7 THEN 'Observation.id' ELSE 'Observation.a' || l_linenumber END attribute_ref, l_discount > 0.05 must_have, l_partkey, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
l AS (SELECT *, CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN group_id ELSE 'none' END linked FROM a),
el AS (SELECT p profile_url, 'Observation.' || e element_id, e = 'a3' is_ref FROM (VALUES ('p/F'), ('p/O')) x(p), (VALUES ('a1'), ('a2'), ('a3'), ('id')) y(e)),
f AS (SELECT o_custkey spec_id, CAST(l_orderkey AS VARCHAR) group_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F')"""


@query(f"""WITH {_SPEC}, al AS (SELECT l.*, g.profile_url FROM l JOIN g USING (spec_id, group_id))
SELECT spec_id, group_id, NULL AS attribute_ref, 'unknown_profile' AS rule FROM g WHERE profile_url = 'p/P'
UNION ALL SELECT spec_id, NULL, NULL, 'one_patient_group' FROM g GROUP BY 1 HAVING count(*) FILTER (type = 'Patient') <> 1
UNION ALL SELECT spec_id, group_id, attribute_ref, 'duplicate_attribute' FROM a GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT spec_id, group_id, attribute_ref, 'standard_must_have' FROM a JOIN g USING (spec_id, group_id) WHERE must_have AND attribute_ref = type || '.id'
UNION ALL SELECT spec_id, group_id, attribute_ref, 'unknown_attribute' FROM al WHERE profile_url <> 'p/P' AND attribute_ref NOT IN (SELECT element_id FROM el)
UNION ALL SELECT spec_id, group_id, attribute_ref, 'reference_without_link' FROM al WHERE profile_url <> 'p/P' AND attribute_ref = 'Observation.a3' AND linked IS NULL
UNION ALL SELECT spec_id, group_id, attribute_ref, 'undefined_link' FROM l WHERE linked = 'none'
UNION ALL SELECT spec_id, group_id, NULL, 'two_date_filters' FROM f GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT spec_id, group_id, NULL, 'not_a_domain_resource' FROM g WHERE type = 'Parameters'""")
def spec_violations(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("spec_id")), "l_orderkey").withColumn("group_id", F.col("l_orderkey").cast("string"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Patient").when(F.col("o_orderpriority") == "2-HIGH", "Parameters").otherwise("Observation")
    groups = orders.select(F.col("o_custkey").alias("spec_id"), F.col("o_orderkey").cast("string").alias("group_id"), F.concat(F.lit("p/"), "o_orderstatus").alias("profile_url"), kind.alias("type"))
    name = F.when(F.col("l_linenumber") == 7, "Observation.id").otherwise(F.concat(F.lit("Observation.a"), "l_linenumber"))
    linked = F.when(F.col("l_returnflag") == "A", F.array().cast("array<string>")).when(F.col("l_returnflag") == "N", F.array("group_id")).otherwise(F.array(F.lit("none")))
    attributes = lines.select("spec_id", "group_id", name.alias("attribute_ref"), (F.col("l_discount") > 0.05).alias("must_have"), linked.alias("linked_groups"))
    filters = lines.where("l_linestatus = 'F'").select("spec_id", "group_id", F.lit("date").alias("kind"))
    elements = spark.createDataFrame([(p, f"Observation.{e}", ["Reference"] if e == "a3" else ["string"]) for p in ("p/F", "p/O") for e in ("a1", "a2", "a3", "id")], "profile_url string, element_id string, types array<string>")
    return spec.violations(groups, attributes, filters, elements, ["Patient", "Observation"])


# --- more of the same families ---------------------------------------------------------------------------------------


@query(f"""WITH {_PROV} SELECT a.event_id AS left_id, b.event_id AS right_id, greatest(a.s, b.s) AS period_start, least(a.e, b.e) AS period_end
FROM prov a JOIN prov b ON a.patient_id = b.patient_id AND a.code = 'A' AND b.code = 'B' AND a.s <= b.e AND b.s <= a.e""")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d)
    both = intervals.intersect(p.where("code = 'A'").select("patient_id", F.col("event_id").alias("left_id"), "start", "end"), p.where("code = 'B'").select("patient_id", "start", "end", F.col("event_id").alias("right_id")), ["patient_id"])
    return _named(both.select("left_id", "right_id", "start", "end"))


@query(f"WITH {_PROV} SELECT event_id, code, coalesce(permit, false) AS permit FROM prov WHERE code IN ('A', 'RETRO') AND s <= e")
def provision_codes(spark: SparkSession, d: str) -> DataFrame:
    return consent.requested(provisions(spark, d), ["A", "RETRO"]).select("event_id", "code", "permit")


@query("SELECT o_orderkey AS consent_id, o_custkey AS patient_id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate IS NOT NULL AND o_custkey IS NOT NULL")
def consent_active(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "active").otherwise("inactive")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("consent_id"), F.col("o_custkey").alias("patient_id"), status.alias("status"), F.col("o_orderdate").cast("date").alias("consent_date"))
    return consent.active_consents(rows).select("consent_id", "patient_id")


@query("""SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity, l_extendedprice) n FROM lineitem) WHERE n = 1""")
def first_copy_wins(spark: SparkSession, d: str) -> DataFrame:
    return load.first_copy(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], [F.col("l_quantity"), F.col("l_extendedprice")]).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query("""SELECT DISTINCT o_orderkey AS src_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 20)""")
def ref_must_have(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("src_id"), F.col("o_custkey").alias("patient_id"))
    refs = table(spark, d, "lineitem").selectExpr("l_orderkey AS src_id", "'Encounter' AS src_type", "'enc' AS group_id", "'Encounter.medication' AS attribute_ref", "true AS must_have", "'med' AS linked_group", "'Medication' AS dst_type", "l_partkey AS dst_id").join(orders, "src_id")
    targets = table(spark, d, "part").selectExpr("'Medication' AS type", "p_partkey AS id", "CAST(NULL AS BIGINT) AS patient_id", "'med' AS group_id", "p_size > 20 AS valid")
    return resolve.unmet(refs, targets).select("src_id")


@query("""SELECT l_orderkey AS src_id, o_orderkey AS dst_id FROM lineitem JOIN orders ON o_orderkey = l_suppkey * 7 WHERE o_custkey = l_partkey % 1500""")
def ref_same_patient(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").selectExpr("l_orderkey AS src_id", "l_partkey % 1500 AS patient_id", "'Encounter' AS dst_type", "l_suppkey * 7 AS dst_id", "'enc' AS linked_group")
    targets = table(spark, d, "orders").selectExpr("'Encounter' AS type", "o_orderkey AS id", "o_custkey AS patient_id", "'enc' AS group_id", "true AS valid")
    return resolve.usable(refs, targets).select("src_id", "dst_id")


@query("""SELECT DISTINCT 'Medication' AS type, l_partkey AS id FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)""")
def core_completion(spark: SparkSession, d: str) -> DataFrame:
    """Core resources that any person refers to, each fetched once."""
    links = table(spark, d, "lineitem").select(F.concat(F.lit("Medication/"), F.col("l_partkey").cast("string")).alias("child"))
    store = table(spark, d, "part").selectExpr("'Medication' AS resource_type", "CAST(p_partkey AS STRING) AS id", "CAST(NULL AS BIGINT) AS patient_id")
    none = spark.createDataFrame([], "type string, id string")
    return resolve.completed_core(links, none, store, spec.PATIENT_TYPES).select(F.col("resource_type").alias("type"), F.col("id").cast("long").alias("id"))


@query("""SELECT event_type AS group_id, k AS attribute_ref, count(*) AS n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS VARCHAR) k FROM events WHERE value > 100) GROUP BY 1, 2""")
def exclusions_by_attribute(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("value") > 100, "must_have").otherwise("filter")
    return report.exclusions_by_attribute(table(spark, d, "events").select(F.col("event_type").alias("group_id"), F.get_json_object("props", "$.k").alias("attribute_ref"), reason.alias("reason")))


_NOTE = """CASE o_orderstatus WHEN 'F' THEN '2020-01-05' WHEN 'O' THEN '2020-01' ELSE '2020-02-30T10:00:00Z' END"""


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN DATE '2020-01-05' END AS note_day FROM orders""")
def temporal_days(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.functions.temporal import day

    return table(spark, d, "orders").select("o_orderkey", day(F.expr(_NOTE)).alias("note_day"))


@query("""SELECT o_orderkey, 'Patient/' || o_custkey || ',Encounter/' || o_orderkey AS refs, CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_custkey END AS patient FROM orders""")
def body_references(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.functions.references import nested_references, patient_of

    body = F.to_json(F.struct(F.struct(F.concat(F.lit("Patient/"), "o_custkey").alias("reference")).alias("subject"), F.array(F.struct(F.struct(F.concat(F.lit("Encounter/"), "o_orderkey").alias("reference")).alias("part"))).alias("partOf")))
    kind = F.when(F.col("o_orderstatus") == "F", "Patient").otherwise("Observation")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", body.alias("body"), kind.alias("kind"))
    return rows.select("o_orderkey", F.array_join(nested_references(F.col("body")), ",").alias("refs"), patient_of(F.col("kind"), F.col("o_orderkey").cast("string"), F.col("body")).cast("long").alias("patient"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'u/kept' ELSE '' END || CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size > 25 THEN ',' ELSE '' END || 'absent' ELSE '' END AS urls FROM part""")
def extension_policy(spark: SparkSession, d: str) -> DataFrame:
    url = lambda u: F.struct(F.lit(u).alias("url"), F.lit("v").alias("valueString"))
    some = F.array_compact(F.array(F.when(F.col("p_size") > 25, url("u/kept")), url("u/dropped"), F.when(F.col("p_type") == "PROMO", url(redact.ABSENT_URL))))
    rows = table(spark, d, "part").select("p_partkey", F.struct(some.alias("extension")).alias("body"))
    e = redact.Element
    elements = [e("Order.extension", "Order.extension", types=("Extension",), discriminators=(("VALUE", "url"),)), e("Order.extension:kept", "Order.extension", "kept", types=("Extension",), type_profiles=("u/kept",))]
    urls = F.transform(_redacted_by(rows, elements)["extension"], lambda x: F.when(x["url"] == redact.ABSENT_URL, "absent").otherwise(x["url"]))
    return rows.select("p_partkey", F.coalesce(F.array_join(urls, ","), F.lit("")).alias("urls"))


@query("""SELECT p_partkey, p_size > 10 AND p_type <> 'PROMO' AS complete, CASE WHEN p_size > 10 THEN 'u/size' ELSE '' END || CASE WHEN p_type <> 'PROMO' THEN CASE WHEN p_size > 10 THEN ',' ELSE '' END || 'u/type' ELSE '' END AS profiles FROM part""")
def profile_claims(spark: SparkSession, d: str) -> DataFrame:
    own = F.array_compact(F.array(F.when(F.col("p_size") > 10, F.lit("u/size|1.0")), F.lit("u/other"), F.when(F.col("p_type") != "PROMO", F.lit("u/type"))))
    body = F.struct(F.col("p_partkey").cast("string").alias("id"), F.struct(own.alias("profile")).alias("meta"))
    rows = table(spark, d, "part").select("p_partkey", body.alias("body"), F.array(F.lit("size"), F.lit("type")).alias("groups"), F.lit(None).cast("map<string,array<string>>").alias("refs"))
    taken = [redact.Selection(g, redact.Profile(f"u/{g}", [redact.Element("Order", "Order")]), ("Order.id", "Order.meta")) for g in ("size", "type")]
    out = redact.copy_and_redact(rows, "Order", rows.schema["body"].dataType, taken)
    shown = F.from_json(F.get_json_object("body", "$.meta.profile"), "array<string>")
    return out.select("p_partkey", "complete", F.array_join(shown, ",").alias("profiles"))


@query("""SELECT o_custkey AS patient_id, '{"resourceType":"Bundle","type":"transaction","entry":[' || string_agg('{"fullUrl":"Encounter/' || o_orderkey || '","resource":{"id":"' || o_orderkey || '"},"request":{"method":"PUT","url":"Encounter/' || o_orderkey || '"}}', ',' ORDER BY CAST(o_orderkey AS VARCHAR)) || ']}' AS value FROM orders GROUP BY 1""")
def transaction_bundles(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.sources.sinks import transaction_bundles as bundles

    return bundles(encounters(spark, d).withColumn("body", F.concat(F.lit('{"id":"'), "id", F.lit('"}'))))


@query("""WITH req AS (SELECT DISTINCT event_id // 4 spec_id, event_type code FROM events), rule AS (SELECT 'click' code, unnest(['view', 'signup']) missing UNION ALL SELECT 'purchase', 'click')
SELECT spec_id, code, missing FROM req JOIN rule USING (code) WHERE NOT EXISTS (SELECT 1 FROM req o WHERE o.spec_id = req.spec_id AND o.code = rule.missing)""")
def consent_code_rules(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.expr("event_id div 4").alias("spec_id"), F.col("event_type").alias("code")).distinct()
    return spec.consent_codes_together(asked, spark.createDataFrame([("click", ["view", "signup"]), ("purchase", ["click"])], "code string, required array<string>"))


@query("""WITH g AS (SELECT o_custkey s, CAST(o_orderkey AS VARCHAR) g, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'Patient' WHEN o_orderstatus = 'F' THEN 'Consent' WHEN o_orderstatus = 'P' THEN 'Medication' WHEN o_orderpriority = '5-LOW' THEN 'Procedure' ELSE 'Observation' END t, min(o_orderkey) OVER (PARTITION BY o_custkey) p FROM orders)
SELECT s AS spec_id, g AS group_id, t || '.id' AS attribute_ref, '' AS linked FROM g UNION ALL SELECT s, g, t || '.meta.profile', '' FROM g
UNION ALL SELECT s, g, t || CASE t WHEN 'Consent' THEN '.patient' ELSE '.subject' END, CAST(p AS VARCHAR) FROM g WHERE t IN ('Consent', 'Observation')""")
def standard_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Medication has a subject in its profile but is no patient-side type; Procedure is one, but its profile has no subject."""
    first = F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    kind = F.when(F.col("o_orderkey") == first, "Patient").when(F.col("o_orderstatus") == "F", "Consent").when(F.col("o_orderstatus") == "P", "Medication").when(F.col("o_orderpriority") == "5-LOW", "Procedure").otherwise("Observation")
    groups = table(spark, d, "orders").select(F.col("o_custkey").alias("spec_id"), F.col("o_orderkey").cast("string").alias("group_id"), F.concat(F.lit("p/"), "o_orderstatus").alias("profile_url"), kind.alias("type"))
    elements = spark.createDataFrame([("p/F", "Consent.patient"), ("p/O", "Observation.subject"), ("p/P", "Medication.subject")], "profile_url string, element_id string")
    none = spark.createDataFrame([], "spec_id long, group_id string, attribute_ref string, must_have boolean, linked_groups array<string>")
    return spec.with_standard_attributes(none, groups, elements).select("spec_id", "group_id", "attribute_ref", F.array_join("linked_groups", ",").alias("linked"))


@query("""SELECT p_partkey AS group_id, CASE WHEN p_size > 40 THEN 'reference_only' WHEN p_type IN ('PROMO', 'LARGE') THEN 'direct_patient' ELSE 'direct_core' END AS role FROM part""")
def group_roles(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "part").select(F.col("p_partkey").alias("group_id"), F.col("p_type").alias("type"), (F.col("p_size") > 40).alias("reference_only"))
    return spec.split_groups(groups, spark.createDataFrame([("PROMO",), ("LARGE",)], "type string")).select("group_id", "role")


# --- specs to groups ---------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT o_custkey spec_id, CAST(l_orderkey AS VARCHAR) group_id, l_linenumber n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT spec_id, group_id, 'Observation.code.coding:loinc.' || f attribute_ref FROM a, (VALUES ('system'), ('version')) v(f) WHERE n = 1 UNION SELECT spec_id, group_id, 'Observation.component:sys.code' FROM a WHERE n = 2),
have AS (SELECT spec_id, group_id, CASE n WHEN 1 THEN 'Observation.code.coding:loinc.code' WHEN 2 THEN 'Observation.component:sys.value[x]' WHEN 3 THEN 'Observation.component:sys.code' WHEN 4 THEN 'Observation.code.coding:loinc' ELSE 'Observation.status' END attribute_ref FROM a)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.spec_id = r.spec_id AND h.group_id = r.group_id AND h.attribute_ref = r.attribute_ref)""")
def discriminator_fields(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("spec_id"))
    names = {1: "Observation.code.coding:loinc.code", 2: "Observation.component:sys.value[x]", 3: "Observation.component:sys.code", 4: "Observation.code.coding:loinc"}
    ref = F.lit("Observation.status")
    for n, name in names.items():
        ref = F.when(F.col("l_linenumber") == n, name).otherwise(ref)
    attributes = table(spark, d, "lineitem").join(orders, "l_orderkey").select("spec_id", F.col("l_orderkey").cast("string").alias("group_id"), ref.alias("attribute_ref")).distinct()
    groups = attributes.select("spec_id", "group_id", F.lit("p/o").alias("profile_url")).distinct()
    rows = [("p/o", "Observation.code.coding", [("pattern", "$this")], None), ("p/o", "Observation.code.coding:loinc", None, '{"system":"l","version":"2"}'), ("p/o", "Observation.component", [("pattern", "code")], None), ("p/o", "Observation.component:sys", None, None)]
    elements = spark.createDataFrame(rows, "profile_url string, element_id string, discriminators array<struct<type: string, path: string>>, pattern string")
    return spec.discriminator_attributes(attributes, groups, elements)


_CRITERIA = """c AS (SELECT user_id spec_id, CASE WHEN event_id % 5 = 0 THEN 'exclusion' ELSE 'inclusion' END kind, CASE WHEN event_type = 'error' THEN 'Consent' ELSE 'Other' END context_code, event_id % 7 k FROM events)"""


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    code = F.struct(F.lit("s").alias("system"), (F.col("event_id") % 7).cast("string").alias("code"))
    kind = F.when(F.col("event_id") % 5 == 0, "exclusion").otherwise("inclusion")
    context = F.when(F.col("event_type") == "error", "Consent").otherwise("Other")
    return table(spark, d, "events").select(F.col("user_id").alias("spec_id"), kind.alias("kind"), context.alias("context_code"), F.array(code).alias("term_codes"))


@query(f"WITH {_CRITERIA} SELECT DISTINCT spec_id, 's' AS system, CAST(k AS VARCHAR) AS code FROM c WHERE kind = 'inclusion' AND context_code = 'Consent'")
def consent_codes_requested(spark: SparkSession, d: str) -> DataFrame:
    return spec.requested_consent_codes(_criteria(spark, d), "Consent")


@query(f"WITH {_CRITERIA} SELECT DISTINCT spec_id, CAST(NULL AS VARCHAR) AS group_id, CAST(NULL AS VARCHAR) AS attribute_ref, 'consent_in_exclusion' AS rule FROM c WHERE kind = 'exclusion' AND context_code = 'Consent'")
def consent_in_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return spec.consent_in_exclusion(_criteria(spark, d), "Consent")


@query("""WITH q AS (SELECT DISTINCT p_brand code FROM part WHERE p_size > 45), r AS (SELECT DISTINCT p_brand code, p_brand IN ('Brand#1', 'Brand#2') gate, 'Brand#' || (CAST(substr(p_brand, 7) AS INT) + 1) retro FROM part)
SELECT code, CASE WHEN gate THEN 'gate' ELSE 'non_gate' END AS role FROM r WHERE code IN (SELECT code FROM q)
UNION ALL SELECT DISTINCT retro, 'retro' FROM r WHERE code IN (SELECT code FROM q) AND retro IN (SELECT code FROM q)""")
def consent_code_sets(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    after = F.concat(F.lit("Brand#"), (F.substring("p_brand", 7, 9).cast("int") + 1).cast("string"))
    rules = part.select(F.col("p_brand").alias("code"), F.col("p_brand").isin("Brand#1", "Brand#2").alias("gate"), F.array(after).alias("retro_codes")).distinct()
    return consent.code_sets(rules, part.where("p_size > 45").select(F.col("p_brand").alias("code")))


@query(f"""WITH RECURSIVE {_TREE}, r AS (SELECT 'R1' AS code UNION SELECT c FROM r JOIN tree ON p = code),
rec AS (SELECT o_custkey patient_id, 'N' || c_nationkey code, o_orderpriority v FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT c_custkey AS patient_id FROM customer WHERE c_custkey IN (SELECT patient_id FROM rec WHERE code IN (SELECT code FROM r) AND v IN ('1-URGENT', '5-LOW'))""")
def cohort_concepts(spark: SparkSession, d: str) -> DataFrame:
    """A criterion with a concept filter, whose code stands for all below it in the tree."""
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    edges = nation.selectExpr("'geo' AS system", "concat('R', n_regionkey) AS parent", "concat('N', n_nationkey) AS child").union(supplier.selectExpr("'geo'", "concat('N', s_nationkey)", "concat('S', s_suppkey)"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), "c_nationkey")
    records = table(spark, d, "orders").withColumnRenamed("o_custkey", "patient_id").join(people, "patient_id").select("patient_id", F.lit("geo").alias("system"), F.concat(F.lit("N"), "c_nationkey").alias("code"), F.lit(None).cast("double").alias("value"), F.lit("prio").alias("value_system"), F.col("o_orderpriority").alias("value_code"))
    wanted = codes.Criterion([("geo", "R1")], concepts=[("prio", "1-URGENT"), ("prio", "5-LOW")])
    return codes.select_cohort(people.select("patient_id"), records, [[wanted]], edges=edges)


# --- consent by type, periods, audit -----------------------------------------------------------------------------------


@query(f"""WITH {_WINDOWS}, {_ENC}, k AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'QuestionnaireResponse' WHEN '2-HIGH' THEN 'Appointment' ELSE 'Encounter' END t FROM enc)
SELECT o_orderkey, t AS resource_type FROM k WHERE (t = 'QuestionnaireResponse' AND o_custkey IN (SELECT patient_id FROM win))
OR (t = 'Encounter' AND EXISTS (SELECT 1 FROM win WHERE patient_id = o_custkey AND period_start <= s AND e <= period_end))""")
def consent_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Types without a date element need no window around them, unlisted types are never consented."""
    kind = F.when(F.col("codes")[0]["code"] == "1-URGENT", "QuestionnaireResponse").when(F.col("codes")[0]["code"] == "2-HIGH", "Appointment").otherwise("Encounter")
    found = consent.consented_by_type(encounters(spark, d).withColumn("resource_type", kind), consent.windows(provisions(spark, d), ["A", "B"]))
    return found.select(F.col("id").cast("long").alias("o_orderkey"), "resource_type")


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 7 m, CAST(o_orderdate AS DATE) s FROM orders)
SELECT o_orderkey, CASE WHEN m IN (0, 1, 3) THEN s WHEN m = 2 THEN s END AS period_start, CASE WHEN m IN (0, 1, 3) THEN s WHEN m = 2 THEN s + 3 END AS period_end FROM k""")
def period_of_type(spark: SparkSession, d: str) -> DataFrame:
    """Periods of bodies of several types: dates, dateTimes, instants, periods, and those that are open, reversed or too coarse."""
    from cohortlake.sources.readers import keyed

    body = """CASE o_orderkey % 7 WHEN 0 THEN concat('{"resourceType":"Condition","id":"', o_orderkey, '","recordedDate":"', date_format(s, 'yyyy-MM-dd'), '"}')
      WHEN 1 THEN concat('{"resourceType":"Observation","id":"', o_orderkey, '","effectiveDateTime":"', date_format(s, 'yyyy-MM-dd'), 'T10:00:00+02:00"}')
      WHEN 2 THEN concat('{"resourceType":"Encounter","id":"', o_orderkey, '","period":{"start":"', date_format(s, 'yyyy-MM-dd'), '","end":"', date_format(date_add(s, 3), 'yyyy-MM-dd'), '"}}')
      WHEN 3 THEN concat('{"resourceType":"Provenance","id":"', o_orderkey, '","recorded":"', date_format(s, 'yyyy-MM-dd'), 'T10:00:00Z"}')
      WHEN 4 THEN concat('{"resourceType":"Procedure","id":"', o_orderkey, '","performedPeriod":{"start":"', date_format(s, 'yyyy-MM-dd'), '"}}')
      WHEN 5 THEN concat('{"resourceType":"MedicationRequest","id":"', o_orderkey, '","authoredOn":"', date_format(s, 'yyyy-MM'), '"}')
      ELSE concat('{"resourceType":"Encounter","id":"', o_orderkey, '","period":{"end":"', date_format(s, 'yyyy-MM-dd'), '","start":"', date_format(date_add(s, 3), 'yyyy-MM-dd'), '"}}') END"""
    rows = table(spark, d, "orders").withColumn("s", F.col("o_orderdate").cast("date")).select(F.expr(body).alias("body"))
    return keyed(rows).select(F.col("id").cast("long").alias("o_orderkey"), "period_start", "period_end")


@query("""SELECT o_custkey AS patient_id, 'Encounter' AS resource_type, CAST(o_orderkey AS VARCHAR) AS id, '{"resourceType":"Encounter","id":"' || o_orderkey || '","meta":{"profile":["p"]},"subject":{"reference":"Patient/' || o_custkey || '"},"period":{"start":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '"}}' AS body FROM orders""")
def audit_minimised(spark: SparkSession, d: str) -> DataFrame:
    body = """concat('{"resourceType":"Encounter","id":"', o_orderkey, '","meta":{"profile":["p"],"source":"x"},"status":"finished","subject":{"reference":"Patient/', o_custkey, '"},"period":{"start":"', date_format(o_orderdate, 'yyyy-MM-dd'), '"},"reason":"', o_orderpriority, '"}')"""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.lit("Encounter").alias("resource_type"), F.col("o_orderkey").cast("string").alias("id"), F.expr(body).alias("body"))
    return consent.minimised(rows)


@query("""WITH a AS (SELECT o_custkey pid, '{"fullUrl":"Encounter/' || o_orderkey || '","resource":{"resourceType":"Encounter","id":"' || o_orderkey || '","meta":{"profile":["p"]}}}' e, CAST(o_orderkey AS VARCHAR) i FROM orders)
SELECT pid AS patient_id, '{"resourceType":"Bundle","type":"collection","entry":[' || string_agg(e, ',' ORDER BY i) || ']}' AS value FROM a GROUP BY 1""")
def consent_audit(spark: SparkSession, d: str) -> DataFrame:
    from cohortlake.sources.sinks import audit_bundles

    body = """concat('{"resourceType":"Encounter","id":"', o_orderkey, '","meta":{"profile":["p"]},"status":"', o_orderstatus, '"}')"""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.lit("Encounter").alias("resource_type"), F.col("o_orderkey").cast("string").alias("id"), F.expr(body).alias("body"))
    return audit_bundles(rows)


# --- reports -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'Medication' AS type, l_partkey AS id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS groups, string_agg(DISTINCT 'S' || l_suppkey, ',' ORDER BY 'S' || l_suppkey) AS refs FROM lineitem GROUP BY 2""")
def info_union(spark: SparkSession, d: str) -> DataFrame:
    """Infos made apart, one for each line number, and united."""
    lines = table(spark, d, "lineitem")
    infos = lines.groupBy("l_linenumber", "l_partkey").agg(F.collect_set("l_returnflag").alias("groups"), F.collect_set(F.concat(F.lit("S"), "l_suppkey")).alias("c"))
    out = report.united_info(infos.select(F.lit("Medication").alias("type"), F.col("l_partkey").alias("id"), "groups", F.create_map(F.lit("manufacturer"), "c").alias("refs")))
    return out.select("type", "id", F.array_join("groups", ",").alias("groups"), F.array_join(F.try_element_at("refs", F.lit("manufacturer")), ",").alias("refs"))


@query("SELECT c_custkey AS patient_id, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 500 AS INT) AS batch FROM customer")
def batch_labels(spark: SparkSession, d: str) -> DataFrame:
    return report.batch_labels(table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id")), 500)


_SUMMARY = """WITH e AS (SELECT event_type g, CASE event_id % 3 WHEN 0 THEN 'MUST_HAVE' WHEN 1 THEN 'CONSENT' ELSE 'CASCADING_DELETE' END r, CAST(event_id % 4 AS VARCHAR) a FROM events),
m AS (SELECT g, string_agg(a || '=' || n, ',' ORDER BY a) t FROM (SELECT g, a, count(*) n FROM e WHERE r = 'MUST_HAVE' GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT g, count(*) FILTER (r = 'CONSENT') c, count(*) FILTER (r = 'CASCADING_DELETE') d FROM e GROUP BY 1),
l AS (SELECT count(DISTINCT o_custkey) n FROM orders)"""


@query(f"""{_SUMMARY} SELECT (SELECT count(*) FROM customer) AS cohort, (SELECT n FROM l) AS final, (SELECT count(*) FROM customer) - (SELECT n FROM l) AS lost,
(SELECT string_agg(g || ':' || t || ';' || c || ';' || d, ' ' ORDER BY g) FROM x JOIN m USING (g)) AS excluded, (SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT o_orderstatus s, count(*) n FROM orders GROUP BY 1)) AS included""")
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    """The one-row report, its maps as text."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"))
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id")).distinct()
    reason = F.when(F.col("event_id") % 3 == 0, "MUST_HAVE").when(F.col("event_id") % 3 == 1, "CONSENT").otherwise("CASCADING_DELETE")
    events = table(spark, d, "events").select(F.col("event_type").alias("group_id"), reason.alias("reason"), (F.col("event_id") % 4).cast("string").alias("attribute_ref"))
    lost = people.join(seen, "patient_id", "left_anti").select("patient_id", F.lit("DIRECT_LOAD").alias("stage"))
    taken = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("group_id")).agg(F.count(F.lit(1)).alias("resources"))
    out = report.job_summary(people, people.join(seen, "patient_id", "left_semi"), lost, events, taken, report.PATIENT_STAGES)
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    groups = F.transform(F.map_entries("Resource-Exclusions"), lambda e: F.concat(e["key"], F.lit(":"), text(e["value"]["mustHave"]), F.lit(";"), e["value"]["CONSENT"].cast("string"), F.lit(";"), e["value"]["CASCADING_DELETE"].cast("string")))
    return out.select(F.col("Num-Cohort-Patients").alias("cohort"), F.col("Num-Final-Patients").alias("final"), F.try_element_at("Patient-Exclusions", F.lit("DIRECT_LOAD")).alias("lost"), F.array_join(groups, " ").alias("excluded"), text(F.col("Resource-Inclusions")).alias("included"))


# --- slices and redaction ----------------------------------------------------------------------------------------------

_BODY = "struct<id: string, meta: struct<profile: array<string>>, code: struct<coding: array<struct<system: string, code: string>>>, subject: struct<reference: string>, status: string, component: array<struct<name: string, note: string>>>"


def _slices(second: str = "u") -> tuple[redact.Profile, redact.Profile]:
    e = redact.Element
    one = redact.Profile("p/F", [
        e("Observation", "Observation"), e("Observation.code", "Observation.code", min=1, types=("CodeableConcept",)),
        e("Observation.code.coding", "Observation.code.coding", min=1, types=("Coding",), discriminators=(("PATTERN", "$this"),)),
        e("Observation.code.coding:prio", "Observation.code.coding", "prio", types=("Coding",), pattern='{"system":"prio"}'),
        e("Observation.subject", "Observation.subject", types=("Reference",)),
    ])
    two = redact.Profile(second, [
        e("Observation", "Observation"), e("Observation.status", "Observation.status", min=1, types=("code",)),
        e("Observation.component", "Observation.component", min=1, types=("BackboneElement",)), e("Observation.component.name", "Observation.component.name", min=1, types=("string",)),
    ])
    return one, two


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Records of orders: one or two codings, a status on some, and the profiles p/F (all) and u (some)."""
    coding = lambda s, c: F.struct(F.lit(s).alias("system"), c.alias("code"))
    codings = F.array_compact(F.array(F.when(F.col("o_orderstatus") != "P", coding("prio", F.col("o_orderpriority"))), coding("clerk", F.col("o_orderstatus"))))
    profiles = F.array_compact(F.array(F.lit("p/F|1"), F.when(F.col("o_totalprice") > 100000, F.lit("u"))))
    body = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.struct(profiles.alias("profile")).alias("meta"), F.struct(codings.alias("coding")).alias("code"), F.struct(F.concat(F.lit("Patient/"), "o_custkey").alias("reference")).alias("subject"),
        F.when(F.col("o_orderstatus") == "F", "final").alias("status"), F.array().cast("array<struct<name: string, note: string>>").alias("component"),
    )
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", body.cast(_BODY).alias("body"))


def _redacted(rows: DataFrame, groups: list[redact.Selection]) -> DataFrame:
    return redact.copy_and_redact(rows, "Observation", rows.schema["body"].dataType, groups)


@query("""SELECT o_orderkey, '{"id":"' || o_orderkey || '","meta":{"profile":["p/F"]},"code":{"coding":[' || CASE WHEN o_orderstatus <> 'P' THEN '{"system":"prio","code":"' || o_orderpriority || '"}' ELSE '' END || ']}}' AS body FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, '{"id":"' || o_orderkey || '","meta":{"profile":["p/F"]},"code":{"extension":[{"url":"http://hl7.org/fhir/StructureDefinition/data-absent-reason","valueCode":"masked"}]}}' FROM orders WHERE o_orderstatus = 'P'""")
def slice_match(spark: SparkSession, d: str) -> DataFrame:
    """Only codings of the slice are asked for; where none matches, the required code is marked."""
    one, _ = _slices()
    rows = _observations(spark, d).withColumns({"groups": F.array(F.lit("g")), "refs": F.lit(None).cast("map<string,array<string>>")})
    return _redacted(rows, [redact.Selection("g", one, ("Observation.id", "Observation.meta", "Observation.code.coding:prio"))]).select("o_orderkey", "body")


_MARK_SQL = '{"extension":[{"url":"http://hl7.org/fhir/StructureDefinition/data-absent-reason","valueCode":"masked"}]}'


@query(f"""SELECT o_orderkey, '{{"id":"' || o_orderkey || '","meta":{{"profile":["p/F"]}},"code":{{"coding":[' || CASE WHEN o_orderstatus <> 'P' THEN '{{"system":"prio","code":"' || o_orderpriority || '"}},' ELSE '' END || '{_MARK_SQL}]}},"subject":' || CASE WHEN o_custkey % 2 = 0 THEN '{{"reference":"Patient/' || o_custkey || '"}}' ELSE '{{"_reference":{_MARK_SQL}}}' END || '}}' AS body FROM orders""")
def half_open_slicing(spark: SparkSession, d: str) -> DataFrame:
    """All codings are asked for; those that match no slice are emptied and marked, and references that are not allowed, too."""
    one, _ = _slices()
    refs = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("Observation.subject"), F.array(F.concat(F.lit("Patient/"), "o_custkey"))))
    rows = _observations(spark, d).withColumns({"groups": F.array(F.lit("g")), "refs": refs})
    return _redacted(rows, [redact.Selection("g", one, ("Observation.id", "Observation.meta", "Observation.code", "Observation.subject"))]).select("o_orderkey", "body")


_BACKBONE = f'"component":[{{"_name":{_MARK_SQL},"extension":[{{"url":"http://hl7.org/fhir/StructureDefinition/data-absent-reason","valueCode":"masked"}}]}}]'


@query(f"""SELECT o_orderkey, '{{"id":"' || o_orderkey || '","meta":{{"profile":[' || CASE WHEN o_totalprice > 100000 THEN '"u"' ELSE '' END || ']}},' || CASE WHEN o_orderstatus = 'F' THEN '"status":"final"' ELSE '"_status":{_MARK_SQL}' END || ',{_BACKBONE}}}' AS body, o_totalprice > 100000 AS complete FROM orders""")
def required_backbone(spark: SparkSession, d: str) -> DataFrame:
    """A required list of parts that is not there becomes a marked part whose required field is marked."""
    _, two = _slices()
    rows = _observations(spark, d).withColumns({"groups": F.array(F.lit("h")), "refs": F.lit(None).cast("map<string,array<string>>")})
    return _redacted(rows, [redact.Selection("h", two, ("Observation.id", "Observation.meta", "Observation.status", "Observation.component"))]).select("o_orderkey", "body", "complete")


@query(f"""SELECT o_orderkey, '{{"id":"' || o_orderkey || '","meta":{{"profile":[' || CASE WHEN o_custkey % 2 = 0 THEN '"p/F"' || CASE WHEN o_totalprice > 100000 THEN ',"u"' ELSE '' END ELSE '"p/F"' END || ']}},' || CASE WHEN o_orderstatus = 'P' THEN '"code":{{"extension":[{{"url":"http://hl7.org/fhir/StructureDefinition/data-absent-reason","valueCode":"masked"}}]}}' ELSE '"code":{{"coding":[{{"system":"prio","code":"' || o_orderpriority || '"}}]}}' END
|| CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN ',"status":"final"' ELSE ',"_status":{_MARK_SQL}' END || ',{_BACKBONE}' ELSE '' END || '}}' AS body, o_custkey % 2 <> 0 OR o_totalprice > 100000 AS complete FROM orders""")
def multi_profile(spark: SparkSession, d: str) -> DataFrame:
    """Half of the records belong to two groups: what either group asks for is copied, what either profile requires is marked."""
    one, two = _slices()
    groups = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("g"), F.lit("h"))).otherwise(F.array(F.lit("g")))
    rows = _observations(spark, d).withColumns({"groups": groups, "refs": F.lit(None).cast("map<string,array<string>>")})
    return _redacted(rows, [redact.Selection("g", one, ("Observation.id", "Observation.meta", "Observation.code.coding:prio")), redact.Selection("h", two, ("Observation.status", "Observation.component"))]).select("o_orderkey", "body", "complete")


_ELEMENT = "struct<id: string, coding: array<struct<system: string, code: string>>, part: array<struct<valueQuantity: struct<value: bigint>, valueString: string>>, note: array<struct<text: string, author: string>>, member: array<struct<reference: string>>, tag: array<struct<name: string, n: bigint>>>"


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Records of orders with lists that slices of every kind tell apart; every fifth device has the profile that is asked for."""
    struct = lambda **parts: F.struct(*(v.alias(k) for k, v in parts.items()))
    none = F.lit(None).cast("string")
    body = struct(
        id=F.col("o_orderkey").cast("string"), coding=F.array(struct(system=F.lit("prio"), code=F.col("o_orderpriority")), struct(system=F.lit("clerk"), code=F.col("o_orderstatus"))),
        part=F.array(struct(valueQuantity=struct(value=F.col("o_custkey")), valueString=none), struct(valueQuantity=F.lit(None).cast("struct<value: bigint>"), valueString=F.col("o_orderstatus"))),
        note=F.array(struct(text=F.lit("t"), author=F.when(F.col("o_orderpriority") == "1-URGENT", "me")), struct(text=F.lit("u"), author=none)),
        member=F.array(struct(reference=F.concat(F.lit("Device/"), (F.col("o_custkey") % 5).cast("string"))), struct(reference=F.concat(F.lit("Patient/"), "o_custkey"))),
        tag=F.array(struct(name=F.col("o_orderstatus"), n=F.lit(1)), struct(name=F.lit("x"), n=F.lit(2))),
    )
    return table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").cast("string").alias("id"), body.cast(_ELEMENT).alias("body"))


def _kinds() -> redact.Profile:
    e, o = redact.Element, "Observation"
    return redact.Profile("p/k", [
        e(o, o), e(f"{o}.coding", f"{o}.coding", discriminators=(("PATTERN", "$this"),)), e(f"{o}.coding:prio", f"{o}.coding", "prio", pattern='{"system":"prio"}'),
        e(f"{o}.tag", f"{o}.tag", discriminators=(("VALUE", "name"),)), e(f"{o}.tag:f", f"{o}.tag", "f"), e(f"{o}.tag:f.name", f"{o}.tag.name", pattern='"F"'),
        e(f"{o}.part", f"{o}.part", discriminators=(("TYPE", "value"),)), e(f"{o}.part:number", f"{o}.part", "number"), e(f"{o}.part:number.value[x]", f"{o}.part.value[x]", types=("Quantity",)),
        e(f"{o}.note", f"{o}.note", discriminators=(("EXISTS", "author"),)), e(f"{o}.note:signed", f"{o}.note", "signed"),
        e(f"{o}.member", f"{o}.member", discriminators=(("PROFILE", "resolve()"),)), e(f"{o}.member:device", f"{o}.member", "device", types=("Reference",), target_profiles=("p/device",)),
    ])


@query("""SELECT o_orderkey, o_orderpriority AS prio, CAST(o_custkey AS VARCHAR) AS number, o_orderstatus AS word, CASE WHEN o_orderpriority = '1-URGENT' THEN 't' ELSE '' END AS signed,
o_orderstatus = 'F' AS tagged, CASE WHEN o_custkey % 5 = 0 THEN 'Device/' || (o_custkey % 5) ELSE '' END AS device FROM orders""")
def path_values(spark: SparkSession, d: str) -> DataFrame:
    """What paths lead to: conditions, types of a choice, what exists, slices by their element ids, and targets' profiles."""
    rows = _elements(spark, d)
    kind = rows.schema["body"].dataType
    devices = spark.createDataFrame([("Device", "0", None, ["p/device|2"]), ("Device", "1", None, ["p/other"])], "resource_type string, id string, patient_id long, profiles array<string>")
    told = resolve.conformance(rows.withColumn("body", F.to_json("body")), devices)
    rows = rows.join(told, ["patient_id", "id"], "left")
    text = lambda p: F.array_join(paths.values(p, F.col("body"), kind, F.col("conforms")), ",")
    return rows.select(
        F.col("id").cast("long").alias("o_orderkey"), text("Observation.coding.where(system = 'prio').code").alias("prio"), text("part.value.ofType(Quantity).value").alias("number"), text("part.where(value.ofType(string)).value.ofType(string)").alias("word"),
        text("note.where(author.exists()).text").alias("signed"), paths.has_value(redact.path_of("Observation.tag:f.n", _kinds()), F.col("body"), kind).alias("tagged"), text(redact.path_of("Observation.member:device.reference", _kinds())).alias("device"),
    )


@query("""SELECT o_orderkey, '{"id":"' || o_orderkey || '","coding":[{"system":"prio","code":"' || o_orderpriority || '"}],"part":[{"valueQuantity":{"value":' || o_custkey || '}}]'
|| CASE WHEN o_orderpriority = '1-URGENT' THEN ',"note":[{"text":"t","author":"me"}]' ELSE '' END || CASE WHEN o_custkey % 5 = 0 THEN ',"member":[{"reference":"Device/0"}]' ELSE '' END || CASE WHEN o_orderstatus = 'F' THEN ',"tag":[{"name":"F","n":1}]' ELSE '' END || '}' AS copied,
'{"id":"' || o_orderkey || '","coding":[{"system":"prio","code":"' || o_orderpriority || '"},{}],"part":[{"valueQuantity":{"value":' || o_custkey || '}},{}],"tag":[' || CASE WHEN o_orderstatus = 'F' THEN '{"name":"F","n":1}' ELSE '{}' END || ',{}]}' AS redacted FROM orders""")
def slice_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Slices of all kinds in copying; in redaction those by value, pattern and type, where other values are emptied."""
    rows = _elements(spark, d)
    kind = rows.schema["body"].dataType
    devices = spark.createDataFrame([("Device", "0", None, ["p/device|2"]), ("Device", "1", None, ["p/other"])], "resource_type string, id string, patient_id long, profiles array<string>")
    rows = rows.join(resolve.conformance(rows.withColumn("body", F.to_json("body")), devices), ["patient_id", "id"], "left")
    tree = redact.copy_tree([f"Observation.{x}" for x in ("id", "coding:prio", "tag:f", "part:number", "note:signed", "member:device")])
    copied = redact.copied(F.col("body"), kind, [(None, "Observation", tree)], [_kinds()], F.col("conforms"))
    plain = rows.withColumns({"copied": F.to_json(copied), "groups": F.array(F.lit("g")), "refs": F.lit(None).cast("map<string,array<string>>")})
    out = redact.copy_and_redact(plain, "Observation", kind, [redact.Selection("g", _kinds(), ("Observation.id", "Observation.coding", "Observation.part", "Observation.tag"))])
    return out.select(F.col("id").cast("long").alias("o_orderkey"), "copied", F.col("body").alias("redacted"))


@query("""WITH c AS (SELECT o_orderkey, 1 n, 'N' || c_nationkey code, n_regionkey IN (2, 3) AND n_nationkey <> 7 ok FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT o_orderkey, 2, o_orderstatus, o_orderstatus <> 'P' FROM orders UNION ALL SELECT o_orderkey, 3, o_orderpriority, o_orderpriority = '1-URGENT' FROM orders)
SELECT o_orderkey, coalesce(string_agg(code, ',' ORDER BY n) FILTER (ok), '') AS kept FROM c GROUP BY 1""")
def value_set_codings(spark: SparkSession, d: str) -> DataFrame:
    """Codings outside a value set go: it imports nations below two regions but for one, all status codes but one, and names a priority."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    edges = nation.selectExpr("'geo' AS system", "concat('R', n_regionkey) AS parent", "concat('N', n_nationkey) AS child")
    tops = region.where("r_regionkey IN (2, 3)").selectExpr("'v/geo' AS value_set", "'include' AS part", "'is-a' AS how", "'geo' AS system", "concat('R', r_regionkey) AS code", "CAST(NULL AS STRING) AS imported")
    fixed = [
        ("v/geo", "exclude", "code", "geo", "N7", None), ("v/status", "include", "system", "status", None, None), ("v/status", "exclude", "code", "status", "P", None),
        ("v/all", "include", "import", None, None, "v/geo"), ("v/all", "include", "import", "status", None, "v/status"), ("v/all", "include", "code", "prio", "1-URGENT", None),
    ]
    rules = tops.union(spark.createDataFrame(fixed, "value_set string, part string, how string, system string, code string, imported string"))
    coding = lambda system, c: F.struct(F.lit(system).alias("system"), c.alias("code"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer").selectExpr("c_custkey AS o_custkey", "concat('N', c_nationkey) AS n"), "o_custkey")
    rows = rows.select("o_orderkey", F.array(coding("geo", F.col("n")), coding("status", F.col("o_orderstatus")), coding("prio", F.col("o_orderpriority"))).alias("coding"))
    out = bindings.bound_codings(rows, ["o_orderkey"], "coding", F.lit("v/all"), *bindings.members(rules, edges))
    return out.select("o_orderkey", F.array_join(F.transform("coding", lambda c: c["code"]), ",").alias("kept"))


@query("""SELECT o_custkey, concat_ws(',', CASE WHEN count(*) > 9 THEN 'Person.visit' END, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 4 THEN 'Person.visit:done' END) AS over FROM orders GROUP BY 1""")
def over_max(spark: SparkSession, d: str) -> DataFrame:
    """People with more visits, or more finished ones, than their profile allows."""
    visit = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.struct(F.array_sort(F.collect_list(visit)).alias("visit")).alias("body"))
    e = redact.Element
    profile = redact.Profile("p", [e("Person", "Person", max="*"), e("Person.visit", "Person.visit", discriminators=(("VALUE", "status"),), max="9"), e("Person.visit:done", "Person.visit", "done", max="4"), e("Person.visit:done.status", "Person.visit.status", pattern='"F"')])
    return rows.select("o_custkey", F.array_join(bindings.over_max(F.col("body"), rows.schema["body"].dataType, profile), ",").alias("over"))


# --- whole extractions -------------------------------------------------------------------------------------------------

_PLAN = """enc AS (SELECT o_orderkey, o_custkey, o_orderpriority = '1-URGENT' must, o_totalprice > 100000 ok FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'),
kept AS (SELECT DISTINCT o_custkey FROM enc WHERE ok), ref AS (SELECT DISTINCT e.o_orderkey, e.o_custkey, e.must, l_partkey, p_type <> 'STANDARD' AND p_type <> 'PROMO' hit FROM enc e JOIN lineitem ON l_orderkey = e.o_orderkey JOIN part ON p_partkey = l_partkey WHERE e.ok),
unmet AS (SELECT o_orderkey FROM ref WHERE must GROUP BY 1 HAVING NOT bool_or(hit)), fin AS (SELECT * FROM enc WHERE ok AND o_orderkey NOT IN (SELECT o_orderkey FROM unmet))"""


def _extraction(spark: SparkSession, d: str):
    """Customers of a segment with their finished orders of some price; what these contain, without two kinds of part."""
    from cohortlake.plans import extract

    none = F.lit(None)
    columns = ["resource_type", "id", "patient_id", "profiles", "codes", "period_start", "period_end", "price"]
    visits = encounters(spark, d).withColumnRenamed("o_totalprice", "price").select(*columns)
    coding = F.array(F.struct(F.lit("type").alias("system"), F.col("p_type").alias("code")))
    drugs = table(spark, d, "part").select(F.lit("Medication").alias("resource_type"), F.col("p_partkey").cast("string").alias("id"), none.cast("long").alias("patient_id"), F.array(F.lit("m")).alias("profiles"), coding.alias("codes"), none.cast("date").alias("period_start"), none.cast("date").alias("period_end"), none.cast("double").alias("price"))
    customers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    people = customers.select(F.lit("Patient").alias("resource_type"), F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("patient_id"), F.array(F.lit("q")).alias("profiles"), F.array().cast("array<struct<system: string, code: string>>").alias("codes"), none.cast("date").alias("period_start"), none.cast("date").alias("period_end"), none.cast("double").alias("price"))
    links = table(spark, d, "lineitem").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").selectExpr(
        "o_custkey AS patient_id", "'Encounter' AS src_type", "CAST(l_orderkey AS STRING) AS src_id", "'enc' AS group_id", "'Encounter.medication' AS attribute_ref", "o_orderpriority = '1-URGENT' AS must_have", "'med' AS linked_group", "'Medication' AS dst_type", "CAST(l_partkey AS STRING) AS dst_id"
    )
    kinds = [r[0] for r in table(spark, d, "part").where("p_type NOT IN ('STANDARD', 'PROMO')").select("p_type").distinct().collect()]  # a few kinds
    groups = [
        extract.Group("pat", "Patient"), extract.Group("enc", "Encounter", "p/F", must_have=[("Encounter.price", F.col("price") > 100000)]),
        extract.Group("med", "Medication", "m", [("type", k) for k in sorted(kinds)], reference_only=True),
    ]
    return extract.extract(customers.select(F.col("c_custkey").alias("patient_id")), visits.unionByName(drugs).unionByName(people), links, groups)


@query(f"WITH {_PLAN} SELECT o_custkey AS patient_id, count(DISTINCT o_orderkey) AS encounters, (SELECT count(*) FROM ref r WHERE r.o_custkey = fin.o_custkey AND hit AND r.o_orderkey IN (SELECT o_orderkey FROM fin)) AS links FROM fin GROUP BY 1")
def extract_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Who is left of an extraction, with how many encounters, and how many references out of them."""
    out = _extraction(spark, d)
    visits = out.groups.where("group_id = 'enc'").groupBy("patient_id").agg(F.count(F.lit(1)).alias("encounters"))
    links = out.links.where("group_id = 'enc'").groupBy("patient_id").agg(F.count(F.lit(1)).alias("links"))
    return out.people.join(visits, "patient_id").join(links, "patient_id", "left").select("patient_id", "encounters", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"""WITH {_PLAN} SELECT 'MUST_HAVE' AS reason, (SELECT count(*) FROM enc WHERE NOT ok) + (SELECT count(*) FROM unmet) AS n
UNION ALL SELECT 'REFERENCE_NOT_FOUND', count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM ref WHERE NOT hit)
UNION ALL SELECT 'patients at DIRECT_LOAD', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') - (SELECT count(*) FROM kept)
UNION ALL SELECT 'patients at CASCADING_DELETE', (SELECT count(*) FROM kept) - (SELECT count(DISTINCT o_custkey) FROM fin)""")
def extract_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Why resources and people were left out of an extraction."""
    out = _extraction(spark, d)
    resources = out.resource_exclusions.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    people = report.patient_exclusions(out.patient_exclusions, report.PATIENT_STAGES[1:]).select(F.concat(F.lit("patients at "), "stage").alias("reason"), F.col("patients").alias("n"))
    return resources.unionByName(people)


_NEED = """enc AS (SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'),
hit AS (SELECT o_orderkey, o_custkey, bool_or(p_type = 'PROMO') ok FROM enc JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


@query(f"""WITH {_NEED} SELECT c_custkey AS patient_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM hit WHERE ok) THEN 'kept' WHEN c_custkey IN (SELECT o_custkey FROM hit) THEN 'CASCADING_DELETE' ELSE 'DIRECT_LOAD' END AS outcome,
(SELECT count(*) FROM hit h WHERE h.o_custkey = c_custkey AND ok) AS encounters FROM customer WHERE c_mktsegment = 'BUILDING'""")
def extract_required_references(spark: SparkSession, d: str) -> DataFrame:
    """A group whose only must-have is a reference: people need an order with a part of one kind, and leave where they have none."""
    from cohortlake.plans import extract

    columns = ["resource_type", "id", "patient_id", "profiles", "codes", "period_start", "period_end"]
    coding = F.array(F.struct(F.lit("type").alias("system"), F.col("p_type").alias("code")))
    drugs = table(spark, d, "part").select(F.lit("Medication").alias("resource_type"), F.col("p_partkey").cast("string").alias("id"), F.lit(None).cast("long").alias("patient_id"), F.array(F.lit("m")).alias("profiles"), coding.alias("codes"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"))
    links = table(spark, d, "lineitem").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").selectExpr(
        "o_custkey AS patient_id", "'Encounter' AS src_type", "CAST(l_orderkey AS STRING) AS src_id", "'enc' AS group_id", "'Encounter.medication' AS attribute_ref", "true AS must_have", "'med' AS linked_group", "'Medication' AS dst_type", "CAST(l_partkey AS STRING) AS dst_id"
    )
    groups = [extract.Group("enc", "Encounter", "p/F", required_refs=["Encounter.medication"]), extract.Group("med", "Medication", "m", [("type", "PROMO")], reference_only=True)]
    cohort = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient_id"))
    out = extract.extract(cohort, encounters(spark, d).select(*columns).unionByName(drugs), links, groups)
    visits = out.groups.where("group_id = 'enc'").groupBy("patient_id").agg(F.count(F.lit(1)).alias("encounters"))
    kept = out.people.join(visits, "patient_id", "left").select("patient_id", F.lit("kept").alias("outcome"), F.coalesce("encounters", F.lit(0)).alias("encounters"))
    return kept.unionByName(out.patient_exclusions.select("patient_id", F.col("stage").alias("outcome"), F.lit(0).cast("long").alias("encounters")))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice - 100000 ELSE o_totalprice END p FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F')
SELECT o_custkey AS patient_id, count(*) AS encounters FROM f WHERE p > 100000 GROUP BY 1""")
def extract_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """A store that holds every third order twice, with another price: one copy counts, the cheaper one by the order given."""
    from cohortlake.plans import extract

    visits = encounters(spark, d).withColumnRenamed("o_totalprice", "price")
    copies = visits.where("CAST(id AS BIGINT) % 3 = 0").withColumn("price", F.col("price") - 100000)
    cohort = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient_id"))
    refs = spark.createDataFrame([], "patient_id long, src_type string, src_id string, group_id string, attribute_ref string, must_have boolean, linked_group string, dst_type string, dst_id string")
    groups = [extract.Group("enc", "Encounter", "p/F", must_have=[("Encounter.price", F.col("price") > 100000)])]
    out = extract.extract(cohort, copies.unionByName(visits).unionByName(copies), refs, groups, copy_order=[F.col("price")])
    return out.groups.groupBy("patient_id").agg(F.count(F.lit(1)).alias("encounters"))


_CARRIED = f"""{_WINDOWS}, enc AS (SELECT o_orderkey k, o_custkey c, o_orderstatus st, o_orderpriority pr, CAST(o_orderdate AS DATE) s, CAST(o_orderdate AS DATE) + 30 e FROM orders WHERE o_orderstatus IN ('F', 'O')),
held AS (SELECT * FROM enc WHERE s <= DATE '2001-06-30' AND EXISTS (SELECT 1 FROM win WHERE patient_id = c AND period_start <= s AND e <= period_end)), fin AS (SELECT * FROM held WHERE pr <> '5-LOW'),
item AS (SELECT DISTINCT k, l_partkey p, p_type = 'PROMO' hit FROM fin JOIN lineitem ON l_orderkey = k JOIN part ON p_partkey = l_partkey),
items AS (SELECT k, string_agg(CASE WHEN hit THEN '{{"reference":"Medication/' || p || '"}}' ELSE '{{"_reference":{_MARK_SQL}}}' END, ',' ORDER BY p) t FROM item GROUP BY 1)"""


@query(f"""WITH {_CARRIED}
SELECT 'Encounter' AS resource_type, CAST(k AS VARCHAR) AS id, c AS patient_id, '{{"resourceType":"Encounter","id":"' || k || '","meta":{{"profile":["p/E"]}},' || CASE WHEN st = 'F' THEN '"status":"F",' ELSE '"_status":{_MARK_SQL},' END
|| '"subject":{{"reference":"Patient/' || c || '"}},"priority":"' || pr || '"' || coalesce(',"item":[' || t || ']', '') || '}}' AS body FROM fin LEFT JOIN items USING (k)
UNION ALL SELECT 'Patient', CAST(c AS VARCHAR), c, '{{"resourceType":"Patient","id":"' || c || '","meta":{{"profile":["q"]}},"gender":"' || (SELECT c_mktsegment FROM customer WHERE c_custkey = c) || '"}}' FROM (SELECT DISTINCT c FROM fin)
UNION ALL SELECT 'Medication', CAST(p AS VARCHAR), NULL, '{{"resourceType":"Medication","id":"' || p || '","meta":{{"profile":["m"]}},"code":{{"coding":[{{"system":"brand","code":"' || (SELECT p_brand FROM part WHERE p_partkey = p) || '"}}]}}}}' FROM (SELECT DISTINCT p FROM item WHERE hit)""")
def extract_request(spark: SparkSession, d: str) -> DataFrame:
    """A request from its rows to redacted bodies: consent windows, filters, a must-have path, slices, references out of bodies."""
    from cohortlake.plans import request
    from cohortlake.plans.lineage import cut

    orders, lines, parts = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    text, struct = (lambda c: F.col(c).cast("string")), (lambda **p: F.struct(*(v.alias(k) for k, v in p.items())))
    ref = lambda kind, c: struct(reference=F.concat(F.lit(f"{kind}/"), F.col(c).cast("string")))
    bought = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_set("l_partkey")), lambda p: struct(reference=F.concat(F.lit("Medication/"), p.cast("string")))).alias("item"))
    meta = lambda url: struct(profile=F.array(F.lit(url)))
    visit = struct(resourceType=F.lit("Encounter"), id=text("o_orderkey"), meta=meta("p/E|1"), status=F.when(F.col("o_orderstatus") == "F", "F"), subject=ref("Patient", "o_custkey"), priority=F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), item=F.col("item"), clerk=F.lit("private"))
    person = struct(resourceType=F.lit("Patient"), id=text("c_custkey"), meta=meta("z"), gender=F.col("c_mktsegment"), name=F.col("c_name"))
    code = struct(coding=F.array(struct(system=F.lit("type"), code=F.col("p_type")), struct(system=F.lit("brand"), code=F.col("p_brand"))))
    drug = struct(resourceType=F.lit("Medication"), id=text("p_partkey"), meta=meta("m"), code=code)
    none, codings = F.lit(None).cast("date"), "array<struct<system: string, code: string>>"
    frame = lambda df, kind, i, p, url, codes, s, e, body: df.select(F.lit(kind).alias("resource_type"), text(i).alias("id"), p.cast("long").alias("patient_id"), F.array(F.lit(url)).alias("profiles"), codes.cast(codings).alias("codes"), s.alias("period_start"), e.alias("period_end"), F.to_json(body).alias("body"))
    day = F.col("o_orderdate").cast("date")
    resources = (
        frame(orders.where("o_orderstatus IN ('F', 'O')").join(bought, "o_orderkey", "left"), "Encounter", "o_orderkey", F.col("o_custkey"), "p/E|1", F.array(), day, F.date_add(day, 30), visit)
        .unionByName(frame(table(spark, d, "customer"), "Patient", "c_custkey", F.col("c_custkey"), "z", F.array(), none, none, person))
        .unionByName(frame(parts.withColumn("c", code), "Medication", "p_partkey", F.lit(None), "m", F.col("c.coding"), none, none, drug))
    )
    resources = cut(resources, "store")
    shape = lambda t: resources.sparkSession.createDataFrame([], f"b struct<{t}>").schema["b"].dataType
    head = "resourceType: string, id: string, meta: struct<profile: array<string>>"
    shapes = {"Encounter": shape(f"{head}, status: string, subject: struct<reference: string>, priority: string, item: array<struct<reference: string>>, clerk: string"), "Patient": shape(f"{head}, gender: string, name: string"), "Medication": shape(f"{head}, code: struct<coding: {codings}>")}
    element = lambda url, kind, i, least=0, types=(), slice_name=None, how=None, pattern=None: (url, kind, i, ".".join(s.split(":")[0] for s in i.split(".")), slice_name, least, list(types), [], [], how, pattern, False)
    elements = spark.createDataFrame([
        element("p/E", "Encounter", "Encounter"), element("p/E", "Encounter", "Encounter.status", 1, ["code"]), element("p/E", "Encounter", "Encounter.priority", 0, ["code"]), element("p/E", "Encounter", "Encounter.subject", 1, ["Reference"]), element("p/E", "Encounter", "Encounter.item", 0, ["Reference"]),
        element("q", "Patient", "Patient"), element("q", "Patient", "Patient.gender", 0, ["code"]), element("m", "Medication", "Medication"), element("m", "Medication", "Medication.code", 0, ["CodeableConcept"]),
        element("m", "Medication", "Medication.code.coding", 0, ["Coding"], None, [("pattern", "$this")]), element("m", "Medication", "Medication.code.coding:brand", 0, ["Coding"], "brand", None, '{"system":"brand"}'),
    ], "profile_url string, resource_type string, element_id string, path string, slice_name string, min int, types array<string>, type_profiles array<string>, target_profiles array<string>, discriminators array<struct<type: string, path: string>>, pattern string, bound boolean")
    groups = spark.createDataFrame([("pat", "q", "Patient", False), ("enc", "p/E", "Encounter", False), ("med", "m", "Medication", True)], "group_id string, profile_url string, type string, reference_only boolean")
    attributes = spark.createDataFrame([("pat", 0, "Patient.gender", False, []), ("enc", 0, "Encounter.priority", True, []), ("enc", 1, "Encounter.status", False, []), ("enc", 2, "Encounter.item", False, ["med"]), ("med", 0, "Medication.code.coding:brand", False, [])], "group_id string, ord int, attribute_ref string, must_have boolean, linked_groups array<string>")
    filters = spark.createDataFrame([("enc", "date", None, None, datetime.date(2001, 6, 30)), ("med", "token", [("type", "PROMO")], None, None)], f"group_id string, kind string, codes {codings}, start date, end date")
    request.checked(groups, attributes, filters, elements, ["Patient", "Encounter", "Medication"])
    rules = spark.createDataFrame([("A", False, [], None), ("B", False, [], None)], "code string, gate boolean, retro_codes array<string>, lookback date")
    asked = request.Consent(provisions(spark, d), rules, rules.select("code"), datetime.date(1997, 6, 15))
    cohort = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"))
    return request.run(cohort, resources, request.read(groups, attributes, filters, elements), shapes, asked).resources.select("resource_type", "id", "patient_id", "body")
