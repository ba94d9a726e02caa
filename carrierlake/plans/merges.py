"""Lookup, merge, entity and reshape queries."""

from pyspark.sql import functions as F

from carrierlake.operators import joins, ranking
from carrierlake.operators.burden import co_carried_pairs
from carrierlake.plans.registry import query, rounded, with_sql
from carrierlake.sources.tables import union_tables


@query(
    "keep_best",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def _best(t):
    return joins.keep_best(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "inner_first",
    """SELECT c_custkey, c_name, o_orderkey FROM customer JOIN (SELECT o_custkey AS c_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) USING (c_custkey)""",
)
def _inner_first(t):
    right = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = joins.inner_first(t.customer, right, ["c_custkey"], [F.asc("c_name")], [F.asc("o_orderkey")])
    return out.select("c_custkey", "c_name", "o_orderkey")


@query(
    "attach_lookup",
    "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def _attach(t):
    stale = t.documents.select("doc_id", "lang", F.lit(9).alias("quality"))
    return joins.attach_lookup(stale, t.labels, ["doc_id"], {"quality": -1, "toxic": -1})


SUPPLIED = """SELECT p_partkey, p_brand, f.l_suppkey AS s_l_suppkey, f.l_quantity AS s_l_quantity, coalesce(n, 0) AS s_candidates,
    CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS s_status
    FROM part LEFT JOIN (SELECT l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY ord) AS rn, count(*) OVER (PARTITION BY l_partkey) AS n
      FROM (SELECT *, l_orderkey * 1000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity AS ord FROM lineitem)) f ON f.l_partkey = p_partkey AND rn = 1"""


def part_lines(t):
    ordinal = F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")
    return t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_quantity", ordinal.alias("ord"))


def supplied(t):
    return joins.lossless_merge(t.part.select("p_partkey", "p_brand"), part_lines(t), "p_partkey", "s_", "ord")


@query("lossless_merge", SUPPLIED)
def _lossless(t):
    return supplied(t)


@query(
    "merge_audit_status",
    f"SELECT s_status AS status, count(*) AS rows, count(DISTINCT p_partkey) AS ids FROM ({SUPPLIED}) GROUP BY 1",
)
def _audit(t):
    return joins.merge_audit(supplied(t), part_lines(t), "p_partkey", "s_status")["status"]


@query("merge_audit_unmatched", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _audit_unmatched(t):
    table = t.labels.select("doc_id", "toxic", F.col("doc_id").alias("ord"))
    merged = joins.lossless_merge(t.documents.select("doc_id"), table, "doc_id", "l_", "ord")
    return joins.merge_audit(merged, table, "doc_id", "l_status")["unmatched"]


@query("merge_audit_table_only", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _audit_right(t):
    merged = t.labels.select("doc_id", F.lit("matched").alias("status"))
    return joins.merge_audit(merged, t.documents, "doc_id", "status")["table_only"]


@query(
    "resolve_entities",
    """WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 50 END AS code, s_nationkey AS label FROM supplier),
      d AS (SELECT c_custkey % 400 AS code, count(DISTINCT c_custkey) AS dn, min(c_custkey) AS de FROM customer GROUP BY 1),
      a AS (SELECT c_nationkey + (c_custkey % 7) * 5 AS label, count(DISTINCT c_custkey) AS n, min(c_custkey) AS e FROM customer GROUP BY 1)
    SELECT s_suppkey, code, label, CASE WHEN coalesce(dn, n, 0) = 1 THEN coalesce(de, e) END AS c_custkey, coalesce(dn, n, 0) AS candidates,
      CASE WHEN dn IS NOT NULL THEN 'code' WHEN n IS NOT NULL THEN 'alias' ELSE 'none' END AS match_by,
      CASE WHEN coalesce(dn, n, 0) = 0 THEN 'unmatched' WHEN coalesce(dn, n, 0) = 1 THEN 'matched' ELSE 'ambiguous' END AS match_status
    FROM l LEFT JOIN d USING (code) LEFT JOIN a USING (label)""",
)
def _resolve(t):
    left = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 50).alias("code"), F.col("s_nationkey").cast("bigint").alias("label"))
    entities = t.customer.select("c_custkey", (F.col("c_custkey") % 400).alias("code"))
    aliases = t.customer.select("c_custkey", (F.col("c_nationkey") + (F.col("c_custkey") % 7) * 5).alias("alias"))
    return joins.resolve_entities(left, entities, aliases, "code", "c_custkey", "label").select(
        "s_suppkey", "code", F.col("label").cast("int"), "c_custkey", "candidates", "match_by", "match_status"
    )


@query(
    "outer_layers",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n_urgent, max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
      b AS (SELECT o_custkey AS k, count(*) AS n_low, max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)
    SELECT k, n_urgent, n_low, coalesce(a.top, b.top) AS top, n_urgent IS NOT NULL AS in_urgent, n_low IS NOT NULL AS in_low FROM a FULL JOIN b USING (k)""",
)
def _outer(t):
    layer = lambda p, n: t.orders.where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias(n), F.max("o_totalprice").alias("top")
    )
    return joins.outer_layers(layer("1-URGENT", "n_urgent"), layer("5-LOW", "n_low"), ["k"], ["top"], ("urgent", "low"))


@query(
    "semi_anti",
    """SELECT c_custkey, true AS bought FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
      UNION ALL SELECT c_custkey, false FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def _semi(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    people = t.customer.select("c_custkey")
    return people.join(urgent, "c_custkey", "left_semi").withColumn("bought", F.lit(True)).unionByName(
        people.join(urgent, "c_custkey", "left_anti").withColumn("bought", F.lit(False))
    )


@query(
    "prioritised_match",
    """WITH b AS (SELECT p_partkey, p_name AS path, p_brand AS grp FROM part),
      c AS (SELECT CASE WHEN p_size > 45 THEN p_name END AS path, p_brand AS grp, p_retailprice AS price FROM part WHERE p_size > 20)
    SELECT p_partkey, b.path, b.grp, round(coalesce(v0, v1), 6) AS price, CASE WHEN v0 IS NOT NULL THEN 'path' WHEN v1 IS NOT NULL THEN 'grp' END AS matched_on FROM b
      LEFT JOIN (SELECT path, min(price) AS v0 FROM c WHERE path IS NOT NULL GROUP BY 1) x ON x.path = b.path LEFT JOIN (SELECT grp, min(price) AS v1 FROM c GROUP BY 1) y ON y.grp = b.grp""",
)
def _prioritised(t):
    base = t.part.select("p_partkey", F.col("p_name").alias("path"), F.col("p_brand").alias("grp"))
    candidates = t.part.where("p_size > 20").select(F.when(F.col("p_size") > 45, F.col("p_name")).alias("path"), F.col("p_brand").alias("grp"), F.col("p_retailprice").alias("price"))
    return rounded(joins.prioritised_match(base, candidates, "p_partkey", ["path", "grp"], "price"))


@query(
    "co_carried_pairs",
    with_sql("purchases", "").rstrip() + """, x AS (SELECT DISTINCT l_orderkey, p_brand AS v FROM purchases)
    SELECT a.v AS first, b.v AS second, count(*) AS n FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.v < b.v GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _pairs(t):
    return co_carried_pairs(t.purchases().select(F.col("l_orderkey").alias("sample"), F.col("p_brand").alias("v")), "v", 3)


@query(
    "whitelist_filter",
    """SELECT p_partkey, p_brand, p_name, p_size FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier) OR p_name IN (SELECT p_name FROM part WHERE p_retailprice > 1500)
      OR p_size IN (SELECT n_nationkey FROM nation)""",
)
def _whitelist(t):
    lists = {
        "p_partkey": t.supplier.select(F.col("s_suppkey").alias("p_partkey")), "p_name": t.part.where("p_retailprice > 1500").select("p_name"),
        "p_size": t.nation.select(F.col("n_nationkey").cast("int").alias("p_size")),
    }
    return joins.whitelist_filter(t.part.select("p_partkey", "p_brand", "p_name", "p_size"), lists)


@query(
    "key_flags",
    """SELECT k, bool_or(a) AS in_a, bool_or(b) AS in_b FROM (SELECT o_custkey AS k, true AS a, false AS b FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_custkey, false, true FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""",
)
def _flags(t):
    k = t.orders.select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_orderpriority")
    return joins.key_flags(k.where("o_orderstatus = 'F'"), k.where("o_orderpriority = '1-URGENT'"), "k")


@query(
    "validate",
    """SELECT unnest(['null:o_orderkey', 'null:o_custkey', 'allowed:o_orderstatus', 'percent:pct', 'rows', 'groups:o_orderpriority']) AS rule,
      unnest([count(*) FILTER (o_orderkey IS NULL), count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')),
        count(*) FILTER (NOT o_totalprice / 4000 BETWEEN 0 AND 100), count(*), count(DISTINCT o_orderpriority)]) AS count FROM orders""",
)
def _validate(t):
    df = t.orders.withColumn("pct", F.col("o_totalprice") / 4000)
    return joins.validate(df, ["o_orderkey", "o_custkey"], {"o_orderstatus": ["F", "O"]}, ["pct"], "o_orderpriority")


@query("restrict_panel_rows", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _panel_rows(t):
    return joins.restrict_panel(t.customer, {"c_mktsegment": ["BUILDING", "MACHINERY"], "sex": ["F"]}).select("c_custkey", "c_mktsegment")


@query(
    "restrict_panel",
    """SELECT 'c_mktsegment' AS filter, 'applied' AS filter_status, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS kept, count(*) AS total FROM customer
      UNION ALL SELECT 'sex', 'column_absent', count(*), count(*) FROM customer""",
)
def _restrict(t):
    return joins.panel_report(t.customer, {"c_mktsegment": ["BUILDING", "MACHINERY"], "sex": ["F"]})


@query("drop_sparse_columns", "SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'x' END AS half FROM documents LEFT JOIN labels USING (doc_id)")
def _sparse(t):
    df = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", F.when(F.col("quality") == 1, "x").alias("half"), F.when(F.col("doc_id") < 0, "y").alias("empty")
    )
    return joins.drop_sparse_columns(df, 0.99, ["doc_id"])


@query(
    "stack_blocks",
    "SELECT s_suppkey, 1 AS block, s_name AS label, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 2, s_nationkey::VARCHAR, s_acctbal / 2 FROM supplier",
)
def _stack(t):
    df = t.supplier.select("s_suppkey", "s_name", "s_acctbal", F.col("s_nationkey").cast("string").alias("n"), (F.col("s_acctbal") / 2).alias("half"))
    return joins.stack_blocks(df, ["s_suppkey"], [{"label": "s_name", "v": "s_acctbal"}, {"label": "n", "v": "half"}])


@query(
    "collapse_replicates",
    """WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS a, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS b FROM orders)
    SELECT o_custkey, count(*) AS source_rows, arg_min(a, o_orderkey) FILTER (a IS NOT NULL) AS a, arg_min(b, o_orderkey) FILTER (b IS NOT NULL) AS b,
      min(a) <> max(a) AS a_mixed, min(b) <> max(b) AS b_mixed FROM x GROUP BY 1""",
)
def _replicates(t):
    status = F.col("o_orderstatus")
    df = t.orders.select("o_custkey", "o_orderkey", F.when(status != "P", F.col("o_orderpriority")).alias("a"), F.when(status == "F", F.col("o_totalprice")).alias("b"))
    return joins.collapse_replicates(df, ["o_custkey"], F.col("o_orderkey"), ["a", "b"])


@query(
    "top_k",
    """SELECT p_brand, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS place FROM part) WHERE place <= 10""",
)
def _top_k(t):
    return ranking.top_k(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 10).select("p_brand", "p_partkey", "place")


@query(
    "share_of",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2",
)
def _share(t):
    df = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return rounded(ranking.share_of(df, ["l_returnflag"], "q"))


@query(
    "first_nonempty",
    "SELECT lang, arg_min(source, doc_id) FILTER (source <> 'src0') AS first_source FROM documents GROUP BY 1",
)
def _first(t):
    value = F.when(F.col("source") != "src0", F.struct("doc_id", "source"))
    return t.documents.groupBy("lang").agg(F.min(value)["source"].alias("first_source"))


@query(
    "unpivot",
    "SELECT s_suppkey, 'nation' AS field, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier",
)
def _unpivot(t):
    wide = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return wide.unpivot(["s_suppkey"], ["nation", "balance"], "field", "value")


@query("explode_lists", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def _explode(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_with_drift",
    "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier",
)
def _union(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return union_tables([a, b])


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
