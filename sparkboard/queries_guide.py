"""Named queries over knowledge bases that are made of the test tables by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import guide, reports
from .operators.classify import Rule
from .queries import _HAZARDS, _NORM, _WORDS, _hazards, query

# ---- one search over all of a knowledge base -------------------------------------------------
# Benchmark texts are norms, part names the glossary, market segments activities, order priorities advice.
# Each turn of a conversation, each order and each part asks a question.


def _known(b: DataFrame, p: DataFrame, c: DataFrame, o: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return guide.entries(
        b.select(F.col("item_id").alias("number"), none.alias("title"), F.col("text").alias("summary"), none.alias("keywords")),
        p.select(F.col("p_name").alias("term"), none.alias("aliases"), F.concat(F.lit("peça "), "p_name").alias("definition")).distinct(),
        c.select(F.col("c_mktsegment").alias("activity"), F.col("c_mktsegment").alias("name"), F.array(F.lit("segmento"), F.lit("mercado")).alias("terms")).distinct(),
        o.select(F.col("o_orderpriority").alias("advice"), F.col("o_orderpriority").alias("title"), F.array(F.lit("tratar pedido"), F.lit("avisar cliente")).alias("steps")).distinct(),
    )


def _questions(p: DataFrame, o: DataFrame, v: DataFrame) -> DataFrame:
    said = v.select(F.concat(F.lit("said "), "conv_id", F.lit(" "), "turn").alias("question"), F.col("text").alias("t"))
    orders = o.select(F.concat(F.lit("order "), "o_orderkey").alias("question"), F.concat(F.lit("pedido "), F.coalesce("o_orderpriority", F.lit("")), F.when(F.col("o_orderkey") % 3 == 0, " e outras coisas que ninguém sabe aqui").otherwise("")).alias("t"))
    return said.unionByName(orders).unionByName(p.select(F.concat(F.lit("part "), "p_partkey").alias("question"), F.concat(F.lit("O que é "), "p_name").alias("t")))


def _answers(b: DataFrame, p: DataFrame, c: DataFrame, o: DataFrame, v: DataFrame) -> DataFrame:
    got = guide.answers(_questions(p, o, v), "question", "t", _known(b, p, c, o), fuzzy=False, stems=False)
    return got.select("question", "kind", "id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


def _tokens(rows: str, key: str) -> str:
    return f"SELECT {key}, unnest({_WORDS.format(t=_NORM.format(c='t'))}) AS token FROM {rows}"


query(
    "knowledge_answers",
    "benchmark part customer orders conversations",
    f"""WITH e AS (SELECT 'norm' AS kind, CAST(item_id AS VARCHAR) AS id, concat_ws(' ', 'NR-' || item_id, text) AS t FROM benchmark
    UNION ALL SELECT DISTINCT 'glossary', p_name, p_name || ' peça ' || p_name FROM part UNION ALL SELECT DISTINCT 'activity', c_mktsegment, c_mktsegment || ' segmento mercado' FROM customer
    UNION ALL SELECT DISTINCT 'advice', o_orderpriority, o_orderpriority || ' tratar pedido avisar cliente' FROM orders),
    u AS (SELECT 'said ' || conv_id || ' ' || turn AS question, text AS t FROM conversations
    UNION ALL SELECT 'order ' || o_orderkey, 'pedido ' || coalesce(o_orderpriority, '') || CASE WHEN o_orderkey % 3 = 0 THEN ' e outras coisas que ninguém sabe aqui' ELSE '' END FROM orders
    UNION ALL SELECT 'part ' || p_partkey, 'O que é ' || p_name FROM part),
    w AS ({_tokens('e', 'kind, id')}), p AS (SELECT kind, id, token, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT kind, id, count(*) AS len FROM w GROUP BY ALL),
    g AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM e) AS m), d AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
    q AS (SELECT DISTINCT * FROM ({_tokens('u', 'question')})), c AS (SELECT question, count(*) AS n FROM q GROUP BY 1),
    s AS (SELECT question, kind, id, sum(ln(1 + (g.n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.28 + 0.72 * len / g.m))) AS score, count(*) AS hit
    FROM q JOIN p USING (token) JOIN d USING (token) JOIN l USING (kind, id), g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, kind || ':' || id) AS r FROM s WHERE score > 0.01),
    a AS (SELECT question, kind, id, round(score, 6) AS score, round(hit / c.n, 6) AS coverage FROM r JOIN c USING (question) WHERE r = 1 AND score > 2.2 AND hit / c.n >= 0.4)
    SELECT x.question, kind, id, score, coverage FROM (SELECT DISTINCT question FROM u) x LEFT JOIN a USING (question)""",
)(_answers)

_ADVICE = (Rule("urgent", r"\burgent\b"), Rule("high", r"\bhigh\b|\burgente\b"), Rule("low", r"\blow\b"))
query(
    "advice_found",
    "orders",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS advice FROM orders",
)(lambda t: t.select("o_orderkey", guide.advice_for(F.concat(F.lit("O que faço? Prioridade "), "o_orderpriority"), _ADVICE).alias("advice")))


def _titles(t: DataFrame) -> DataFrame:
    """An intent for each order, by its key; those of a document, an activity or a norm say so, and some say nothing but names."""
    k = F.col("o_orderkey")
    names = ("doc_generate", "nr_info", "tab_create", "calc", "doc_summary", "advice", "define", "other")
    said = t.select("o_orderkey", F.col("o_orderpriority"), F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int")).alias("intent"), F.concat(F.lit("Painel de pedidos do cliente número "), F.col("o_custkey").cast("string"), F.lit(" e seus valores")).alias("said"))
    slots = {
        "intent": F.col("intent"), "document": F.when(k % 8 == 0, "APR"), "activity": F.when(k % 16 == 0, F.col("o_orderpriority")),
        "norm": (k % 38).cast("string"), "norm_title": F.col("o_orderpriority"), "advice": F.col("o_orderpriority"), "term": F.col("o_orderpriority"),
    }
    return guide.titles(said, "o_orderkey", "said", slots)


query(
    "chat_titles",
    "orders",
    """SELECT o_orderkey AS chat, CASE o_orderkey % 8 WHEN 0 THEN 'APR' || CASE WHEN o_orderkey % 16 = 0 THEN ' — ' || o_orderpriority ELSE '' END WHEN 1 THEN 'NR-' || lpad(CAST(o_orderkey % 38 AS VARCHAR), 2, '0') || ' — ' || o_orderpriority
    WHEN 2 THEN 'Abas — ' || rtrim(left('Painel de pedidos do cliente número ' || o_custkey || ' e seus valores', 39)) || '…' WHEN 3 THEN 'Cálculo de SST' WHEN 4 THEN 'Análise de arquivo' WHEN 5 THEN o_orderpriority WHEN 6 THEN 'O que é ' || o_orderpriority
    ELSE 'Cliente, painel, numero' END AS title FROM orders""",
)(_titles)

# ---- cores of further reports ------------------------------------------------------------------

_TERMS = (("queda de anel", ("ring",)), ("choque em aparelho", ("gadget", "gizmo")), ("corte", ("small", "bolt")))
query(
    "report_inspection",
    "part",
    """WITH d AS (SELECT p_partkey, p_name || CASE WHEN p_size % 4 = 0 THEN ' com fiação exposta' ELSE '' END AS t FROM part),
    h AS (SELECT p_partkey, t, list_filter([CASE WHEN contains(t, 'ring') THEN 'queda de anel' END, CASE WHEN contains(t, 'gadget') OR contains(t, 'gizmo') THEN 'choque em aparelho' END, CASE WHEN contains(t, 'small') OR contains(t, 'bolt') THEN 'corte' END], lambda x: x IS NOT NULL) AS f FROM d),
    e AS (SELECT p_partkey, t, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['Condição insegura descrita'] END) AS hazard, unnest(range(greatest(len(f), 1))) + 1 AS position FROM h)
    SELECT p_partkey AS "case", position::INT AS position, hazard, CASE WHEN contains(t, 'exposta') THEN 'Alto' ELSE 'Moderado' END AS severity FROM e""",
)(lambda t: reports.inspections(t.select("p_partkey", F.concat("p_name", F.when(F.col("p_size") % 4 == 0, " com fiação exposta").otherwise("")).alias("t")), "p_partkey", "t", _TERMS).select("case", "position", "hazard", "severity"))
query(
    "report_bulletin",
    "orders customer",
    """WITH c AS (SELECT o_orderkey, c_mktsegment AS a, o_orderpriority AS d FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
    x AS (SELECT o_orderkey, CASE WHEN a IN ('BUILDING', 'MACHINERY') THEN a WHEN d IN ('1-URGENT', '2-HIGH') THEN d ELSE 'Segurança em primeiro lugar' END AS subject,
    CASE WHEN a IN ('BUILDING', 'MACHINERY') THEN ['talk ' || a, 'second'] WHEN d IN ('1-URGENT', '2-HIGH') THEN [d || ' ' || k FOR k IN range(1, 6)]
    ELSE ['Pare, pense e planeje antes de iniciar a tarefa.', 'Use os EPIs obrigatórios da área.', 'Comunique qualquer condição insegura.'] END AS p FROM c)
    SELECT o_orderkey AS call, subject, unnest(range(len(p)))::INT + 1 AS position, unnest(p) AS point FROM x""",
)(
    lambda o, c: reports.bulletins(
        o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left"), "o_orderkey", "c_mktsegment", "o_orderpriority",
        c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_mktsegment").alias("activity")).distinct().withColumn("points", F.array(F.concat(F.lit("talk "), "activity"), F.lit("second"))),
        o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderpriority").alias("advice")).distinct().withColumn("steps", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.concat("advice", F.lit(" "), k.cast("string")))),
    )
)
query(
    "report_training",
    "part",
    f"""WITH w AS (SELECT activity, list(hazard || ' — prevenção e controle' ORDER BY r) AS own FROM (SELECT activity, hazard, row_number() OVER (PARTITION BY activity ORDER BY p * s DESC, hazard) AS r FROM {_HAZARDS}) WHERE r <= 5 GROUP BY 1),
    x AS (SELECT p_partkey, CASE WHEN p_size IN (10, 20) THEN p_size * 2 END AS hours, CASE WHEN p_size IN (10, 20) THEN ['module of ' || p_size, 'practice']
    ELSE list_concat(list_concat(['Normas e procedimentos aplicáveis'], own), ['EPIs: seleção, uso, inspeção e conservação', 'Situações de emergência']) END AS m FROM part LEFT JOIN w ON activity = p_brand)
    SELECT p_partkey AS course, hours::INT AS hours, unnest(range(len(m)))::INT + 1 AS position, unnest(m) AS module FROM x""",
)(
    lambda t: reports.trainings(
        t, "p_partkey", "p_brand", "p_size",
        t.where(F.col("p_size").isin(10, 20)).select(F.col("p_size").alias("norm")).distinct().select("norm", (F.col("norm") * 2).cast("int").alias("hours"), F.array(F.concat(F.lit("module of "), F.col("norm").cast("string")), F.lit("practice")).alias("modules")),
        _hazards(t),
    )
)
