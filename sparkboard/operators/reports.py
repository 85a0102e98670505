"""Relational cores of the safety reports, over a table of hazards, and document alerts.

Hazards have the columns activity, stage, hazard, consequence, p and s (1 to 5) and
controls (an array). Layout is left to whoever shows the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import residual_probability, risk_level
from ..functions.text import norm
from .classify import Rule, first_match

#: Classes of hazards and first steps against them, by the first pattern that matches.
HAZARD_CLASSES = (Rule("eletrico", r"eletric|choque|fiacao|painel"), Rule("queda", r"queda|altura|escada|telhado|andaime"), Rule("quimico", r"quimic|solvente|vapor|gas|tinta"), Rule("fisico", r"ruido|calor|vibracao|radiacao|frio"), Rule("biologico", r"biologic|virus|bacteria|sangue|residuo"), Rule("ergonomico", r"postura|esforco|repetitiv|ergonom|peso"))
ACTIONS = (Rule("Desenergizar, bloquear e sinalizar", r"eletric|choque|fiacao"), Rule("Instalar proteção contra quedas e ancoragem", r"queda|altura|escada|telhado"), Rule("Ventilar e fornecer proteção respiratória", r"quimic|vapor|gas|solvente"), Rule("Isolar a fonte e fornecer proteção auditiva", r"ruido"), Rule("Desobstruir e sinalizar a rota", r"obstru|saida|rota|extintor"))


def score() -> Column:
    return F.col("p") * F.col("s")


def risk_analysis(hazards: DataFrame, short: bool = False) -> DataFrame:
    """Hazards with level, residual score and level; with ``short`` only Alto and Crítico."""
    rest = residual_probability(F.col("p"), F.col("s"))
    out = hazards.withColumn("score", score()).withColumn("level", risk_level(F.col("p"), F.col("s"))).withColumn("residual", rest * F.col("s")).withColumn("residual_level", risk_level(rest, F.col("s")))
    return out.where(F.col("level").isin("Alto", "Crítico")) if short else out


def top_hazards(hazards: DataFrame, n: int, least: int = 0, keys: Sequence[str] = ("activity",)) -> DataFrame:
    """The n hazards of highest score of each key: 3 for a talk, 8 of at least 8 for a permit."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(score().desc(), F.asc("hazard")))
    return hazards.where(score() >= least).withColumn("rank", rank).where(F.col("rank") <= n)


def action_plan(hazards: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """What to do against the hazards of at least ``least``, the worst first, with a term in days by level."""
    level = risk_level(F.col("p"), F.col("s"))
    term = F.when(level == "Crítico", 1).when(level == "Alto", 7).otherwise(30)
    return top_hazards(hazards, most, least).select("activity", "rank", "hazard", corrective_action(F.col("hazard")).alias("action"), level.alias("level"), term.alias("days"))


def procedure(hazards: DataFrame, most: int = 3) -> DataFrame:
    """(activity, stage, position, control): distinct controls of a stage's hazards, the worst hazards first."""
    each = hazards.select("activity", "stage", score().alias("score"), F.posexplode("controls").alias("at", "control"))
    best = each.groupBy("activity", "stage", "control").agg(F.min(F.struct((-F.col("score")).alias("score"), "at")).alias("o"))
    rank = F.row_number().over(Window.partitionBy("activity", "stage").orderBy("o", "control"))
    return best.withColumn("position", rank).where(F.col("position") <= most).select("activity", "stage", "position", "control")


def inventory(activities: DataFrame, hazards: DataFrame) -> DataFrame:
    """Every hazard of the given activities with its class."""
    return hazards.join(activities.select("activity").distinct(), "activity", "left_semi").select("activity", "hazard", hazard_class(F.col("hazard")).alias("kind"), risk_level(F.col("p"), F.col("s")).alias("level"))


def merged_activity(hazards: DataFrame, activities: Sequence[str], prefix: int = 40) -> DataFrame:
    """One activity made of several: hazards that agree in the first ``prefix`` characters of their normal form once, the worst kept."""
    some = hazards.where(F.col("activity").isin(*activities))
    rank = F.row_number().over(Window.partitionBy(F.substring(norm(F.col("hazard")), 1, prefix)).orderBy(score().desc(), F.asc("activity"), F.asc("hazard")))
    return some.withColumn("_r", rank).where("_r = 1").drop("_r")


def hazard_class(text: Column) -> Column:
    return first_match(text, HAZARD_CLASSES, "acidente")


def corrective_action(text: Column) -> Column:
    return first_match(text, ACTIONS, "Avaliar e corrigir a condição")


def attendance(spark, n: int) -> DataFrame:
    """Numbered blank rows, 5 to 60."""
    return spark.range(1, max(5, min(60, n)) + 1).select(F.col("id").cast("int").alias("n"), F.lit("").alias("name"), F.lit("").alias("signature"))


def document_alerts(kind: Column, text: Column, expired: Column, due: Column, hours: Column | None = None, norms: Column | None = None) -> Column:
    """Names of what is wrong with a document: expiry, missing signature, revoked norms, unfit result, too few hours, superseded programme."""
    t = norm(text)
    #: Least hours of training by norm, norms that were revoked.
    least = {35: 8, 10: 40, 33: 16, 20: 4}
    alerts = [
        F.when(expired > 0, "vencido"),
        F.when(due > 0, "a_vencer"),
        F.when(kind.isin("apr", "pt", "ficha_epi", "os", "certificado") & ~t.rlike("assinatura|assinado|ciente"), "sem_assinatura"),
        F.when((kind == "aso") & t.rlike(r"\binapto\b"), "inapto"),
        F.when(kind == "ppra", "programa_substituido"),
    ]
    if norms is not None:
        alerts.append(F.when(F.array_contains(norms, 2) | F.array_contains(norms, 27), "norma_revogada"))
        if hours is not None:
            alerts += [F.when(F.array_contains(norms, n) & (hours < h), f"carga_horaria_nr{n}") for n, h in least.items()]
    return F.filter(F.array(*alerts), lambda x: x.isNotNull())


#: How grave a described condition is, by the first pattern that matches, and points of a bulletin that has no others.
SEVERITY = (Rule("Alto", r"grave|iminente|critic|risco de morte|exposta|energizad|sem guarda|altura|queda"),)
POINTS = ("Pare, pense e planeje antes de iniciar a tarefa.", "Use os EPIs obrigatórios da área.", "Comunique qualquer condição insegura.")


def inspections(cases: DataFrame, case: str, text: str, terms: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(case, position, hazard, kind, action, severity): the hazards that each description names, in the order of ``terms``
    (hazard, words); a hazard is named where one of its words is part of the normal form.

    A description that names none, a null and an empty one too, has one row: an unsafe
    condition. Severity goes by the whole description and is Moderado if no pattern matches.
    """
    t = norm(F.coalesce(F.col(text), F.lit("")))
    named = [F.when(F.greatest(*[F.contains("t", norm(F.lit(w))) for w in (*words, words[0])]), F.lit(hazard)) for hazard, words in terms]
    hit = F.filter(F.array(*named), lambda x: x.isNotNull()) if named else F.array().cast("array<string>")
    rows = cases.select(F.col(case).alias("case"), t.alias("t")).withColumn("hits", hit)
    severity = F.when(F.col("t") == "", "Moderado").otherwise(first_match(F.col("t"), SEVERITY, "Moderado"))
    each = rows.select("case", severity.alias("severity"), F.posexplode(F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array(F.lit("Condição insegura descrita")))).alias("position", "hazard"))
    return each.select("case", (F.col("position") + 1).alias("position"), "hazard", hazard_class(F.col("hazard")).alias("kind"), corrective_action(F.col("hazard")).alias("action"), "severity")


def bulletins(calls: DataFrame, call: str, activity: str, advice: str, talks: DataFrame, steps: DataFrame, most: int = 5) -> DataFrame:
    """(call, subject, position, point): what a bulletin says: the points of its activity's talk, else the first ``most`` steps
    of its advice, else ``POINTS``.

    talks (activity, points) and steps (advice, steps) are keyed tables with arrays; one
    without points counts as absent. A null activity or advice is none.
    """
    rows = calls.select(F.col(call).alias("call"), F.col(activity).alias("activity"), F.col(advice).alias("advice"))
    full = lambda t, key, items: t.where(F.size(items) > 0).select(key, F.col(items).alias(f"_{key}"))
    joined = rows.join(full(talks, "activity", "points"), "activity", "left").join(full(steps, "advice", "steps"), "advice", "left")
    points = F.coalesce(F.col("_activity"), F.slice("_advice", 1, most), F.array(*map(F.lit, POINTS)))
    subject = F.when(F.col("_activity").isNotNull(), F.col("activity")).when(F.col("_advice").isNotNull(), F.col("advice")).otherwise("Segurança em primeiro lugar")
    return joined.select("call", subject.alias("subject"), F.posexplode(points).alias("position", "point")).withColumn("position", F.col("position") + 1)


def trainings(courses: DataFrame, course: str, activity: str, norm_id: str, contents: DataFrame, hazards: DataFrame, most: int = 5) -> DataFrame:
    """(course, hours, position, module): what a course teaches: the modules of its norm, else of its activity: the rules, its
    ``most`` worst hazards, protective equipment, emergencies.

    contents (norm, hours, modules) is keyed by norm. Hazards of an activity are ranked
    once, whatever the number of courses. A course whose activity has no hazards keeps the
    other three modules; hours are null without a norm.
    """
    rows = courses.select(F.col(course).alias("course"), F.col(activity).alias("activity"), F.col(norm_id).alias("norm"))
    worst = top_hazards(hazards, most).groupBy("activity").agg(F.array_sort(F.collect_list(F.struct("rank", "hazard"))).alias("h"))  # ``most`` at most
    worst = worst.select("activity", F.transform("h.hazard", lambda x: F.concat(x, F.lit(" — prevenção e controle"))).alias("own"))
    joined = rows.join(contents.where(F.size("modules") > 0).select("norm", "hours", "modules"), "norm", "left").join(worst, "activity", "left")
    made = F.concat(F.array(F.lit("Normas e procedimentos aplicáveis")), F.coalesce("own", F.array().cast("array<string>")), F.array(F.lit("EPIs: seleção, uso, inspeção e conservação"), F.lit("Situações de emergência")))
    return joined.select("course", "hours", F.posexplode(F.coalesce("modules", made)).alias("position", "module")).withColumn("position", F.col("position") + 1)
