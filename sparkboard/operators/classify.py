"""Rule tables compiled to CASE expressions: types of documents, intents, hazards, actions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, norm


@dataclass(frozen=True)
class Rule:
    """``result`` where ``pattern`` matches the normal form and ``needs`` (a context column) holds."""

    result: str
    pattern: str
    needs: str | None = None


#: Intents in order of priority: the first rule that matches decides. Context columns
#: (pending, has_doc, has_tab) come with the row.
INTENTS: tuple[Rule, ...] = (
    Rule("help", r"^/(ajuda|help)\b"),
    Rule("new_chat", r"^/(nova|novo|new)\b"),
    Rule("tab_list", r"^/(abas|tabs)\b"),
    Rule("site_read", r"^/(site|url)\b"),
    Rule("doc_generate", r"^/(gerar|doc|documento|apr|pt|dds|checklist|os)\b"),
    Rule("pending_answer", r".", "pending"),
    Rule("greet", r"^(oi|ola|bom dia|boa tarde|boa noite|hello|hi)\b"),
    Rule("thanks", r"\b(obrigad[oa]|valeu|thanks|thank you)\b"),
    Rule("bye", r"^(tchau|ate logo|ate mais|bye)\b"),
    Rule("set_name", r"\b(meu nome e|me chamo|my name is)\b"),
    Rule("remember", r"^(lembre|lembra|anote|guarde|remember)\b"),
    Rule("forget", r"^(esqueca|esquece|apague da memoria|forget)\b"),
    Rule("recall_profile", r"\b(o que voce sabe|lembra de mim|meu perfil)\b"),
    Rule("tab_undo", r"\b(desfaz|desfazer|desfaca|undo)\b"),
    Rule("tab_from_site", r"\b(aba|painel|dashboard)\b.*https?://"),
    Rule("tab_from_file", r"\b(aba|painel|dashboard)\b.*\b(planilha|arquivo|anexo)\b"),
    Rule("tab_delete", r"\b(exclu[ia]|apag[ue]|remov[ae])\w*\b.*\b(aba|painel)\b"),
    Rule("tab_edit", r"\b(adicion|inclu|coloqu|mud|troqu|renome|remov)\w*\b.*\b(grafico|indicador|tabela|kpi|coluna|sub-?aba|cor|titulo)\b"),
    Rule("tab_create", r"\b(cri[ae]|mont[ae]|fac[ao]|nova)\w*\b.*\b(aba|painel|dashboard)\b"),
    Rule("site_read", r"https?://"),
    Rule("calc", r"\b(calcul\w+|taxa de (frequencia|gravidade)|dose de ruido)\b"),
    Rule("doc_summary", r"\b(resum\w+|sintese|summary)\b", "has_doc"),
    Rule("doc_validity", r"\b(vencid\w*|validade|vence\w*)\b", "has_doc"),
    Rule("doc_qa", r"\?\s*$", "has_doc"),
    Rule("doc_generate", r"\b(ger[ae]|faz|faca|elabor\w+|redij\w+|prepar\w+)\b.*\b(apr|pt|dds|checklist|ordem de servico|relatorio|plano|procedimento|comunicado)\b"),
    Rule("nr_info", r"\bnr[\s-]*\d{1,2}\b"),
    Rule("nr_search", r"\bqual (nr|norma)\b"),
    Rule("define", r"^(o que (e|sao|significa)|defin\w+|what is)\b"),
    Rule("advice", r"\b(como (fazer|proceder|evitar)|o que (fazer|devo))\b"),
)


def first_match(text: Column, rules: Sequence[Rule], default: str, context: dict[str, Column] | None = None) -> Column:
    """The result of the first rule that matches, as one CASE."""
    return let(norm(text), lambda t: first_of(t, rules, default, context))


def first_of(t: Column, rules: Sequence[Rule], default: str, context: dict[str, Column] | None = None) -> Column:
    """``first_match`` of a normal form that is there already."""
    out = None
    for rule in rules:
        hit = t.rlike(rule.pattern)
        if rule.needs:
            hit = hit & F.coalesce((context or {}).get(rule.needs, F.lit(False)), F.lit(False))
        out = F.when(hit, rule.result) if out is None else out.when(hit, rule.result)
    return F.when(t == "", "empty").otherwise(out.otherwise(default))


def intent(text: Column, context: dict[str, Column] | None = None) -> Column:
    return first_match(text, INTENTS, "unknown", context)


@dataclass(frozen=True)
class DocType:
    name: str
    keywords: tuple[str, ...]
    strong: tuple[str, ...] = ()


#: Types of safety documents, their keywords and strong phrases.
DOC_TYPES = (
    DocType(
        "apr",
        ("analise preliminar de risco", "apr", "perigo", "medidas de controle", "etapa", "probabilidade", "severidade", "risco residual"),
        ("analise preliminar de risco",),
    ),
    DocType(
        "pt",
        ("permissao de trabalho", "permissao de entrada", "pet", "liberacao", "emitente", "executante", "encerramento"),
        ("permissao de trabalho", "permissao de entrada e trabalho"),
    ),
    DocType(
        "aso",
        ("atestado de saude ocupacional", "apto", "inapto", "admissional", "periodico", "demissional", "medico examinador", "crm", "exames complementares"),
        ("atestado de saude ocupacional",),
    ),
    DocType(
        "pgr",
        ("programa de gerenciamento de riscos", "inventario de riscos", "plano de acao", "gro", "avaliacao de riscos", "ghe", "grupo homogeneo"),
        ("programa de gerenciamento de riscos", "inventario de riscos"),
    ),
    DocType("ppra", ("programa de prevencao de riscos ambientais", "ppra"), ("programa de prevencao de riscos ambientais",)),
    DocType(
        "pcmso",
        ("programa de controle medico", "pcmso", "periodicidade dos exames", "medico responsavel", "relatorio analitico"),
        ("programa de controle medico de saude ocupacional",),
    ),
    DocType(
        "ltcat",
        ("laudo tecnico", "ltcat", "insalubridade", "periculosidade", "agente nocivo", "aposentadoria especial", "conclusao"),
        ("laudo tecnico das condicoes ambientais", "laudo de insalubridade", "laudo de periculosidade"),
    ),
    DocType(
        "fds",
        ("ficha de informacoes de seguranca", "ficha com dados de seguranca", "fispq", "fds", "identificacao do produto", "composicao", "primeiros socorros", "combate a incendio", "numero cas", "numero onu", "pictograma", "frases de perigo", "14725"),
        ("fispq", "ficha com dados de seguranca", "ficha de informacoes de seguranca"),
    ),
    DocType(
        "os",
        ("ordem de servico", "obrigacoes", "proibicoes", "riscos da funcao", "ciente", "penalidades", "recomendacoes"),
        ("ordem de servico",),
    ),
    DocType(
        "certificado",
        ("certificado", "certificamos", "carga horaria", "concluiu", "curso", "instrutor", "conteudo programatico", "participou"),
        ("certificamos", "certificado de conclusao"),
    ),
    DocType(
        "ficha_epi",
        ("ficha de entrega", "ficha de controle", "epi", "data de entrega", "devolucao", "assinatura do colaborador", "termo de responsabilidade"),
        ("ficha de entrega", "controle de entrega de epi", "ficha de epi"),
    ),
    DocType(
        "procedimento",
        ("procedimento", "objetivo", "escopo", "campo de aplicacao", "responsabilidades", "definicoes", "descricao das atividades", "referencias", "instrucao de trabalho", "pop"),
        ("procedimento operacional", "instrucao de trabalho", "procedimento de seguranca"),
    ),
    DocType(
        "inspecao",
        ("inspecao", "nao conformidade", "evidencia", "constatacao", "auditoria", "recomendacao", "registro fotografico"),
        ("relatorio de inspecao", "nao conformidade", "relatorio de auditoria"),
    ),
    DocType(
        "acidente",
        ("acidente", "investigacao", "causa raiz", "testemunha", "lesao", "ocorrencia", "acidentado", "5 porques", "ishikawa"),
        ("investigacao de acidente", "analise de acidente", "comunicacao de acidente", "relatorio de acidente"),
    ),
    DocType(
        "ata",
        ("ata", "reuniao", "presentes", "pauta", "deliberacoes", "secretario", "cipa"),
        ("ata da reuniao", "ata de reuniao", "ata de eleicao"),
    ),
    DocType(
        "checklist",
        ("checklist", "check list", "conforme", "nao conforme", "n/a", "verificacao", "item"),
        ("checklist", "lista de verificacao"),
    ),
    DocType("dds", ("dialogo diario de seguranca", "dds", "tema do dia", "participantes"), ("dialogo diario de seguranca",)),
    DocType("norma", ("portaria", "norma regulamentadora", "subitem", "anexo", "disposicoes", "vigencia", "revoga"), ("norma regulamentadora",)),
    DocType("contrato", ("contrato", "clausula", "contratante", "contratada", "rescisao"), ("clausula primeira", "do objeto")),
)


def doc_type_scores(docs: DataFrame, doc: str, text: str, types: Sequence[DocType]) -> DataFrame:
    """(doc, type, score): four points at most for each keyword's occurrences, twelve for a
    strong phrase in the first 1500 characters, five for one elsewhere. Word borders are
    those of ASCII words."""
    t = F.concat(F.lit(" "), norm(F.col(text)), F.lit(" "))
    head = norm(F.substring(text, 1, 1500))
    scores = []
    single = sorted({k for kind in types for k in kind.keywords if re.fullmatch("[A-Za-z0-9_]+", k)})

    def times(k: str) -> Column:
        if k in single:
            return F.size(F.filter("said", lambda w: w == k))
        return F.when(F.contains("t", F.lit(k)), F.regexp_count("t", F.lit(rf"(?<![A-Za-z0-9_]){re.escape(k)}(?![A-Za-z0-9_])"))).otherwise(0)

    for kind in types:
        s = F.lit(0)
        for k in kind.keywords:
            s = s + F.least(F.lit(4), times(k))
        for k in kind.strong:
            s = s + F.when(F.contains(F.col("head"), F.lit(k)), 12).when(F.contains(F.col("t"), F.lit(k)), 5).otherwise(0)
        scores.append(F.struct(F.lit(kind.name).alias("type"), s.cast("int").alias("score")))
    rows = docs.select(F.col(doc).alias("doc"), t.alias("t"), head.alias("head"))
    rows = rows.withColumn("said", F.filter(F.split("t", "[^A-Za-z0-9_]+"), lambda w: w.isin(*single)))  # split once, for all keywords of one word
    return rows.select("doc", F.explode(F.array(*scores)).alias("s")).select("doc", "s.type", "s.score")


def doc_type(scores: DataFrame, order: Sequence[str], sheet: Column | None = None) -> DataFrame:
    """(doc, type, score): the best type, the first in ``order`` of equals; sheets under 14
    points are planilha, all under 5 are documento."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("type"))
    best = scores.groupBy("doc").agg(F.max(F.struct("score", (-rank).alias("r"), "type")).alias("b")).select("doc", F.col("b.type").alias("type"), F.col("b.score").alias("score"))
    fallback = F.when(F.col("score") < 5, "documento").otherwise(F.col("type"))
    return best.withColumn("type", F.when(sheet & (F.col("score") < 14), "planilha").otherwise(fallback) if sheet is not None else fallback)


#: Slots of a request: the first group of the first pattern that matches.
SLOTS: dict[str, tuple[str, ...]] = {
    "place": (r"\b(?:no|na|em)\s+((?:galpao|setor|area|patio|sala|predio|bloco|linha)\s+\w+)",),
    "person": (r"\b(?:para|colaborador|funcionario)\s+([A-ZÀ-Ý][a-zà-ÿ]+(?:\s[A-ZÀ-Ý][a-zà-ÿ]+)+)",),
    "count": (r"\b(\d+)\s+(?:pessoas|colaboradores|participantes|trabalhadores)\b",),
    "duration": (r"\b(\d+)\s*(?:h|horas?|minutos?|dias?)\b",),
    "topic": (r"\bsobre\s+(.{3,60}?)(?:[.,;]|$)",),
}


def slot(text: Column, name: str) -> Column:
    """A slot of a request; null if it is not there."""
    source = text if name == "person" else norm(text)
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(source, p, 1)), F.lit("")) for p in SLOTS[name]])


FORMATS = (Rule("pdf", r"\bpdf\b"), Rule("docx", r"\b(word|docx?)\b"), Rule("xlsx", r"\b(excel|xlsx?|planilha)\b"), Rule("html", r"\bhtml\b"), Rule("md", r"\b(markdown|md)\b"))


def wanted_format(text: Column) -> Column:
    return first_match(text, FORMATS, "pdf")


def mined(docs: DataFrame, doc: str, sentence: str, pattern: str, most: int, shortest: int = 20, longest: int = 240) -> DataFrame:
    """(doc, position, sentence) of the first ``most`` distinct sentences of a document that match."""
    from pyspark.sql import Window

    s = F.col(sentence)
    hit = docs.where(F.length(s).between(shortest, longest) & norm(s).rlike(pattern)).groupBy(doc, s.alias("sentence")).agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("position"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= most)


def recommendations(alerts: Column) -> Column:
    """Advice for each alert of an array of alert names."""
    table = F.create_map(*[F.lit(x) for pair in {"vencido": "Renovar o que está vencido antes de continuar.", "a_vencer": "Programar a renovação do que vence em 30 dias.", "sem_assinatura": "Colher a assinatura que falta.", "norma_revogada": "Trocar a norma revogada pela vigente.", "inapto": "Afastar da função e encaminhar ao médico."}.items() for x in pair])
    return F.filter(F.transform(alerts, lambda a: F.try_element_at(table, a)), lambda x: x.isNotNull())


def preferred(counts: DataFrame, key: str, n: str, least: int = 2) -> DataFrame:
    """The most frequent choice, if it was made ``least`` times."""
    return counts.where(F.col(n) >= least).orderBy(F.desc(n), F.asc(key)).limit(1)
