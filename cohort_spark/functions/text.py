"""Display and text rules (C9, C15, C16): one column expression each, so a
whole table gets its texts in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profile as P
from ..profile import DEFAULT, Profile
from .numeric import blank, truthy
from .rules import c, has

# ---------------------------------------------------------------------------
# Sentences of the recommendation and diagnosis texts, in the
# order they are emitted. ``{nome}`` / ``{p}`` mark the inserted values.
# ---------------------------------------------------------------------------
RISK_SENTENCES = {
    "Muito Alto": "{nome} apresenta risco MUITO ALTO de reprovação. Recomenda-se intervenção imediata, acompanhamento semanal e contato com responsáveis.",
    "Alto": "{nome} demonstra risco ALTO. É importante reforço contínuo e monitoramento quinzenal.",
    "Médio": "{nome} possui risco MÉDIO. Um reforço leve e estímulo ao estudo podem ajudar.",
    "other": "{nome} apresenta risco regular, com bom potencial de evolução.",
}
INDE_SENTENCES = (
    "O INDE é muito baixo, indicando forte defasagem geral de aprendizagem.",  # inde < 4
    "O INDE está abaixo do ideal, sugerindo foco em leitura e matemática.",    # inde < 6
    "O INDE é elevado, sugerindo boa compreensão geral.",                      # inde > 7.5
)
MEAN_SENTENCES = (
    "A média geral é crítica. Reforço intensivo recomendado.",                 # media < 5
    "A média está abaixo da linha de suficiência. Atenção às dificuldades.",   # media < 6
    "A média é excelente, demonstrando bom desempenho.",                       # media > 7.5
)
STONE_SENTENCES = (
    "{nome} possui nível MUITO BAIXO em {p}, indicando forte defasagem.",      # <= 2
    "{p} apresenta nível intermediário, sugerindo necessidade de reforço.",   # == 3
    "{p} indica bom domínio do conteúdo.",                                     # >= 4
)
PSYCHOLOGY_SENTENCE = "Há registro de recuperação com psicologia. Acompanhar aspectos socioemocionais."
INDICATED_SENTENCE = "Aluno foi indicado pela equipe. Recomenda-se atenção especial."
DIAGNOSIS_TEMPLATE = (
    "Diagnóstico para {nome}: O aluno apresenta nível atual '{pedra}' com risco classificado como {risco}. ",
    "Seu engajamento (IEG) está em {ieg} e o desempenho acadêmico (IDA) em {ida}. ",
    "Análise de Evolução: {progresso}",
)
FOLLOW_UP_MESSAGES = ("Sinal para acompanhamento", "Sem sinal crítico de acompanhamento")
PARENT_MEETING_MESSAGES = ("Aluno crítico indicado", "Sem critério para reunião de pais")


def fixed(x: Column, places: int) -> Column:
    """Number as text with ``places`` decimals, rounded half-even on the exact
    binary value (same digits as Python's ``f"{x:.{places}f}"``)."""
    pattern = "0." + "0" * places if places > 0 else "0"
    return _fmt(x, pattern)


def _fmt(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x, F.lit(pattern))


def decimal_comma(x: Column, places: int = 1) -> Column:
    """Decimal-comma display, missing -> '-'."""
    pattern = "0." + "0" * places
    return F.coalesce(F.replace(_fmt(x, pattern), F.lit("."), F.lit(",")), F.lit(P.MISSING_DISPLAY))


def _sub(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots of a fixed sentence with column values."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(values[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*parts)


def pupil_name(df: DataFrame, prof: Profile = DEFAULT, default: str = "O aluno") -> Column:
    return F.coalesce(c(prof.name).cast("string"), F.lit("nan")) if has(df, prof.name) else F.lit(default)


def recommendation(df: DataFrame, label: Column, mean: Column, prof: Profile = DEFAULT,
                   progress: Column | None = None) -> Column:
    """Ordered sentences; parts that do not apply are null and skipped."""
    nome = pupil_name(df, prof)
    risk = (
        F.when(label == "Muito Alto", _sub(RISK_SENTENCES["Muito Alto"], nome=nome))
        .when(label == "Alto", _sub(RISK_SENTENCES["Alto"], nome=nome))
        .when(label == "Médio", _sub(RISK_SENTENCES["Médio"], nome=nome))
        .otherwise(_sub(RISK_SENTENCES["other"], nome=nome))
    )
    parts = [risk]
    if has(df, prof.inde):
        inde = c(prof.inde)
        parts.append(
            F.when(inde < 4, F.lit(INDE_SENTENCES[0]))
            .when(inde < 6, F.lit(INDE_SENTENCES[1]))
            .when(inde > 7.5, F.lit(INDE_SENTENCES[2]))
        )
    parts.append(
        F.when(mean < 5, F.lit(MEAN_SENTENCES[0]))
        .when(mean < 6, F.lit(MEAN_SENTENCES[1]))
        .when(mean > 7.5, F.lit(MEAN_SENTENCES[2]))
    )
    for s in prof.stones:
        if not has(df, s):
            continue
        v = c(s)
        parts.append(
            F.when(v <= 2, _sub(STONE_SENTENCES[0], nome=nome, p=F.lit(s)))
            .when(v == 3, _sub(STONE_SENTENCES[1], p=F.lit(s)))
            .when(v >= 4, _sub(STONE_SENTENCES[2], p=F.lit(s)))
        )
    if has(df, prof.psychology):
        parts.append(F.when(~blank(c(prof.psychology)), F.lit(PSYCHOLOGY_SENTENCE)))
    if has(df, prof.indicated):
        parts.append(F.when(truthy(c(prof.indicated)), F.lit(INDICATED_SENTENCE)))
    if progress is not None:
        parts.append(F.when(F.length(progress) > 0, progress))
    return F.concat_ws(" ", *parts)


def diagnosis(df: DataFrame, label: Column, prof: Profile = DEFAULT, progress: Column | None = None) -> Column:
    """Diagnosis text (IEG / IDA with two decimals, missing -> 'nan')."""
    nome = F.trim(c(prof.name).cast("string")) if has(df, prof.name) else F.lit("Aluno")
    present = [c(s).cast("string") for s in reversed(prof.stones) if has(df, s)]
    pedra = F.coalesce(*present, F.lit("-")) if present else F.lit("-")
    ieg = F.coalesce(_fmt(c(prof.ieg), "0.00"), F.lit("nan")) if has(df, prof.ieg) else F.lit("0.00")
    ida = F.coalesce(_fmt(c(prof.ida), "0.00"), F.lit("nan")) if has(df, prof.ida) else F.lit("0.00")
    prog = progress if progress is not None else F.lit("")
    return F.concat(
        _sub(DIAGNOSIS_TEMPLATE[0], nome=nome, pedra=pedra, risco=F.coalesce(label, F.lit("Regular"))),
        _sub(DIAGNOSIS_TEMPLATE[1], ieg=ieg, ida=ida),
        _sub(DIAGNOSIS_TEMPLATE[2], progresso=F.coalesce(prog, F.lit(""))),
    )


def display_or_dash(x: Column) -> Column:
    """Trimmed text, blank or missing -> '-'."""
    s = F.trim(x.cast("string"))
    return F.when(s.isNull() | (s == ""), F.lit(P.MISSING_DISPLAY)).otherwise(s)
