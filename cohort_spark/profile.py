"""Column names, name tables, thresholds and label sets of the pupil schema.

Every operator takes a :class:`Profile` so that column names and cut-offs are
parameters: the same code runs on a yearly pupil snapshot and on any table
bound to that schema (see :mod:`cohort_spark.sources.tables`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced (column names,
# rename table, feature sets, label names, cut-offs and word lists), stated
# plainly in their natural order.
# ---------------------------------------------------------------------------

RENAME_MAP: dict[str, str] = {
    "Nome Anonimizado": "Nome",
    "Escola": "Instituição de ensino",
    "Mat": "Matem",
    "Por": "Portug",
    "Ing": "Inglês",
    "Data de Nasc": "Ano nasc",
    "Idade": "Idade 22",
    "Fase Ideal": "Fase ideal",
}

ALLOWED_FEATURES: frozenset[str] = frozenset({
    "Fase", "Turma", "Gênero", "Ano ingresso", "Instituição de ensino",
    "Idade 22",
    "Pedra 20", "Pedra 21", "Pedra 22", "INDE 22",
    "IAA", "IEG", "IPS", "IDA", "IPV", "IAN",
    "Cg", "Cf", "Ct", "Nº Av",
    "Matem", "Portug", "Inglês",
    "Atingiu PV", "Indicado", "Fase ideal", "Destaque IEG", "Destaque IDA", "Destaque IPV",
    "Rec Psicologia", "Rec Av1", "Rec Av2", "Rec Av3", "Rec Av4",
    "Avaliador1", "Avaliador2", "Avaliador3", "Avaliador4",
})

FORBIDDEN_FEATURES: frozenset[str] = frozenset({
    "RA", "Nome", "Defasagem", "Defasagem_next_year",
})

CATEGORICAL_FEATURES: frozenset[str] = frozenset({
    "Fase", "Turma", "Gênero", "Instituição de ensino", "Atingiu PV", "Indicado",
    "Fase ideal", "Destaque IEG", "Destaque IDA", "Destaque IPV",
    "Avaliador1", "Avaliador2", "Avaliador3", "Avaliador4",
})

NUMERIC_COLUMNS: tuple[str, ...] = (
    "Idade 22", "Ano ingresso", "Pedra 20", "Pedra 21", "Pedra 22", "INDE 22",
    "IAA", "IEG", "IPS", "IDA", "IPV", "IAN", "Cg", "Cf", "Ct", "Nº Av",
    "Matem", "Portug", "Inglês",
)

# Free-text recovery notes: allowed as features by name but kept out of the
# model (they are text, not numbers).
RECOVERY_TEXT_COLUMNS: tuple[str, ...] = ("Rec Psicologia", "Rec Av1", "Rec Av2", "Rec Av3", "Rec Av4")

DRIFT_FEATURES: tuple[str, ...] = (
    "INDE 22", "IEG", "IPS", "IDA", "IPV", "IAN",
    "Pedra 20", "Pedra 21", "Pedra 22", "Matem", "Portug", "Inglês",
)

RISK_LABELS: tuple[str, ...] = ("Muito Alto", "Alto", "Médio", "Regular")
HIGH_RISK_LABELS: tuple[str, ...] = ("Alto", "Muito Alto")
NEXT_PHASE_LABELS: tuple[str, ...] = ("Regular", "Médio")
FUTURE_LABELS: tuple[str, ...] = ("Alta Defasagem", "Risco Moderado", "Baixo Risco")
PSI_STATUSES: tuple[str, ...] = ("OK", "ATENCAO", "DRIFT", "SEM_DADOS")

# Target text parsing (binary target) and truthy flags: two different sets.
TARGET_POSITIVES: tuple[str, ...] = ("1", "true", "sim", "s", "yes", "y", "x")
TARGET_NEGATIVES: tuple[str, ...] = ("0", "false", "nao", "não", "n", "no", "")
TRUTHY_VALUES: tuple[str, ...] = ("1", "true", "sim", "yes", "y", "x", "ok")

# Rule scorer: INDE cut-offs for the 4-level label, default INDE for missing.
RULE_DEFAULT_INDE = 6.0
RULE_CUTS = (4.0, 5.5, 6.5)  # < 4 Muito Alto, < 5.5 Alto, < 6.5 Médio, else Regular
# Probability scorer: >= .85 Muito Alto, >= .70 Alto, >= .50 Médio, else Regular.
PROBA_CUTS = (0.85, 0.70, 0.50)
# Future label: >= .70 Alta Defasagem, >= .40 Risco Moderado, else Baixo Risco.
FUTURE_CUTS = (0.70, 0.40)
# Same-year target: INDE < 4 or IPS < 0.4 or Pedra 22 <= 1.
TARGET_INDE_LT = 4.0
TARGET_IPS_LT = 0.4
TARGET_PEDRA_LE = 1.0
# Cohort rules.
PASS_MARK = 6.0            # subject below pass, subject status "Abaixo"
LOW_ENGAGEMENT = 0.4       # IEG / IPS follow-up cut
STONE_RISK_LE = 2.0        # trend risk count: Pedra <= 2
MEAN_CLASS_CUTS = (6.0, 7.0)  # < 6 bad, < 7 ok, else good; null ok
PSI_CUTS = (0.10, 0.25)    # < .10 OK, < .25 ATENCAO, else DRIFT
PSI_BINS = 10
PSI_EPS = 1e-6
TOP_HIGH_RISK = 15
SEARCH_LIMIT = 20
SEARCH_SCORED_LIMIT = 10
NO_PROGRESS_MIN_STEPS = 2
INACTIVE_MARK = "inativ"
NO_HISTORY_MESSAGE = "Histórico insuficiente."
NEXT_YEAR_FALLBACK = "próximo ano"
MISSING_DISPLAY = "-"
PROBA_THRESHOLD = 0.5      # classification metrics cut

# Model hyper-parameters of the boosted-tree scorer.
BOOST_PARAMS = dict(rate=0.06, depth=4, rounds=300, least_rows=20, l2=0.1)
MODEL_NAME = "histogram_boosting_classifier"
MODEL_VERSION = "1.0.0"


@dataclass(frozen=True)
class Profile:
    """Column names of one pupil schema."""

    key: str = "RA"
    year: str = "ano"
    name: str = "Nome"
    klass: str = "Turma"
    school: str = "Instituição de ensino"
    inde: str = "INDE 22"
    subjects: tuple[str, ...] = ("Matem", "Portug", "Inglês")
    stones: tuple[str, ...] = ("Pedra 20", "Pedra 21", "Pedra 22")
    ieg: str = "IEG"
    ips: str = "IPS"
    ida: str = "IDA"
    iaa: str = "IAA"
    ipv: str = "IPV"
    ian: str = "IAN"
    indicated: str = "Indicado"
    psychology: str = "Rec Psicologia"
    recovery: tuple[str, ...] = ("Rec Av1", "Rec Av2", "Rec Av3", "Rec Av4")
    status: str = "Ativo/ Inativo"
    target: str = "Defasagem_next_year"
    score: str = "_risk_score"
    label: str = "_risk_label"
    mean: str = "_media"
    numeric: tuple[str, ...] = NUMERIC_COLUMNS
    drift_features: tuple[str, ...] = DRIFT_FEATURES
    extra: dict = field(default_factory=dict, compare=False, hash=False)


DEFAULT = Profile()
