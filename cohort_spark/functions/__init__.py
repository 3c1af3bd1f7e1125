"""Column-expression rules (no Python UDF anywhere)."""

from .numeric import (binary_target, blank, categorical_clean, clean_numeric, coerce_numeric, is_finite,
                      nan_to_null, nz, to_double, truthy)
from .rules import (c, cohort_follow_up, confidence_percent, future_label, high_risk, indicated, latest_stone,
                    mean_class, minmax_scaled, parent_meeting, proba_label, proba_score, psi_status,
                    pupil_follow_up, recovery_filled, rule_inde, rule_label, rule_score, same_year_target,
                    subject_mean, subject_status)
from .text import decimal_comma, diagnosis, display_or_dash, fixed, recommendation

__all__ = [
    "binary_target", "blank", "categorical_clean", "clean_numeric", "coerce_numeric", "is_finite", "nan_to_null",
    "nz", "to_double", "truthy", "c", "cohort_follow_up", "confidence_percent", "future_label", "high_risk",
    "indicated", "latest_stone", "mean_class", "minmax_scaled", "parent_meeting", "proba_label", "proba_score",
    "psi_status", "pupil_follow_up", "recovery_filled", "rule_inde", "rule_label", "rule_score",
    "same_year_target", "subject_mean", "subject_status", "decimal_comma", "diagnosis", "display_or_dash",
    "fixed", "recommendation",
]
