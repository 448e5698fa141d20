"""Report labels and bucket rules.

The label texts are fixed values: they are part of the published
results (dashboard categories), so they are kept verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (published report labels), in the order the reports list them.
# ---------------------------------------------------------------------------
UNCATEGORISED = "Non catégorisé"

INSTALLMENT_TRANCHES = (
    "1 - Comptant",
    "2-3 mensualités",
    "4-6 mensualités",
    "7-12 mensualités",
    "12+ mensualités",
)

PUNCTUALITY_BUCKETS = (
    "🟢 Très en avance (>7j avant)",
    "🟡 En avance (1-7j avant)",
    "✅ À temps (jour J)",
    "🟠 Retard léger (1-7j)",
    "🔴 Retard important (>7j)",
)

STATUS_DESCRIPTIONS = (
    ("delivered", "✅ Livré au client"),
    ("shipped", "🚚 En transit"),
    ("canceled", "❌ Annulé"),
    ("invoiced", "🧾 Facturé"),
    ("processing", "⚙️ En traitement"),
    ("approved", "✔️ Paiement approuvé"),
    ("created", "🆕 Créé"),
    ("unavailable", "⛔ Indisponible"),
)
STATUS_OTHER = "Autre"

SELLER_TOP_LABEL = "🏆 Top vendeur"
SELLER_BOTTOM_LABEL = "⚠️ À surveiller"

DELAY_SCORE_BUCKETS = (
    "Très en avance (>10j avant)",
    "En avance (3-10j avant)",
    "Légèrement en avance (1-3j)",
    "À temps (jour J)",
    "Léger retard (1-3j)",
    "Retard modéré (3-10j)",
    "Retard important (>10j)",
)

RFM_SEGMENTS = (
    "🏆 Champion",
    "💛 Client Fidèle",
    "🌱 Potentiel",
    "🆕 Nouveau Client",
    "⚠️ À Risque",
    "🔴 Presque Perdu",
    "💤 Client Inactif",
)

SCORE_BAR_MARK = "█"
# ---------------------------------------------------------------------------


def first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    """Searched CASE: the first true condition wins, else ``default``."""
    expr = None
    for cond, label in cases:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def installment_tranche(n: Column) -> Column:
    """Edges = 1, <= 3, <= 6, <= 12, else (0 falls in 2-3, NULL in the last)."""
    t = INSTALLMENT_TRANCHES
    return first_match([(n == 1, t[0]), (n <= 3, t[1]), (n <= 6, t[2]), (n <= 12, t[3])], t[4])


def punctuality_bucket(gap_micros: Column) -> Column:
    """Fractional-day gap buckets: < -7, < 0, = 0, <= 7, else."""
    b = PUNCTUALITY_BUCKETS
    week = 7 * 86_400_000_000
    return first_match([(gap_micros < -week, b[0]), (gap_micros < 0, b[1]),
                        (gap_micros == 0, b[2]), (gap_micros <= week, b[3])], b[4])


def status_description(status: Column) -> Column:
    return first_match([(status == s, d) for s, d in STATUS_DESCRIPTIONS], STATUS_OTHER)


def delay_score_bucket(days: Column) -> Column:
    """Whole-day gap buckets: < -10, < -3, < 0, = 0, <= 3, <= 10, else."""
    b = DELAY_SCORE_BUCKETS
    return first_match([(days < -10, b[0]), (days < -3, b[1]), (days < 0, b[2]),
                        (days == 0, b[3]), (days <= 3, b[4]), (days <= 10, b[5])], b[6])


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    s = RFM_SEGMENTS
    return first_match([
        ((r == 3) & (f == 3) & (m == 3), s[0]),
        ((f == 3) & (m == 3), s[1]),
        ((r == 3) & (f >= 2), s[2]),
        ((r == 3) & (f == 1), s[3]),
        ((r == 2) & (f >= 2), s[4]),
        ((r == 1) & (f >= 2), s[5]),
    ], s[6])


def category_label(english: Column, original: Column) -> Column:
    """English name, else the original name, else the uncategorised label."""
    return F.coalesce(english, original, F.lit(UNCATEGORISED))
