"""Categories of texts, sectors and recommendations by the first keyword that is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import first_match

#: Words of a gap or claim and the metric category that they speak for.
METRIC_WORDS = {
    "margins": ["ebitda margin", "gross margin", "operating margin", "margin"],
    "revenue_growth": ["revenue growth", "top-line", "top line"],
    "volume_growth": ["volume", "tonnage"],
    "roic": ["roic", "return on invested"],
    "roce": ["roce", "return on capital employed"],
    "cash_flow": ["ocf", "operating cash", "free cash flow", "fcf", "cash conversion"],
    "working_capital": ["working capital", "receivable", "payable", "inventory days"],
    "leverage": ["debt", "leverage", "gearing", "d/e", "net debt"],
    "capex": ["capex", "capital expenditure", "cwip"],
    "guidance": ["guidance", "guided", "guide ", "outlook", "forecast"],
    "demand_commentary": ["demand", "offtake", "volume commentary"],
    "pricing_power": ["pricing power", "price hike", "realisation"],
    "governance": ["governance", "board", "independent director"],
    "promoter_pledge": ["pledge", "encumbrance"],
    "rpt": ["related party", "rpt"],
    "auditor": ["auditor", "audit qualification", "emphasis of matter"],
    "mna": ["acquisition", "m&a", "merger"],
    "dividend_policy": ["dividend", "buyback", "payout"],
    "distribution_reach": ["distribution", "reach", "stores", "outlets"],
    "regional_revenue": ["region", "geography", "geographic"],
    "segments": ["segment", "division"],
    "product_mix": ["product mix", "premium mix"],
    "competitive_position": ["moat", "competitive", "market share"],
    "compliance": ["sebi", "regulatory", "compliance"],
    "litigation": ["litigation", "lawsuit", "case"],
}
#: Words of a sector's name and its vertical, in order.
VERTICALS = [
    ("fast moving consumer goods", "manufacturer"),
    ("fmcg", "manufacturer"),
    ("consumer goods", "manufacturer"),
    ("personal care", "manufacturer"),
    ("food products", "manufacturer"),
    ("household products", "manufacturer"),
    ("banks", "bank"),
    ("banking", "bank"),
    ("private sector bank", "bank"),
    ("public sector bank", "bank"),
    ("nbfc", "bank"),
    ("financial services", "bank"),
    ("insurance", "bank"),
    ("it - software", "it_services"),
    ("information technology", "it_services"),
    ("technology", "it_services"),
    ("consulting", "it_services"),
    ("pharmaceuticals", "pharma"),
    ("healthcare", "pharma"),
    ("drug", "pharma"),
    ("auto", "auto"),
    ("automobile", "auto"),
    ("cement", "manufacturer"),
    ("metals", "manufacturer"),
    ("chemicals", "manufacturer"),
    ("oil & gas", "manufacturer"),
    ("power", "utility"),
    ("telecom", "telecom"),
    ("real estate", "real_estate"),
]
#: METRIC_WORDS as rules in order.
METRIC_RULES = [(word, category) for category, words in METRIC_WORDS.items() for word in words]


def metric_category(text: Column | str) -> Column:
    """The metric that a text speaks of; uncategorized where none is named or the text is null."""
    return F.coalesce(first_match(text, METRIC_RULES), F.lit("uncategorized"))


def vertical(sector: Column | str) -> Column:
    """The vertical of a sector's name; other where none is known or the name is null."""
    return F.coalesce(first_match(sector, VERTICALS), F.lit("other"))


def action_bucket(recommendation: Column) -> Column:
    """add, sell or hold by the words of a recommendation; null where it is null or blank."""
    text = F.upper(F.trim(recommendation))
    bucket = F.when(text.rlike("ADD|BUY|CONSTRUCTIVE"), "add").when(text.rlike("SELL|SHORT|AVOID|EXIT"), "sell").otherwise("hold")
    return F.when(text != "", bucket)
