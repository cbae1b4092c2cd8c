"""The whole spending report of all users: a dictionary of tables from one cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from spendgrid.operators import analytics as N
from spendgrid.operators.prepare import prepare_transactions
from spendgrid.session import cut_lineage

ANALYSES = ("vendor_intelligence", "anomaly_detection", "subscription_analysis", "savings_opportunities",
            "cash_flow_prediction")


def report(transactions: DataFrame, excluded: Sequence[str] = (), analyses: Sequence[str] = ANALYSES,
           prepared: bool = False) -> dict[str, DataFrame]:
    """Tables by name, each keyed by ``user_id``; ``analyses`` selects the parts that are built.

    The transactions are read once for the cube, which is written, and once more if outliers are wanted.
    """
    unknown = set(analyses) - set(ANALYSES)
    if unknown:
        raise ValueError(f"unknown analyses: {sorted(unknown)}")
    rows = transactions if prepared else prepare_transactions(transactions)
    cube = cut_lineage(N.spending_cube(rows))
    kinds = cut_lineage(N.category_kinds(cube))
    flagged = N.with_flow_flags(cube, kinds)
    tables = {"analysis_period": N.analysis_period(cube), "categories_found": N.category_lists(kinds)}
    if "vendor_intelligence" in analyses:
        top = N.top_vendors(N.vendor_profile(flagged, excluded))
        tables["vendors"] = N.rounded(top, ["total_spent", "avg_transaction"])
        tables["vendor_insights"] = N.vendor_insights(top)
    if "anomaly_detection" in analyses:
        tables["anomalies"] = N.anomalies(rows, flagged, excluded)
        tables["anomaly_insights"] = N.anomaly_insights(N.outliers(rows, flagged, excluded), N.recurring_vendors(flagged, excluded))
    if "subscription_analysis" in analyses:
        detail = cut_lineage(N.subscription_detail(cube, N.recurring_vendors(flagged, excluded), excluded))
        totals = N.subscription_summary(detail)
        tables["subscriptions"] = N.rounded_subscriptions(detail)
        tables["subscription_summary"] = totals
        tables["subscription_insights"] = N.subscription_insights(detail, totals)
    if "savings_opportunities" in analyses:
        tables["opportunities"] = N.savings_opportunities(flagged, excluded)
        tables["savings_insights"] = N.savings_insights(N.category_savings(flagged, excluded))
    if "cash_flow_prediction" in analyses:
        flow = N.cash_flow(flagged, excluded)
        tables["cash_flow"] = flow
        tables["cash_flow_insights"] = N.cash_flow_insights(flow)
    return tables
