"""Network / threat view (lifecycle E3): one scored frame feeds every panel.

    network --threat_score, tcp_flag_text--> scored (written once)
       scored --> A5 port access, A6 SYN pairs, A7 inbound/outbound (+ top 5),
                  A2 metrics, A14 hourly timeline, I5 incidents (with process)

Every panel reads the scored frame, so it is written to the shared folder
once; each panel is then one aggregate over that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import scalars as S
from vigil.operators import aggregates as A
from vigil.operators import detect as D
from vigil.session import cut_lineage


def score_network(network: DataFrame) -> DataFrame:
    """Rows with ``threat_score`` and ``flag_analysis``."""
    return network.withColumns({
        "threat_score": S.threat_score(network),
        "flag_analysis": S.tcp_flag_text(F.col("flags")),
    })


@dataclass
class NetworkView:
    scored: DataFrame
    metrics: DataFrame
    port_access: DataFrame
    syn_floods: DataFrame
    top_inbound: DataFrame
    top_outbound: DataFrame
    timeline: DataFrame
    incidents: DataFrame


def network_view(network: DataFrame, process: DataFrame | None = None) -> NetworkView:
    """All panels read one written table of scored rows."""
    scored = cut_lineage(score_network(network), "network-view")
    return NetworkView(
        scored=scored,
        metrics=A.network_metrics(scored),
        port_access=A.port_access_counts(scored),
        syn_floods=A.syn_flood_pairs(scored),
        top_inbound=A.top_inbound(scored),
        top_outbound=A.top_outbound(scored),
        timeline=A.hourly_timeline(scored),
        incidents=D.sort_incidents(D.detect_incidents(scored, process)),
    )
