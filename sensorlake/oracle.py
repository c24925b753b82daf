"""DuckDB SQL twins of the fixtures, used by the oracle queries.

Plain SQL over the pre-registered views (events, lineitem, orders, ...).
"""

from __future__ import annotations

from sensorlake.fixtures import EVENT_CHANNELS, LINEITEM_CHANNELS


def _case(col: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN {col} = '{a}' THEN {b}" for a, b in pairs)
    return f"CASE {whens} ELSE {default} END"


def nn(col: str) -> str:
    """NaN -> NULL."""
    return f"CASE WHEN isnan({col}) THEN NULL ELSE {col} END"


ALIAS = _case("event_type", [(a, f"'{b}'") for a, b in EVENT_CHANNELS], "event_type")
ORDINAL = _case("event_type", [(a, str(i)) for i, (a, _b) in enumerate(EVENT_CHANNELS)], str(len(EVENT_CHANNELS)))

EVENTS_LONG = f"SELECT {ALIAS} AS channel, ts, event_id AS rid, {nn('value')} AS value FROM events"
EVENTS_LONG_ORD = (f"SELECT {ALIAS} AS channel, ts, event_id AS rid, {nn('value')} AS value, "
                   f"{ORDINAL} AS ordinal FROM events")
EVENTS_WIDE = ("SELECT ts, event_id AS rid, " + ", ".join(
    f"CASE WHEN event_type = '{a}' THEN {nn('value')} END AS {b}" for a, b in EVENT_CHANNELS) + " FROM events")
# unpivot with NULLs kept (UNPIVOT INCLUDE NULLS), written as a union to stay plain SQL
EVENTS_WIDE_LONG = " UNION ALL ".join(
    f"SELECT ts, rid, '{b}' AS channel, {b} AS value FROM ew" for _a, b in EVENT_CHANNELS)
LINEITEM_WIDE = ("SELECT l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                 + ", ".join(f"{nn(c)} AS {c}" for c in LINEITEM_CHANNELS) + " FROM lineitem")
LINEITEM_MASKED = ("SELECT ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                   "CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS l_quantity, "
                   "CASE WHEN l_suppkey % 4 <> 0 THEN l_extendedprice END AS l_extendedprice, "
                   "l_discount, l_tax FROM lw")
ORDERS_SERIES = (f"SELECT 'o_totalprice' AS channel, o_orderdate AS ts, o_orderkey AS rid, "
                 f"{nn('o_totalprice')} AS value FROM orders")

# Family classification, same patterns as sensorlake.functions.families (RE2 syntax).
from sensorlake.functions.families import FAMILIES  # noqa: E402


def family_case(col: str) -> str:
    parts = []
    for fid, _l, _u, pats in FAMILIES:
        if pats:
            rx = "|".join(pats)
            parts.append(f"WHEN regexp_matches(lower({col}), '{rx}') THEN '{fid}'")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


def family_attr_case(fam_col: str, idx: int) -> str:
    parts = " ".join(f"WHEN {fam_col} = '{f[0]}' THEN '{f[idx]}'" for f in FAMILIES)
    return f"CASE {parts} END"


def family_rank_case(fam_col: str) -> str:
    parts = " ".join(f"WHEN {fam_col} = '{f[0]}' THEN {i}" for i, f in enumerate(FAMILIES))
    return f"CASE {parts} END"


def channels_sql(src: str) -> str:
    """Channels dimension from a (channel, ordinal) relation."""
    return f"""SELECT channel, CAST(ordinal AS BIGINT) AS ordinal, family, {family_attr_case('family', 1)} AS label,
        {family_attr_case('family', 2)} AS unit, CAST({family_rank_case('family')} AS BIGINT) AS family_rank,
        CAST(row_number() OVER (PARTITION BY family ORDER BY ordinal) - 1 AS BIGINT) AS idx_in_family
      FROM (SELECT channel, ordinal, {family_case('channel')} AS family FROM ({src}))"""


EVENT_CHANNELS_DIM = channels_sql(
    "SELECT channel, CAST(min(ordinal) AS INTEGER) AS ordinal FROM (" + EVENTS_LONG_ORD + ") GROUP BY channel")


def with_ctes(body: str, **ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body

LOAD_RECORDS = ("SELECT user_id AS record_id, ts, event_id AS rid, " + nn("value") + " AS load FROM events")
