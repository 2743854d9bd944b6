"""Query names by profile; `all` is every registered query of the library."""

from __future__ import annotations

from .catalog import QUERIES

CORE = (
    "scan_events", "scan_transactions", "scan_transactions_by_function", "tx_call_attribution", "wallet_history", "balance_as_of", "registry_search", "hot_cold_read", "token_resolve", "identify_entity",
    "decode_tx", "operation_match", "normalize_address", "coin_symbol", "time_to_checkpoint", "activity_since", "portfolio", "numeric_path", "numeric_fields",
    "object_read", "object_read_version", "object_display", "owned_objects", "non_coin_objects", "child_rows", "transaction_read", "history_page", "coin_info", "token_catalogue", "chain_epochs", "checkpoint_read",
    "latest_checkpoint", "resolve_forward", "resolve_reverse", "bound_kinds", "amount_text", "duration_text", "scaled_prices", "type_parts", "name_checks", "owner_text", "decode_flows", "scan_transactions_by_object", "tx_sponsored", "token_lookup", "token_metadata", "deep_numeric_fields",
)
FORENSICS = (
    "aggregate_events_by_sender", "aggregate_events_by_type", "aggregate_events_asc", "aggregate_events_by_count", "aggregate_events_distribution", "aggregate_events_totals", "aggregate_events_discovery",
    "fanout_all", "funding_edges", "funding_walk", "shared_funders", "trace_edges", "trace_walk", "next_tx", "timeline", "earliest_n", "latest_n", "dominant_inflow", "label_lookup", "label_precedence",
    "ownership_transitions", "case_list", "case_order", "fanout_cache_valid", "stream_new_events", "stream_aggregate_events", "stream_hourly_events", "stream_owner_changes", "shared_funder_fanout", "fanout_cached", "label_override", "trace_story", "case_reports",
    "capped_timeline", "trace_summary", "hub_suggestions", "severity_order", "label_import", "store_state",
)
DEVELOPER = ("ptb_anomalies", "package_rules", "capability_risk", "package_diff", "line_multiset_delta", "lcs_diff", "unknown_packages", "dependency_bfs", "coin_selection", "package_api", "budget_cut", "package_diff_summary", "module_churn", "package_line_diff", "type_text", "datatype_fields", "operation_registry", "package_info", "struct_tags")
MARKET = (
    "asof_price", "oracle_deviation", "deviation_summary", "deviation_mean", "pipeline_status", "book_summary", "trade_participation", "price_merge", "market_cap", "usd_value", "format_usd", "top_holders", "nft_owner_resolution", "nft_holders",
    "nft_filter", "nft_page", "nft_cursor_page", "collection_counts", "stake_totals", "validator_rank", "validator_rank_by_stake", "collection_resolve", "feed_match", "kiosk_discovery", "stream_candles", "pool_views", "position_entries",
)
PROFILES = {"core": CORE, "forensics": FORENSICS, "developer": DEVELOPER, "market": MARKET}


def query_names(*profiles: str) -> list[str]:
    """Names of the chosen profiles in order, each once; an unknown profile is an error."""
    if "all" in profiles or not profiles:
        return list(QUERIES)
    unknown = set(profiles) - set(PROFILES)
    if unknown:
        raise ValueError(f"unknown profiles: {', '.join(sorted(unknown))}")
    return list(dict.fromkeys(n for p in profiles for n in PROFILES[p]))
