"""Operation patterns as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values: (module, prefix of the function, action, skip) in the order in which they are tried.
OPERATIONS = [
    # exchanges: swaps
    ("pool", "swap", "swap", False),
    ("pool", "flash_swap", "swap", False),
    ("router", "swap", "swap", False),
    ("cetus", "swap", "swap", False),
    ("router", "new_swap_context", "swap", False),
    ("router", "confirm_swap", "swap", True),
    # exchanges: liquidity and positions
    ("pool", "add_liquidity", "add_liquidity", False),
    ("pool", "repay_add_liquidity", "add_liquidity", False),
    ("pool", "remove_liquidity", "remove_liquidity", False),
    ("pool", "open_position", "open_position", False),
    ("pool", "close_position", "close_position", False),
    # lending
    ("lending", "deposit", "deposit", False),
    ("lending", "withdraw", "withdraw", False),
    ("lending", "borrow", "borrow", False),
    ("lending", "repay", "repay", False),
    ("lending", "flash_loan", "flash_loan", False),
    ("lending", "flash_repay", "flash_repay", False),
    ("lending_market", "deposit_liquidity", "deposit", False),
    ("lending_market", "redeem_ctokens", "withdraw", False),
    ("lending_market", "borrow", "borrow", False),
    ("lending_market", "repay", "repay", False),
    ("lending_market", "liquidate", "liquidate", False),
    ("lending_market", "claim_rewards", "claim_rewards", False),
    ("lending_market", "create_obligation", "create_obligation", False),
    ("lending_market", "deposit_ctokens", "deposit", False),
    ("lending_market", "withdraw_ctokens", "withdraw", False),
    ("lending_market", "refresh_reserve", "refresh", True),
    ("lending_market", "compound_interest", "compound", True),
    # liquid staking, routers and positions
    ("liquid_staking", "mint", "stake", False),
    ("liquid_staking", "redeem", "unstake", False),
    ("swap_router", "swap", "swap", False),
    ("position_manager", "mint", "open_position", False),
    ("position_manager", "increase_liquidity", "add_liquidity", False),
    ("position_manager", "decrease_liquidity", "remove_liquidity", False),
    ("position_manager", "collect", "claim_rewards", False),
    ("position_manager", "burn", "close_position", False),
    ("pool_fetcher", "compute_swap_result", "quote", True),
    ("swap", "swap", "swap", False),
    ("deposit", "deposit", "add_liquidity", False),
    ("withdraw", "", "remove_liquidity", False),
    ("hasui", "request_stake", "stake", False),
    ("hasui", "request_unstake", "unstake", False),
    ("settlement", "", "settle", False),
    ("margin", "", "manage_margin", False),
    # names
    ("payment", "register", "register", False),
    ("payment", "renew", "renew", False),
    ("payment", "init_registration", "register", True),
    ("payment", "init_renewal", "renew", True),
    ("controller", "set_target_address", "set_address", True),
    ("controller", "set_reverse_lookup", "set_reverse_lookup", True),
    ("controller", "set_user_data", "set_user_data", True),
    ("register", "register", "register", False),
    ("direct_setup", "set_target_address", "set_address", True),
    ("direct_setup", "set_reverse_lookup", "set_reverse_lookup", True),
    ("payments", "calculate_price", "calculate_price", True),
    ("payments", "handle_payment", "handle_payment", True),
    # storage
    ("staking", "stake_with_pool", "stake", False),
    ("staking", "request_withdraw_stake", "unstake", False),
    ("blob", "register", "register_blob", False),
    ("blob", "certify", "certify_blob", False),
    # order books and options
    ("spot_dex", "swap", "swap", False),
    ("spot_dex", "add_liquidity", "add_liquidity", False),
    ("spot_dex", "remove_liquidity", "remove_liquidity", False),
    ("pool", "place_limit_order", "place_order", False),
    ("pool", "place_market_order", "swap", False),
    ("pool", "cancel_order", "cancel_order", False),
    ("balance_manager", "deposit", "deposit", False),
    ("balance_manager", "withdraw", "withdraw", False),
    ("tails_staking", "stake", "stake", False),
    ("tails_staking", "unstake", "unstake", False),
    # staking and transfers
    ("staking_pool", "request_add_stake", "stake", False),
    ("staking_pool", "request_withdraw_stake", "unstake", False),
    ("coin", "transfer", "transfer", False),
    ("pay", "", "transfer", False),
    ("coin", "from_balance", "convert", True),
    ("coin", "into_balance", "convert", True),
]

SCHEMA = "priority int, module string, prefix string, action string, skip boolean"


def operation_patterns(spark: SparkSession) -> DataFrame:
    """priority, module, prefix, action, skip; the least priority wins."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(OPERATIONS, 1)], SCHEMA)
