"""Chains and defaults."""

from __future__ import annotations

# Chains, how their contracts are found, and when they began.
CHAINS = [
    ("ethereum", "direct", "2015-07-30", "active"),
    ("polygon", "direct", "2020-05-30", "active"),
    ("arbitrum", "join", "2021-08-31", "active"),
    ("optimism", "join", "2021-12-16", "active"),
    ("avalanche", "join", "2020-09-23", "active"),
]
CUTOFF = "2025-06-01"
PERIOD_DAYS = 30
ZERO_ADDRESS = "0x" + "0" * 40

# Factories that are known beforehand.
KNOWN_FACTORIES = [
    ("ethereum", "0x5c69bee701ef814a2b6a3edd4b1652cb9cc5aa6f", "Uniswap V2 Factory", "Uniswap", "factory_create2"),
    ("ethereum", "0x1f98431c8ad98523631ae4a59f267346ea31f984", "Uniswap V3 Factory", "Uniswap", "factory_create2"),
    ("ethereum", "0xc0aee478e3658e2610c5f7a4a2e1777ce9e4f2ac", "SushiSwap Factory", "SushiSwap", "factory_create2"),
    ("ethereum", "0xba12222222228d8ba445958a75a0704d566bf2c8", "Balancer V2 Vault", "Balancer", "factory_create"),
    ("ethereum", "0x0959158b6040d32d04c301a72cbfd6b39e21c9ae", "Curve Factory", "Curve", "factory_create2"),
    ("polygon", "0x5757371414417b8c6caad45baef941abc7d3ab32", "QuickSwap Factory", "QuickSwap", "factory_create2"),
    ("polygon", "0xc35dadb65012ec5796536bd9864ed8773abc74c4", "SushiSwap Factory (Polygon)", "SushiSwap", "factory_create2"),
]
