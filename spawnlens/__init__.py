"""Spark-native analytics of smart contracts that deploy other contracts."""
