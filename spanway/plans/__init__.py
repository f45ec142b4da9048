"""Logical plans that operators share: closure rules and the binned pair join."""
