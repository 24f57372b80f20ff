from .codes import is_rural, is_shared_e_and_m, provider_tier, ruca_bucket, ruca_int
from .numeric import (
    guarded_money,
    guarded_ratio,
    money_total,
    to_money,
    to_ratio,
    weighted_mean,
    weighted_sum,
    whole_number,
)
from .text import blank_to_null, clean_identifier, display_name, hcpcs_family, service_key

__all__ = [
    "blank_to_null",
    "clean_identifier",
    "display_name",
    "guarded_money",
    "guarded_ratio",
    "hcpcs_family",
    "is_rural",
    "is_shared_e_and_m",
    "money_total",
    "provider_tier",
    "ruca_bucket",
    "ruca_int",
    "service_key",
    "to_money",
    "to_ratio",
    "weighted_mean",
    "weighted_sum",
    "whole_number",
]
