"""Coded fields: rurality, credentials, procedure groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..schemas import (
    NURSE_PRACTITIONER,
    OTHER_TIER,
    PHYSICIAN,
    PHYSICIAN_ASSISTANT,
    RUCA_BUCKETS,
    SHARED_E_AND_M,
    SPECIALIST,
)
from .numeric import whole_number

# Credential tokens per tier, in order of precedence. The published pipeline
# does not include its own list; correct the table here if one becomes known.
TIER_TOKENS = {
    PHYSICIAN: "MD DO MBBS",
    NURSE_PRACTITIONER: "NP ARNP APRN FNP CRNP CNP DNP FNPBC FNPC NPC",
    PHYSICIAN_ASSISTANT: "PA PAC RPAC",
    SPECIALIST: "OD DPM DDS DMD DC PHD PSYD AUD PT DPT OT OTR CRNA CNM LCSW PHARMD SLP",
}


def ruca_int(text: Column) -> Column:
    """Primary rural-urban code: ``4.1`` is 4."""
    return whole_number(text, "int")


def is_rural(ruca: Column) -> Column:
    """Codes 4 to 10; 99 (not coded) is false and NULL stays NULL."""
    return ruca.between(4, 10)


def ruca_bucket(ruca: Column) -> Column:
    """Urban 1-3, large rural 4-6, small rural 7-10, otherwise Unknown."""
    urban, large, small, unknown = map(F.lit, RUCA_BUCKETS)
    return (
        F.when(ruca.between(1, 3), urban)
        .when(ruca.between(4, 6), large)
        .when(ruca.between(7, 10), small)
        .otherwise(unknown)
    )


def credential_words(credentials: Column) -> Column:
    """``M. D., Ph.D`` -> `` MD PHD ``: dots vanish, runs of single letters join.

    Every word has a space on both sides, so a word is found by a plain pattern.
    """
    undotted = F.translate(F.upper(credentials), ".", "")
    spaced = F.regexp_replace(F.concat(F.lit(" "), undotted, F.lit(" ")), "[^A-Z]+", " ")
    return F.regexp_replace(spaced, r"\b([A-Z]) (?=[A-Z]\b)", "$1")


def tier_of_words(words: Column) -> Column:
    """The first tier, in order of precedence, that any word names."""
    matches = [
        F.when(words.rlike(f" ({'|'.join(tokens.split())}) "), F.lit(tier))
        for tier, tokens in TIER_TOKENS.items()
    ]
    return F.coalesce(*matches, F.lit(OTHER_TIER))


def provider_tier(credentials: Column) -> Column:
    """One of five tiers, never NULL."""
    return tier_of_words(credential_words(credentials))


def is_shared_e_and_m(code: Column, codes: Sequence[str] = SHARED_E_AND_M) -> Column:
    return code.isin(*codes)
