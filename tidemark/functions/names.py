"""Parts of a dataset path ``/primary/processed-campaign-version/tier``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern that defines a dataset's input campaign.
INPUT_CAMPAIGN = r"^/[^/]*/((?:HI|PA|PN|XeXe|)Run201\d\w-[^-]+|CMSSW_\d+|[^-]+)[^/]*/"


def path_part(path: Column, index: int) -> Column:
    """``index``-th piece of a ``/``-separated path (0 is before the leading slash), or NULL."""
    return F.get(F.split(path, "/"), F.lit(index))


def tier(dataset: Column) -> Column:
    return path_part(dataset, 3)


def input_campaign(dataset: Column) -> Column:
    """Run era, release or campaign prefix of the processed name; empty when none matches."""
    return F.regexp_extract(dataset, INPUT_CAMPAIGN, 1)


def tape_campaign(dataset: Column) -> Column:
    """First and last-but-one ``-`` piece of the processed name, without a trailing ``_ext1``.

    NULL for a processed name that has no ``-``.
    """
    pieces = F.split(path_part(dataset, 2), "-")
    campaign = F.concat(
        F.get(pieces, F.lit(0)), F.lit("-"), F.get(pieces, F.size(pieces) - F.lit(2))
    )
    return F.regexp_replace(campaign, "_ext1$", "")


def unused_campaign(dataset: Column) -> Column:
    """Processed name without its version and without up to three trailing ``_v...`` tokens."""
    unversioned = F.regexp_replace(path_part(dataset, 2), "-[^-]*$", "")
    return F.regexp_replace(unversioned, "(_v[^_]*){1,3}$", "")


def tier_categories(tier_col: Column | str = "tier") -> dict[str, Column]:
    """Report category -> membership predicate. Categories overlap; a NULL tier is only in All."""
    lowered = F.lower(F.col(tier_col) if isinstance(tier_col, str) else tier_col)
    some_aod = lowered.contains("aod")
    return {
        "All": F.lit(True),
        "sAODs": some_aod,
        "sMINIAODs": lowered.contains("miniaod"),
        "AODs": lowered.startswith("aod"),
        "notsAODs": ~some_aod,
    }


def tally_day_of_path(file_path: Column, marker: str = "/rucio/") -> Column:
    """DATE named by the directory right after the last ``marker`` in a file path."""
    directory = F.substring_index(F.substring_index(file_path, marker, -1), "/", 1)
    return F.try_to_date(directory, "yyyy-MM-dd")
