import random

import pytest
from conftest import as_set

from tidemark.functions.metrics import READ_METRICS, SIZE_METRICS, WINDOWS, windowed
from tidemark.operators.histogram import (
    histogram_arrays,
    histogram_from_arrays,
    histogram_long,
    histogram_names,
    popularity_histogram,
)

POP = (
    "dataset_id int, tier string, "
    + ", ".join(f"{n} double" for n in windowed(SIZE_METRICS))
    + ", "
    + ", ".join(f"{n} bigint" for n in windowed(READ_METRICS))
)

MEMBERS = {
    "All": lambda t: True,
    "sAODs": lambda t: t is not None and "aod" in t.lower(),
    "sMINIAODs": lambda t: t is not None and "miniaod" in t.lower(),
    "AODs": lambda t: t is not None and t.lower().startswith("aod"),
    "notsAODs": lambda t: t is not None and "aod" not in t.lower(),
}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    return [
        (
            i,
            rng.choice(["AOD", "AODSIM", "MINIAODSIM", "NANOAOD", "RAW", None]),
            *[rng.choice([None, 0.5, 1.0, 8.25]) for _ in range(18)],
            *[rng.choice([0, 1, 3, 15, 20, -1]) for _ in range(12)],
        )
        for i in range(60)
    ]


@pytest.fixture(scope="module")
def histogram(rows, data):
    return popularity_histogram(rows(POP, *data))


def test_histogram_matches_brute_force(histogram, data):
    size_at = {n: 2 + i for i, n in enumerate(windowed(SIZE_METRICS))}
    bin_at = {n: 20 + i for i, n in enumerate(windowed(READ_METRICS))}
    expected = []
    for w in WINDOWS:
        for size in SIZE_METRICS:
            for read in READ_METRICS:
                for category, belongs in MEMBERS.items():
                    totals = [0.0] * 16
                    for row in data:
                        b = row[bin_at[f"{read}{w}"]]
                        if belongs(row[1]) and 0 <= b <= 15:
                            totals[b] += row[size_at[f"{size}{w}"]] or 0.0
                    expected.append((f"sums_{size}_{read}_{category}_{w}", *totals))
    assert len(expected) == 360
    assert as_set(histogram) == sorted(expected)


def test_names_are_complete_without_data(rows):
    empty = popularity_histogram(rows(POP))
    got = as_set(empty)
    assert [r[0] for r in got] == sorted(histogram_names())
    assert {v for r in got for v in r[1:]} == {0.0}


def test_long_and_arrays_carry_the_same_cells(histogram):
    wide = as_set(histogram)
    assert as_set(histogram_long(histogram)) == sorted(
        (r[0], i, v) for r in wide for i, v in enumerate(r[1:])
    )
    arrays = histogram_arrays(histogram)
    assert arrays.columns == histogram_names()
    assert arrays.count() == 1
    assert as_set(histogram_from_arrays(arrays)) == wide


def test_categories_partition_all(histogram, data):
    cells = {r[0]: r[1:] for r in as_set(histogram)}
    known = {r[0]: r for r in data}
    for w in WINDOWS:
        whole = sum(cells[f"sums_allSize_fract_read_All_{w}"])
        parts = sum(sum(cells[f"sums_allSize_fract_read_{c}_{w}"]) for c in ("sAODs", "notsAODs"))
        position = 2 + windowed(SIZE_METRICS).index(f"allSize{w}")
        at = 20 + windowed(READ_METRICS).index(f"fract_read{w}")
        untiered = sum(
            r[position] or 0.0 for r in known.values() if r[1] is None and 0 <= r[at] <= 15
        )
        assert whole == pytest.approx(parts + untiered)


def test_fractional_override_is_in_no_bin(rows, data):
    ddl = POP.replace("bigint", "double")
    pop = rows(ddl, (1, "RAW", *[1.0] * 18, *[2.5] * 6, *[2.0] * 6))
    cells = {r[0]: r[1:] for r in as_set(popularity_histogram(pop))}
    assert sum(cells["sums_allSize_fract_read_All_90"]) == 0.0
    assert cells["sums_allSize_classad_read_All_365"][2] == 1.0
