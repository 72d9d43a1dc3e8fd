import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from conftest import as_set

from tidemark.operators.rolling import rolling_popularity

READS = "d_dataset_id int, day string, fract_read double"
DAILY = "date date, dataset_id int, allOpsSize double"
START, END = date(2020, 1, 1), date(2020, 4, 30)


def day(n):
    return START + timedelta(days=n)


def key(n):
    return day(n).strftime("%Y%m%d")


def brute(reads, daily, windows):
    result = []
    for w in windows:
        live = set()
        for dataset, text, _ in reads:
            if dataset is None or text is None:
                continue
            d = date(int(text[:4]), int(text[4:6]), int(text[6:]))
            live |= {(d + timedelta(days=i), dataset) for i in range(w + 1)}
        read, total, any_read = defaultdict(float), defaultdict(float), set()
        for d, dataset, size in daily:
            if not START <= d <= END:
                continue
            total[d] += size
            if (d, dataset) in live:
                any_read.add(d)
                read[d] += size
        result += [(w, d, read[d] / total[d] if total[d] else None, total[d]) for d in any_read]
    return sorted(result, key=lambda r: r[:2])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(rows, seed):
    rng = random.Random(seed)
    reads = [
        (rng.choice([None, 1, 1, 1, 2, 3, 4, 5]), rng.choice([None, *map(key, range(-200, 130, 7))]), rng.choice([0.0, 1.0, None]))
        for _ in range(60)
    ]
    held = {(d, i) for i in range(1, 7) for d in range(-5, 130) if rng.random() < 0.6}
    daily = [(day(d), i, rng.choice([0.0, 1.0, 2.5])) for d, i in held]
    windows = (5, 30, 90)
    got = rolling_popularity(rows(READS, *reads), rows(DAILY, *daily), windows, START, END)
    assert got.columns == ["window", "date", "fraction", "size"]
    assert as_set(got) == brute(reads, daily, windows)
    for w, _, fraction, _ in as_set(got):
        assert fraction is None or 0 <= fraction <= 1


def test_edges(rows):
    daily = rows(DAILY, *[(day(n), 1, 2.0) for n in range(-1, 12)], *[(day(n), 2, 6.0) for n in range(12)])
    reads = rows(READS, (1, key(0), 1.0), (1, key(0), 0.0), (2, key(9), None), (3, key(0), 1.0))
    got = as_set(rolling_popularity(reads, daily, (3,), START, END))
    assert got == [
        *[(3, day(n), 0.25, 8.0) for n in (0, 1, 2, 3)],
        *[(3, day(n), 0.75, 8.0) for n in (9, 10, 11)],
    ]


def test_read_before_the_spine_counts(rows):
    daily = rows(DAILY, (day(0), 1, 2.0), (day(1), 1, 2.0))
    reads = rows(READS, (1, key(-5), 1.0))
    assert as_set(rolling_popularity(reads, daily, (5,), START, END)) == [(5, day(0), 1.0, 2.0)]


def test_zero_and_unknown_sizes(rows):
    daily = rows(DAILY, (day(0), 1, 0.0), (day(1), 1, None))
    reads = rows(READS, (1, key(0), 1.0))
    assert as_set(rolling_popularity(reads, daily, (5,), START, END)) == [
        (5, day(0), None, 0.0),
        (5, day(1), None, None),
    ]


def test_decimal_sizes(rows):
    daily = rows(DAILY.replace("double", "int"), (day(0), 1, 1), (day(0), 2, 3)).selectExpr(
        "date", "dataset_id", "CAST(allOpsSize AS decimal(18,2)) AS allOpsSize"
    )
    reads = rows(READS, (1, key(0), 1.0))
    assert as_set(rolling_popularity(reads, daily, (5,), START, END).select("fraction")) == [(0.25,)]
