"""Fixtures in plain Python, and totals taken from them without Spark."""

import contextlib
import io
import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

LINES = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_shipdate timestamp_ntz"
PARTS = "p_partkey bigint, p_brand string"


def some_lines(n, seed=0, n_parts=12):
    """Lines with nulls in every column that counts, unknown parts and repeated keys."""
    rng = random.Random(seed)

    def or_null(value):
        return None if rng.random() < 0.1 else value

    return [
        (
            rng.randrange(n // 3 + 1),
            rng.randrange(1, 4),
            # a third of all lines fall to one part
            or_null(3 if rng.random() < 1 / 3 else rng.randrange(n_parts + 4)),
            or_null(rng.choice([1, 1, 0.1, 0.125]) * rng.randrange(1, 51) // 0.001 / 1000),
            or_null(datetime(2023, 11, 1) + timedelta(seconds=rng.randrange(200 * 86400))),
        )
        for _ in range(n)
    ]


def some_parts(n_parts=12):
    return [(key, None if key == 5 else f"Brand#{key % 4}") for key in range(n_parts)]


def brute_force(lines, parts):
    brands = dict(parts)
    units, n_lines = defaultdict(list), defaultdict(int)
    for _, _, part, quantity, when in lines:
        if part not in brands:
            continue
        key = (brands[part], when and datetime(when.year, when.month, 1))
        n_lines[key] += 1
        if quantity is not None:
            units[key].append(Decimal(repr(quantity)))
    return as_sorted((*k, sum(units[k]) if units[k] else None, n) for k, n in n_lines.items())


def as_sorted(rows):
    """Rows as plain tuples in one order, decimals cut to their digits; repeats stay repeated."""

    def plain(value):
        return value.normalize() if isinstance(value, Decimal) else value

    return sorted((tuple(map(plain, row)) for row in rows), key=repr)


def rows(df):
    return as_sorted(df.collect())


def plan_of(thing):
    """What ``explain`` prints for a DataFrame (the final plan, once it has run) or a stream."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        thing.explain()
    return out.getvalue()
