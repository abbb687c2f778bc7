from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelog.functions.hlc import COUNTERS, MAX_NODE_ID, HlcClock, HlcError, Stamp, decode, encode

NOW = 1_700_000_000_000


def test_base62():
    assert encode(0, 3) == "000" and encode(238327, 3) == "zzz"
    for value, width in ((238328, 3), (-1, 3), (0, 0), (0, 9)):
        with pytest.raises(HlcError):
            encode(value, width)
    with pytest.raises(HlcError, match="at 2"):
        decode("00-00")


@given(st.integers(0, 62**8 - 1))
def test_base62_round_trip(n):
    assert decode(encode(n, 8)) == n


stamps = st.builds(Stamp, st.integers(0, 62**8 - 1), st.integers(0, COUNTERS - 1), st.integers(0, MAX_NODE_ID))


@given(stamps, stamps)
def test_text_order_is_tuple_order(a, b):
    assert Stamp.parse(str(a)) == a
    assert (str(a) < str(b)) == (a < b)


@given(st.integers(NOW - 5, NOW + 5), st.integers(0, COUNTERS - 1), st.lists(st.integers(0, 9000), max_size=4))
def test_reserve_equals_single_draws(ms, counter, sizes):
    many, single = HlcClock(7, lambda: NOW, (ms, counter)), HlcClock(7, lambda: NOW, (ms, counter))
    for n in sizes:
        at, first = many.reserve(n)
        for i in range(n):
            s = single.next()
            assert (s.ms, s.counter) == (at + (first + i) // COUNTERS, (first + i) % COUNTERS)
    assert (many.ms, many.counter) == (single.ms, single.counter)


def test_first_draw_rollover_and_merge():
    clock = HlcClock(7, lambda: NOW)
    s = clock.next()
    assert (s.counter, s.node, len(str(s))) == (1, 7, 15)
    full = HlcClock(7, lambda: NOW, (NOW, COUNTERS - 1)).next()
    assert (full.ms, full.counter) == (NOW + 1, 0)
    merged = clock.merge(str(Stamp(NOW, 0, 9)))
    assert (merged.ms, merged.counter, merged.node) == (NOW, 2, 7)
    with pytest.raises(HlcError):
        clock.merge("bad!")
    assert (clock.ms, clock.counter) == (NOW, 2)
    for bad in (-1, MAX_NODE_ID + 1):
        with pytest.raises(HlcError):
            HlcClock(bad)
