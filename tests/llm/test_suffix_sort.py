import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import suffix_sort


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=40), st.text("ab\0", max_size=40).map(str.encode)), max_size=30), st.sampled_from([8, 16]), st.sampled_from([16, 32]))
def test_order_and_common_prefixes(strings, shallow, width):
    was, suffix_sort.SHALLOW = suffix_sort.SHALLOW, shallow
    try:
        order, common = suffix_sort.deep_shallow_sort(strings, width)
    finally:
        suffix_sort.SHALLOW = was
    padded = [s[:width].ljust(width, b"\0") for s in strings]
    got = [padded[i] for i in order]
    assert sorted(order.tolist()) == list(range(len(strings))) and got == sorted(padded)
    assert common.tolist() == [0 if not i else len(os.path.commonprefix([got[i - 1], got[i]])) for i in range(len(got))]
