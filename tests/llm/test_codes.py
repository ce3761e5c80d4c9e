"""Numbers of chunks go into a binary column and come back."""

import numpy as np
import pytest

from parley.llm import pieces


@pytest.mark.parametrize("codes", [[], [-1], [0, -1, 255, 256, 65535, 299_999, -1], list(range(-1, 9000))])
def test_codes_round_trip(codes):
    assert pieces.unpacked(pieces.packed(np.array(codes, dtype=np.int64))).tolist() == codes
