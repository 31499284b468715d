"""What tasks hold."""

import tracemalloc

import numpy as np
import pandas as pd

from skyquarry.llm import decontamination as D


def test_decontamination_keeps_places_not_words():
    """What a task holds of the texts it looks at together: a few bytes a word, not the words."""
    class Sent:
        value = np.zeros(1 << (D.KNOWN_BITS - 3), np.uint8), np.zeros(1 << 17, np.uint8), 20, [8]

    words, held = 50 * 2000, []

    def batches():
        for i in range(51):
            held.append(tracemalloc.get_traced_memory()[0])
            yield pd.DataFrame({"digest": [str(i)], "text": [b" ".join(b"word%d" % (j % 100) for j in range(2000))]})

    tracemalloc.start()
    try:
        assert list(D._hits(Sent)(batches())) == []
    finally:
        tracemalloc.stop()
    assert words < D.TOGETHER and (held[50] - held[1]) / words < 16
