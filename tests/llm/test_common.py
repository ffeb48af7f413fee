import numpy as np
import pyarrow as pa

from sheetlark.llm import common


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate({97: 98, 98: 97})
    return text


def test_words_that_defeat_rolling_hashes_differ():
    a = thue_morse(1024)
    b = a.translate({97: 98, 98: 97})
    hashes, rows = common.word_hashes(*common.text_buffer(pa.array([f"x {a} {b} {a.upper()}", "", None, "X"])))
    assert rows.tolist() == [0, 4, 4, 4, 5] and len(set(hashes.tolist())) == 3
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] != hashes[2]


def test_hashes_depend_on_the_span_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 30_000).astype(np.uint8)
    starts = rng.integers(0, 20_000, 400)
    ends = starts + np.concatenate([rng.integers(0, 30, 390), rng.integers(4000, 9000, 10)])
    got = common.byte_hashes(data, starts, ends).tolist()
    seen = {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), got):
        assert seen.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
    again = common.byte_hashes(data[starts[0] :], starts[:1] - starts[0], ends[:1] - starts[0])
    assert again.tolist() == got[:1]
