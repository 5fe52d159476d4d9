import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from rowlake.llm import bytescan


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n日", max_size=30), max_size=8), st.integers(1, 40))
def test_hashes_dont_depend_on_blocks(texts, block):
    raw = [x.encode() for x in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    start, end = bytescan.spans(bytescan.NON_SPACE[data], offsets)
    want = bytescan.span_hashes(bytescan.prefix_hashes(data), start, end) if len(start) else np.zeros(0, np.uint64)
    assert (bytescan.hash_spans(data, start, end, block) == want).all()
    same = {}
    for s, e, h in zip(start, end, bytescan.hash_spans(data, start, end, block).tolist()):
        assert same.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(same.values())) == len(same)
    flags = data == ord("a")
    assert bytescan.sums(flags, offsets).tolist() == [x.count(b"a") for x in raw]


def test_memory_of_long_texts():
    """A text of many blocks, and one word of many blocks, cost a few times their bytes."""
    import tracemalloc

    for raw in (b"some words and more " * 200_000, b"x" * 4_000_000):
        data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        bytescan.words(data[:1000], np.array([0, 1000]), bytescan.ALNUM, bytescan.LOWER)
        tracemalloc.start()
        w = bytescan.words(data, offsets, bytescan.ALNUM, bytescan.LOWER)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 * len(raw) + (24 << 20) and len(w.start) in (1, 800_000)
