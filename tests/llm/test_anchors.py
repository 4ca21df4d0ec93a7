"""Anchors are the leftmost least hash of each window, whatever batch the text is in."""

import numpy as np

from quillspark.llm import induced, substrings
from quillspark.llm.textnp import prefix_hash, span_hash


def flat(texts):
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends


def test_leftmost_least_hash():
    g = np.random.default_rng(3)
    for length in (32, 40, 75):
        texts = [bytes(g.integers(0, 3, k, np.uint8)) for k in (5, 80, 200, 0, 33)] + [b"a" * 150, b"ab" * 90]
        data, starts, ends = flat(texts)
        got = {}
        for t, place, h, first, last in zip(*(x.tolist() for x in substrings._anchors(data, starts, ends, length)), strict=True):
            for w in range(first, last + 1):
                got[t, w - int(starts[t])] = (place - int(starts[t]), h)
        total = prefix_hash(data)
        for t, x in enumerate(texts):
            for w in range(len(x) - length + 1):
                at = starts[t] + np.arange(w, w + length - substrings.ANCHOR + 1)
                h = span_hash(total, at, at + substrings.ANCHOR)
                assert got.pop((t, w)) == (w + int(h.argmin()), int(h.min()))
        assert not got


def test_which_way_names_are_sorted(monkeypatch):
    """Names of small alphabets go through the queues again; both ways give one order."""
    used = []
    double, suffixes = induced._double, induced.suffixes
    monkeypatch.setattr(induced, "_double", lambda *a: used.append("doubled") or double(*a))
    monkeypatch.setattr(induced, "suffixes", lambda *a: used.append("induced") or suffixes(*a))
    g = np.random.default_rng(5)
    text = g.integers(97, 101, 3000).astype(np.uint8)

    def order():
        used.clear()
        return np.concatenate([x[0] for x in suffixes(text, 256, 200, 50)]).tolist()

    monkeypatch.setattr(induced, "LARGE", 10**9)
    want = order()
    assert "induced" in used and "doubled" not in used
    monkeypatch.setattr(induced, "LARGE", 1)
    assert order() == want and used == ["doubled"]
    raw = text.tobytes()
    assert want == sorted(range(len(raw)), key=lambda i: raw[i:], reverse=True)
