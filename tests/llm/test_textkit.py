"""Outer punctuation of any length is dropped."""

import random

from velonet.llm import textkit as tk


def test_all_outer_marks_go():
    rng = random.Random(4)
    marks = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    words = ["word....", "****word****", "(((((a-b)))))", "é", "....é", "x", "don't", "_" * 9 + "y"]
    words += ["".join(rng.choices(marks + "aé", k=rng.randrange(1, 12))) for _ in range(500)]
    got, h = tk.plain_words([" ".join(words).encode(), b"", b"..word.."])
    plain = [w.strip(marks) for w in words] + ["word"]
    spans = [got.blob[a:b].decode() for a, b in zip(got.start, got.end)]
    assert len(spans) == len(plain)
    for w, s, p in zip([*words, "..word.."], spans, plain):
        assert s == (p or w[len(w) // 2])
    assert h[0] == h[1] == h[-1]
