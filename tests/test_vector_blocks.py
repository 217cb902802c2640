import numpy as np
import pytest

from lexspan.operators import vectors as vc


def _plain(a, skip, b, items, expired, k):
    out = []
    for i in range(len(a)):
        lengths = np.linalg.norm(b, axis=1) * np.linalg.norm(a[i])
        scores = np.round(np.divide(b @ a[i], lengths, out=np.zeros_like(lengths), where=lengths > 0), 9)
        ranked = sorted((-s, item) for s, item, gone in zip(scores, items, expired) if np.isfinite(s) and not (skip[i] and gone))
        out += [(i, item, -s) for s, item in ranked[:k]]
    return out


@pytest.mark.parametrize("strange", [False, True])
def test_blocks_keep_the_exact_top_k(monkeypatch, strange):
    monkeypatch.setattr(vc, "ROWS", 7)
    monkeypatch.setattr(vc, "STRIP", 40)
    draw = np.random.default_rng(3)
    b = draw.normal(size=(333, 8))
    b[50:200] = b[50]  # copies: ties go to the smaller item
    b[210], b[5] = 0, 3 * b[50]
    a = np.vstack([b[40:60], draw.normal(size=(9, 8)), np.zeros((1, 8))])
    if strange:
        b[300, 2] = np.nan
    items, expired, skip = draw.permutation(333), draw.random(333) < 0.4, draw.random(len(a)) < 0.5
    row, place, scores = vc.block_top_k(a, skip, b, items, expired, 10)
    assert [(r, items[p], pytest.approx(s, abs=2e-9)) for r, p, s in zip(row, place, scores)] == _plain(a, skip, b, items, expired, 10)
